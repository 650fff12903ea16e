"""Deduplication of lines by overlapping windows of three.

Every three consecutive lines of a document are hashed to 128 bits. A window is repeated when the same
hash starts earlier: in a smaller id, or in the same document at an earlier line. The repeated windows of
a document are merged into covered line positions, and those lines go.

DataFrame expressions only. A window that occurs millions of times is one partial row per task before the
shuffle; the join that hands each later occurrence its verdict is one that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import text_of

WINDOW = 3


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Starts of the repeated windows: id, text_key, starts (array of line numbers from 0)."""
    hashed = (
        docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
        .select("id", F.xxhash64("text").alias("text_key"), F.transform(F.split("text", "\n"), lambda x: F.struct(F.xxhash64(F.lit(0), x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"))).alias("lines"))
        .where(F.size("lines") >= window)
    )
    windows = hashed.select(
        "id",
        "text_key",
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0), F.size("lines") - window),
                lambda i: F.struct(
                    F.xxhash64(*[F.get("lines", i + k)["a"] for k in range(window)]).alias("a"),
                    F.xxhash64(*[F.get("lines", i + k)["b"] for k in range(window)]).alias("b"),
                ),
            )
        ).alias("start", "w"),
    ).select("id", "text_key", "start", "w.a", "w.b")
    first = (
        windows.groupBy("a", "b")
        .agg(F.min(F.struct("id", "text_key", "start")).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select(F.col("a").alias("fa"), F.col("b").alias("fb"), "first")
    )
    later = windows.join(first, (F.col("a") == F.col("fa")) & (F.col("b") == F.col("fb"))).where(
        ~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("text_key") == F.col("first.text_key")) & (F.col("start") == F.col("first.start")))
    )
    return later.groupBy("id", "text_key").agg(F.sort_array(F.collect_set("start")).alias("starts"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: id, n_lines, n_removed, text (the lines that stay, joined by newlines).

    Lines are what newlines separate, compared unchanged, blank ones included; null counts as empty text,
    which is one empty line. A document of fewer than three lines has no window and stays whole. Every line
    that a repeated window covers goes, also where the earlier window overlaps it. Rows that repeat both id
    and text are one document given twice and get the same result; with one id on different texts, the
    order between those texts is that of their hashes. A null id sorts first. An empty table gives an
    empty result; other columns of ``docs`` are ignored.
    """
    found = repeated_windows(docs, id_col, text_col, window).select(F.col("id").alias("__id"), F.col("text_key").alias("__key"), "starts")
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).withColumn("text_key", F.xxhash64("text"))
    joined = rows.join(found, F.col("id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key")), "left")
    # Columns of their own: within the lambda below they would be computed again for each line.
    split = joined.withColumns(
        {
            "lines": F.split("text", "\n"),
            # A set first, so that a text of very many lines is not searched once for each of them.
            "covered": F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + (window - 1))))),
        }
    )
    kept_at = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "covered")
    whole = F.col("starts").isNull()
    return split.select(
        F.col("id").alias(id_col),
        F.size("lines").cast("long").alias("n_lines"),
        F.when(whole, F.lit(0)).otherwise(F.size("covered")).cast("long").alias("n_removed"),
        F.when(whole, F.col("text")).otherwise(F.array_join(F.transform(kept_at, lambda i: F.get("lines", i)), "\n")).alias("text"),
    )
