"""Exact deduplication over an extendible-hash index in shared files.

Texts are keyed by a 64-bit hash. A directory maps the leading bits of a hash to a bucket: it starts with
one bucket and doubles whenever a bucket holds more keys than its capacity, so that buckets stay even
whatever the hashes look like. Equal texts meet inside their bucket, where Spark's aggregation compares
whole byte strings: texts whose hashes collide form a chain of several index entries under one key. The
finished entries are written to the shared folder in order of their keys, one range of buckets per owner
task. Every document then finds the bucket of its key in the directory and looks there for its entry, among
those with its key for the one with its text.

Everything is DataFrame expressions. Copies collapse in the map-side part of the aggregation, so one text
that holds a third of all rows costs no more in the shuffle than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import shuffle_partitions, stored, text_of

#: Keys a bucket may hold before it is split, and the depth at which the directory stops doubling.
BUCKET_CAPACITY = 4096
MAX_DEPTH = 16


def grow_directory(cells: dict[int, int], depth: int, capacity: int) -> tuple[int, list[int]]:
    """Directory for ``cells`` (leading ``depth`` bits -> number of keys).

    Returns the global depth and, for each of its 2^depth slots, the first slot of the bucket it belongs
    to. Doubling: as long as some bucket is overfull and bits are left, its local depth grows by one and
    the directory doubles if the bucket was as deep as the directory.
    """
    totals = [[0] * (1 << d) for d in range(depth + 1)]
    for cell, n in cells.items():
        for d in range(depth + 1):
            totals[d][cell >> (depth - d)] += n
    local, todo = {}, [(0, 0)]
    while todo:
        d, prefix = todo.pop()
        if totals[d][prefix] > capacity and d < depth:
            todo += [(d + 1, 2 * prefix), (d + 1, 2 * prefix + 1)]
        else:
            local[(d, prefix)] = totals[d][prefix]
    deepest = max(d for d, _ in local)
    slots = [0] * (1 << deepest)
    for d, prefix in local:
        first = prefix << (deepest - d)
        for slot in range(first, first + (1 << (deepest - d))):
            slots[slot] = first
    return deepest, slots


def _leading(h: Column, bits: int) -> Column:
    return F.shiftrightunsigned(h, 64 - bits).cast("int") if bits else F.lit(0)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = BUCKET_CAPACITY) -> tuple[DataFrame, DataFrame]:
    """Index of the texts of ``docs``.

    Returns (entries, index). ``entries`` has a row per document: id, bucket, key (the 64-bit hash), text_sha256.
    ``index`` has a row per different text: bucket, key, text_sha256, keep_id (the largest id), group_size.
    A null text counts as empty. The directory has at most 2^16 slots; beyond 2^16 x capacity keys the
    buckets grow instead, which Spark's aggregation spills.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).withColumn("key", F.xxhash64("text"))
    cells = rows.select("key").groupBy("key").agg(F.count(F.lit(1)).alias("n")).groupBy(_leading(F.col("key"), MAX_DEPTH).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    # At most 2^16 rows, whatever the size of the input.
    depth, slots = grow_directory({r.cell: r.n for r in cells.collect()}, MAX_DEPTH, capacity)
    bucket = F.get(F.from_json(F.lit(str(slots)), "array<int>"), _leading(F.col("key"), depth))
    per_text = (
        rows.withColumn("bucket", bucket)
        .groupBy("bucket", "key", "text")
        .agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("bucket", "key", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    owners = min(max(1, len(set(slots))), shuffle_partitions(spark))
    index = stored(per_text.repartitionByRange(owners, "bucket", "key").sortWithinPartitions("bucket", "key"), "exact-index")
    entries = rows.select("id", bucket.alias("bucket"), "key", F.sha2("text", 256).alias("text_sha256"))
    return entries, index


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = BUCKET_CAPACITY) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; null counts as empty. Of equal texts the largest id stays. Rows
    that repeat both id and text are one document given twice: they share their verdict. A null id never
    stays while another copy has an id; if no copy has one, keep_id is null and the rows are kept. An
    empty table gives an empty result; other columns of ``docs`` are ignored.
    """
    entries, index = build_index(docs, id_col, text_col, capacity)
    groups = index.where("group_size > 1").select(F.col("bucket").alias("b"), F.col("key").alias("k"), F.col("text_sha256").alias("s"), "keep_id", "group_size")
    found = entries.join(groups, (F.col("bucket") == F.col("b")) & (F.col("key") == F.col("k")) & (F.col("text_sha256") == F.col("s")), "left")
    single = F.col("group_size").isNull()
    keep = F.when(single, F.col("id")).otherwise(F.col("keep_id"))
    return found.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def _unused(docs: DataFrame, name: str) -> str:
    """``name``, made longer until no column has it."""
    while name in docs.columns:
        name += "_"
    return name


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text is also that of a row with a larger id; all columns stay."""
    i, h = _unused(docs, "__id"), _unused(docs, "__sha")
    gone = exact_duplicates(docs, id_col, text_col).where("not kept").select(F.col(id_col).alias(i), F.col("text_sha256").alias(h)).distinct()
    same = F.col(id_col).eqNullSafe(F.col(i)) & (F.sha2(text_of(text_col), 256) == F.col(h))
    return docs.join(gone, same, "left_anti")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each text, the one with the largest id, then with the largest other columns; null
    counts as empty text. All columns stay.

    Only rows whose text is given more than once are shuffled. Copies collapse in the map-side part of the
    aggregation.
    """
    h, n, whole = _unused(docs, "__sha"), _unused(docs, "__n"), _unused(docs, "__row")
    keyed = docs.withColumn(h, F.sha2(text_of(text_col), 256))
    again = keyed.groupBy(h).agg(F.count(F.lit(1)).alias(n)).where(F.col(n) > 1).select(h)
    again = stored(again, "repeated-texts")
    largest = F.max(F.struct(id_col, *[c for c in docs.columns if c not in (id_col, text_col)], text_col)).alias(whole)
    chosen = keyed.join(again, h, "left_semi").groupBy(h).agg(largest).select(f"{whole}.*").select(*docs.columns)
    return keyed.join(again, h, "left_anti").select(*docs.columns).unionByName(chosen)
