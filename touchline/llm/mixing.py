"""Mixing sources to target weights by a budget that runs down a tree.

The leaves of the tree domain - language - source hold documents; each can give its tokens ``max_epochs``
times. A budget of tokens is shared among the children of a node by their weights. A child that can't use its
share gives the rest to its siblings; a node gets no more than its leaves can give, so only what all siblings
leave over goes to the node's own siblings. A leaf's tokens are taken from seeded epochs: whole epochs first,
then of the next one, in the order of its seed, the longest run of documents from the start that fits.

DataFrame expressions only. The tree has a row per leaf. The order within an epoch is cut into ranges of its
hash, so the running sum over a leaf that holds a third of all documents is one over sums of ranges, and
then one within each range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import WORD_PATTERN, text_of

LEVELS = ("domain", "lang", "source")
#: Leading hex digits of the order hash that name a range: 4096 ranges a leaf.
RANGE_DIGITS = 3


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    given = weights.get(level, {})
    return reduce(lambda w, item: w.when(F.col(level) == item[0], item[1]), given.items(), F.when(F.lit(False), 0)).otherwise(1).cast("long")


def _shared(children: DataFrame, parent: list[str]) -> DataFrame:
    """Adds ``alloc``: each parent's ``budget`` shared among its children by ``weight``, up to ``cap``.

    Children are filled in the order of cap / weight. As long as a child's cap is below its share of what
    is left, it takes its cap; the rest take by one common rate.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), *[F.asc_nulls_first(c) for c in LEVELS if c in children.columns])
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    rated = children.withColumn("rate", (F.col("budget") - before) / onward)
    full = F.col("cap") <= F.col("rate") * F.col("weight")
    common = F.max(F.when(~full, F.col("rate"))).over(Window.partitionBy(*parent))
    return rated.withColumn("alloc", F.when(full, F.col("cap")).otherwise(F.floor(common * F.col("weight"))).cast("long")).drop("rate")


def allocate(leaves: DataFrame, budget: int, weights: dict[str, dict[str, int]], max_epochs: int) -> DataFrame:
    """``leaves`` (the levels, tokens) with ``alloc``, the tokens each is to give. Weights are whole numbers,
    1 where none is given; nodes of weight 0 are left out."""
    alive = reduce(lambda df, level: df.where(_weight(level, weights) > 0), LEVELS, leaves).withColumn("cap", F.col("tokens") * max_epochs)
    given = None
    for depth in range(1, len(LEVELS) + 1):
        own, parent = list(LEVELS[:depth]), list(LEVELS[: depth - 1])
        nodes = alive.groupBy(*own).agg(F.sum("cap").alias("cap")).withColumn("weight", _weight(own[-1], weights))
        if given is None:
            nodes = nodes.withColumn("budget", F.lit(budget).cast("long"))
        else:
            above = given.select(*[F.col(c).alias(f"__{c}") for c in parent], F.col("alloc").alias("budget"))
            same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in parent])
            nodes = nodes.join(above, same).drop(*[f"__{c}" for c in parent])
        given = _shared(nodes, parent)
    return given.select(*LEVELS, "alloc")


def mix(docs: DataFrame, domain: Column, budget_percent: int = 60, weights: dict[str, dict[str, int]] | None = None, max_epochs: int = 4, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", carry: str | None = None) -> DataFrame:
    """One row per row of ``docs``: id, domain, lang, source, n_tokens (words), alloc (of its leaf), copies
    (how often the document is taken, 0 to ``max_epochs``).

    The budget is ``budget_percent`` of the tokens of all documents. Null counts as empty text; a
    null domain, language or source is a value of its own. Documents without tokens go where the order puts
    them, as they fit everywhere. Equal order hashes (rows with one id) are taken or left together. An empty
    table gives an empty result; columns but lang, source, the id and the text matter only to ``domain``.
    ``carry`` names a further column, a struct of the row's own columns.
    """
    weights = weights or {}
    rows = docs.select(F.col(id_col).alias("id"), domain.alias("domain"), "lang", "source", F.regexp_count(text_of(text_col), F.lit(WORD_PATTERN)).cast("long").alias("n_tokens"), *([F.struct(*docs.columns).alias(carry)] if carry else []))
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    given = allocate(leaves, total * budget_percent // 100, weights, max_epochs)
    plan = leaves.select(*[F.col(c).alias(f"__{c}") for c in LEVELS], "tokens").join(given, reduce(lambda a, b: a & b, [F.col(f"__{c}").eqNullSafe(F.col(c)) for c in LEVELS]), "left").select(*[f"__{c}" for c in LEVELS], "tokens", F.coalesce("alloc", F.lit(0)).alias("alloc"))
    epochs = F.when(F.col("tokens") > 0, F.floor(F.col("alloc") / F.col("tokens"))).otherwise(0).cast("long")
    plan = plan.withColumns({"epochs": epochs, "rest": F.col("alloc") - epochs * F.col("tokens")})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in LEVELS])
    ordered = rows.join(plan, same).withColumn("h", F.md5(F.concat_ws(":", F.lit(seed), F.col("epochs") + 1, F.coalesce("id", F.lit(-1)))))
    ordered = ordered.withColumn("range", F.substring("h", 1, RANGE_DIGITS))
    sums = ordered.groupBy(*LEVELS, "range").agg(F.sum("n_tokens").alias("s"))
    starts = sums.select(*[F.col(c).alias(f"_s_{c}") for c in LEVELS], F.col("range").alias("_s_range"), F.coalesce(F.sum("s").over(Window.partitionBy(*LEVELS).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    at = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in LEVELS]) & (F.col("range") == F.col("_s_range"))
    upto = F.col("start") + F.sum("n_tokens").over(Window.partitionBy(*LEVELS, "range").orderBy("h").rangeBetween(Window.unboundedPreceding, 0))
    copies = F.col("epochs") + F.when((F.col("rest") > 0) & (upto <= F.col("rest")), 1).otherwise(0)
    return ordered.join(starts, at).select(F.col("id").alias(id_col), *LEVELS, "n_tokens", "alloc", copies.cast("long").alias("copies"), *([carry] if carry else []))


def taken(docs: DataFrame, domain: Column, budget_percent: int = 60, weights: dict[str, dict[str, int]] | None = None, max_epochs: int = 4, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, each as often as ``mix`` takes it. No join by id: rows without an id,
    or with one id, stand for themselves."""
    mixed = mix(docs, domain, budget_percent, weights, max_epochs, seed, id_col, text_col, carry="__row").where("copies > 0")
    return mixed.select("__row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("__row.*")
