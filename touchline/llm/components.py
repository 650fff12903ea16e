"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import stored


def _with_least(edges: DataFrame) -> DataFrame:
    """Adds m, the least of u and all its v. Aggregated before the shuffle; the join can be split where one
    node has very many neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("w")).select(F.col("u").alias("__u"), F.least("u", "w").alias("m"))
    return edges.join(least, F.col("u") == F.col("__u")).drop("__u")


def large_star(edges: DataFrame) -> DataFrame:
    """Links each greater neighbour of a node to the least of the node's neighbourhood."""
    both = edges.union(edges.select("v", "u"))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Links each node and its lesser neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    starred = _with_least(down)
    return starred.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """Of ``edges`` (u, v), one row per node that has an edge to another: id, component (its least node).

    Both steps are repeated, each round written to the shared folder, until all links are stars: no node has two links
    to lesser ones, and none with such a link is the lesser one of another.
    """
    edges = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")

    def are_stars(df: DataFrame) -> bool:
        ends = df.select(F.inline(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))))
        nodes = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        return not nodes.agg(F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()[0]

    while not are_stars(edges):
        edges = stored(small_star(large_star(edges)), "links")
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
