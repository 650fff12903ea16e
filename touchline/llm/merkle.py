"""A manifest of a dataset: a Merkle tree over its rows, with a proof for each row.

Rows are leaves. The leaves of a language, in ascending order of id, are the bottom of its tree; the roots of the
languages, null first and then bytewise, are the bottom of the tree whose root stands for the dataset. A node is the
hash of its two children, the last of a level of its one child if the level is odd.

The trees are climbed by supersteps over RDDs. A vertex is (tree, level, index). In a superstep each node sends its
digest to the ancestor that stands ``STRIDE`` levels above it; an ancestor that has all its descendants hashes what
lies between and forwards its own digest in the next superstep. Then the supersteps go back: each node that knows
the siblings on its way to the root sends them to the vertices below, which put their own siblings before them, down
to the leaves. A message's key is (tree, block of nodes below one ancestor), so a language that has most of the rows
is spread over all tasks, and a task holds one block of at most 2^STRIDE digests at a time. What each upward
superstep has is written to the shared folder, from where the reverse one rereads it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial
from hashlib import sha256
from itertools import groupby

from pyspark import RDD
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import shuffle_partitions, stored

#: Columns of a row that its leaf covers.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels that one superstep climbs.
STRIDE = 10
#: Rows of the table of where each part of a tree begins up to which it is broadcast.
BROADCAST_PARTS = 100_000
#: The tree whose leaves are the roots of the other trees; no language is named so, as theirs begin with "=".
TOP = "^"


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(**changed: Column) -> Column:
    """The digest of a row: sha256 over ``FIELDS``, each as its UTF-8 byte count, a colon and its value, or "-" for null."""
    return F.sha2(F.concat(*[_field(changed.get(c, F.col(c))) for c in FIELDS]), 256)


def _joined(digests: Iterable[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def _levels(nodes: list[str], height: int) -> list[list[str]]:
    """``nodes`` and the ``height`` levels above them."""
    out = [nodes]
    for _ in range(height):
        nodes = [_joined(nodes[k : k + 2]) for k in range(0, len(nodes), 2)]
        out.append(nodes)
    return out


def _way(levels: list[list[str]], at: int) -> list[tuple[str | None, bool]]:
    """For each level below the top: the sibling of the node that node ``at`` of the lowest level comes up by, None
    without one, and whether it stands to the left."""
    out = []
    for level in levels[:-1]:
        out.append((level[at ^ 1] if at ^ 1 < len(level) else None, bool(at & 1)))
        at >>= 1
    return out


def fold(leaf: str, way: Iterable[tuple[str | None, bool]]) -> str:
    """The root that follows from a leaf's digest and its siblings."""
    for sibling, left in way:
        leaf = _joined([leaf] if sibling is None else [sibling, leaf] if left else [leaf, sibling])
    return leaf


def _task(key: tuple) -> int:
    """The task of a vertex: that of its tree and block."""
    return zlib.crc32(f"{key[0]}/{key[1]}".encode())


def _height(n: Column) -> Column:
    """Levels above n leaves until one node is left."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


def _placed(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` (tree and others), stored, with idx, the place within the tree in ``order``, and height of the tree.

    A sort by ranges, so that no tree is in one task; then the rows of each tree in each range are counted.
    """
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(shuffle_partitions(spark), "tree", *order).sortWithinPartitions("tree", *order)
    ordered = stored(ranged.withColumns({"part": F.spark_partition_id(), "seq": F.monotonically_increasing_id()}), name)
    counted = ordered.groupBy("tree", "part").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("n"))
    of = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(of.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = stored(counted.select("tree", "part", (before - F.col("first")).alias("shift"), _height(F.sum("n").over(of)).alias("height")), name + "-starts")
    if starts.count() <= BROADCAST_PARTS:
        starts = F.broadcast(starts)
    return ordered.join(starts, ["tree", "part"]).withColumn("idx", F.col("seq") + F.col("shift")).drop("part", "seq", "shift")


@dataclass
class Climbed:
    """``levels``: what each superstep begins with (tree, idx, height left to climb, digest, and payload at the leaves);
    ``roots``: tree, height, digest."""

    levels: list[DataFrame]
    roots: DataFrame


def _hashed(stride: int, messages: Iterator[tuple]) -> Iterator[tuple]:
    """Of messages (tree, block, idx), (height, digest), sorted: each block's ancestor."""
    for (tree, block), own in groupby(messages, key=lambda m: m[0][:2]):
        own = [value for _, value in own]
        height = own[0][0]
        rise = min(stride, height)
        yield tree, block, height - rise, _levels([digest for _, digest in own], rise)[-1][0]


def climb(leaves: DataFrame, stride: int = STRIDE) -> Climbed:
    """Supersteps up from ``leaves`` (tree, idx, height, digest) until every tree has its root."""
    spark, tasks = leaves.sparkSession, shuffle_partitions(leaves.sparkSession)
    levels, tallest = [leaves], leaves.agg(F.max("height")).first()[0] or 0
    for k in range(-(-tallest // stride)):
        sent = levels[-1].where("height > 0").select("tree", "idx", "height", "digest").rdd.map(lambda r: ((r.tree, r.idx >> stride, r.idx), (r.height, r.digest)))
        above = sent.repartitionAndSortWithinPartitions(tasks, _task).mapPartitions(partial(_hashed, stride))
        levels.append(stored(spark.createDataFrame(above, "tree string, idx bigint, height int, digest string", verifySchema=False), f"merkle-level{k}"))
    tops = [level.where("height = 0").select("tree", F.lit(k).alias("steps"), "digest") for k, level in enumerate(levels)]
    roots = tops[0]
    for more in tops[1:]:
        roots = roots.union(more)
    return Climbed(levels, stored(roots, "merkle-roots"))


def _sent_down(stride: int, messages: Iterator[tuple]) -> Iterator[tuple]:
    """Of messages (tree, block, idx), sorted, first what the ancestor of a block knows, (whatever it passes on, way), then
    the block's (height, digest, payload): for each node tree, idx, digest, payload, what is passed on, and its own way."""
    for (tree, _), own in groupby(messages, key=lambda m: m[0][:2]):
        passed, way = next(own)[1]
        own = [(idx, *value) for (_, _, idx), value in own]
        levels = _levels([digest for _, _, digest, _ in own], min(stride, own[0][1]))
        for at, (idx, _, digest, payload) in enumerate(own):
            yield tree, idx, digest, payload, passed, _way(levels, at) + way


def descend(climbed: Climbed, roots: RDD, payload: list[str], stride: int = STRIDE) -> RDD:
    """Supersteps down from ``roots``: (tree, steps climbed, what is passed on, way from the tree's root onward). For each
    leaf tree, idx, digest, its ``payload`` columns, what was passed on, and its siblings on the whole way."""
    tasks, found = shuffle_partitions(climbed.roots.sparkSession), None
    for k in reversed(range(max(1, len(climbed.levels) - 1))):
        begin = roots.filter(lambda r, k=k: max(r[1] - 1, 0) == k).map(lambda r: ((r[0], 0, -1), (r[2], r[3])))
        if found is not None:
            begin = begin.union(found.map(lambda v: ((v[0], v[1], -1), (v[4], v[5]))))
        own = payload if k == 0 else []
        level = climbed.levels[k] if k == 0 else climbed.levels[k].where("height > 0")
        nodes = level.select("tree", "idx", "height", "digest", *own).rdd.map(lambda r: ((r[0], r[1] >> stride, r[1]), (r[2], r[3], tuple(r[4:]))))
        found = begin.union(nodes).repartitionAndSortWithinPartitions(tasks, _task).mapPartitions(partial(_sent_down, stride))
    return found


def prove(docs: DataFrame, suspect: Column | None = None, with_way: bool = True, id_col: str = "doc_id", group_col: str = "lang", stride: int = STRIDE) -> DataFrame:
    """One row per row of ``docs``: id, leaf, subroot (of its language), root, proof_sha256 (over the siblings' digests
    from the leaf upward), folded_root (from the leaf and its siblings), verified (whether that is the root), and with
    ``with_way`` the siblings themselves: way, an array of (sibling, null where a node is hashed alone; left).

    ``suspect``: a digest, over columns of ``docs``, that takes the leaf's place in the verification; null stands for
    the leaf itself. Null fields are part of a leaf as "-"; a null language is a group of its own; null ids come first.
    Rows of one id are ordered by their digests; repeated rows are leaves of their own. An empty table gives an empty
    result. Texts are hashed whole; other columns than ``FIELDS`` are ignored.
    """
    spark = docs.sparkSession
    changed = F.lit(None).cast("string") if suspect is None else suspect
    tree = F.coalesce(F.concat(F.lit("="), F.col(group_col)), F.lit("-"))
    leaves = stored(docs.select(tree.alias("tree"), F.col(id_col).alias("id"), leaf_hash().alias("digest"), changed.alias("suspect"), F.monotonically_increasing_id().alias("row")), "merkle-leaves")
    placed = _placed(leaves, [F.col("id").asc_nulls_first(), F.col("digest"), F.col("row")], "merkle-ordered").drop("row")
    trees = climb(placed, stride)
    named = trees.roots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("name"), "steps", "digest")
    top = climb(_placed(named, [F.col("name")], "merkle-top"), stride)
    whole = top.roots.rdd.map(lambda r: (r.tree, r.steps, r.digest, []))
    below = descend(top, whole, ["name", "steps"], stride).map(lambda v: (v[3][0], v[3][1], (v[2], v[4]), v[5]))

    def row(v: tuple) -> tuple:
        _, _, leaf, (own_id, now), (subroot, root), way = v
        folded = fold(now or leaf, way)
        return own_id, leaf, subroot, root, _joined(x for x, _ in way if x is not None), folded, folded == root, *([way] if with_way else [])

    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return spark.createDataFrame(descend(trees, below, ["id", "suspect"], stride).map(row), schema + ", way array<struct<sibling:string,left:boolean>>" * with_way, verifySchema=False)
