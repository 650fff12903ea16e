"""Shards of nearly equal bytes that are cells of a k-d tree over the documents' metadata.

A node of the tree that is to become k shards is cut along its widest dimension, at the place where the bytes
below are floor(k / 2) of k parts: a weighted median. The upper levels are searched by histograms, all nodes of a
level at once: of the keys that may still hold a cut, Spark sums the bytes in 1024 ranges, and the range in which
the sum is reached is the next to be looked at, until it holds one key. Rows don't move meanwhile: a row's node
follows from its own columns and the cuts so far. Below ``TOP_LEAVES`` nodes, a running sum within each node of the
top finds the cuts, so that the driver never holds more than that many nodes.

Dimensions are laid out on 31 bits between their least and largest value; a text dimension counts by the bytes
after what all its values begin with. Ties within a dimension, such as a source that holds a third of all rows, are
told apart by 32 hashed bits. DataFrame expressions only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import shuffle_partitions, stored, text_of

DIMENSIONS = ("source", "lang", "n_chars", "doc_id")
#: What a document takes beyond its text, bytes.
OVERHEAD = 8
COORDINATE_BITS, TIE_BITS = 31, 32
#: Ranges of a histogram, and nodes that are cut by histograms.
RANGES, TOP_LEAVES = 1024, 1024
#: Rows of a shard that are numbered in one window, and the least number of such windows as a power of two.
NUMBERED_TOGETHER, LEAST_PARTS = 1 << 17, 6


@dataclass
class Node:
    """Shards ``first`` to ``first + shards - 1``; cut at ``key`` of the dimension ``dim`` if it has more than one."""

    first: int
    shards: int
    dim: int | None = None
    key: int = 0
    left: Node | None = None
    right: Node | None = None


def _coordinates(docs: DataFrame, dimensions: tuple[str, ...]) -> list[Column]:
    """Each dimension as a long of ``COORDINATE_BITS`` bits, 0 for null, from one aggregation over ``docs``."""
    kinds = dict(docs.dtypes)
    ends = docs.agg(*[f(F.col(f"`{d}`")).alias(f"{f.__name__}{k}") for k, d in enumerate(dimensions) for f in (F.min, F.max)]).first()
    out = []
    for k, d in enumerate(dimensions):
        low, high = ends[f"min{k}"], ends[f"max{k}"]
        if low is None:
            out.append(F.lit(0).cast("long"))
            continue
        if kinds[d] == "string":
            a, b = low.encode(), high.encode()
            same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            width = 6

            def number(raw: bytes) -> int:
                return int.from_bytes(raw[same : same + width].ljust(width, b"\0"), "big")

            piece = F.rpad(F.hex(F.substring(F.encode(F.col(f"`{d}`"), "UTF-8"), same + 1, width)), 2 * width, "0")
            value, first, last = F.conv(piece, 16, 10).cast("double"), float(number(a)), float(number(b))
        else:
            value, first, last = F.col(f"`{d}`").cast("double"), float(low), float(high)
        span = max(last - first, 1e-300)
        scaled = F.floor((value - first) / span * ((1 << COORDINATE_BITS) - 2)).cast("long")
        out.append(F.coalesce(F.least(scaled, F.lit((1 << COORDINATE_BITS) - 2)) + 1, F.lit(0)).cast("long"))
    return out


def _leaves(node: Node) -> list[Node]:
    return [node] if node.dim is None else _leaves(node.left) + _leaves(node.right)


def _at(node: Node, value: Callable[[Node], int]) -> Column:
    """``value`` of the leaf that the row is in."""
    if node.dim is None:
        return F.lit(value(node))
    return F.when(F.col(f"__k{node.dim}") >= node.key, _at(node.right, value)).otherwise(_at(node.left, value))


def _listed(values: list[int], at: Column) -> Column:
    return F.get(F.from_json(F.lit(str(values)), "array<bigint>"), at)


def grow(rows: DataFrame, shards: int, n_dims: int, top_leaves: int = TOP_LEAVES) -> Node:
    """The tree over ``rows`` (``__k0`` and so on, below 2^63; size) down to ``shards`` or ``top_leaves`` leaves.

    The driver gets two rows for each node of a level and each round of its search.
    """
    root = Node(0, shards)
    while (n_leaves := len(_leaves(root))) < top_leaves and any(leaf.shards > 1 for leaf in _leaves(root)):
        leaves = [leaf for leaf in _leaves(root) if leaf.shards > 1][: top_leaves - n_leaves]
        place = {leaf.first: k for k, leaf in enumerate(leaves)}
        node = _at(root, lambda leaf: place.get(leaf.first, -1))
        at = rows.withColumn("__node", node).where("__node >= 0")
        ends = [f(f"__k{d}").alias(f"{f.__name__}{d}") for d in range(n_dims) for f in (F.min, F.max)]
        found = {r["__node"]: r for r in at.groupBy("__node").agg(F.sum("size").alias("bytes"), *ends).collect()}
        dims, low, high, below, goal = ([0] * len(leaves) for _ in range(5))
        searched = set(found)
        for k, r in found.items():
            wide = [(r[f"max{d}"] >> TIE_BITS) - (r[f"min{d}"] >> TIE_BITS) for d in range(n_dims)]
            dims[k] = wide.index(max(wide))
            low[k], high[k] = r[f"min{dims[k]}"], r[f"max{dims[k]}"]
            goal[k] = r.bytes * (leaves[k].shards // 2) // leaves[k].shards
        cuts = [0] * len(leaves)
        while searched:
            low = [x if k in searched else 1 for k, x in enumerate(low)]
            high = [x if k in searched else 0 for k, x in enumerate(high)]
            of = F.col("__node")
            key = F.get(F.array(*[F.col(f"__k{d}") for d in range(n_dims)]), _listed(dims, of).cast("int"))
            steps = [max(0, b - a) // RANGES + 1 for a, b in zip(low, high)]
            near = at.withColumn("key", key).where(F.col("key").between(_listed(low, of), _listed(high, of))).withColumns({"low": _listed(low, of), "step": _listed(steps, of)})
            sums = near.groupBy("__node", F.expr("(key - low) div step").alias("range")).agg(F.sum("size").alias("bytes"), F.min("key").alias("low"), F.max("key").alias("high"))
            upto = F.sum("bytes").over(Window.partitionBy("__node").orderBy("range")) + _listed(below, of)
            reached = sums.withColumn("upto", upto).where(F.col("upto") >= _listed(goal, of))
            for r in reached.groupBy("__node").agg(F.min_by(F.struct("upto", "bytes", "low", "high"), "range").alias("r")).collect():
                k, r = r["__node"], r.r
                low[k], high[k], below[k] = r.low, r.high, r.upto - r.bytes
                if r.low == r.high:
                    # One key is left: it goes to the side that comes nearer to the goal.
                    cuts[k] = r.low if 2 * goal[k] < r.upto + below[k] else r.low + 1
                    searched.discard(k)
        for k, leaf in enumerate(leaves):
            half = leaf.shards // 2
            leaf.left, leaf.right = Node(leaf.first, half), Node(leaf.first + half, leaf.shards - half)
            leaf.dim, leaf.key = dims[k], cuts[k]
    return root


def _deepened(placed: DataFrame, most: int, n_dims: int) -> DataFrame:
    """``placed`` (__top, __first, __shards) with nodes of several shards cut down to one, by running sums within
    the nodes of the top."""
    placed = placed.repartition("__top")
    for _ in range((most - 1).bit_length()):
        of = Window.partitionBy("__top", "__first")
        spread = [F.shiftright(F.max(f"__k{d}").over(of), TIE_BITS) - F.shiftright(F.min(f"__k{d}").over(of), TIE_BITS) for d in range(n_dims)]
        wide = placed.withColumns({f"__w{d}": w for d, w in enumerate(spread)} | {"__bytes": F.sum("size").over(of)})
        widest = F.greatest(*[f"__w{d}" for d in range(n_dims)]) if n_dims > 1 else F.col("__w0")
        wide = wide.withColumn("__key", F.coalesce(*[F.when(F.col(f"__w{d}") == widest, F.col(f"__k{d}")) for d in range(n_dims)]))
        wide = wide.withColumn("__upto", F.sum("size").over(of.orderBy("__key").rowsBetween(Window.unboundedPreceding, 0)))
        right = F.expr("(2 * __upto - size) > 2 * (__bytes * (__shards div 2) div __shards)")
        half = F.expr("__shards div 2")
        placed = wide.withColumns({"__first": F.when(right, F.col("__first") + half).otherwise(F.col("__first")), "__shards": F.when(right, F.col("__shards") - half).otherwise(half)}).drop("__key", "__upto", "__bytes", *[f"__w{d}" for d in range(n_dims)])
    return placed


def _keyed(docs: DataFrame, dimensions: tuple[str, ...], id_col: str, text_col: str, keep: list[Column]) -> DataFrame:
    """A stored row per row of ``docs``: what ``keep`` names, size, text_crc32, __row, and a key for each dimension."""
    text = text_of(text_col)
    given = docs.select(*keep, (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.monotonically_increasing_id().alias("__row"), F.col(f"`{id_col}`").alias("__id"), *[c.alias(f"__c{k}") for k, c in enumerate(_coordinates(docs, dimensions))])
    tie = F.shiftrightunsigned(F.xxhash64("__id", "text_crc32", "__row"), 64 - TIE_BITS)
    keys = [(F.shiftleft(F.col(f"__c{k}"), TIE_BITS) + tie).alias(f"__k{k}") for k in range(len(dimensions))]
    return stored(given.select(*[c for c in given.columns if not c.startswith("__c") and c != "__id"], tie.alias("__tie"), *keys), "shard-keys")


def _sharded(rows: DataFrame, shards: int | None, target_bytes: int | None, n_dims: int, top_leaves: int = TOP_LEAVES) -> DataFrame:
    """``rows`` with law, shard and slot. Slots are counted within ranges of the hash, and ranges added up."""
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    if shards is None:
        shards = max(1, -(-total // target_bytes))
    root = grow(rows, shards, n_dims, top_leaves)
    placed = rows.withColumn("shard", _at(root, lambda leaf: leaf.first))
    most = max(leaf.shards for leaf in _leaves(root))
    if most > 1:
        wide = placed.withColumns({"__top": F.col("shard"), "__first": F.col("shard").cast("long"), "__shards": _at(root, lambda leaf: leaf.shards).cast("long")})
        placed = _deepened(wide, most, n_dims).withColumn("shard", F.col("__first").cast("int"))
    bits = min(TIE_BITS, max(LEAST_PARTS, (n // shards // NUMBERED_TOGETHER).bit_length()))
    placed = placed.withColumn("__part", F.shiftrightunsigned("__tie", TIE_BITS - bits).cast("int"))
    sums = placed.groupBy("shard", "__part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(F.col("shard").alias("__s"), F.col("__part").alias("__p"), before.alias("__start"))
    place = F.row_number().over(Window.partitionBy("shard", "__part").orderBy("__tie", "__row")) - 1
    numbered = placed.withColumn("__place", place)
    slotted = numbered.join(starts, (F.col("shard") == F.col("__s")) & (F.col("__part") == F.col("__p")))
    return slotted.withColumns({"law": F.lit("bytes"), "slot": (F.col("__start") + F.col("__place")).cast("long")})


def assign_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, dimensions: tuple[str, ...] = DIMENSIONS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, size (UTF-8 bytes of the text and ``OVERHEAD``), text_crc32, law ("bytes"),
    shard, slot (place within the shard, from 0).

    There are ``shards`` shards, or as many as ``target_bytes`` each ask for. A null text counts as empty; a null in
    a dimension lies below all values. Repeated rows are rows of their own and may go to different shards. Shards'
    bytes differ by no more than documents do that lie at a cut: a very long text is not divided. With fewer
    documents than shards, some shards are empty; an empty table gives an empty result. Other columns are ignored.
    Equal texts are not held together, as a text that fills a third of a table would fill eight shards of 24.
    """
    if (shards is None) == (target_bytes is None):
        raise ValueError("give shards or target_bytes")
    rows = _keyed(docs, dimensions, id_col, text_col, [F.col(f"`{id_col}`").alias(id_col)])
    return _sharded(rows, shards, target_bytes, len(dimensions)).select(id_col, "size", "text_crc32", "law", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int | None = None, target_bytes: int | None = None, dimensions: tuple[str, ...] = DIMENSIONS, id_col: str = "doc_id", text_col: str = "text", files_per_shard: int = 4) -> DataFrame:
    """Writes doc (a struct of all columns of a row of ``docs``) and slot as Parquet under ``path``/shard=N and reads
    them back. Rows, nulls and ties as in ``assign_shards``.

    Each shard is written by ``files_per_shard`` tasks, each of which takes a range of its slots.
    """
    if (shards is None) == (target_bytes is None):
        raise ValueError("give shards or target_bytes")
    whole = _keyed(docs, dimensions, id_col, text_col, [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc")])
    placed = stored(_sharded(whole.drop("__doc"), shards, target_bytes, len(dimensions)).select(F.col("__row").alias("__r"), "shard", "slot"), "shard-slots")
    n = placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    part = placed.join(n, "shard").select("__r", "shard", "slot", F.expr(f"slot * {files_per_shard} div n").alias("file"))
    out = whole.select("__row", "__doc").join(part, F.col("__row") == F.col("__r")).select(F.struct("__doc.*").alias("doc"), "shard", "slot", "file")
    out.repartition(shuffle_partitions(docs.sparkSession), "shard", "file").sortWithinPartitions("shard", "slot").select("doc", "slot", "shard").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.parquet(path)
