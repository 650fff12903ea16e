"""Near-duplicate documents by MinHash.

1. Each document's set of five-word shingles gets 128 minima under universal hashes and a digest of the whole
   set. Documents with equal sets form one class, represented by its smallest id.
2. The minima are cut into 32 bands of 4. Two sets of similarity 0.75 agree in some band with a probability
   of more than 0.99999.
3. In each bucket of a band, every class is paired with the bucket's smallest. Pairs are checked by their
   signatures, then confirmed on the full sets, and linked classes merged into components.
4. Only where a bucket of three or more still spans several components can a link have been missed. There,
   classes outside the bucket's largest component meet all classes of other components, in blocks; the join
   itself compares signatures and sets, so no list of all pairs exists. Two classes that share several buckets are
   compared in the first of them only.
5. Components come from alternating large-star and small-star steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import stored, text_of
from touchline.llm.components import connected_components
from touchline.llm.words import chunks, shingle_sets

SHINGLE = 5
SIMILARITY = 75  # hundredths
BANDS, ROWS = 32, 4
#: A pair whose signatures agree in fewer places is not looked at: at a similarity of 0.75, some 96 of 128
#: agree, and fewer than 64 with a probability of less than 1e-9.
LEAST_AGREEING = 64
#: Classes of a bucket that one task compares with a class outside the bucket's largest component.
BLOCK = 1024
_HASHES = BANDS * ROWS
_RANDOM = np.random.RandomState(19971)
_A = _RANDOM.randint(0, 1 << 63, _HASHES, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RANDOM.randint(0, 1 << 63, _HASHES, dtype=np.int64).astype(np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """128 minima of a set, each as 7 bits of its place and 25 bits of its value, so that two signatures
    have as many numbers in common as places in which they agree."""
    least = np.full(_HASHES, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 512):
        part = shingles[k : k + 512, None] * _A
        part += _B
        np.minimum(least, part.min(axis=0), out=least)
    value = (least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(39)
    return (value | (np.arange(_HASHES, dtype=np.uint64) << np.uint64(25))).astype(np.uint32).view(np.int32)


def _signed(rows: DataFrame, shingle: int) -> DataFrame:
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for first, raws in chunks(texts, lower=True):
                n, a, b, minima = [], [], [], []
                for shingles in shingle_sets(raws, shingle):
                    digest = xxhash.xxh128_digest(shingles.tobytes())
                    n.append(len(shingles))
                    a.append(int.from_bytes(digest[:8], "little", signed=True))
                    b.append(int.from_bytes(digest[8:], "little", signed=True))
                    minima.append(signature(shingles))
                offsets = pa.array(np.arange(len(n) + 1, dtype=np.int32) * _HASHES)
                signatures = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(minima)))
                yield pa.RecordBatch.from_arrays([ids.slice(first, len(n)), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), signatures], ["id", "n", "a", "b", "signature"])

    return rows.mapInArrow(signed, "id bigint, n bigint, a bigint, b bigint, signature array<int>")


def _sets(rows: DataFrame, shingle: int) -> DataFrame:
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, raws in chunks(batch.column(1).to_pylist(), lower=True):
                sets = list(shingle_sets(raws, shingle))
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(sets)), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets).view(np.int64)))], ["id", "shingles"])

    return rows.mapInArrow(listed, "id bigint, shingles array<bigint>")


def _agreeing(x: str, y: str):
    return F.size(F.array_intersect(x, y)) >= LEAST_AGREEING


def _similar_sizes(x: str, y: str):
    return 100 * F.least(x, y) >= SIMILARITY * F.greatest(x, y)


def _similar_sets(x: str, y: str):
    common = F.size(F.array_intersect(x, y))
    return 100 * common >= SIMILARITY * (F.size(x) + F.size(y) - common)


def _confirmed(pairs: DataFrame, rows: DataFrame, shingle: int) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough. ``rows``: id, text."""
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    sets = stored(_sets(rows.join(wanted, "id", "left_semi"), shingle).dropDuplicates(["id"]), "shingle-sets")
    one = sets.select(F.col("id").alias("v"), F.col("shingles").alias("sv"))
    other = sets.select(F.col("id").alias("u"), F.col("shingles").alias("su"))
    return pairs.join(one, "v").join(other, "u").where(_similar_sets("su", "sv")).select("u", "v")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept.

    A-Z count as a-z; words are what ASCII white space separates. A document's set holds its distinct
    five-word shingles, or its whole word sequence if that is shorter. Documents are linked when the
    intersection of their sets holds 0.75 of the union or more; component_id is the smallest id that links
    reach, and kept marks that document. A document without words (null, empty, blank) is linked with
    nothing. Ids are integers and should be unique: rows that share one count as one node. A row without an
    id keeps a null component_id and is kept, as nothing can name it. An empty table gives an empty result;
    other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text_of(text_col).alias("text"))
    signed = stored(_signed(rows, shingle), "signatures")
    light = signed.select("id", "n", "a", "b")
    classes = stored(light.where("n > 0 and id is not null").groupBy("a", "b").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    chosen = classes.select(F.col("rep").alias("id"), "a", "b")
    reps = stored(signed.join(chosen, ["id", "a", "b"], "left_semi").dropDuplicates(["id"]).select("id", "n", "signature"), "representatives")

    bands = F.array(*[F.xxhash64(F.lit(b), *[F.get("signature", F.lit(b * ROWS + r)) for r in range(ROWS)]) for b in range(BANDS)])
    banded = reps.select("id", F.explode(bands).alias("bucket"))
    buckets = stored(banded.groupBy("bucket").agg(F.min("id").alias("u"), F.count(F.lit(1)).alias("size")).where("size > 1"), "buckets")
    members = stored(banded.join(buckets, "bucket").select("bucket", "size", "u", F.col("id").alias("v")), "bucket-members")

    sized = reps.select("id", "n", "signature")
    pairs = members.where("u <> v").select("u", "v").distinct()
    for side in ("v", "u"):
        pairs = pairs.join(sized.select(F.col("id").alias(side), F.col("n").alias(f"n{side}"), F.col("signature").alias(f"s{side}")), side)
    pairs = stored(pairs.where(_similar_sizes("nu", "nv") & _agreeing("su", "sv")).select("u", "v"), "candidates")
    representatives = rows.join(chosen.select("id"), "id", "left_semi")
    links = stored(_confirmed(pairs, representatives, shingle), "confirmed")
    first = stored(connected_components(links), "components")

    # Buckets that still span components.
    labelled = members.where("size > 2").join(first.withColumnRenamed("id", "v"), "v", "left").select("bucket", "size", "u", "v", F.coalesce("component", "v").alias("c"))
    counted = labelled.groupBy("bucket", "c").agg(F.count(F.lit(1)).alias("n"))
    spanning = stored(counted.groupBy("bucket").agg(F.max_by("c", F.struct("n", "c")).alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1"), "spanning")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    signs = sized.select(F.col("id").alias("v"), "n", "signature", bands.alias("every_bucket"))
    open_rows = labelled.where("v <> u").join(spanning, "bucket").join(signs, "v").select("bucket", "main", "v", "c", "n", "signature", "every_bucket", blocks.alias("blocks"))
    open_rows = stored(open_rows, "spanning-members")
    sets = stored(_sets(representatives.join(open_rows.select(F.col("v").alias("id")).distinct(), "id", "left_semi"), shingle).dropDuplicates(["id"]), "shingle-sets")
    held = open_rows.join(sets.withColumnRenamed("id", "v"), "v")
    side = lambda s: [F.col(c).alias(f"{c[0]}{s}") for c in ("c", "n")] + [F.col("v").alias(s), F.col("signature").alias(f"s{s}"), F.col("every_bucket").alias(f"e{s}"), F.col("shingles").alias(f"w{s}")]
    left = held.where("c <> main").select(F.col("bucket").alias("bx"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("kx"), *side("x"))
    right = held.select(F.col("bucket").alias("by"), F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int").alias("ky"), F.col("main").alias("my"), *side("y"))
    once = (F.col("cy") == F.col("my")) | (F.col("x") < F.col("y"))
    # Compared in full within the join, so that pairs which only look alike are never written.
    here = F.get(F.array_intersect("ex", "ey"), F.lit(0)) == F.col("bx")  # the first bucket that both are in
    alike = _similar_sizes("nx", "ny") & here & _agreeing("sx", "sy") & _similar_sets("wx", "wy")
    met = left.join(right, (F.col("bx") == F.col("by")) & (F.col("kx") == F.col("ky")) & (F.col("cx") != F.col("cy")) & once & alike)
    late = stored(met.select(F.greatest("x", "y").alias("v"), F.least("x", "y").alias("u")).distinct(), "late-links")
    if late.isEmpty():
        final = first
    else:
        final = stored(connected_components(late.select("u", "v").union(first.where("id <> component").select("id", "component"))), "components")

    named = classes.join(final.withColumnRenamed("id", "rep"), "rep", "left").where("copies > 1 or component is not null").select("a", "b", F.coalesce("component", "rep").alias("component"))
    component = F.coalesce("component", "id")
    return light.join(named, ["a", "b"], "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` without the rows that are not kept; all columns stay. Ids are taken to be unique."""
    other = "__id"
    while other in docs.columns:
        other += "_"
    gone = near_duplicates(docs, id_col, text_col, shingle).where("not kept").select(F.col(id_col).alias(other)).distinct()
    return docs.join(gone, F.col(id_col) == F.col(other), "left_anti")
