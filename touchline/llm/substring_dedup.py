"""Removal of repeated passages, found by recompression.

Recompression renames a sequence of words in rounds. First each run of one word becomes a symbol, then each
round joins pairs of neighbours into one: every symbol has a coin for the round, and a heads followed by a
tails is a pair. A name is a hash of what it stands for and a coin a hash of the name, so all names and coins
are global without any table, and a round needs nothing but the symbols. Whether a symbol arises depends on
its neighbourhood only; that span is carried along, so it is known for each window of 20 words which symbols
it fixes by itself. Equal windows fix the same symbols at the same places.

1. Each window takes as its anchor, at the highest level that has one, the least of the sequences of three
   neighbouring symbols that it fixes; a window that fixes none takes its own hash. Neighbouring windows share
   anchors, some 5 each.
2. Spark counts the anchors' names. Windows whose anchor has no other place have no other place either. Names
   are shuffled with the documents' ids only; where they stand is found again in the documents that have some.
3. The windows that are left are told apart by 128 bits: two hashes of their 20 words, each over words that
   are hashed from their bytes in a way of its own. The smallest place of a window is its first, the others
   are repeats.

Exact copies of a whole document need no windows: but for the smallest id, all of their windows are repeats.
Texts are compressed where they are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import stored, text_of, wide_hash
from touchline.llm.words import chunks, mixed, powers, word_hashes

WINDOW = 20
#: Rounds of pairs, and how many neighbouring symbols are an anchor.
ROUNDS, SYMBOLS = 2, 3
#: Bytes of text whose windows are looked at together.
RUN_BYTES = 1 << 19
#: Most keys that may be broadcast, some 30 MB; more are joined by a shuffle.
BROADCAST_KEYS = 500_000
#: Bases of the two halves of a 128-bit hash.
_BASES = 0x9FB21C651E98DF25, 0xA0761D6478BD642F
_PAIR_A, _PAIR_B, _RUN = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5)


def _rounds(words: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levels 0 to ``ROUNDS``: (name, low, high) of each symbol in order. A window [p, p + 20) of one
    document fixes the symbols with p <= low and high <= p + 20; both rise with the symbols."""
    begins = np.ones(len(words), bool)
    begins[1:] = words[1:] != words[:-1]
    begins[offsets[:-1][offsets[:-1] < len(words)]] = True
    start = np.flatnonzero(begins)
    end = np.append(start[1:], len(words))
    name = mixed(words[start] + _RUN * (end - start).astype(np.uint64))
    document = np.searchsorted(offsets, start, "right")
    low, high = start - 1, end + 1
    yield name, low, high
    for level in range(ROUNDS):
        tails = (mixed(name ^ powers(_PAIR_A, level + 2)[-1]) & np.uint64(1)).astype(bool)
        joined = document[1:] == document[:-1]
        left = np.append(joined & ~tails[:-1] & tails[1:], False)  # the left one of a pair
        right = np.concatenate([[False], left[:-1]])
        has_next, has_previous = np.append(joined, False), np.concatenate([[False], joined])
        next_high = np.append(high[1:], 0)
        previous_low = np.concatenate([[0], low[:-1]])
        next_name = np.append(name[1:], np.uint64(0))
        # A heads that is in no pair depends on the next symbol, a tails in none on the one before; where
        # there is none, on what lies beyond the document.
        edge_high = np.where(has_next, next_high, offsets[document] + 1)
        edge_low = np.where(has_previous, previous_low, offsets[document - 1] - 1)
        new_high = np.where(tails, high, edge_high)
        new_low = np.where(tails & ~right, edge_low, low)
        name = np.where(left, mixed(name * _PAIR_A + next_name * _PAIR_B + np.uint64(level)), name)
        kept = ~right
        name, low, high, document = name[kept], new_low[kept], new_high[kept], document[kept]
        yield name, low, high


def _least_of(priority: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Index of the least priority in first..last of each query."""
    best = np.arange(len(priority))
    tables = [best]
    longest = int((last - first).max()) + 1
    step = 1
    while 2 * step <= longest:
        a, b = tables[-1][:-step], tables[-1][step:]
        tables.append(np.where(priority[b] < priority[a], b, a))
        step *= 2
    size = last - first + 1
    order = np.frexp(size)[1] - 1
    out = np.empty(len(first), np.int64)
    for k, table in enumerate(tables):
        at = np.flatnonzero(order == k)
        a, b = table[first[at]], table[last[at] - (1 << k) + 1]
        out[at] = np.where(priority[b] < priority[a], b, a)
    return out


def _grams(words: np.ndarray, base: int) -> np.ndarray:
    """Hash of the ``WINDOW`` words from each place on."""
    n = len(words) - WINDOW + 1
    factors = powers(np.uint64(base), WINDOW + 1)[1:]
    total = words[:n] * factors[0]
    for k in range(1, WINDOW):
        total += words[k : k + n] * factors[k]
    return mixed(total)


def anchors(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, first window, last window, document) of each stretch of windows with one anchor, in order.
    Windows are named by the number of their first word."""
    lengths = np.diff(offsets)
    windows = np.maximum(lengths - WINDOW + 1, 0)
    document = np.repeat(np.arange(len(lengths)), windows)
    if not len(document):
        empty = np.zeros(0, np.int64)
        return empty.astype(np.uint64), empty, empty, empty
    place = np.arange(len(document)) - np.repeat(np.cumsum(windows) - windows, windows) + offsets[document]
    chosen_name = np.zeros(len(place), np.uint64)
    chosen = np.full(len(place), -1, np.int64)  # the symbol, numbered through all levels
    open_at = np.arange(len(place))
    passed = 0
    for name, low, high in reversed(list(_rounds(words, offsets))):
        n = len(name) - SYMBOLS + 1
        if n > 0:
            joined = name[:n]
            for k in range(1, SYMBOLS):
                joined = mixed(joined * _PAIR_A + name[k : k + n] * _PAIR_B)
            first = np.searchsorted(low[:n], place[open_at], "left")
            last = np.searchsorted(high[SYMBOLS - 1 :], place[open_at] + WINDOW, "right") - 1
            some = first <= last
            if some.any():
                at = open_at[some]
                symbol = _least_of(mixed(joined ^ _RUN), first[some], last[some])
                chosen[at] = symbol + passed
                chosen_name[at] = joined[symbol]
                open_at = open_at[~some]
            passed += n
        if not len(open_at):
            break
    if len(open_at):
        chosen[open_at] = passed + open_at
        chosen_name[open_at] = _grams(words, _BASES[0])[place[open_at]]
    change = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (document[1:] != document[:-1])]))
    until = np.append(change[1:], len(place)) - 1
    return chosen_name[change], place[change], place[until], document[change]


def _anchored(rows: DataFrame, keys: list[str]) -> DataFrame:
    """From (keys, text) one row per stretch of windows with one anchor: name and keys."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, raws in chunks(batch.column(len(keys)).to_pylist(), lower=False):
                name, _, _, document = anchors(*word_hashes(raws))
                take = pa.array(document + at)
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), *(batch.column(c).take(take) for c in range(len(keys)))], ["name", *keys])

    return rows.mapInArrow(found, "name bigint, " + ", ".join(f"{c} bigint" for c in keys))


def _windows_of(raws: list[bytes], names: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(hash of every word, number of each text's first word, and for each text the first and last windows of the stretches
    whose anchors are among its ``names``)."""
    words, offsets = word_hashes(raws)
    name, first, last, document = anchors(words, offsets)
    bounds = np.searchsorted(document, np.arange(len(raws) + 1))
    out = []
    for i, own in enumerate(names):
        part = slice(bounds[i], bounds[i + 1])
        hit = np.isin(name[part].view(np.int64), own)
        out.append((first[part][hit] - offsets[i], last[part][hit] - offsets[i]))
    return words, offsets, out


def _packed(rows: DataFrame, id_type: str, keys: list[str]) -> DataFrame:
    """``rows`` (id, keys, text) with the text compressed: id, keys, z."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, n = zstandard.ZstdCompressor(level=1).compress, len(keys) + 1
        for batch in batches:
            z = pa.array([pack(x.as_buffer()) for x in batch.column(n)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(n)), z], ["id", *keys, "z"])

    return rows.mapInArrow(packed, f"id {id_type}, " + ", ".join(f"{c} bigint" for c in keys) + ", z binary")


def _unpacked(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first text, texts) of runs of some ``RUN_BYTES``; a longer text makes a run of its own."""
    unpack = zstandard.ZstdDecompressor().decompress
    first, held, size = 0, [], 0
    for k, x in enumerate(column):
        raw = unpack(x.as_buffer())
        if held and size + len(raw) > RUN_BYTES:
            yield first, held
            first, held, size = k, [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield first, held


def _hashed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """From (keys, z, names) the hash (a, b) of each window whose anchor is among the names: a, b, keys, r (its first word)."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(keys)
        for batch in batches:
            for begin, raws in _unpacked(batch.column(n)):
                words, offsets, found = _windows_of(raws, [batch.column(n + 1)[begin + i].values.to_numpy() for i in range(len(raws))])
                hashes = [_grams(words, _BASES[0]), _grams(word_hashes(raws, 1)[0], _BASES[1])]
                owner = np.repeat(np.arange(len(raws)), [len(f) for f, _ in found])
                first, last = np.concatenate([f for f, _ in found]), np.concatenate([x for _, x in found])
                size = last - first + 1
                place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - first - offsets[owner], size)
                owner = np.repeat(owner, size)
                take = pa.array(owner + begin)
                columns = [*(pa.array(x[place].view(np.int64)) for x in hashes), *(batch.column(c).take(take) for c in range(n)), pa.array((place - offsets[owner]).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["a", "b", *keys, "r"])

    return rows.mapInArrow(hashed, "a bigint, b bigint, " + ", ".join(f"{c} bigint" for c in keys) + ", r int")


def _cut(rows: DataFrame, id_type: str) -> DataFrame:
    """From (id, z, names, firsts, copy) the result: words covered by repeats are left out."""

    def covered(n: int, ranges: tuple[np.ndarray, np.ndarray], firsts: pa.ListScalar) -> np.ndarray:
        repeats = np.zeros(n, bool)
        for first, last in zip(*ranges):
            repeats[first : last + 1] = True
        if firsts.is_valid:
            repeats[firsts.values.to_numpy()] = False
        at, steps = np.flatnonzero(repeats), np.zeros(n + 1, np.int32)
        steps[at] += 1
        steps[at + WINDOW] -= 1
        return np.cumsum(steps[:n]) > 0

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, raws in _unpacked(batch.column(1)):
                part = batch.slice(begin, len(raws))
                copies, names, firsts = part.column(4).to_pylist(), part.column(2), part.column(3)
                looked = [k for k in range(len(raws)) if not copies[k] and names[k].is_valid]
                ranges = dict(zip(looked, _windows_of([raws[k] for k in looked], [names[k].values.to_numpy() for k in looked])[2])) if looked else {}
                n_words, n_removed, texts = [], [], []
                for k, text in enumerate(raws):
                    words = text.split()
                    n = len(words)
                    if copies[k]:
                        words = words if n < WINDOW else []
                    elif k in ranges:
                        words = [w for w, c in zip(words, covered(n, ranges[k], firsts[k]).tolist()) if not c]
                    n_words.append(n)
                    n_removed.append(n - len(words))
                    texts.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts, pa.string())], ["id", "n_words", "n_removed", "text"])

    return rows.mapInArrow(kept, f"id {id_type}, n_words bigint, n_removed bigint, text string")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed, text (the words that stay, joined by a space).

    Words are what ASCII white space separates, unchanged; null counts as no words. A word goes if it lies
    in a window of 20 consecutive words of its document whose sequence also starts earlier: in a document
    with a smaller id, or at an earlier word of the same. Windows are judged on the input. Shorter documents
    stay whole. Rows that repeat id and text are one document given twice; with one id on different texts,
    their order is that of the texts' hashes; a null id comes first. An empty table gives an empty result;
    other columns are ignored. Ids are integers.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63))).alias("k"), text_of(text_col).alias("text"))
    a, b = wide_hash(F.col("text"))
    rows = rows.withColumns({"h": a, "h2": b})
    light = stored(rows.select("k", "h", "h2"), "text-hashes")
    # Where no id stands on two texts, the texts' hashes are not needed to tell documents apart.
    one_text = light.groupBy("k").agg(F.min("h").alias("x"), F.max("h").alias("y")).where("x <> y").isEmpty()
    rows, light = (df.withColumnRenamed("h", "t") if not one_text else df for df in (rows.withColumn("__h", F.col("h")), light.withColumn("__h", F.col("h"))))
    keys = ["k"] if one_text else ["k", "t"]
    smallest = light.groupBy("__h", "h2").agg(F.min("k").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").select("__h", "h2", "rep")
    copies = stored(light.join(smallest, ["__h", "h2"]).where("k <> rep").select(*keys).distinct(), "copies")

    # Copies are left out where they are few enough to be known to every task; else they are at the end, and
    # only make more windows to be looked at.
    few_copies = copies.count() <= BROADCAST_KEYS // 2
    fresh = rows.select(*keys, "text")
    place = _anchored(fresh.join(F.broadcast(copies), keys, "left_anti").select(*keys, "text") if few_copies else fresh, keys)
    repeated = stored(place.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name"), "repeated-names")
    repeated = F.broadcast(repeated) if repeated.count() <= BROADCAST_KEYS else repeated
    named = place.join(repeated, "name", "left_semi").groupBy(*keys).agg(F.collect_set("name").alias("names"))
    named = stored(named if few_copies else named.join(copies, keys, "left_anti"), "names")

    id_type = dict(rows.dtypes)["id"]
    texts = _packed(rows.select("id", *keys, "text"), id_type, keys)
    windows = _hashed(texts.join(named, keys).select(*keys, "z", "names"), keys)
    first = windows.groupBy("a", "b").agg(F.min(F.struct(*keys, "r")).alias("f")).select("f.*")
    firsts = stored(first.groupBy(*keys).agg(F.collect_set("r").alias("firsts")), "firsts")
    verdict = named.join(firsts, keys, "left")
    marked = texts.join(verdict, keys, "left").join(copies.withColumn("copy", F.lit(True)), keys, "left")
    out = _cut(marked.select("id", "z", "names", "firsts", F.coalesce("copy", F.lit(False)).alias("copy")), id_type)
    return out.withColumnRenamed("id", id_col)
