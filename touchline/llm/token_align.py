"""Alignment of two tokenizers over the bytes of each text.

Both tokenizers cut the same bytes. For each of them an array has, for every byte, the number of the token that owns
it (``np.repeat`` of token numbers over token lengths). Where either array changes, a new pair of owners begins: each
such pair is a link between two tokens whose bytes overlap. Where both change at once, both tokenizers begin a token:
a cut, and what lies between two cuts is a group. A batch of texts is one stretch of bytes, as texts begin at cuts.

Neither tokenizer has a token across the place between a character that is no white space and a space: A's pattern ends
what it merges there, and no piece of B reaches from the one to the other, so no merge does. Texts are cut there, both
libraries encode the words, and each worker keeps a bounded memory of the ids of words it has seen.

How common a pair of ids is (in how many documents it is linked) is counted by Spark. Every document has its distinct
pairs with the number of their links; pairs of one document only don't come into the table of counts, and the greatest
count of an id of A is at most one row per id of the vocabulary.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import stored

#: Documents that a worker aligns together, and bytes of their texts beyond which no further one joins them.
ROWS_AT_ONCE, BYTES_AT_ONCE = 256, 1 << 20
#: Pairs of counts, of some 30 bytes each as Spark keeps them, up to which their table is broadcast.
BROADCAST_PAIRS = 2_000_000
SPACE_MARK = "▁"
#: Words that a worker remembers, of some 350 bytes each, and the longest of them.
REMEMBERED, LONGEST = 300_000, 64
#: New words that A encodes as one text.
WORDS_AT_ONCE = 500
#: From a space to before the next one that follows a character which is no white space; a last single space stays.
WORD = re.compile(r" \s*\S*(?:[^\S ]\s*\S*)*(?: \Z)?")
#: What no word may be cut out of: to some libraries U+180E is white space.
UNCUT = "\u180e"


def byte_level_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself where it can be seen, else the next of
    those from U+0100."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(seen)))}


class Aligner:
    """A byte-level BPE of the tokenizers library (A) and a SentencePiece model with byte fallback (B).

    A encodes a space and the text, B the text, before which it puts a space itself.
    """

    def __init__(self, a_file: str, b_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        alphabet, names = byte_level_alphabet(), self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.a_bytes[i] = bytes(alphabet[c] for c in name) if all(c in alphabet for c in name) else name.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(pieces)]
        self.a_lengths, self.b_lengths = (np.array([len(x) for x in own], np.int64) for own in (self.a_bytes, self.b_bytes))
        # What follows an id in the text of the groups: more of its kind, the other kind, or the next group.
        n, m = len(self.a_bytes), len(self.b_bytes)
        self.cuts = self._cuts(pieces)
        self.a_of: dict[str, bytes] = {}
        self.b_of: dict[str, bytes] = {}
        self.odd: set[str] = set()
        self.written = [f"{i}{end}" for ids, end in ((n, ","), (n, "|"), (m, ","), (m, ";")) for i in range(ids)]

    def _cuts(self, pieces: list[str]) -> bool:
        """Whether texts may be cut into words. Other models than those described encode whole texts."""
        a = json.loads(self.a.to_str())
        before = a["pre_tokenizer"] or {}
        plain = a["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
        return plain and all(t["special"] for t in a["added_tokens"]) and not any(re.search(f"[^ {SPACE_MARK}][ {SPACE_MARK}]", p) for p in pieces)

    def _ids_of_a(self, spaced: list[str]) -> list[list[int]]:
        """Ids by A of texts that begin with a space. Those that a space may follow are encoded many as one, and their ids told apart
        by the bytes: what A spends on each text is more than what it spends on a word."""
        alone = [k for k, t in enumerate(spaced) if not self.cuts or t[-1].isspace() or UNCUT in t]
        apart = set(alone)
        joined = [k for k in range(len(spaced)) if k not in apart]
        out: list[list[int]] = [[]] * len(spaced)
        runs = [joined[k : k + WORDS_AT_ONCE] for k in range(0, len(joined), WORDS_AT_ONCE)]
        for run, e in zip(runs, self.a.encode_batch_fast(["".join([spaced[k] for k in run]) for run in runs], add_special_tokens=False)):
            ids, ends = e.ids, np.cumsum([len(spaced[k].encode()) for k in run])
            token_ends = np.cumsum(self.a_lengths[ids])
            to = np.searchsorted(token_ends, ends) + 1
            if token_ends[-1:] != ends[-1:] or to[-1] != len(ids) or not np.array_equal(token_ends[to - 1], ends):  # some bytes have no token
                alone += run
                continue
            at = 0
            for k, end in zip(run, to.tolist()):
                out[k], at = ids[at:end], end
        for k, e in zip(alone, self.a.encode_batch_fast([spaced[k] for k in alone], add_special_tokens=False)):
            out[k] = e.ids
        return out

    def _encoded(self, spaced: list[str]) -> list[tuple[bytes, bytes, bool]]:
        """Ids by A and by B of texts that begin with a space, as 64-bit integers in native order, and whether the tokens of both
        give the text's bytes back."""
        a = self._ids_of_a(spaced)
        b = self.b.encode([t[1:] for t in spaced], num_threads=1)
        a_of, b_of = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        return [(array("q", x).tobytes(), array("q", y).tobytes(), b"".join(map(a_of, x)) == t.encode() == b"".join(map(b_of, y))) for t, x, y in zip(spaced, a, b)]

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Ids by A and by B, as 64-bit integers in native order; none for an empty text, nor for one whose tokens don't give its
        bytes back."""
        if len(self.a_of) > REMEMBERED:
            self.a_of.clear(), self.b_of.clear(), self.odd.clear()
        words = [WORD.findall(" " + t) if t and self.cuts and UNCUT not in t else [" " + t] if t else [] for t in texts]
        a_of, b_of, odd = self.a_of, self.b_of, self.odd
        new = [w for w in dict.fromkeys(chain.from_iterable(words)) if w not in a_of]
        for w, (a, b, same) in zip(new, self._encoded(new)):
            a_of[w], b_of[w] = a, b
            if not same:
                odd.add(w)
        out_a, out_b = ([b"".join(map(ids.__getitem__, own)) for own in words] for ids in (a_of, b_of))
        # Where a word's bytes aren't given back, the whole text decides.
        for k in [k for k, own in enumerate(words) if odd and not odd.isdisjoint(own)]:
            a, b, same = self._encoded([" " + texts[k]])[0]
            out_a[k], out_b[k] = (a, b) if same else (b"", b"")
        for w in new:
            if len(w) > LONGEST:
                del a_of[w], b_of[w]
                odd.discard(w)
        return out_a, out_b

    def align(self, texts: list[str]) -> dict[str, list]:
        """For each text n_a, n_b, n_groups, n_links, groups (decimal ids, as in `a1,a2|b1;a3|b2`), and its distinct pairs,
        ascending, with the number of links of each: pairs (id of A times the size of B, plus id of B), times."""
        ids_a, ids_b = self.encode(texts)
        n_a, n_b = ([len(x) // 8 for x in ids] for ids in (ids_a, ids_b))
        a, b = (np.frombuffer(b"".join(ids), np.int64) for ids in (ids_a, ids_b))
        from_a, from_b = (np.concatenate([[0], np.cumsum(n)]).astype(np.int64) for n in (n_a, n_b))
        owner_a, owner_b = np.repeat(np.arange(len(a), dtype=np.int32), self.a_lengths[a]), np.repeat(np.arange(len(b), dtype=np.int32), self.b_lengths[b])
        new_a, new_b = np.diff(owner_a, prepend=-1) != 0, np.diff(owner_b, prepend=-1) != 0
        begins = np.flatnonzero(new_a | new_b)
        link_a, link_b = owner_a[begins], owner_b[begins]
        cuts = np.flatnonzero(new_a & new_b)
        # Each token's group, and its place among all tokens when each group's are written A first.
        first_a, first_b = owner_a[cuts], owner_b[cuts]
        group_a, group_b = np.searchsorted(first_a, np.arange(len(a)), "right") - 1, np.searchsorted(first_b, np.arange(len(b)), "right") - 1
        end_a, end_b = np.append(first_a[1:], len(a)), np.append(first_b[1:], len(b))
        size_a, size_b = len(self.a_bytes), len(self.b_bytes)
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + first_b[group_a]] = a + size_a * (np.arange(len(a)) + 1 == end_a[group_a])
        order[np.arange(len(b)) + end_a[group_b]] = 2 * size_a + b + size_b * (np.arange(len(b)) + 1 == end_b[group_b])
        keys = a[link_a] * size_b + b[link_b]
        links_to, groups_to = np.searchsorted(link_a, from_a), np.searchsorted(first_a, from_a)
        out: dict[str, list] = {"n_a": n_a, "n_b": n_b, "n_groups": np.diff(groups_to).tolist(), "n_links": np.diff(links_to).tolist(), "groups": [], "pairs": [], "times": []}
        for k in range(len(texts)):
            own = order[from_a[k] + from_b[k] : from_a[k + 1] + from_b[k + 1]]
            out["groups"].append("".join(map(self.written.__getitem__, own.tolist()))[:-1])
            pairs, times = np.unique(keys[links_to[k] : links_to[k + 1]], return_counts=True)
            out["pairs"].append(pairs)
            out["times"].append(times)
        return out


@cache
def aligner(a_file: str, b_file: str) -> Aligner:
    """One for each worker process."""
    return Aligner(a_file, b_file)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths, at = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False), 0
        while at < batch.num_rows:
            room = np.cumsum(lengths[at : at + ROWS_AT_ONCE])
            n = max(1, int(np.searchsorted(room, BYTES_AT_ONCE, "right")))
            yield batch.slice(at, n)
            at += n


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays), kind))


def align_documents(docs: DataFrame, a_file: str, b_file: str, with_groups: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_a, n_b (tokens), n_groups, n_links, groups_sha256, pairs, times, and with
    ``with_groups`` groups itself, as ``Aligner.align`` describes them.

    Texts that are null or empty, or that the tokens of A or B don't give back byte by byte (such as those with a
    space mark of their own), have no tokens: zeros, empty arrays, groups_sha256 ''. Texts are aligned whole; a very long one is
    a batch of its own, of some 60 bytes of memory a byte. Repeated rows give repeated results; an empty table gives an
    empty one. Other columns are ignored. Both files must be readable on every executor.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias(id_col), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text"))
    longs = ["n_a", "n_b", "n_groups", "n_links"]

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_file, b_file)
        for batch in _batches(batches):
            x = own.align(batch.column(1).to_pylist())
            digests = [sha256(g.encode()).hexdigest() if g else "" for g in x["groups"]]
            columns = [batch.column(0), *[pa.array(x[c], pa.int64()) for c in longs], pa.array(digests), _lists(x["pairs"], pa.int64()), _lists(x["times"], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(x["groups"])] * with_groups, [id_col, *longs, "groups_sha256", "pairs", "times"] + ["groups"] * with_groups)

    kind = dict(rows.dtypes)[id_col]
    return rows.mapInArrow(aligned, f"`{id_col}` {kind}, " + ", ".join(f"{c} bigint" for c in longs) + ", groups_sha256 string, pairs array<bigint>, times array<int>" + ", groups string" * with_groups)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, documents: how many rows of ``aligned`` hold each pair linked. Counted within tasks before the shuffle."""
    return aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("documents"))


def alignment_report(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text", broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """One row per row of ``docs``: id, n_a, n_b, n_groups, n_links, n_best (links whose pair is in as many documents as
    any pair of its id of A), count_sum (documents of the pair, summed over links), groups_sha256.

    Nulls, empty texts and the like as in ``align_documents``; a repeated row counts as a document of its own. Beyond
    ``broadcast_pairs`` pairs that are in two documents or more, their table is joined by a shuffle.
    """
    size_b = aligner(a_file, b_file).b.get_piece_size()
    given = align_documents(docs, a_file, b_file, False, id_col, text_col)
    rows = stored(given.withColumn("__row", F.monotonically_increasing_id()), "aligned")
    counts = stored(pair_counts(rows).withColumn("a", F.expr(f"pair div {size_b}")), "pair-counts")
    most = counts.groupBy("a").agg(F.max("documents").alias("most"))
    # A pair that is in one document only is its id's best where all pairs of the id are; no more than one row per id.
    table = counts.where("documents > 1").select(F.col("pair").alias("p"), "documents")
    links = rows.select("__row", F.inline(F.arrays_zip("pairs", "times"))).withColumn("a", F.expr(f"pairs div {size_b}"))
    known = F.broadcast(table) if table.count() <= broadcast_pairs else table
    counted = links.join(known, F.col("pairs") == F.col("p"), "left").join(F.broadcast(most), "a")
    documents = F.coalesce("documents", F.lit(1))
    sums = counted.groupBy("__row").agg(F.sum(F.when(documents == F.col("most"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(documents * F.col("times")).alias("count_sum"))
    out = rows.drop("pairs", "times").join(sums.withColumnRenamed("__row", "__r"), F.col("__row") == F.col("__r"), "left")
    return out.select(id_col, "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"), F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"), "groups_sha256")
