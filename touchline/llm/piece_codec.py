"""Encoding and decoding with a SentencePiece BPE model.

The encoder does not replay merges over a text. A sequence of tokens is what the merges give if and only if
each two neighbours are, so it walks from the left: an Aho-Corasick automaton over the vocabulary gives the
longest token at each place; a token is taken if re-merging it with its left neighbour leaves the two as
they are; if no prefix of it fits, the place is marked as failed in a bitfield and the walk steps back.

Where no piece joins two neighbouring characters (a space mark after a letter, a letter and a bracket), no
merge reaches across; a text is cut there and each worker keeps a bounded memory of the stretches it has seen.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import text_of

MARK = "▁"
#: Stretches that a worker remembers; some 200 bytes each.
REMEMBERED = 300_000
#: Documents that a worker holds as Python objects.
ROWS_AT_ONCE = 128


class PieceCodec:
    """A SentencePiece model of type BPE with byte fallback and the identity normaliser."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        self.byte_ids = {model.id_to_piece(i): i for i in range(size) if model.is_byte(i)}
        self.ids, self.scores = {}, {}
        self.surface = [b""] * size
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.surface[i] = bytes([int(piece[3:5], 16)])
            elif model.is_unknown(i):
                self.surface[i] = " ⁇ ".encode()
            elif not model.is_control(i):
                self.surface[i] = piece.replace(MARK, " ").encode()
                if not model.is_unused(i):
                    self.ids[piece], self.scores[piece] = i, model.get_score(i)
        self.byte_of = [self.byte_ids[f"<0x{b:02X}>"] for b in range(256)]
        self.unknown = model.unk_id()
        self.control = {i for i in range(size) if model.is_control(i)}
        self.is_byte = [model.is_byte(i) for i in range(size)]
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            self.automaton.add_word(piece, len(piece))
        self.automaton.make_automaton()
        self.stretch = re.compile(self._stretches())
        # Pieces of one character over and over (white space) share a score, so their merges have no order
        # by score alone; pairs with such a piece are merged again in full.
        counts = Counter(self.scores[piece] for piece in self.ids if len(piece) > 1)
        self.tied = {piece for piece in self.ids if len(piece) > 1 and counts[self.scores[piece]] > 1}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.edges: dict[str, tuple[list[str], list[str]] | None] = {}
        self.shorter: dict[str, str | None] = {}
        self.memory: dict[str, bytes] = {}

    def _stretches(self) -> str:
        """Pattern of the stretches that can be encoded each by itself.

        Characters that stand next to each other in some piece are of one kind. No merge joins characters of
        two kinds, nor a space mark to a character before it, so a text is cut at such places. All kinds but
        those of the ASCII characters are left together, which only makes longer stretches.
        """
        if any(MARK in piece.lstrip(MARK) for piece in self.ids):
            return "(?s).+"
        kind: dict[str, str] = {}

        def root(c: str) -> str:
            while kind.setdefault(c, c) != c:
                c = kind[c]
            return c

        for piece in self.ids:
            body = piece.lstrip(MARK)
            for a, b in zip(body, body[1:]):
                kind[root(a)] = root(b)
        letters = root("e")
        classes: dict[str, list[str]] = {}
        for c in map(chr, range(1, 128)):
            if c != " " and root(c) != letters:
                classes.setdefault(root(c), [])
        for c in list(kind):
            if root(c) in classes and c != MARK:
                classes[root(c)].append(c)
        sets = ["".join(map(re.escape, members)) for members in classes.values()]
        return f"{MARK}*[^{MARK}{''.join(sets)}]+|" + "|".join(f"{MARK}*[{x}]+" for x in sets) + f"|{MARK}+"

    def merged(self, text: str) -> list[str]:
        """The tokens of a short text by merging: the best score first, of equal ones the leftmost."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _prefix(self, token: str) -> str | None:
        """The longest token that is a proper prefix of ``token``."""
        if token not in self.shorter:
            self.shorter[token] = next((token[:n] for n in range(len(token) - 1, 0, -1) if token[:n] in self.ids), None)
        return self.shorter[token]

    def _edges(self, token: str) -> tuple[list[str], list[str]] | None:
        """What stands at the left and at the right edge of ``token`` while it is merged, from one character
        to the whole; None if the merges do not give it."""
        if token not in self.edges:
            parts, scores, left, right = list(token), self.scores, [token[0]], [token[-1]]
            while len(parts) > 1:
                found = [(-scores[x], k) for k in range(len(parts) - 1) if (x := parts[k] + parts[k + 1]) in scores]
                if not found:
                    break
                k = min(found)[1]
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
                if k == 0:
                    left.append(parts[0])
                if k == len(parts) - 1:
                    right.append(parts[-1])
            self.edges[token] = (left, right) if len(parts) == 1 else None
        return self.edges[token]

    def _stay_apart(self, a: str, b: str) -> bool:
        """Whether merging a + b leaves both: at no time may what stands left and right of the border be
        merged sooner than either goes into its own token."""
        if a in self.tied or b in self.tied:
            return self.merged(a + b) == [a, b]
        scores = self.scores
        lefts, rights = self._edges(a)[1], self._edges(b)[0]
        i = j = 0
        while True:
            across = scores.get(lefts[i] + rights[j])
            grow_a = scores[lefts[i + 1]] if i + 1 < len(lefts) else None
            grow_b = scores[rights[j + 1]] if j + 1 < len(rights) else None
            if across is not None and (grow_a is None or across > grow_a) and (grow_b is None or across >= grow_b):
                return False
            if grow_a is not None and (grow_b is None or grow_a >= grow_b):
                i += 1
            elif grow_b is not None:
                j += 1
            else:
                return True

    def _fits(self, left: str | None, token: str) -> bool:
        if self._edges(token) is None:
            return False
        if left is None:
            return True
        pair = (left, token)
        fits = self.pairs.get(pair)
        if fits is None:
            if len(self.pairs) > REMEMBERED:
                self.pairs.clear()
            fits = self.pairs[pair] = self._stay_apart(left, token)
        return fits

    def _tokens(self, text: str) -> list[str]:
        """Tokens of a text all of whose characters are pieces."""
        end = len(text)
        longest = [1] * end
        for last, n in self.automaton.iter(text):
            if n > 1 and n > longest[start := last - n + 1]:
                longest[start] = n
        if longest[0] == end and self._fits(None, text):
            return [text]
        failed = bytearray(end // 8 + 1)
        tokens: list[str] = []
        at, left, token, pairs = 0, None, text[: longest[0]], self.pairs
        while at < end:
            candidate: str | None = token
            while candidate is not None:
                to = at + len(candidate)
                if not failed[to >> 3] >> (to & 7) & 1:
                    fits = pairs.get((left, candidate))
                    if fits or fits is None and self._fits(left, candidate):
                        break
                candidate = self._prefix(candidate)
            if candidate is not None:
                tokens.append(candidate)
                left, at = candidate, to
                if at < end:
                    token = text[at : at + longest[at]]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                token = tokens.pop()
                at -= len(token)
                left = tokens[-1] if tokens else None
        return tokens

    def _ids(self, stretch: str) -> list[int]:
        known = self.ids
        if all(map(known.__contains__, stretch)):
            return [known[t] for t in self._tokens(stretch)]
        ids: list[int] = []
        run = 0
        for k, c in enumerate(stretch):
            if c not in known:
                if k > run:
                    ids += [known[t] for t in self._tokens(stretch[run:k])]
                ids += [self.byte_of[b] for b in c.encode()]
                run = k + 1
        if run < len(stretch):
            ids += [known[t] for t in self._tokens(stretch[run:])]
        return ids

    def encode_packed(self, text: str) -> bytes:
        """Ids as 32-bit integers in native order."""
        if not text:
            return b""
        memory, out = self.memory, []
        for stretch in self.stretch.findall(MARK + text.replace(" ", MARK)):
            ids = memory.get(stretch)
            if ids is None:
                ids = array("i", self._ids(stretch)).tobytes()
                if len(stretch) <= 64:
                    if len(memory) >= REMEMBERED:
                        memory.clear()
                    memory[stretch] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return memoryview(self.encode_packed(text)).cast("i").tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``: control ids vanish, the first space mark goes, and bytes that are not UTF-8
        become one U+FFFD each."""
        surface = self.surface
        raw = b"".join(map(surface.__getitem__, ids))
        first = next((i for i in ids if i not in self.control), None)
        if first is not None and not self.is_byte[first] and first != self.unknown and raw[:1] == b" ":
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return _decode_bytewise(raw)


def _decode_bytewise(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        try:
            out.append(raw[at:].decode())
            break
        except UnicodeDecodeError as e:
            out.append(raw[at : at + e.start].decode() + "�")
            at += e.start + 1
    return "".join(out)


@cache
def codec(model_file: str) -> PieceCodec:
    """One codec per worker process."""
    return PieceCodec(model_file)


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def _encoded(own: PieceCodec, texts: pa.Array) -> pa.ListArray:
    packed = [own.encode_packed(t) for t in texts.to_pylist()]
    offsets = [0]
    for p in packed:
        offsets.append(offsets[-1] + len(p) // 4)
    values = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(packed))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _decoded(own: PieceCodec, lists: pa.ListArray) -> pa.StringArray:
    # One text's ids at a time: as Python objects they take ten times their room.
    return pa.array([own.decode(ids.values.to_numpy().tolist()) for ids in lists], pa.string())


def encode_documents(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ids (array of int), as the sentencepiece library encodes the text
    without begin or end ids.

    Null counts as empty, and the empty text has no ids. Texts are encoded whole, however long. Rows are
    independent of each other: repeated rows and ids give repeated results, an empty table an empty one.
    Other columns are ignored. ``model_file`` must be readable on every executor.
    """
    rows = docs.select(F.col(id_col).alias(id_col), text_of(text_col).alias("__text"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_file)
        for batch in _small(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), _encoded(own, batch.column(1))], [id_col, "ids"])

    kind = dict(rows.dtypes)[id_col]
    return rows.mapInArrow(encoded, f"`{id_col}` {kind}, ids array<int>")


def decode_documents(encoded: DataFrame, model_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of ``encoded``: id, ids, text, as the sentencepiece library decodes the ids. Null
    ids count as none."""
    rows = encoded.select(F.col(id_col).alias(id_col), F.coalesce(ids_col, F.array().cast("array<int>")).alias("ids"))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_file)
        for batch in _small(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _decoded(own, batch.column(1))], [id_col, "ids", "text"])

    kind = dict(rows.dtypes)[id_col]
    return rows.mapInArrow(decoded, f"`{id_col}` {kind}, ids array<int>, text string")


def round_trip(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``decode_documents`` of ``encode_documents``, in one pass of one worker a task."""
    rows = docs.select(F.col(id_col).alias(id_col), text_of(text_col).alias("__text"))

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_file)
        for batch in _small(batches):
            ids = _encoded(own, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, _decoded(own, ids)], [id_col, "ids", "text"])

    kind = dict(rows.dtypes)[id_col]
    return rows.mapInArrow(both, f"`{id_col}` {kind}, ids array<int>, text string")
