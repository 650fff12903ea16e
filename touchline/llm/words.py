"""Words and word shingles of many texts at once, as 64-bit hashes in NumPy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text that are hashed together; a longer text makes a chunk of its own.
CHUNK_BYTES = 1 << 21
_RANDOM = np.random.RandomState(20240229)
#: A value for each byte and a base, for two hashes that know nothing of each other.
_BYTES = _RANDOM.randint(0, 1 << 63, (2, 256), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def chunks(texts: list[str], lower: bool) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, UTF-8 texts) of chunks of some ``CHUNK_BYTES``; ``lower`` folds A-Z only."""
    first, held, size = 0, [], 0
    for k, text in enumerate(texts):
        raw = (text or "").encode()
        if held and size + len(raw) > CHUNK_BYTES:
            yield first, held
            first, held, size = k, [], 0
        held.append(raw.lower() if lower else raw)
        size += len(raw)
    if held:
        yield first, held


def word_hashes(raws: list[bytes], kind: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of the first word of each text and of the end).

    Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. ``kind`` 0 and 1 are two different hashes.
    """
    buffer = np.frombuffer(b"\n".join(raws) + b"\n", dtype=np.uint8)
    white = (buffer == 32) | ((buffer >= 9) & (buffer <= 13))
    begins = ~white
    begins[1:] &= white[:-1]
    starts = np.flatnonzero(begins)
    ends_of_texts = np.cumsum([len(r) + 1 for r in raws])
    offsets = np.concatenate([[0], np.searchsorted(starts, ends_of_texts)])
    if not len(starts):
        return np.zeros(0, np.uint64), offsets
    inside = np.arange(starts[0], len(buffer)) - np.repeat(starts, np.diff(np.append(starts, len(buffer))))
    tail = buffer[starts[0] :]
    values = _BYTES[kind][tail] * powers(_BASE[kind], int(inside.max()) + 1)[inside]
    values[white[starts[0] :]] = 0
    return mixed(np.add.reduceat(values, starts - starts[0])), offsets


def shingle_sets(raws: list[bytes], size: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its ``size``-word shingles; with fewer words, of the whole
    sequence; none without words."""
    words, offsets = word_hashes(raws)
    factors = powers(np.uint64(0xD6E8FEB86659FD93), size + 1)[1:]
    n = len(words) - size + 1
    if n > 0:
        total = words[:n] * factors[0]
        for k in range(1, size):
            total += words[k : k + n] * factors[k]
        total = mixed(total)
    for a, b in zip(offsets, offsets[1:]):
        if b - a >= size:
            yield np.unique(total[a : b - size + 1])
        elif b > a:
            yield mixed(np.array([(words[a:b] * factors[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)
