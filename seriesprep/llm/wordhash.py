"""Words of whole texts as 64-bit hashes, computed over an Arrow string column at once.

A word is a maximal run of word bytes of the UTF-8 form. Both word classes in use are made of
ASCII delimiters, so cutting bytes equals cutting code points. Hashes depend on nothing but the
word's bytes; two different words of a corpus share one with a chance of about n*n/2^65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (splitmix64 finish)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, 0xD1342543DE82EF95, np.uint64))


class WordClass:
    """Which bytes are in words, and whether A-Z count as a-z."""

    def __init__(self, delimiters: list[int], fold_case: bool = True):
        self.inside = np.ones(256, bool)
        self.inside[delimiters] = False
        folded = np.arange(256, dtype=np.uint64)
        if fold_case:
            folded[65:91] += np.uint64(32)
        self.values = mix((folded + np.uint64(1)) * _STEP) | np.uint64(1)


#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z are lower-cased.
PLAIN = WordClass([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
#: ``[^\x20\x09-\x0D]+`` after A-Z are lower-cased.
SPACED = WordClass([0x20, *range(0x09, 0x0E)])


def _spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string array and the n + 1 places where its rows begin and end."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def hash_words(
    data: np.ndarray, offsets: np.ndarray, kind: WordClass
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and start bytes of the words of rows ``offsets``, and the words of each row."""
    starts, counts, hashes, _ = hash_stems(data, offsets, kind, ())
    return hashes, starts, counts


def hash_stems(
    data: np.ndarray, offsets: np.ndarray, kind: WordClass, stems: tuple[int, ...]
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start bytes of words, words of each row, hashes, and the number of the word each hash
    belongs to: first all words, then the first k bytes of all longer words for k in ``stems``."""
    n_rows = len(offsets) - 1
    inside = kind.inside[data]
    before = np.empty_like(inside)
    if len(data):
        before[0], before[1:] = False, inside[:-1]
        before[offsets[:-1][offsets[:-1] < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    if not len(starts):
        return starts, np.zeros(n_rows, np.int64), np.zeros(0, np.uint64), starts
    used = np.flatnonzero(inside)
    first = np.searchsorted(used, starts)
    lengths = np.diff(first, append=len(used))
    place = np.arange(len(used)) - np.repeat(first, lengths)
    with np.errstate(over="ignore"):
        parts = kind.values[data[used]] * _powers(int(lengths.max()))[place]
        sums = [np.add.reduceat(parts, first) + lengths.astype(np.uint64) * _STEP]
        numbers = [np.arange(len(first))]
        total = np.cumsum(parts) if stems else parts
        for k in stems:
            long = np.flatnonzero(lengths > k)
            ahead = total[first[long] + k - 1] - (total[first[long]] - parts[first[long]])
            sums.append(ahead + np.uint64(k + (1 << 40)) * _STEP)
            numbers.append(long)
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, counts, mix(np.concatenate(sums)), np.concatenate(numbers)


def pieces(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``first row, last row + 1, bytes, offsets`` of pieces of the column of about
    ``CHUNK_BYTES``; a row is never cut."""
    data, offsets = _spans(texts)
    row, n_rows = 0, len(offsets) - 1
    while row < n_rows:
        end = int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1
        end = min(max(end, row + 1), n_rows)
        part = offsets[row : end + 1]
        yield row, end, data[part[0] : part[-1]], part - part[0]
        row = end


def word_hashes(texts: pa.Array, kind: WordClass) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``first row, last row + 1, hashes, words per row`` of the column's pieces."""
    for row, end, data, offsets in pieces(texts):
        hashes, _, counts = hash_words(data, offsets, kind)
        yield row, end, hashes, counts
