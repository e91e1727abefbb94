"""Byte-level text work on Arrow columns with numpy: words, word hashes and shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
SHINGLE = 5

_U = np.uint64
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(20_240_229).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_STEP = 0x9E3779B97F4A7C15
_LANES = np.random.default_rng(7).integers(1, 2**63, SHINGLE, dtype=np.uint64) * _U(2) + _U(1)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A well-mixed bijection of 64-bit integers (the finaliser of splitmix64)."""
    x = x + _U((seed * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def columns(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and the n + 1 offsets of its rows; null is empty."""
    a = batch.column(i).cast(pa.large_binary()).fill_null(b"")
    off = np.frombuffer(a.buffers()[1], dtype=np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], dtype=np.uint8) if a.buffers()[2] else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def pieces(data: np.ndarray, off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of about limit bytes; a longer row is a run of its own."""
    n, a = len(off) - 1, 0
    while a < n:
        z = max(a + 1, int(np.searchsorted(off, off[a] + limit, side="right")) - 1)
        yield a, min(z, n)
        a = min(z, n)


def _hash_words(data: np.ndarray, cuts: np.ndarray, bytes_of: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of data (A-Z folded, broken at white space and at cuts) and the place of their first byte.

    With bytes_of, only that many bytes of a word count.
    """
    fold = _FOLD[data]
    word = ~_SPACE[fold]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    cuts = cuts[cuts < len(data)]
    begin[cuts] = word[cuts]
    first = np.flatnonzero(begin)
    if not len(first):
        return np.zeros(0, np.uint64), first
    last = np.empty_like(first)
    gaps = np.flatnonzero(~word)
    stop = np.searchsorted(gaps, first)
    last[:] = len(data)
    ok = stop < len(gaps)
    last[ok] = gaps[stop[ok]]
    last[:-1] = np.minimum(last[:-1], first[1:])
    if bytes_of:
        last = np.minimum(last, first + bytes_of)
    # each byte and its place in the word are mixed before they are summed, so that no words are made to share a sum
    place = np.arange(len(data), dtype=np.uint64)
    from_first = np.repeat(first.astype(np.uint64), np.diff(np.concatenate([first, [len(data)]])))
    place[first[0] :] -= from_first
    place *= _U(_STEP)
    place += _BYTE[fold]
    place ^= place >> _U(29)
    place *= _U(0xBF58476D1CE4E5B9)
    place ^= place >> _U(32)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(place, out=total[1:])
    return mix(total[last] - total[first] + (last - first).astype(np.uint64)), first


def word_hashes(data: np.ndarray, off: np.ndarray, bytes_of: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of rows, and the n + 1 offsets of the rows among them. Very long rows go by slices."""
    if len(data) <= 2 * SLICE_BYTES:
        h, first = _hash_words(data, off[1:-1], bytes_of)
        return h, np.searchsorted(first, off)
    out, counts = [], []
    for a, z in zip(off[:-1], off[1:], strict=True):
        got, at = 0, int(a)
        while at < z:
            end = min(at + SLICE_BYTES, int(z))
            while end < z:
                gaps = np.flatnonzero(_SPACE[data[end : end + SLICE_BYTES]])
                end = end + int(gaps[0]) if len(gaps) else min(end + SLICE_BYTES, int(z))
                if len(gaps):
                    break
            h, _ = _hash_words(data[at:end], np.zeros(0, np.int64), bytes_of)
            out.append(h)
            got, at = got + len(h), end
        counts.append(got)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(counts)])


def shingles(h: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row: SHINGLE words in a row, or the whole sequence where there are fewer."""
    n = len(h) - SHINGLE + 1
    if n > 0:
        s = np.zeros(n, np.uint64)
        for k in range(SHINGLE):
            s += h[k : k + n] * _LANES[k]
        s = mix(s, 1)
    out = []
    for a, z in zip(off[:-1], off[1:], strict=True):
        if z - a >= SHINGLE:
            out.append(np.unique(s[a : z - SHINGLE + 1]))
        elif z > a:
            out.append(mix((h[a:z] * _LANES[: z - a]).sum(dtype=np.uint64)[None] + _U(z - a), 2))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_sets(batch: pa.RecordBatch, i: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and shingle set of each row of a text column."""
    data, off = columns(batch, i)
    for a, z in pieces(data, off):
        h, at = word_hashes(data[off[a] : off[z]], off[a : z + 1] - off[a])
        yield from enumerate(shingles(h, at), a)
