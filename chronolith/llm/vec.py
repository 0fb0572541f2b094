"""Numpy helpers that run inside tasks: word slices and 64-bit word and shingle hashes of whole texts, a few MB at a time.

Words are the runs of bytes other than 0x20 and 0x09-0x0D, after lower-casing A-Z. Texts are never cut: a text longer than
a slice is hashed piecewise at word ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
MULT = U64(0x9E3779B97F4A7C15 | 1)
_INVERSE = U64(pow(int(MULT), -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_SHINGLE = np.array([0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165], U64)
SLICE = 1 << 19
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection that spreads every input bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, SLICE + 4096)
        for name, base in (("up", MULT), ("down", _INVERSE)):
            powers = np.full(size, base, U64)
            powers[0] = 1
            _powers[name] = np.multiply.accumulate(powers)
    return _powers["up"], _powers["down"]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a null-free string column and its n + 1 offsets, from 0."""
    column = column.cast(pa.large_binary()) if column.type not in (pa.string(), pa.binary(), pa.large_string(), pa.large_binary()) else column
    wide = column.type in (pa.large_string(), pa.large_binary())
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(batch, bytes, offsets) of runs of rows with about `most` bytes of the column `text`; a longer text is a run of its own."""
    for batch in batches:
        raw, off = utf8(batch.column("text"))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
            yield batch.slice(at, to - at), raw[off[at] : off[to]], off[at : to + 1] - off[at]
            at = to


def solid(raw: np.ndarray) -> np.ndarray:
    """Which bytes are part of a word."""
    return ~_SPACE[raw]


def words(raw: np.ndarray, off: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word, and the n + 1 word offsets of the texts. lower: A-Z are lower-cased first."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = solid(raw)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.empty(n, bool)
    before[0], before[1:] = True, ~inside[:-1]
    starts = np.flatnonzero(inside & (before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, ~inside[1:]
    ends = np.flatnonzero(inside & (after | edge[1:])) + 1
    return hashes(_LOWER[raw] if lower else raw, starts, ends), starts, ends, np.searchsorted(starts, off)


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte slices, which must ascend and not overlap."""
    out = np.empty(len(starts), U64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + SLICE, "right")))
        base, end = starts[at], ends[to - 1]
        up, down = _table(end - base + 1)
        total = np.zeros(end - base + 1, U64)
        np.cumsum((raw[base:end].astype(U64) + U64(1)) * up[: end - base], out=total[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = mix((total[e] - total[s]) * down[s] + (e - s).astype(U64) * U64(0xC2B2AE3D27D4EB4F))
        at = to
    return out


def runs(raw: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all runs of n bytes, in order."""
    if len(raw) < n:
        return np.zeros(0, U64)
    up, down = _table(len(raw) + 1)
    total = np.zeros(len(raw) + 1, U64)
    np.cumsum((raw.astype(U64) + U64(1)) * up[: len(raw)], out=total[1:])
    return mix((total[n:] - total[:-n]) * down[: len(raw) - n + 1])


def shingles(h: np.ndarray, woff: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text in order, and their n + 1 offsets. A text of fewer words has one, its whole sequence; one without words has none."""
    count = np.diff(woff)
    size = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    soff = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(int(soff[-1]), U64)
    long_ = count >= k
    if len(h) >= k:
        run = np.zeros(len(h) - k + 1, U64)
        for j in range(k):
            run += h[j : len(h) - k + 1 + j] * _SHINGLE[j]
        at = np.repeat(woff[:-1][long_] - np.concatenate([[0], np.cumsum(size[long_])[:-1]]), size[long_]) + np.arange(int(size[long_].sum()))
        whole = mix(run[at])
    else:
        whole = np.zeros(0, U64)
    place = np.repeat(long_, size)
    out[place] = whole
    for i in np.flatnonzero(~long_ & (count > 0)):
        own = h[woff[i] : woff[i + 1]]
        out[soff[i]] = mix(np.array([np.sum(own * _SHINGLE[: len(own)], dtype=U64) + U64(len(own))], U64))[0]
    return out, soff
