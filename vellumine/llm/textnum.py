"""Words and shingles of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK = 1 << 20
#: White space as the contracts define it: space and U+0009 to U+000D.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_POW = [np.ones(1, U), np.ones(1, U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n + 1:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            a = np.full(max(n, CHUNK) + 1, base, U)
            a[0] = 1
            _POW[i] = np.cumprod(a, dtype=U)
    return _POW[0], _POW[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def texts(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about `most` bytes: first row, row after the last, bytes, offsets into them. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def words(data: np.ndarray, off: np.ndarray, apart: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the index of its first word (one more at the end)."""
    return spans(~apart[data], off)


def spans(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(inside)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[off[:-1][off[:-1] < n]] = False
    after[off[1:][off[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, the same wherever the span stands."""
    power, inverse = _powers(len(data))
    sums = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text and the index of each text's first. A text of fewer words has one: all its words."""
    counts = np.diff(first)
    n = len(h)
    out = np.zeros(max(0, n - k + 1), U)
    for i in range(k if len(out) else 0):
        out = out * U(0xFF51AFD7ED558CCD) + h[i : i + len(out)]
    out = mix(out)
    doc = np.repeat(np.arange(len(counts)), counts)
    keep = doc[: len(out)] == doc[k - 1 :] if len(out) else np.zeros(0, bool)
    made, of = out[keep], doc[: len(out)][keep]
    if len(few := np.flatnonzero((counts > 0) & (counts < k))):
        whole = []
        for d in few:
            x = 0
            for w in h[first[d] : first[d + 1]].tolist():
                x = (x * 0xC4CEB9FE1A85EC53 + w) & 0xFFFFFFFFFFFFFFFF
            whole.append((x + int(counts[d])) & 0xFFFFFFFFFFFFFFFF)
        made, of = np.concatenate([made, mix(np.array(whole, U) ^ U(0xA0761D6478BD642F))]), np.concatenate([of, few])
        order = np.argsort(of, kind="stable")
        made, of = made[order], of[order]
    return made, np.searchsorted(of, np.arange(len(first)))
