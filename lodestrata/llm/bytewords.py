"""Words of many texts at once, and 64-bit hashes of them, from Arrow's UTF-8 buffers with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that are part of words: all but ASCII white space; or letters, digits and whatever is not ASCII.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 32

U = np.uint64
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) <= n:
        size = max(n + 1, 1 << 20)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits all depend on all bits."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def chunks(texts: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of rows in them) of runs of about ``limit`` bytes; a null text is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(n, max(end, row + 1))
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def spans(data: np.ndarray, offsets: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, rows) of all words; ``part``: which bytes are part of words."""
    inside = part[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(starts)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(offsets, starts, side="right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words with A to Z folded: a polynomial of random values of the bytes, mixed with the length."""
    up, down = _powers(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[FOLD[data]] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of ``size`` words; a row with fewer words has one, of all its words."""
    starts, ends, rows = spans(data, offsets, NOT_SPACE)
    h = hashes(data, starts, ends)
    if not len(h):
        return h, rows
    factors = mix(np.arange(1, size + 1, dtype=np.uint64)) | U(1)
    counts = np.bincount(rows, minlength=len(offsets) - 1)
    n = len(h) - size + 1
    out_h, out_r = [], []
    if n > 0:
        total = np.zeros(n, dtype=np.uint64)
        for k in range(size):
            total += h[k : n + k] * factors[k]
        whole = rows[:n] == rows[size - 1 :]
        out_h.append(mix(total[whole]))
        out_r.append(rows[:n][whole])
    first = np.cumsum(counts) - counts
    for row in np.flatnonzero((counts > 0) & (counts < size)):
        own = h[first[row] : first[row] + counts[row]]
        total = (own * factors[: len(own)]).sum(dtype=np.uint64, keepdims=True)
        out_h.append(mix(total + np.array([len(own)], dtype=np.uint64) * U(0xA24BAED4963EE407)))
        out_r.append(np.array([row]))
    return np.concatenate(out_h), np.concatenate(out_r)


def sets(texts: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text, in order."""
    for first, data, offsets in chunks(texts):
        h, rows = shingles(data, offsets, size)
        order = np.argsort(rows, kind="stable")
        h, rows = h[order], rows[order]
        cuts = np.searchsorted(rows, np.arange(len(offsets)))
        for i in range(len(offsets) - 1):
            yield first + i, np.unique(h[cuts[i] : cuts[i + 1]])
