"""Words and shingles of whole texts as 64-bit hashes, by array operations.

A text is worked on as UTF-8 bytes in blocks of bounded size, cut between words, so a text of
any length needs memory for its hashes only. The functions travel to the executors by value.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark.cloudpickle import register_pickle_by_value

BLOCK = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of a word that ends at ASCII white space: all but 0x20 and 0x09-0x0D.
SPACED = np.ones(256, bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False
#: Bytes of a word of letters and digits: 0-9, a-z and all of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: Bytes of a line without its line feed.
NO_BREAK = np.ones(256, bool)
NO_BREAK[10] = False


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse, modulo 2**64, for i < n; kept for the largest n so far."""
    kept = powers.__dict__.get("kept")
    if kept is None or len(kept[0]) < n:
        def row(base: int) -> np.ndarray:
            out = np.full(max(n, BLOCK + 1), base, np.uint64)
            out[0] = 1
            return np.cumprod(out, dtype=np.uint64)

        kept = powers.__dict__["kept"] = row(BASE), row(pow(BASE, -1, 1 << 64))
    return kept


def buffers(array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string array without nulls."""
    import pyarrow as pa

    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    if not len(array) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32, len(array) + 1, array.offset * (8 if wide else 4))
    off = off.astype(np.int64)
    return np.frombuffer(data, np.uint8, int(off[-1] - off[0]), int(off[0])), off - off[0]


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, lower: bool = True):
    """Hashes of all words, each text's first word in them, and where words start and end."""
    hashes, starts, ends = [], [], []
    total, at = len(data), 0
    firsts = offsets[:-1]
    while at < total:
        end = min(total, at + BLOCK)
        while end < total:  # a cut in front of a byte that is in no word, or of a text
            edge = firsts[np.searchsorted(firsts, end)] if end <= firsts[-1] else total
            step = min(int(edge), end + BLOCK)
            gap = np.flatnonzero(~kind[LOWER[data[end:step]]] if lower else ~kind[data[end:step]])
            if len(gap):
                end += int(gap[0])
                break
            end = step
            if step == edge:
                break
        x = LOWER[data[at:end]] if lower else data[at:end]
        inside = kind[x]
        edges = np.zeros(len(x) + 1, bool)
        edges[0] = edges[-1] = True
        lo, hi = np.searchsorted(firsts, (at, end))
        edges[firsts[lo:hi] - at] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | edges[1:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | edges[1:-1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = powers(len(x) + 1)
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[: len(x)], out=sums[1:])
        hashes.append(mix((sums[e] - sums[s]) * down[s]))
        starts.append(s + at)
        ends.append(e + at)
        at = end
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    starts = join(starts, np.int64)
    return join(hashes, np.uint64), np.searchsorted(starts, offsets), starts, join(ends, np.int64)


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` words; all words as one where there are fewer."""
    n = min(size, len(h))
    if not n:
        return h[:0]
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out *= np.uint64(BASE)
        out += h[i : len(h) - n + 1 + i]
    return mix(out + np.uint64(n))


def slices(batch, column: str, limit: int = 4 << 20):
    """Parts of an Arrow batch with about ``limit`` bytes of text, or one longer text, each."""
    sizes = np.cumsum(np.diff(buffers(batch.column(column))[1]))
    at = 0
    while at < batch.num_rows:
        before = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, before + limit, "right")))
        yield batch.slice(at, end - at)
        at = end


register_pickle_by_value(sys.modules[__name__])
