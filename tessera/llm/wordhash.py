"""Words of an Arrow batch of texts as 64-bit hashes, by numpy over the batch's own bytes: no Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_rng = np.random.Generator(np.random.PCG64(20240607))
_odd = lambda n: _rng.integers(0, 2**64, n, dtype=np.uint64) | np.uint64(1)
#: Tabulation hashing: a random long for each byte value at each of the 256 places of a block of a word.
TABLE = _rng.integers(0, 2**64, (256, 256), dtype=np.uint64)
STEP, LENGTH = _odd(64), _odd(1)[0]
#: A table of its own for the second of two hashes.
SECOND = _rng.integers(0, 2**64, (256, 256), dtype=np.uint64)
BLOCK = _odd(1)[0]
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SLICE_BYTES = 4_000_000


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every bit of the result hangs on every bit of x."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets into the bytes) of runs of rows of about `size` bytes; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offs, data = texts.buffers()
    off = np.frombuffer(offs, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, side="right")) - 1)
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def spans(raw: np.ndarray, off: np.ndarray, gap: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and for each document the number of its first word (one more entry than documents).
    `gap`: for each byte value whether it separates words."""
    solid = ~gap[raw]
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    edge = off[:-1][off[:-1] < off[1:]]
    start[edge] = solid[edge]
    end[off[1:][off[:-1] < off[1:]] - 1] = solid[off[1:][off[:-1] < off[1:]] - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, off)


def _places(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words cut into blocks of 256 bytes: for each byte its place in its block, and where each block begins."""
    mark = np.zeros(len(raw), dtype=bool)
    mark[starts] = True
    size = ends - starts
    if len(size) and size.max() > 256:
        long = np.flatnonzero(size > 256)
        mark[np.concatenate([np.arange(starts[k] + 256, ends[k], 256) for k in long])] = True
    block = np.flatnonzero(mark)
    place = np.arange(len(raw)) - block[np.maximum(np.cumsum(mark) - 1, 0)]
    return place & 255, block


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, *tables: np.ndarray) -> np.ndarray | tuple[np.ndarray, ...]:
    """A hash of each word, or one for each of `tables`. A block of 256 bytes is summed from the table; the blocks of a longer word
    are chained through the mixer, so that no exchange of bytes between blocks cancels out."""
    if not len(starts):
        empty = np.empty(0, dtype=np.uint64)
        return tuple(empty for _ in tables) if len(tables) > 1 else empty
    place, block = _places(raw, starts, ends)
    at = np.searchsorted(block, starts)
    size, long = (ends - starts).astype(np.uint64), np.flatnonzero(ends - starts > 256)
    stop = np.minimum(ends, starts + 256)
    edges = np.empty(2 * len(block), dtype=np.int64)
    edges[0::2] = block
    edges[1::2] = block + 256
    edges[2 * at + 1] = stop
    if len(long):
        last = np.append(at[1:], len(block))[long] - 1
        edges[2 * last + 1] = ends[long]
    out = []
    for table in tables or (TABLE,):
        value = np.append(table[place, raw], np.uint64(0))
        sums = np.add.reduceat(value, edges)[0::2]
        h = sums[at]
        for k in long:
            for x in sums[at[k] + 1 : at[k] + -(-int(size[k]) // 256)]:
                h[k : k + 1] = mixed(h[k : k + 1] * BLOCK) + x
        out.append(mixed(h + size * LENGTH))
    return tuple(out) if len(out) > 1 else out[0]


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word sequences that start at each word (as if the words were one document)."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out += h[j : j + n] * STEP[j]
    return mixed(out + np.full(1, k, dtype=np.uint64) * LENGTH)
