"""Word hashes of whole Arrow text columns, computed with numpy over the UTF-8 bytes.

A word gets a 64-bit polynomial hash of its bytes (A-Z lower-cased), taken from prefix sums,
so no Python object is made per word. Texts are handled in blocks of about ``BLOCK`` bytes;
a longer text is cut at word boundaries and its hashes are joined again, so working memory
does not depend on the longest text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

SPACE = np.ones(256, dtype=bool)  # words [^\x20\x09-\x0D]+
SPACE[[32, 9, 10, 11, 12, 13]] = False

LETTERS = np.zeros(256, dtype=bool)  # words of digits, letters and all non-ASCII characters
LETTERS[48:58] = LETTERS[97:123] = LETTERS[128:] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWERS: list[np.ndarray] = []


def tidy() -> None:
    """Give memory that is free back to the system: a Python worker outlives its tasks, beside those of other operators."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidied(run: Callable) -> Callable:
    """``run`` for mapInArrow, with ``tidy`` at its end."""

    def tidied_run(batches):
        try:
            yield from run(batches)
        finally:
            tidy()

    return tidied_run


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        up, down = np.full(n, _BASE), np.full(n, inverse)
        up[0] = down[0] = 1
        _POWERS[:] = [np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)]
    return _POWERS[0], _POWERS[1]


def _hash_block(data: np.ndarray, cuts: np.ndarray, word: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in ``data`` and the number of words that start before each cut.

    With ``prefixes``, every word gives 1 + len(prefixes) hashes: its own, and those of its first so many bytes
    (its own again where it is not longer).
    """
    low = _LOWER[data]
    inside = word[low]
    n = len(low)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(cuts), np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = cuts[(cuts > 0) & (cuts < n)]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers(BLOCK + 1 if n <= BLOCK else n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[low] * up[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    at = np.searchsorted(starts, cuts)
    if not prefixes:
        return hashes, at
    wide = np.empty((len(hashes), 1 + len(prefixes)), np.uint64)
    wide[:, 0] = hashes
    for k, size in enumerate(prefixes):
        longer = ends - starts > size
        begins = starts[longer]
        wide[:, k + 1] = hashes
        wide[longer, k + 1] = mix((sums[begins + size] - sums[begins]) * down[begins] + np.uint64(1000 + size))
    return wide.ravel(), at * (1 + len(prefixes))


def _raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.fill_null("") if column.null_count else column
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data, offsets


def _long(data: np.ndarray, word: np.ndarray, prefixes: tuple[int, ...]) -> np.ndarray:
    parts, at = [], 0
    while at < len(data):
        to = at + BLOCK
        while to < len(data) and word[_LOWER[data[to]]]:
            to += 1
        parts.append(_hash_block(data[at:to], np.zeros(0, np.int64), word, prefixes)[0])
        at = to
    return np.concatenate(parts)


def blocks(column: pa.Array, word: np.ndarray = SPACE, prefixes: tuple[int, ...] = ()) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, word hashes, offsets into them of each row and the end); a null counts as empty."""
    data, offsets = _raw(column)
    at, rows = 0, len(offsets) - 1
    while at < rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, side="right")) - 1)
        part = data[offsets[at] : offsets[to]]
        if to == at + 1 and len(part) > BLOCK:
            hashes = _long(part, word, prefixes)
            yield at, to, hashes, np.array([0, len(hashes)])
        else:
            hashes, counts = _hash_block(part, offsets[at : to + 1] - offsets[at], word, prefixes)
            yield at, to, hashes, counts
        at = to


def shingles(hashes: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of all runs of ``width`` words of each row, and the rows' offsets into them.

    A row with fewer words has its whole run as the only one; a row without words has none.
    """
    counts = np.diff(at)
    runs = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    to = np.concatenate([[0], np.cumsum(runs)])
    total = np.full(len(hashes), np.uint64(width))
    for k in range(width):
        total *= _BASE
        total[: max(0, len(hashes) - k)] += hashes[k:]
    total = mix(total)
    row = np.repeat(np.arange(len(counts)), runs)
    out = total[np.arange(to[-1]) - to[row] + at[row]]
    for r in np.flatnonzero((counts > 0) & (counts < width)):
        out[to[r]] = _short(hashes[at[r] : at[r + 1]])
    fresh = np.ones(len(out), bool)
    for r in np.flatnonzero(runs > 1):
        own = out[to[r] : to[r + 1]]
        own.sort()
    fresh[1:] = out[1:] != out[:-1]
    fresh[to[:-1][runs > 0]] = True
    return out[fresh], np.concatenate([[0], np.cumsum(fresh)])[to]


def _short(words: np.ndarray) -> np.uint64:
    total = np.full(1, np.uint64(len(words)))
    for w in words:
        total = total * _BASE + w
    return mix(total)[0]
