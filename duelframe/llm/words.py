"""Words of whole texts as arrays: runs of bytes other than space and \\x09-\\x0D, A-Z lower-cased."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 21  # bytes handled at once; longer input is cut between words

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.default_rng(0x5EED)
_BYTE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ONE = np.uint64(1)


def releasing(task):
    """A task's iterator that gives memory back when it ends: its worker stays alive, idle, beside those of later tasks."""

    @functools.wraps(task)
    def run(batches):
        yield from task(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit of 64-bit values over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _STEP, np.uint64)
    out[:1] = _ONE
    return np.multiply.accumulate(out)


def _pieces(data: bytes) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        yield at, end
        at = end


def words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hashes, starts, ends) of the words of ``data``, in order."""
    out = []
    for at, end in _pieces(data):
        raw = np.frombuffer(data, np.uint8, end - at, at)
        inside = np.r_[False, ~_SPACE[raw], False]
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edge[::2], edge[1::2]
        if not len(starts):
            continue
        sizes = ends - starts
        first = np.cumsum(sizes) - sizes
        place = np.arange(sizes.sum()) - np.repeat(first, sizes)  # of a byte in its word
        chars = raw[inside[1:-1]]
        chars = _LOWER[chars]
        sums = np.add.reduceat(_BYTE[chars] * _powers(int(sizes.max()))[place], first)
        out.append((mix(sums + sizes.astype(np.uint64) * _STEP), starts + at, ends + at))
    if not out:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def slices(ids: pa.Array, texts: pa.Array, size: int = PIECE) -> Iterator[tuple[list, list[bytes]]]:
    """Rows in slices of about ``size`` bytes of whole texts; null counts as empty."""
    keys: list = []
    part: list[bytes] = []
    held = 0
    for key, text in zip(ids, texts, strict=True):
        keys.append(key.as_py())
        part.append((text.as_py() or "").encode())
        held += len(part[-1])
        if held >= size:
            yield keys, part
            keys, part, held = [], [], 0
    if keys:
        yield keys, part


def words_of(texts: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, word lengths, bounds): text i has the words bounds[i] to bounds[i + 1]."""
    texts = list(texts)
    hashes, starts, ends = words(b"\n".join(texts))
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return hashes, ends - starts, np.searchsorted(starts, begins)


def distinct(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct values, how often each occurs, bounds), text by text."""
    values = values.copy()
    new = np.ones(len(values), bool)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        values[a:b].sort()
    new[1:] = values[1:] != values[:-1]
    new[bounds[:-1][bounds[:-1] < len(values)]] = True
    at = np.flatnonzero(new)
    return values[at], np.diff(np.r_[at, len(values)]), np.searchsorted(at, bounds)


def decimal_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 to n - 1, right-aligned, and how many."""
    wide = len(str(max(n - 1, 0)))
    values = np.arange(n)[:, None] // 10 ** np.arange(wide - 1, -1, -1)
    return (values % 10 + 48).astype(np.uint8), np.maximum((values > 0).sum(1), 1)


def decimals(ids: np.ndarray, marks: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> bytes:
    """The ids in decimal, each followed by its mark (one byte)."""
    digits, length = table
    used = np.arange(digits.shape[1] + 1) >= (digits.shape[1] - length[ids])[:, None]
    return np.column_stack([digits[ids], marks])[used].tobytes()
