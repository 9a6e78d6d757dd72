"""Vectorised word splitting and hashing over Arrow string columns.

Every Arrow-based operator of this subpackage reads texts through
:class:`Words`.  It works on the UTF-8 bytes of a whole column at once, so the
cost per word is a few nanoseconds and no Python object is made per word.

Word hashes are 64 bits wide: eight bytes at a time are mixed into the length.
Shingle hashes are mixed sums of word hashes times random odd codes from a
splitmix64 generator, the same on every executor and in every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; temporaries take about forty times this.
SLICE_BYTES = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def codes(seed: int, count: int) -> np.ndarray:
    """``count`` pseudo-random 64-bit values that depend on ``seed`` alone."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed << 32))


_SHINGLE = codes(2, 4096) | np.uint64(1)
_EVERY = np.arange(256)
_UPPER = (_EVERY >= 65) & (_EVERY <= 90)
_LOWERED = np.where(_UPPER, _EVERY + 32, _EVERY).astype(np.uint8)

#: Bytes of words split at ASCII white space.
SPACED = ~((_EVERY == 32) | ((_EVERY >= 9) & (_EVERY <= 13)))
#: Bytes of words made of ASCII letters, digits and everything beyond ASCII.
ALNUM = (_EVERY >= 128) | ((_EVERY >= 48) & (_EVERY <= 57)) | ((_EVERY >= 97) & (_EVERY <= 122)) | _UPPER


def hash_runs(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte run; runs of one length up to eight bytes never collide."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    out = sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    rest, at, rows = sizes, starts, None
    while len(rest):
        word = eight[at] & _KEEP[np.minimum(rest, 8)]
        if rows is None:
            out = mix(out + word)
        else:
            out[rows] = mix(out[rows] * np.uint64(0xD6E8FEB86659FD93) + word)
        longer = np.flatnonzero(rest > 8)
        rows = longer if rows is None else rows[longer]
        rest, at = rest[longer] - 8, at[longer] + 8
    return out


_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values and ``len + 1`` offsets into them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges that hold at most ``most`` bytes each, or a single row."""
    at, rows = 0, len(offsets) - 1
    while at < rows:
        end = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        end = min(rows, max(at + 1, end))
        yield at, end
        at = end


class Words:
    """The words of consecutive texts.

    ``starts``/``ends`` are byte positions in ``data``; words of text ``i`` are
    those from ``first[i]`` up to ``first[i + 1]``; ``hashes`` has one value a word.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, lower: bool):
        inside = kind[data]
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        bounds = offsets[:-1]
        bounds = bounds[bounds < len(data)]
        before[bounds] = False
        self.starts = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[-1:] = False
        after[:-1] = inside[1:]
        lasts = offsets[1:] - 1
        after[lasts[lasts >= 0]] = False
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.data = data
        self.first = np.searchsorted(self.starts, offsets)
        sizes = self.ends - self.starts
        self.hashes = hash_runs(_LOWERED[data] if lower else data, self.starts, sizes)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Start words and hashes of all windows of ``size`` words in one text."""
        at = window_starts(self.first, size)
        return at, shingle(self.hashes, size)[at]


def window_starts(first: np.ndarray, size: int) -> np.ndarray:
    """Word positions at which ``size`` words of the same text begin."""
    total = int(first[-1])
    ok = np.ones(total, bool)
    for back in range(1, min(size, 64)):
        last = first[1:] - back
        ok[last[last >= first[:-1]]] = False
    if size > 64:
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        ok = np.arange(total) + size <= first[1:][text]
    return np.flatnonzero(ok)


def shingle(hashes: np.ndarray, size: int) -> np.ndarray:
    """For each word the hash of the ``size`` words from there, 0 near the end."""
    total = np.zeros(len(hashes), np.uint64)
    count = len(hashes) - size + 1
    if count > 0:
        part = total[:count]
        part += np.uint64(size)
        for k in range(size):
            part += hashes[k : k + count] * _SHINGLE[k % 4096]
        total[:count] = mix(part)
    return total


def pieces(table: pa.Table | pa.RecordBatch, text: str = "text", kind: np.ndarray = SPACED, lower: bool = False, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, Words]]:
    """Row ranges of a batch with their words."""
    data, offsets = utf8(table.column(text))
    for at, end in slices(offsets, most):
        part = offsets[at : end + 1]
        yield at, end, Words(data[part[0] : part[-1]], part - part[0], kind, lower)

