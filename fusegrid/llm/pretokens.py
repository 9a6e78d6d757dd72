"""Byte-level BPE over whole columns: split with numpy, encode each distinct piece once.

The split follows the public byte-level pattern of such tokenizers: contractions,
letter runs, digit runs and other runs, each with at most one space before it, and
white space.  Which code points are letters, digits or white space is asked of the library,
as that depends on its edition of Unicode.  What the split finds is encoded by the ``tokenizers`` library itself;
only repeated pieces are looked up instead, by a 64-bit hash of their bytes that is
unique for pieces of one length up to eight bytes.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa

from .words import hash_runs, utf8

_SPACE, _LETTER, _DIGIT, _OTHER, _UNKNOWN = range(5)
# The endings that the pattern splits off behind an apostrophe.
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]


class Encoder:
    """``encode(column)`` gives the ids of all texts and how many each text has."""

    #: Pieces remembered before the memory is emptied; bounds the worker's memory
    #: to about 30 bytes for each.
    REMEMBERED = 3_000_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.kinds = np.full(0x110000, _UNKNOWN, np.uint8)
        self.forget()

    def classify(self, points: np.ndarray) -> np.ndarray:
        """The classes of code points; the library's own split tells what it takes a new one for."""
        found = self.kinds[points]
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        for c in np.unique(points[found == _UNKNOWN]).tolist():
            joins = (k for k, mate in ((_LETTER, "a"), (_DIGIT, "1"), (_OTHER, "!")) if len(split(mate + chr(c))) == 1)
            self.kinds[c] = next(joins, _SPACE)
        return self.kinds[points]

    def forget(self) -> None:
        self.keys, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.bounds, self.count = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), 0

    def learn(self, keys: np.ndarray, names: list[str]) -> None:
        """Encodes pieces and puts their ids behind those already held; keys are in order."""
        found = [x.ids for x in self.tokenizer.encode_batch_fast(names, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        held = int(self.bounds[self.count])
        need, rows = held + int(sizes.sum()), self.count + len(found)
        if need > len(self.ids):
            self.ids = np.resize(self.ids, 2 * need)
        if rows >= len(self.bounds):
            self.bounds = np.resize(self.bounds, 2 * rows)
        self.ids[held:need] = np.fromiter(itertools.chain.from_iterable(found), np.uint32, need - held)
        self.bounds[self.count + 1 : rows + 1] = held + np.cumsum(sizes)
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.rows = np.insert(self.rows, at, np.arange(self.count, rows))
        self.count = rows

    def piece_starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Byte positions at which a piece of the pattern begins."""
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        at_byte = np.flatnonzero((data & 0xC0) != 0x80)
        kind = self.classify(points)
        n = len(points)
        first = np.zeros(n + 1, bool)
        begins = np.searchsorted(at_byte, offsets[:-1][np.diff(offsets) > 0])
        first[begins] = True
        first[n] = True
        start = first[:n].copy()
        blank = points == 32
        changed = kind[1:] != kind[:-1]
        start[1:] |= changed & ~((kind[1:] != _SPACE) & blank[:-1])
        # the last white space before a visible character stands alone or leads it
        start[:-1] |= (kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~first[1:n]
        for at in np.flatnonzero((points[:-1] == 39) & start[:-1] & (kind[1:] == _LETTER) & ~first[1:n]):
            tail = "".join(map(chr, points[at + 1 : at + 3]))
            size = next((len(x) for x in CONTRACTIONS if tail.startswith(x) and not first[at + 1 : at + 1 + len(x)].any()), 0)
            if size:
                start[at + 1 : at + 1 + size] = False
                if at + 1 + size < n:
                    start[at + 1 + size] |= kind[at + 1 + size] == _LETTER
        return at_byte[start]

    def encode(self, column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = utf8(column)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        starts = self.piece_starts(data, offsets)
        sizes = np.diff(np.append(starts, len(data)))
        keys, sample, which = np.unique(hash_runs(data, starts, sizes), return_index=True, return_inverse=True)
        if self.count > self.REMEMBERED:
            self.forget()
        at = np.searchsorted(self.keys, keys)
        new = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] != keys) if self.count else np.arange(len(keys))
        if len(new):
            raw, picked = data.tobytes(), sample[new]
            self.learn(keys[new], [raw[a:b].decode() for a, b in zip(starts[picked].tolist(), (starts + sizes)[picked].tolist(), strict=True)])
            at = np.searchsorted(self.keys, keys)
        row = self.rows[at][which]
        base = self.bounds[row]
        each = self.bounds[row + 1] - base
        before = np.cumsum(each) - each
        ids = self.ids[np.repeat(base - before, each) + np.arange(int(each.sum()))]
        ends = np.append(before, len(ids))
        return ids, np.diff(ends[np.searchsorted(starts, offsets)])


_SHARED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker process's encoder, kept from task to task."""
    if path not in _SHARED:
        _SHARED[path] = Encoder(path)
    return _SHARED[path]
