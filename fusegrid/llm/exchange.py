"""Asking all documents about a key: blocks of documents meet buckets of hashes.

Some statistics concern every n-gram of every document: in how many documents it
occurs, how often, in which it comes first.  As rows of their own, n-grams would
fill the disks.  Here documents are dealt into blocks of bounded size; a block sends
each of its distinct keys once, pre-aggregated, sorted and packed, to the bucket that
the key's top bits name; the bucket works out one value for each key over all
blocks; and each block gets back the values of its own keys, in its own order.

    docs -> block: distinct keys, packed -> bucket: one value a key -> block: result

The parts of all blocks that a task reads travel together, one row a bucket, so there
are as many rows as Spark's own shuffle has segments, tasks times buckets; buckets are
sized by what a worker can hold, whatever the blocks are.

A key that many documents hold costs one entry a block, and a bucket is an even
share of the range of keys, so no task gathers more than its share.  Blocks are dealt
by id and text, so rows with one id or without an id spread as others do.  The documents'
exchange is the same for both visits to a block, so Spark reuses it.  All steps are
deterministic, so whatever a lost executor held can be computed again.

Limits: a text is never divided.  It takes some forty times its size in the worker
that reads it, so texts should stay below a fortieth of a worker's memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text of a block, about; a block's arrays take some twenty times this at most.
BLOCK_BYTES = 8 << 20
#: Text whose keys one bucket holds, about; its arrays take some ten times this.
BUCKET_BYTES = 16 << 20
#: Bits of a filter key beyond those that number all keys: one key in 2**12 or so is
#: taken for another one, which a filter may do.
SPARE_BITS = 12
#: Packed bytes that a task holds before it gives rows out.
HELD_BYTES = 24 << 20
ANSWER = "block int, bucket int, places binary, found binary"
PACKED = "bucket int, blocks array<int>, counts array<int>, keys array<binary>, vals array<binary>"


def squeeze(values: np.ndarray) -> bytes:
    """Packs integers by byte planes; give differences where values are sorted."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    used = 8
    while used and not planes[used - 1].any():
        used -= 1
    return bytes([used]) + zstandard.ZstdCompressor(level=1).compress(planes[:used].tobytes())


def expand(raw: bytes, count: int) -> np.ndarray:
    planes = np.zeros((8, count), np.uint8)
    if raw[0] and count:
        planes[: raw[0]] = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), np.uint8).reshape(raw[0], count)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


def squeeze_sorted(values: np.ndarray) -> bytes:
    return squeeze(np.diff(values, prepend=values[:1] * 0))


def expand_sorted(raw: bytes, count: int) -> np.ndarray:
    return np.cumsum(expand(raw, count), dtype=np.uint64)


@dataclass(frozen=True)
class Layout:
    """How many blocks and buckets there are, and how many bits a filter key has."""

    blocks: int
    buckets: int
    bits: int

    def edges(self, bits: int) -> np.ndarray:
        """Lower bounds of the buckets in the range of keys of ``bits`` bits."""
        return np.array([(k << bits) // self.buckets for k in range(self.buckets)], np.uint64)


def layout(docs: DataFrame, text: str = "text") -> Layout:
    """The layout for the bytes of a string column."""
    total = int(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0)
    return Layout(max(1, -(-total // BLOCK_BYTES)), max(1, -(-total // BUCKET_BYTES)), min(64, total.bit_length() + SPARE_BITS))


@dataclass
class Asked:
    """What a block asks: sorted keys (equal ones differ in a value), values of its own for each, and its state."""

    keys: np.ndarray
    values: tuple[np.ndarray, ...] = ()
    state: dict = field(default_factory=dict)


#: Gets a bucket's keys in order with the block and the values of each entry (equal keys
#: are adjacent, by block); gives a mask of the entries to answer and the answers.
Reduce = Callable[[np.ndarray, np.ndarray, list[np.ndarray]], tuple[np.ndarray, np.ndarray]]


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of equal neighbours, and each entry's run."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often each occurs."""
    keys = np.sort(keys)
    first, _ = runs(keys)
    return keys[first], np.diff(np.append(first, len(keys)))


def deal(docs: DataFrame, plan: Layout) -> DataFrame:
    """Adds the column ``block`` and brings the rows of a block together."""
    spread = F.xxhash64("doc_id", "text")
    return docs.withColumn("block", F.pmod(spread, F.lit(plan.blocks)).cast("int")).repartition("block")


class Packer:
    """Collects the parts of several blocks and gives them out as one row a bucket."""

    def __init__(self, bounds: np.ndarray):
        self.bounds = bounds
        self.rows: dict[int, tuple[list, list, list, list]] = {}
        self.size = 0

    def add(self, block: int, asked: Asked) -> None:
        cut = np.append(np.searchsorted(asked.keys, self.bounds), len(asked.keys))
        for k in np.flatnonzero(np.diff(cut)).tolist():
            a, b = int(cut[k]), int(cut[k + 1])
            blocks, counts, keys, vals = self.rows.setdefault(k, ([], [], [], []))
            blocks.append(block)
            counts.append(b - a)
            keys.append(squeeze_sorted(asked.keys[a:b]))
            vals += [squeeze(v[a:b]) for v in asked.values]
            self.size += len(keys[-1]) + sum(map(len, vals[len(vals) - len(asked.values) :]))

    def drain(self) -> pa.RecordBatch:
        names = sorted(self.rows)
        kinds = [pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.binary())]
        columns = [pa.array([self.rows[k][i] for k in names], kind) for i, kind in enumerate(kinds)]
        self.rows, self.size = {}, 0
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), *columns], ["bucket", "blocks", "counts", "keys", "vals"])


def _one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The blocks of a partition that is sorted by block."""
    number, held = None, []
    for batch in batches:
        blocks = batch["block"].to_numpy()
        first, _ = runs(blocks)
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(blocks)], strict=True):
            if held and blocks[a] != number:
                yield number, pa.Table.from_batches(held)
                held = []
            number = int(blocks[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield number, pa.Table.from_batches(held)


def _asker(emit: Callable[[pa.Table], Asked], bounds: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(bounds)
        for block, table in _one_by_one(batches):
            packer.add(block, emit(table))
            if packer.size >= HELD_BYTES:
                yield packer.drain()
        if packer.rows:
            yield packer.drain()

    return run


def gather(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray, list]:
    """A bucket's keys, values and blocks part by part, their order, and (block, size) of the parts."""
    parts = []
    for blocks, counts, keys, vals in zip(*(table[c].to_pylist() for c in ("blocks", "counts", "keys", "vals")), strict=True):
        width = len(vals) // len(blocks)
        parts += [(b, n, keys[i], vals[i * width : (i + 1) * width]) for i, (b, n) in enumerate(zip(blocks, counts, strict=True))]
    parts.sort(key=lambda x: x[0])
    keys = np.concatenate([expand_sorted(k, n) for _, n, k, _ in parts])
    vals = [np.concatenate([expand(v[i], n) for _, n, _, v in parts]) for i in range(len(parts[0][3]))]
    block = np.repeat(np.array([b for b, _, _, _ in parts], np.int32), [n for _, n, _, _ in parts])
    return keys, vals, block, np.argsort(keys, kind="stable"), [(b, n) for b, n, _, _ in parts]


def _reducer(reduce: Reduce) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        keys, vals, block, order, parts = gather(table)
        mask, answer = reduce(keys[order], block[order], [v[order] for v in vals])
        full, value = np.zeros(len(keys), bool), np.zeros(len(keys), np.uint64)
        full[order], value[order] = mask, answer
        bucket, at = table["bucket"][0].as_py(), 0
        rows = []
        for b, n in parts:
            places = np.flatnonzero(full[at : at + n])
            if len(places):
                rows.append((b, bucket, squeeze_sorted(places.astype(np.uint64)) + len(places).to_bytes(4, "little"), squeeze(value[at : at + n][places])))
            at += n
        names = ("block", "bucket", "places", "found")
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.table({k: pa.array([r[i] for r in rows], kind) for i, (k, kind) in enumerate(zip(names, kinds, strict=True))})

    return run


def received(keys: np.ndarray, table: pa.Table, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the answered keys among a block's own keys, in order, and the answers."""
    start = np.searchsorted(keys, bounds)
    places, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for bucket, p, f in sorted(zip(*(table[c].to_pylist() for c in ("bucket", "places", "found")), strict=True)):
        n = int.from_bytes(p[-4:], "little")
        places.append(expand_sorted(p[:-4], n).astype(np.int64) + start[bucket])
        found.append(expand(f, n))
    return np.concatenate(places), np.concatenate(found)


def ask(blocks: DataFrame, emit: Callable[[pa.Table], Asked], reduce: Reduce, finish: Callable[[pa.Table, Asked, np.ndarray, np.ndarray], pa.Table], schema: str, plan: Layout, bits: int = 64) -> DataFrame:
    """The whole exchange over keys of ``bits`` bits; ``finish`` gets a block, what it asked, and the answers."""
    bounds = plan.edges(bits)

    def last(block: pa.Table, got: pa.Table) -> pa.Table:
        asked = emit(block)
        return finish(block, asked, *received(asked.keys, got, bounds))

    asked = blocks.sortWithinPartitions("block").mapInArrow(_asker(emit, bounds), PACKED)
    told = asked.groupBy("bucket").applyInArrow(_reducer(reduce), ANSWER)
    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(last, schema)
