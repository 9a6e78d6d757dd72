"""Benchmark decontamination by winnowing.

The hash of every ``GRAM`` consecutive words is computed, and of each
``window - GRAM + 1`` consecutive hashes the smallest is kept as a fingerprint.
Two texts that share ``window`` words in a row therefore share a fingerprint.
Documents' fingerprints are joined with those of the benchmark; around each hit
the windows of ``window`` words are compared with the benchmark's, by hash and then
word for word.  Items of fewer than ``window`` words are one window of their own
length, to which the guarantee does not apply; they are looked up at every place.

The benchmark is handed to all executors in blocks of at most ``block_bytes`` of
text, a bound that is checked by a count first; each block meets all documents in
one pass without a shuffle, and several blocks' hits are merged by document.

Defined results: a null text has no words and no hits; items without words, and
items whose id is null, match nothing; rows with equal item_id are one item;
repeated documents are judged one by one; an empty benchmark leaves all clean;
columns other than the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import ALNUM, Words, pieces, shingle, window_starts

GRAM = 5
SCHEMA = "doc_id bigint, version bigint, n_words bigint, spans array<struct<first: bigint, last: bigint>>, items array<string>"


def fingerprints(hashes: np.ndarray, first: np.ndarray, window: int) -> np.ndarray:
    """Word positions of the winnowed grams of all texts that have ``window`` words."""
    grams, width = shingle(hashes, GRAM), window - GRAM + 1
    at = window_starts(first, window)
    if not len(at):
        return at
    best = at.copy()
    for k in range(1, width):
        best = np.where(grams[at + k] <= grams[best], at + k, best)
    return np.unique(best)


class Benchmark:
    """One block of items: its fingerprints, and its windows by length and hash."""

    def __init__(self, rows: list[tuple[str, str]], window: int):
        self.window, self.names = window, sorted({i for i, _ in rows})
        place = {x: k for k, x in enumerate(self.names)}
        prints, windows = [], {}
        for name, text in rows:
            raw = np.frombuffer(text.encode(), np.uint8)
            w = Words(raw, np.array([0, len(raw)]), ALNUM, True)
            n = len(w.hashes)
            if not n:
                continue
            size = min(window, n)
            if n >= window:
                prints.append(shingle(w.hashes, GRAM)[fingerprints(w.hashes, w.first, window)])
            words = self.words(w, 0, n)
            for at, h in zip(*w.windows(size), strict=True):
                windows.setdefault(size, {}).setdefault(int(h), {}).setdefault(b" ".join(words[at : at + size]), set()).add(place[name])
        self.prints = np.unique(np.concatenate(prints)) if prints else np.zeros(0, np.uint64)
        self.windows = {size: (np.array(sorted(found), np.uint64), found) for size, found in windows.items()}

    @staticmethod
    def words(w: Words, begin: int, end: int) -> list[bytes]:
        raw = w.data[w.starts[begin] : w.ends[end - 1]].tobytes().lower()
        base = w.starts[begin]
        return [raw[a - base : b - base] for a, b in zip(w.starts[begin:end].tolist(), w.ends[begin:end].tolist(), strict=True)]

    def hits(self, w: Words) -> list[tuple[int, int, set[int]]]:
        """(first word, end, items) of every occurring window, in order of its start."""
        out = []
        for size, (known, found) in self.windows.items():
            at = window_starts(w.first, size)
            if size == self.window:
                marks = fingerprints(w.hashes, w.first, size)
                marks = marks[_member(shingle(w.hashes, GRAM)[marks], self.prints)]
                near = np.unique(marks[:, None] - np.arange(size - GRAM + 1))
                at = np.intersect1d(at, near, assume_unique=True)
                if not len(at):
                    continue
            hashes = shingle(w.hashes, size)[at]
            ok = _member(hashes, known)
            for a, h in zip(at[ok].tolist(), hashes[ok].tolist(), strict=True):
                items = found[h].get(b" ".join(self.words(w, a, a + size)))
                if items:
                    out.append((a, a + size, items))
        return sorted(out, key=lambda x: x[:2])


def _member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _scanner(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench: Benchmark = shared.value
        for batch in batches:
            for begin, end, w in pieces(batch, kind=ALNUM, lower=True):
                spans: list[list[dict]] = [[] for _ in range(end - begin)]
                items: list[set[int]] = [set() for _ in range(end - begin)]
                for a, b, which in bench.hits(w):
                    row = int(np.searchsorted(w.first, a, side="right")) - 1
                    a, b = a - int(w.first[row]), b - int(w.first[row])
                    items[row] |= which
                    if spans[row] and a <= spans[row][-1]["last"] + 1:
                        spans[row][-1]["last"] = max(spans[row][-1]["last"], b - 1)
                    else:
                        spans[row].append({"first": a, "last": b - 1})
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(begin, end - begin),
                        batch.column(2).slice(begin, end - begin),
                        pa.array(w.counts, pa.int64()),
                        pa.array(spans, pa.list_(pa.struct({"first": pa.int64(), "last": pa.int64()}))),
                        pa.array([sorted(bench.names[i] for i in x) for x in items], pa.list_(pa.string())),
                    ],
                    ["doc_id", "version", "n_words", "spans", "items"],
                )

    return run


def _blocks(bench: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of bounded size, one block on the driver at a time."""
    total = bench.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    count = -(-total // block_bytes)
    if count <= 1:
        yield [tuple(r) for r in bench.collect()] if total else []
        return
    for k in range(2 * count):
        yield [tuple(r) for r in bench.where(F.pmod(F.xxhash64("text"), F.lit(2 * count)) == k).collect()]


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = 10, block_bytes: int = 16 << 20) -> DataFrame:
    """One row per input row: doc_id, n_words, hit word ``spans`` (inclusive, from 0) and sorted ``items``."""
    if window < GRAM:
        raise ValueError(f"window must be {GRAM} words or more")
    spark = docs.sparkSession
    text = F.col(text_col)
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("version"))
    bench = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(text_col).alias("text")).dropna()
    found = [slim.mapInArrow(_scanner(spark.sparkContext.broadcast(Benchmark(rows, window))), SCHEMA) for rows in _blocks(bench, block_bytes)]
    if len(found) == 1:
        return found[0].drop("version")
    hits = found[0].select("doc_id", "version", "spans", "items")
    for more in found[1:]:
        hits = hits.unionByName(more.select("doc_id", "version", "spans", "items"))
    merged = hits.where(F.size("items") > 0).groupBy("doc_id", "version").agg(F.sort_array(F.flatten(F.collect_set("spans"))).alias("all_spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("all_items"))
    joined = found[0].alias("l").join(merged.alias("r"), F.expr("l.doc_id <=> r.doc_id and l.version = r.version"), "left")
    empty = "array<struct<first: bigint, last: bigint>>"
    merge = """aggregate(coalesce(all_spans, array()), cast(array() as {0}), (s, x) -> case
        when size(s) > 0 and x.first <= element_at(s, -1).last + 1
        then concat(slice(s, 1, size(s) - 1), array(named_struct('first', element_at(s, -1).first, 'last', greatest(element_at(s, -1).last, x.last))))
        else concat(s, array(x)) end)"""
    return joined.select("l.doc_id", "l.n_words", F.expr(merge.format(empty)).alias("spans"), F.coalesce("all_items", F.array().cast("array<string>")).alias("items"))
