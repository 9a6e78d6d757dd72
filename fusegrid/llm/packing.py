"""Packing of token streams by order-preserving dynamic programming.

Each task reads its documents in order, encodes them, ends each with id 0 and
chooses where to cut the stream into windows of at most ``size`` ids.  A window
may end at a document's end (free), at a sentence's end (``sentence_cut``) or,
only where a sentence is longer than a window, elsewhere (``hard_cut``).  The
cheapest chain of cuts minimises padding plus these penalties:

    best(j) = penalty(j) + min over i of best(i) + padding(c_j - c_i)

Padding is ``size`` minus the length, so the minimum over all windows that end
at ``c_j`` is the smallest ``best(i) + c_i`` within reach, which a monotone queue
gives in constant time.  Windows whose length is a power of two are not padded;
those few transitions are looked up by position.

Defined results: a null or empty text is the single id 0; repeated documents are
packed each for itself; an empty table gives no rows; a null doc_id stays null;
columns other than the two named ones are ignored.  Nothing is shuffled: each
task packs what it reads, in sections of about ``section`` ids, and whatever is
recomputed after the loss of an executor comes out the same.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import encoder
from .words import slices, utf8

SEQUENCE_SHIFT = 33  # as monotonically_increasing_id: the partition stands above this bit


def choose_cuts(allowed: np.ndarray, penalty: np.ndarray, size: int) -> list[int]:
    """Indices into ``allowed`` of the cheapest cuts; ``allowed[0]`` is the start.

    Consecutive allowed positions must not be further apart than ``size``.
    """
    where = np.full(int(allowed[-1]) + 1, -1, np.int32)
    where[allowed] = np.arange(len(allowed))
    exact = []
    power = 1
    while power < size:
        back = allowed - power
        exact.append(np.where(back >= 0, where[np.maximum(back, 0)], -1))
        power *= 2
    extra: list[list[int]] = [[] for _ in allowed]
    for row in exact:
        hit = np.flatnonzero(row >= 0)
        for j, i in zip(hit.tolist(), row[hit].tolist(), strict=True):
            extra[j].append(i)
    at, cost = allowed.tolist(), penalty.tolist()
    best, came = [0.0] * len(at), [0] * len(at)
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    for j in range(1, len(at)):
        here = at[j]
        while at[queue[0][1]] < here - size:
            queue.popleft()
        low, source = queue[0]
        low += size - here
        for i in extra[j]:
            if best[i] < low:
                low, source = best[i], i
        best[j], came[j] = low + cost[j], source
        key = best[j] + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    cuts = [len(at) - 1]
    while cuts[-1]:
        cuts.append(came[cuts[-1]])
    return cuts[::-1]


def allowed_cuts(stream: np.ndarray, doc_ends: np.ndarray, sentence: np.ndarray, size: int, sentence_cut: float, hard_cut: float) -> tuple[np.ndarray, np.ndarray]:
    price = np.full(len(stream) + 1, np.inf)
    price[1:][sentence[stream]] = sentence_cut
    price[doc_ends] = 0
    price[0] = 0
    open_at = np.flatnonzero(np.isfinite(price))
    for a, gap in zip(open_at[:-1][np.diff(open_at) > size].tolist(), np.diff(open_at)[np.diff(open_at) > size].tolist(), strict=True):
        price[a + size : a + gap : size] = hard_cut
    allowed = np.flatnonzero(np.isfinite(price))
    return allowed, price[allowed] + (allowed > 0)  # each window costs 1 besides


def sentence_ends(vocabulary: dict[str, int]) -> np.ndarray:
    """Ids whose piece ends a sentence or a line (byte-level letters: Ċ is a newline)."""
    marks = np.zeros(max(vocabulary.values()) + 1, bool)
    marks[[i for piece, i in vocabulary.items() if piece.endswith((".", "!", "?", "Ċ"))]] = True
    return marks


def _packer(path: str, size: int, section: int, sentence_cut: float, hard_cut: float, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        marks = sentence_ends(bpe.tokenizer.get_vocab())
        marks[0] = False
        sequence = TaskContext.get().partitionId() << SEQUENCE_SHIFT

        def packed(keys: list, parts: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
            nonlocal sequence
            keys, stream, count = pa.concat_arrays(keys), np.concatenate(parts), np.concatenate(counts)
            ends = np.cumsum(count)
            cuts, price = allowed_cuts(stream, ends, marks, size, sentence_cut, hard_cut)
            windows = cuts[choose_cuts(cuts, price, size)]
            edges = np.union1d(windows, ends)
            begin, stop = np.append(0, edges[edges > 0][:-1]), edges[edges > 0]
            doc = np.searchsorted(ends, begin, side="right")
            window = np.searchsorted(windows, begin, side="right") - 1
            ids = stream.astype("<u4")
            columns = {
                "doc_id": keys.take(pa.array(doc)),
                "start": begin - (ends - count)[doc],
                "length": stop - begin,
                "ids_crc32": [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begin.tolist(), stop.tolist(), strict=True)],
                "doc_tokens": count[doc],
                "sequence_id": sequence + window,
                "offset": begin - windows[window],
            }
            if with_ids:
                columns["ids"] = pa.LargeListArray.from_arrays(pa.array(np.append(begin, stop[-1])), pa.array(stream.astype(np.int32))).cast(pa.list_(pa.int32()))
            sequence += len(windows) - 1
            return pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) if isinstance(v, (list, np.ndarray)) else v for k, v in columns.items()})

        keys, parts, counts, held = [], [], [], 0
        for batch in batches:
            column = batch.column(1)
            _, offsets = utf8(column)
            for a, b in slices(offsets, 3 << 20):
                ids, count = bpe.encode(column.slice(a, b - a))
                ends = np.cumsum(count)
                parts.append(np.insert(ids, ends, 0))
                counts.append(count + 1)
                keys.append(batch.column(0).slice(a, b - a))
                held += len(parts[-1])
                if held >= section:
                    yield packed(keys, parts, counts)
                    keys, parts, counts, held = [], [], [], 0
        if held:
            yield packed(keys, parts, counts)

    return run


def pack(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, section: int = 500_000, sentence_cut: float = 8, hard_cut: float = 64, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document in a sequence; ``with_ids`` adds the ids themselves.

    ``tokenizer`` is the path of a byte-level ``tokenizers`` file, readable on all
    executors. ``sequence_id`` is unique over the whole result.
    """
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(_packer(tokenizer, size, section, sentence_cut, hard_cut, with_ids), schema + ", ids array<int>" * with_ids)
