"""Language-model scoring with a weighted backoff automaton.

The model is an n-gram model with hierarchical Dirichlet smoothing:

    P(w | h) = (c(hw) + k P(w | h')) / (c(h) + k),   P(w) = (c(w) + a) / (N + a (V + 1))

where h' is h without its first word; unknown words share one place in P(w).  Seen
n-grams are states.  A state has an arc for each word that followed it in training,
with that probability, and a failure arc of weight k / (c(h) + k) to the state of h'.
A text is read once from left to right: each word follows an arc of the current
state, or failure arcs until one fits, and the logarithms add up.  Many texts are
read at a time, each with a state of its own.

The automaton of a large corpus fits no executor, so each block of documents gets
the part that its own texts can reach: :mod:`exchange` counts every n-gram of the
corpus and tells each block the counts of those it holds.  What is gathered grows
with the corpus, and no part of it is capped or pruned.

Defined results: a null or empty text is its end token alone; repeated rows count
and are scored one by one; an empty table gives no rows; without training texts all
tokens are unknown; a null doc_id is held out; other columns are ignored.  N-grams
are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exchange import PACKED, Asked, Packer, ask, deal, gather, layout, runs
from .words import SPACED, Words, codes, mix, pieces, shingle

BEGIN, END = codes(11, 2)


def sequences(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each between a begin and an end, and where texts begin."""
    n = w.counts
    first = np.append(0, np.cumsum(n + 2))
    seq = np.full(int(first[-1]), BEGIN, np.uint64)
    inner = np.ones(len(seq), bool)
    inner[first[:-1]] = inner[first[1:] - 1] = False
    seq[inner] = w.hashes
    seq[first[1:] - 1] = END
    return seq, first


def grams(seq: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends and keys of all grams of ``size`` tokens within a text."""
    place = np.arange(len(seq)) - np.repeat(first[:-1], np.diff(first))
    end = np.flatnonzero(place >= size - 1)
    return end, shingle(seq, size)[end - size + 1] if len(end) else np.zeros(0, np.uint64)


def _counted(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    known, which = np.unique(keys, return_inverse=True)
    return known, np.bincount(which, train, len(known)).astype(np.uint64), which


def _emit(order: int) -> Callable[[pa.Table], Asked]:
    def emit(table: pa.Table) -> Asked:
        parts, starts, base = [], [np.zeros(1, np.int64)], 0
        for _, _, w in pieces(table, kind=SPACED, lower=True):
            seq, first = sequences(w)
            parts.append(seq)
            starts.append(first[1:] + base)
            base += len(seq)
        seq, first = np.concatenate(parts), np.concatenate(starts)
        train = np.repeat(table["train"].to_numpy().astype(float), np.diff(first))
        keys, values, levels = [], [], []
        for size in range(1, order + 1):
            end, key = grams(seq, first, size)
            known, count, which = _counted(key, train[end])
            keys.append(known)
            values.append(count)
            levels.append((end, which))
        joined = np.concatenate(keys)
        order_of = np.argsort(joined)
        place = np.empty(len(joined), np.int64)
        place[order_of] = np.arange(len(joined))
        cut = np.cumsum([0, *map(len, keys)])
        at = [np.full(len(seq), -1, np.int64) for _ in range(order + 1)]
        for m, (end, which) in enumerate(levels, 1):
            at[m][end] = place[cut[m - 1] + which]
        return Asked(joined[order_of], (np.concatenate(values)[order_of],), {"first": first, "at": at})

    return emit


def _total(keys: np.ndarray, block: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    first, run = runs(keys)
    total = np.add.reduceat(values[0], first)[run]
    return total > 0, total


@dataclass
class Automaton:
    """The part of the automaton that one block's texts can reach.

    ``at[m]`` names for each token the gram of ``m`` tokens that ends there (-1: none);
    ``arc`` and ``fail`` hold, by gram, the log10 weight of the arc that its last token
    follows, and that of its failure arc as a state.
    """

    first: np.ndarray
    at: list[np.ndarray]
    seen: np.ndarray
    arc: np.ndarray
    fail: np.ndarray
    unigram: np.ndarray

    @classmethod
    def build(cls, asked: Asked, count: np.ndarray, total: int, types: int, add: float, strength: float) -> Automaton:
        first, at = asked.state["first"], asked.state["at"]
        p = np.zeros(len(count))
        whole = total + add * (types + 1)
        one = at[1][at[1] >= 0]
        p[one] = (count[one] + add) / whole
        for m in range(2, len(at)):
            end = np.flatnonzero(at[m] >= 0)
            context = count[at[m - 1][end - 1]]
            p[at[m][end]] = (count[at[m][end]] + strength * p[at[m - 1][end]]) / (context + strength)
        with np.errstate(divide="ignore"):
            arc = np.log10(p)
        return cls(first, at, count > 0, arc, np.log10(strength / (count + strength)), arc[at[1]])

    def scores(self) -> np.ndarray:
        """Log10 probability of each text, all texts read in step from left to right."""
        n = np.diff(self.first) - 1  # tokens read: the words and the end
        rows = np.argsort(-n, kind="stable")
        here, left = self.first[:-1][rows], n[rows]
        total, deepest = np.zeros(len(rows)), len(self.at) - 2
        depth = np.full(len(rows), min(1, deepest))
        depth[~self.seen[self.at[1][here]]] = 0
        active = np.searchsorted(-left, -np.arange(1, left.max(initial=0) + 1), side="right")
        for step, count in enumerate(active.tolist(), 1):
            now = here[:count] + step
            state = depth[:count].copy()
            gain = np.where(state == 0, self.unigram[now], 0.0)
            todo = np.flatnonzero(state > 0)
            while len(todo):
                d, t = state[todo], now[todo]
                move = np.empty(len(todo), np.int64)
                back = np.empty(len(todo), np.int64)
                for m in range(1, deepest + 1):
                    same = d == m
                    move[same], back[same] = self.at[m + 1][t[same]], self.at[m][t[same] - 1]
                fits = self.seen[move]
                gain[todo] += np.where(fits, self.arc[move], self.fail[back])
                state[todo[~fits]] -= 1
                rest = todo[~fits]
                root = rest[state[rest] == 0]
                gain[root] += self.unigram[now[root]]
                todo = rest[state[rest] > 0]
            total[:count] += gain
            state = np.minimum(state + 1, deepest)
            state[~self.seen[self.at[1][now]]] = 0
            depth[:count] = state
        out = np.empty(len(rows))
        out[rows] = total
        return out


def _finish(total: int, types: int, add: float, strength: float):
    def finish(table: pa.Table, asked: Asked, places: np.ndarray, found: np.ndarray) -> pa.Table:
        count = np.zeros(len(asked.keys))
        count[places] = found
        model = Automaton.build(asked, count, total, types, add, strength)
        text = np.repeat(np.arange(table.num_rows), np.diff(model.first))
        read = np.ones(len(text), bool)
        read[model.first[:-1]] = False
        known = model.seen[model.at[1]] & read
        columns = {
            "doc_id": table["doc_id"],
            "n_tokens": pa.array(np.diff(model.first) - 1, pa.int64()),
            "n_known": pa.array(np.bincount(text[known], minlength=table.num_rows), pa.int64()),
            "train_tokens": pa.array(np.full(table.num_rows, total), pa.int64()),
            "base_score": pa.array(np.bincount(text[read], model.unigram[read], table.num_rows), pa.float64()),
            "score": pa.array(model.scores(), pa.float64()),
        }
        return pa.table({"doc_id": columns.pop("doc_id"), "train": table["train"], **columns})

    return finish


#: Text whose distinct tokens a task holds before it sends them on.
HELD_TEXT = 16 << 20


def _vocabulary(bounds: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def packed() -> pa.RecordBatch:
            known, which = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            count = np.bincount(which, np.concatenate([c for _, c in held]), len(known)).astype(np.uint64)
            packer = Packer(bounds)
            packer.add(0, Asked(known, (count,)))
            return packer.drain()

        for batch in batches:
            for _, _, w in pieces(batch, kind=SPACED, lower=True):
                tokens = np.append(w.hashes, np.full(len(w.first) - 1, END, np.uint64))
                known, count = np.unique(tokens, return_counts=True)
                held.append((mix(known), count))
                size += len(w.data)
                if size >= HELD_TEXT:
                    yield packed()
                    held, size = [], 0
        if held:
            yield packed()

    return run


def _bucket_totals(table: pa.Table) -> pa.Table:
    keys, vals, _, _, _ = gather(table)
    return pa.table({"tokens": [int(vals[0].sum())], "types": [len(np.unique(keys))]})


def corpus_totals(docs: DataFrame, bounds: np.ndarray) -> tuple[int, int]:
    """Tokens and distinct tokens of (text) rows; ``bounds`` are the lower bounds of the buckets."""
    parts = docs.select("text").mapInArrow(_vocabulary(bounds), PACKED)
    row = parts.groupBy("bucket").applyInArrow(_bucket_totals, "tokens bigint, types bigint").agg(F.sum("tokens"), F.sum("types")).first()
    return row[0] or 0, row[1] or 0


def score_lm(docs: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text", order: int = 2, add: float = 0.1, strength: float = 20.0) -> DataFrame:
    """One row per input row: doc_id, train, n_tokens, n_known, train_tokens, base_score, score.

    ``train`` is a boolean over the id column: texts the model learns from.
    """
    if order < 2:
        raise ValueError("order must be 2 or more")
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    plan = layout(slim)
    total, types = corpus_totals(slim.where("train"), plan.edges(64))
    schema = "doc_id bigint, train boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return ask(deal(slim, plan), _emit(order), _total, _finish(total, types, add, strength), schema, plan)
