"""Counterfactually regularised toxicity classifier.

Features of a text are the set of its distinct words and of their first 4 and 5
bytes (A-Z lowered), hashed; a logistic regression scores them.  Labelled texts
that name a group are repeated with the group's name swapped for others of its
kind, and the squared change of the score before and after is added to the loss,
so that the mere mention of a group cannot carry weight.

The model is fitted on the driver with at most ``max_rows`` labelled documents, those
first in order of a hash: a bounded sample, documented here.  All features of their
whole texts are counted; those that tell the classes apart take part.  Scoring reads every text whole, needs no shuffle, and
takes the fitted weights, 2**BITS numbers, to each executor.

Defined results: a null or empty text has only the bias as its input; without
labelled rows of both classes the score is the share of toxic labels, or 0.5
without labels; a null label row is ignored; of a labelled doc_id with several texts the
smallest one is learnt; repeated rows are scored one by one;
an empty table gives no rows; columns other than the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import drop_parquet, shared_parquet
from .words import _LOWERED, ALNUM, Words, hash_runs, pieces

BITS = 20
#: Words that name groups of one kind; a swap stays within its kind.
IDENTITY_TERMS = [
    ["muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "atheist"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "catholics", "atheists"],
    ["black", "white", "asian", "latino", "african", "european", "arab"],
    ["gay", "lesbian", "straight", "bisexual", "queer", "transgender"],
    ["women", "men", "girls", "boys"],
    ["woman", "man", "girl", "boy"],
    ["immigrants", "refugees", "foreigners", "natives", "citizens"],
    ["blind", "deaf", "disabled", "autistic"],
    ["old", "young", "elderly", "teenage"],
    ["musulman", "chrétien", "juif", "hindou", "bouddhiste"],
    ["muslimisch", "christlich", "jüdisch", "hinduistisch"],
    ["musulmán", "cristiano", "judío", "hindú", "budista"],
]
_KIND = {w.encode(): row for row in IDENTITY_TERMS for w in row}


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each text: text numbers and features, sorted by text."""
    text = np.repeat(np.arange(len(w.first) - 1), w.counts)
    data, sizes = _LOWERED[w.data], w.ends - w.starts
    found = [w.hashes]
    for size in (4, 5):
        found.append(hash_runs(data, w.starts, np.minimum(sizes, size)) ^ np.uint64(size))
    bucket = np.concatenate([x >> np.uint64(64 - BITS) for x in found]).astype(np.int64)
    keys = np.unique((np.concatenate([text] * 3) << BITS) | bucket)
    return keys >> BITS, keys & ((1 << BITS) - 1)


def word_features(word: bytes) -> set[int]:
    raw = np.frombuffer(word, np.uint8)
    return set(features(Words(raw, np.array([0, len(raw)]), ALNUM, True))[1].tolist())


def _in(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, held, bad): in how many labelled rows a feature occurs, and in how many toxic ones."""
    held, bad = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    for batch in batches:
        toxic = batch.column("toxic").to_numpy()
        for begin, _, w in pieces(batch, kind=ALNUM, lower=True):
            text, what = features(w)
            held += np.bincount(what, minlength=1 << BITS)
            bad += np.bincount(what, toxic[text + begin], 1 << BITS).astype(np.int64)
    use = np.flatnonzero(held)
    yield pa.RecordBatch.from_arrays([pa.array(use.astype(np.int32)), pa.array(held[use]), pa.array(bad[use])], ["feature", "held", "bad"])


def _extractor(use: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each labelled row's features among ``use``, and what the swaps of its group names add and drop."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {w: word_features(w) for w in _KIND}
        hashed = {int(Words(np.frombuffer(w, np.uint8), np.array([0, len(w)]), ALNUM, True).hashes[0]): w for w in _KIND}
        known = np.array(sorted(hashed), np.uint64)
        for batch in batches:
            labels = batch.column("toxic").to_pylist()
            for begin, end, w in pieces(batch, kind=ALNUM, lower=True):
                text, what = features(w)
                kept = _in(what, use) if len(use) else np.zeros(len(what), bool)
                text, what = text[kept], what[kept]
                bounds = np.searchsorted(text, np.arange(end - begin + 1))
                rows, added, dropped = [], [], []
                for k in range(end - begin):
                    rows.append(what[bounds[k] : bounds[k + 1]].astype(np.int32))
                    there = np.unique(w.hashes[w.first[k] : w.first[k + 1]])
                    named = [hashed[h] for h in there[_in(there, known)].tolist()]
                    swaps = [(own[b.encode()], own[a]) for a in sorted(named) for b in _KIND[a] if b.encode() != a]
                    added.append([sorted(x - y) for x, y in swaps])
                    dropped.append([sorted(y - x) for x, y in swaps])
                lists = pa.list_(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(labels[begin:end], pa.int32()), pa.array(rows, pa.list_(pa.int32())), pa.array(added, lists), pa.array(dropped, lists)], ["toxic", "x", "added", "dropped"])

    return run


class Model:
    """Weights of the features, the last one of the bias."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def scores(self, w: Words) -> np.ndarray:
        text, what = features(w)
        z = np.bincount(text, self.weights[what], len(w.first) - 1) + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def screened(counts: pa.Table, share: float, min_rows: int = 3, min_z: float = 4.5) -> np.ndarray:
    """Features of ``min_rows`` rows or more whose share of toxic rows differs from the whole by ``min_z`` standard errors.

    In long texts the chance weights of thousands of others would drown them.  The features
    of the group names and of what they are swapped for take part as well.
    """
    held, bad = counts["held"].to_numpy(), counts["bad"].to_numpy()
    often = (held >= min_rows) & (np.abs(bad - held * share) >= min_z * np.sqrt(held * share * (1 - share)))
    named = sorted({f for w in _KIND for f in word_features(w)})
    return np.union1d(counts["feature"].to_numpy()[often], np.array(named, np.int64)).astype(np.int64)


def fit(use: np.ndarray, rows: list[np.ndarray], labels: np.ndarray, swaps: list[tuple[list[int], list[int]]], *, l2: float = 0.5, fairness: float = 5.0, steps: int = 200) -> Model:
    """Minimises log loss + l2 + fairness * (score change by swaps)**2, by Adam on all rows and the features ``use``."""
    weights = np.zeros((1 << BITS) + 1)
    share = float(labels.mean()) if len(labels) else 0.5
    if not len(labels) or share in (0.0, 1.0):
        weights[-1] = 0.0 if not len(labels) else np.log((share + 1e-6) / (1 - share + 1e-6))
        return Model(weights)
    what = np.concatenate(rows).astype(np.int64)
    text = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    at = np.searchsorted(use, what)
    sf = np.fromiter((f for a, d in swaps for f in [*a, *d]), np.int64)
    ss = np.fromiter((s for a, d in swaps for s in [1] * len(a) + [-1] * len(d)), float)
    st = np.repeat(np.arange(len(swaps)), [len(a) + len(d) for a, d in swaps]) if swaps else np.zeros(0, np.int64)
    sf = np.searchsorted(use, sf)
    v, n = np.zeros(len(use) + 1), len(labels)
    m1, m2 = np.zeros_like(v), np.zeros_like(v)
    v[-1] = np.log(share / (1 - share))
    for step in range(1, steps + 1):
        z = np.bincount(text, v[at], n) + v[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels) / n
        grad = np.append(np.bincount(at, error[text], len(use)) + l2 / n * v[:-1], error.sum())
        if len(swaps):
            change = np.bincount(st, v[sf] * ss, len(swaps))
            grad[:-1] += 2 * fairness / len(swaps) * np.bincount(sf, change[st] * ss, len(use))
        m1 += 0.1 * (grad - m1)
        m2 += 0.01 * (grad * grad - m2)
        v -= 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-9)
    weights[use] = v[:-1]
    weights[-1] = v[-1]
    return Model(weights)


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", where: Column | None = None, max_rows: int = 12_000) -> Model:
    """Fits on at most ``max_rows`` labelled documents, taken in order of a hash of doc_id.

    Their texts are written once; all their features are counted, and those that tell the
    classes apart come to the driver.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).dropna()
    known = known.where(where) if where is not None else known
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    joined = texts.join(F.broadcast(chosen), "doc_id")  # max_rows small rows
    joined = shared_parquet(joined.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("toxic", "text"))
    total = joined.agg(F.count("*"), F.sum("toxic")).first()
    share = (total[1] or 0) / total[0] if total[0] else 0.5
    counts = joined.mapInArrow(_counter, "feature int, held bigint, bad bigint").groupBy("feature").agg(F.sum("held").alias("held"), F.sum("bad").alias("bad")).orderBy("feature").toArrow()
    use = screened(counts, share)
    got = joined.mapInArrow(_extractor(use), "toxic int, x array<int>, added array<array<int>>, dropped array<array<int>>").toArrow()
    drop_parquet(joined)
    x = got["x"].combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.int32()))
    x = pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x
    bounds, flat = np.asarray(x.offsets), np.asarray(x.values)
    target = np.array(got["toxic"].to_pylist(), float) if got.num_rows else np.zeros(0)
    # in an order of their own, so that the fit does not depend on that of arrival
    order = np.array(sorted(range(len(x)), key=lambda k: (flat[bounds[k] : bounds[k + 1]].tobytes(), target[k])), np.int64)
    rows = [flat[bounds[k] : bounds[k + 1]] for k in order]
    swaps = [s for a, d in zip(got["added"].to_pylist(), got["dropped"].to_pylist(), strict=True) for s in zip(a, d, strict=True)]
    return fit(use, rows, target[order], sorted(swaps))


def _scorer(shared, threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(shared.value)
        for batch in batches:
            scores = [model.scores(w) for _, _, w in pieces(batch, kind=ALNUM, lower=True)]
            score = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return run


def score_toxicity(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from ``threshold``) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model.weights.astype(np.float32))
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(_scorer(shared, threshold), "doc_id bigint, score double, predicted int")
