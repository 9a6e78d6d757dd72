"""Substring dedup by level-wise doubling.

The question is which windows of ``min_words`` words stand in several documents, and
which document holds each first.  It is answered level by level.  The first level asks
for windows of about half that length; only those that several documents hold are
extended to twice the length (less a shared word where ``min_words`` is odd), so that the
last level asks for the few windows whose two halves both repeat.  A document loses
each word covered by a window that a document with a smaller doc_id holds.

A text without candidates is settled at once and goes no further; the others are
written with their candidates and dealt anew.  On request the doubling goes on beyond
``min_words`` until no candidates survive, and ``longest_repeat`` is the last length at
which a window of the document still repeats.

All questions go through :mod:`exchange`, so a window that very many documents share
costs one entry a block of documents.  Levels that only choose candidates compare short
hashes, as a false candidate does no harm; the level that decides compares a key and 64 more
bits from hashes of their own, over 100 bits together.

Defined results: a null or empty text has no words; texts shorter than a window lose
nothing; rows with equal doc_id are one document, each row is rewritten for itself; rows
with a null doc_id come first and lose nothing to others; an empty table gives no rows;
columns other than the two named ones are ignored.  A text is never divided (see
:mod:`exchange` for what one may measure).
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import Asked, ask, deal, layout, runs
from .store import drop_parquet, release, shared_parquet
from .words import SPACED, Words, hash_runs, pieces, shingle, window_starts

LOWEST = np.iinfo(np.int64).min
#: Words of the first level's windows, at most.
START = 7
#: Seed of the words' second hash.
SECOND = 0x2545F4914F6CDD1D
RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept_text string, kept_sha256 string, level bigint, text string, places binary"


def levels(min_words: int, start: int = START) -> list[int]:
    """Window lengths up to ``min_words``, each twice the one before or one less."""
    sizes = [min_words]
    while sizes[0] > max(start, 1):
        sizes.insert(0, -(-sizes[0] // 2))
    return sizes


def _order(table: pa.Table) -> np.ndarray:
    """doc_ids as unsigned numbers in the same order, null first."""
    ids = table["doc_id"].fill_null(int(LOWEST)).to_numpy().astype(np.int64)
    return ids.view(np.uint64) ^ np.uint64(1 << 63)


def _starts(table: pa.Table, size: int, second: bool = False):
    """(words, row range, start words, keys, checks, rows) of each slice's windows.

    Where the table has ``places``, the candidates of each text, only those are windows.
    """
    given = table["places"].to_pylist() if "places" in table.column_names else None
    for begin, end, w in pieces(table, kind=SPACED):
        if given is None:
            at = window_starts(w.first, size)
        else:
            own = [np.frombuffer(p, np.int32).astype(np.int64) + f for p, f in zip(given[begin:end], w.first[:-1].tolist(), strict=True)]
            at = np.concatenate(own)
        key = shingle(w.hashes, size)[at]
        check = shingle(hash_runs(w.data, w.starts, w.ends - w.starts, SECOND), size)[at] if second else None
        yield w, begin, end, at, key, check, np.searchsorted(w.first, at, side="right") - 1 + begin


def _holders(columns: tuple[np.ndarray, ...], docs: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows of the columns in order, their smallest and largest documents, and each entry's row."""
    order = np.lexsort((docs, *columns[::-1]))
    ranked = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in ranked])
    first = np.flatnonzero(new)
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    low = docs[order][first]
    high = docs[order][np.append(first[1:], len(order)) - 1] if len(first) else low
    return tuple(c[first] for c in ranked), low, high, which


def _joined(parts: list[np.ndarray], kind=np.uint64) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _candidates(size: int, shift: int):
    """Asks whether several documents hold a window, by the upper bits of its key."""

    def emit(table: pa.Table) -> Asked:
        ids = _order(table)
        parts = list(_starts(table, size))
        key = _joined([p[4] for p in parts]) >> np.uint64(shift)
        row = _joined([p[6] for p in parts], np.int64)
        (known,), low, high, which = _holders((key,), ids[row])
        return Asked(known, (), {"parts": parts, "several": low != high, "which": which})

    return emit


def _in_blocks(keys: np.ndarray, block: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Answers the entries of keys that two blocks or more share."""
    first, run = runs(keys)
    return (np.diff(np.append(first, len(keys))) > 1)[run], np.ones(len(keys), np.uint64)


def _cover(starts: np.ndarray, size: int, total: int) -> np.ndarray:
    """Words inside any window of ``size`` words at ``starts``."""
    change = np.bincount(starts, minlength=total + size + 1)[: total + size + 1].astype(np.int32)
    change[size:] -= np.bincount(starts, minlength=total + 1)[: total + 1]
    return np.cumsum(change[:total]) > 0


def _extended(w: Words, at: np.ndarray, alive: np.ndarray, size: int, longer: int) -> list[bytes | None]:
    """Each text's starts of windows of ``longer`` words whose first and last ``size`` words repeat; null without any."""
    good = np.zeros(len(w.hashes) + longer, bool)
    good[at[alive]] = True
    start = window_starts(w.first, longer)
    start = start[good[start] & good[start + longer - size]]
    bounds = np.searchsorted(start, w.first)
    return [(start[a:b] - f).astype(np.int32).tobytes() if a < b else None for a, b, f in zip(bounds[:-1].tolist(), bounds[1:].tolist(), w.first[:-1].tolist(), strict=True)]


def _words(w: Words, a: int, b: int) -> list[bytes]:
    """Words ``a`` up to ``b`` of one text; bytes.split() splits at the same white space."""
    return w.data[w.starts[a] : w.ends[b - 1]].tobytes().split() if a < b else []


def _rows(table: pa.Table, out: dict[str, list]) -> pa.Table:
    kinds = {"kept_text": pa.string(), "kept_sha256": pa.string(), "places": pa.binary()}
    text = pa.chunked_array([table["text"].combine_chunks()]).cast(pa.string())
    open_text = pc.if_else(pa.array([p is not None for p in out["places"]], pa.bool_()), text, pa.scalar(None, pa.string()))
    columns = {"doc_id": table["doc_id"]} | {k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()} | {"text": open_text}
    return pa.table([columns[k.split()[0]] for k in RESULT.split(", ")], names=[k.split()[0] for k in RESULT.split(", ")])


def _settle(size: int, longer: int, with_text: bool, final: bool):
    """Settles the texts without candidates; ``final`` if texts were settled before and only lengths matter."""

    def finish(table: pa.Table, asked: Asked, places: np.ndarray, found: np.ndarray) -> pa.Table:
        repeat = asked.state["several"]
        repeat[places] = True
        alive = repeat[asked.state["which"]]
        out: dict[str, list] = {k: [] for k in ("n_words", "n_removed", "kept_text", "kept_sha256", "level", "places")}
        base = 0
        for w, begin, end, at, *_ in asked.state["parts"]:
            here = alive[base : base + len(at)]
            base += len(at)
            ahead = _extended(w, at, here, size, longer)
            hit = np.bincount(np.searchsorted(w.first, at[here], side="right") - 1, minlength=end - begin) > 0
            for k, places_of in enumerate(ahead):
                a, b = int(w.first[k]), int(w.first[k + 1])
                kept = b" ".join(_words(w, a, b)) if places_of is None and not final else None
                out["n_words"].append(b - a)
                out["n_removed"].append(0)
                out["kept_text"].append(kept.decode() if with_text and kept is not None else None)
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest() if kept is not None else None)
                out["level"].append(size if final and hit[k] else 0)
                out["places"].append(places_of)
        return _rows(table, out)

    return finish


def _decisive(size: int, shift: int):
    """Asks who holds a window first, by the upper bits of its key and a second hash."""

    def emit(table: pa.Table) -> Asked:
        ids = _order(table)
        parts = list(_starts(table, size, second=True))
        key, check = _joined([p[4] for p in parts]) >> np.uint64(shift), _joined([p[5] for p in parts])
        row = _joined([p[6] for p in parts], np.int64)
        (known, proof), low, high, which = _holders((key, check), ids[row])
        return Asked(known, (proof, low), {"parts": parts, "first": low, "several": low != high, "which": which, "ids": ids[row]})

    return emit


def _earlier(keys: np.ndarray, block: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Answers windows that blocks share: 1 if a smaller doc_id than the block's own holds it, else 0."""
    _, low, high, which = _holders((keys, values[0]), values[1])
    entries = np.bincount(which)
    return (entries > 1)[which], (low[which] < values[1]).astype(np.uint64)


def _rewrite(size: int, with_text: bool, longer: int):
    def finish(table: pa.Table, asked: Asked, places: np.ndarray, found: np.ndarray) -> pa.Table:
        s = asked.state
        before = np.zeros(len(asked.keys), bool)
        before[places] = found > 0
        repeat = s["several"].copy()
        repeat[places] = True
        later = before[s["which"]] | (s["ids"] != s["first"][s["which"]])
        alive = repeat[s["which"]]
        out: dict[str, list] = {k: [] for k in ("n_words", "n_removed", "kept_text", "kept_sha256", "level", "places")}
        base = 0
        for w, begin, end, at, *_ in s["parts"]:
            part = slice(base, base + len(at))
            base += len(at)
            gone = _cover(at[later[part]], size, len(w.hashes))
            hit = np.bincount(np.searchsorted(w.first, at[alive[part]], side="right") - 1, minlength=end - begin) > 0
            out["places"] += _extended(w, at, alive[part], size, longer) if longer else [None] * (end - begin)
            for k in range(end - begin):
                a, b = int(w.first[k]), int(w.first[k + 1])
                lost = int(gone[a:b].sum())
                words = _words(w, a, b)
                kept = b" ".join(compress(words, (~gone[a:b]).tolist()) if lost else words)
                out["n_words"].append(b - a)
                out["n_removed"].append(lost)
                out["kept_text"].append(kept.decode() if with_text else None)
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["level"].append(size if hit[k] else 0)
        return _rows(table, out)

    return finish


def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 13, with_text: bool = True, longest: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_text, kept_sha256.

    Without ``with_text`` kept_text is null, for callers that need the digest alone; with
    ``longest`` the column longest_repeat tells how far the doubling went (0: no window
    of ``min_words`` words repeats).
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    plan = layout(rows)
    shift = 64 - plan.bits  # bits that number all of the corpus' windows, at every level
    sizes, settled = levels(min_words), []
    for size, longer in zip(sizes, sizes[1:], strict=False):
        asked = shared_parquet(ask(deal(rows, plan), _candidates(size, shift), _in_blocks, _settle(size, longer, with_text, False), RESULT, plan, plan.bits))
        release(asked)
        settled.append(asked.where("places is null"))
        rows = asked.where("places is not null").select("doc_id", "text", "places")
        plan = layout(rows)
    size, bits = sizes[-1], 64 - shift
    last = ask(deal(rows, plan), _decisive(size, shift), _earlier, _rewrite(size, with_text, 2 * size if longest else 0), RESULT, plan, bits)
    columns = ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"]
    if not longest:
        for part in settled:
            last = last.unionByName(part)
        return last.select(columns)
    last = shared_parquet(last)
    out, reached = last, last.select("doc_id", "level")
    for part in settled:
        out = out.unionByName(part)
    rows = last.where("places is not null").select("doc_id", "text", "places")
    while rows.limit(1).count():
        size *= 2
        plan = layout(rows)
        found = shared_parquet(ask(deal(rows, plan), _candidates(size, 0), _in_blocks, _settle(size, 2 * size, False, True), RESULT, plan))
        reached = reached.unionByName(found.select("doc_id", "level"))
        rows = found.where("places is not null").select("doc_id", "text", "places")
    reached = reached.groupBy("doc_id").agg(F.max("level").alias("longest_repeat"))
    joined = out.select(columns).alias("l").join(reached.alias("r"), F.expr("l.doc_id <=> r.doc_id"), "left")
    return joined.select("l.*", F.coalesce("longest_repeat", F.lit(0).cast("bigint")).alias("longest_repeat"))
