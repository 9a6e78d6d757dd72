"""N-gram Jaccard join: a grouped prefix join with exact verification.

A document's set is its distinct shingles.  Shingles are ordered by the number of
documents that hold them, then by hash; two sets with a Jaccard similarity of ``t``
or more share a shingle among the first ``n - ceil(t n) + 1`` of each.  As rare ones
come first, documents with enough shingles of their own have no shared one in
their prefix and drop out at once; no cap is needed.

1. Each document's shared prefix shingles are found (:mod:`exchange` counts the
   documents of every shingle).  Equal sets are one class from here on.
2. Classes with the same size and the same shared prefix form a group.  Groups are
   joined by prefix shingle with a few *hubs* of each shingle and size band, and filtered by
   size and parity sketches; members are paired with their group's head.  The nearest
   hubs of each group, three at most, are verified on their sets.
3. Verified links make components.  While many groups of different components still
   share a shingle, new hubs are drawn and compared, a few pairs a group again.
4. What then still shares a prefix shingle across components is compared whole:
   groups are paired across components only, filtered by size, by the order of the prefix
   and by parity sketches, expanded to members and verified.  So every link between
   different components is found, and none is lost, while a family of copies that the
   hubs have joined costs nothing more.

The result is the classes and their components.  Links inside a component beyond
those that hold it together are not counted: a family of n near copies has about
n**2 / 2 of them.

Defined results: texts without words are empty sets that link with nothing, null texts
too; with fewer words than a shingle the whole sequence is one; equal rows are one
vertex, and rows that share a doc_id but not the text follow each its own text; a null
doc_id links with nothing and has a null component; an empty table gives no rows;
columns other than the two named ones are ignored.  Shingles are
compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .exchange import Asked, ask, deal, distinct, layout, runs
from .store import drop_parquet, release, shared_parquet
from .words import SPACED, Words, mix, pieces, shingle, window_starts

SETS = "doc_id bigint, n_shingles bigint, f1 bigint, f2 bigint, shared bigint, width int, sketch array<bigint>, shingles array<bigint>"
#: Words of 64 bits in a set's parity sketch.
SKETCH = 16
#: Words of a sketch folded for the hubs: parities of the parities.
FOLDED = SKETCH // 4
#: Hubs of a shingle and size band, and how many of them a group's head is verified with.
HUBS, TRIED = 8, 3
#: Posts of other components that a post may still meet, on average, without another round of hubs.
PER_POST = 64


def shingle_sets(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Text numbers and shingles of all texts' sets, in order of both."""
    at = window_starts(w.first, size)
    text = np.searchsorted(w.first, at, side="right") - 1
    keys = shingle(w.hashes, size)[at]
    for k in np.flatnonzero((w.counts > 0) & (w.counts < size)).tolist():
        a, b = w.first[k], w.first[k + 1]
        text, keys = np.append(text, k), np.append(keys, shingle(w.hashes[a:b], b - a)[:1])
    order = np.lexsort((keys, text))
    text, keys = text[order], keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])
    return text[new], keys[new]


def _emit(size: int, shift: int):
    def emit(table: pa.Table) -> Asked:
        texts, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for begin, _, w in pieces(table, kind=SPACED, lower=True):
            text, key = shingle_sets(w, size)
            texts.append(text + begin)
            keys.append(key)
        text, key = np.concatenate(texts), np.concatenate(keys)
        known, count = distinct(key >> np.uint64(shift))
        return Asked(known, (count.astype(np.uint64),), {"text": text, "key": key})

    return emit


def _shared_count(keys: np.ndarray, block: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Answers the number of documents of each key that two or more hold."""
    first, run = runs(keys)
    total = np.add.reduceat(values[0], first)[run]
    return total > 1, total


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - -(-n * percent // 100) + 1


def _finish(percent: int, shift: int):
    def finish(table: pa.Table, asked: Asked, places: np.ndarray, found: np.ndarray) -> pa.Table:
        text, key = asked.state["text"], asked.state["key"]
        held = np.ones(len(asked.keys), np.int64)
        held[places] = found
        held = held[np.searchsorted(asked.keys, key >> np.uint64(shift))]
        n = np.bincount(text, minlength=table.num_rows)
        start = np.append(0, np.cumsum(n))
        f1 = np.add.reduceat(np.append(mix(key.copy()), np.uint64(0)), start[:-1])
        f2 = np.bitwise_xor.reduceat(np.append(mix(key ^ np.uint64(0x5851F42D4C957F2D)), np.uint64(0)), start[:-1])
        f1[n == 0] = f2[n == 0] = 0
        order = np.lexsort((key, held, text))
        rank = np.arange(len(key)) - start[text]
        use = (held[order] > 1) & (rank < prefix_length(n, percent)[text])
        count = np.bincount(text[use], minlength=table.num_rows)
        full = np.repeat(count > 0, n)
        bits = np.zeros((table.num_rows, 64 * SKETCH), np.uint8)
        np.bitwise_xor.at(bits, (text[full], (key[full] >> np.uint64(40)).astype(np.int64) % (64 * SKETCH)), 1)
        words = np.packbits(bits[count > 0], axis=1).view(np.int64).reshape(-1)
        sketch = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.where(count > 0, SKETCH, 0))).astype(np.int32)), pa.array(words))
        kept = np.where(count > 0, n, 0)
        # a set's shared prefix comes first, then its other shingles
        ahead = np.lexsort((~use, text))
        sets = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(kept)).astype(np.int32)), pa.array(key[order][ahead][full].view(np.int64)))
        shared = np.bincount(text[held > 1], minlength=table.num_rows)
        return pa.table({"doc_id": table["doc_id"], "n_shingles": pa.array(n, pa.int64()), "f1": f1.view(np.int64), "f2": f2.view(np.int64), "shared": pa.array(shared, pa.int64()), "width": pa.array(count, pa.int32()), "sketch": sketch, "shingles": sets})

    return finish


def _size_fits(a: Column, b: Column, percent: int) -> Column:
    return (a * 100 >= b * percent) & (b * 100 >= a * percent)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs (a, b) of classes whose sets are similar enough; only sets of pairs are moved."""
    pairs = shared_parquet(pairs)
    used = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    sets = sets.select("doc_id", "shingles").join(used, "doc_id", "left_semi")
    left, right = sets.toDF("a", "sa"), sets.toDF("b", "sb")
    common = F.size(F.array_intersect("sa", "sb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("common", common)
    return both.where(F.col("common") * 100 >= (F.size("sa") + F.size("sb") - F.col("common")) * percent).select("a", "b")


def _apart(x: str, y: str, names: Iterable) -> Column:
    """In how many bits two parity sketches differ: two sets differ in at least as many shingles."""
    return sum((F.bit_count(F.col(f"{x}{k}").bitwiseXOR(F.col(f"{y}{k}"))) for k in names), F.lit(0))


def _hub_pairs(posts: DataFrame, seed: int, percent: int) -> DataFrame:
    """Each lot's speaker with the nearest hubs of its shingles that are in other components.

    A shingle has HUBS hubs a size band, drawn by a hash, and at first the text with the
    most shared shingles, the likeliest origin of a family.  So a post meets a few hubs
    however many posts share its shingle.
    """
    folded = [f"q{k}" for k in range(FOLDED)]
    draw = F.xxhash64("rep", "token", F.lit(seed))
    carried = ["rep", "n_shingles", "label", *folded]
    drawn = posts.withColumn("slot", F.pmod(draw, F.lit(HUBS))).groupBy("token", "band", "slot").agg(F.min(F.struct(draw.alias("rank"), *carried)).alias("hub"))
    if not seed:
        common = posts.groupBy("token", "band").agg(F.min(F.struct((-F.col("shared")).alias("rank"), *carried)).alias("hub"))
        drawn = drawn.drop("slot").unionByName(common)
    hubs = drawn.select("token", "band", *[F.col("hub")[c].alias(f"hub_{c}") for c in carried])
    total = F.col("n_shingles") + F.col("hub_n_shingles")
    apart = _apart("", "hub_", folded)
    fits = (F.col("label") != F.col("hub_label")) & _size_fits(F.col("n_shingles"), F.col("hub_n_shingles"), percent) & (apart <= total - 2 * _need(total, percent))
    near = posts.join(hubs, ["token", "band"]).where(fits).groupBy("rep").agg(F.slice(F.array_sort(F.collect_set(F.struct(apart.alias("apart"), F.col("hub_rep").alias("hub")))), 1, TRIED).alias("near"))
    star = near.select("rep", F.explode("near.hub").alias("hub"))
    return star.select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()


def _need(total: Column, percent: int) -> Column:
    """Common shingles that two sets of together ``total`` shingles need."""
    return F.ceil(total * F.lit(percent) / F.lit(100 + percent))


def _lots(placed: DataFrame) -> DataFrame:
    """Members of one group in one component: (head, label, rep, many); the smallest speaks for all."""
    lots = placed.groupBy("head", "label").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("most"))
    return lots.select("head", "label", "rep", (F.col("rep") != F.col("most")).alias("many"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, rounds: int = 2) -> DataFrame:
    """One row per input row: doc_id, n_shingles, class_id (smallest doc_id with the same set), component_id.

    Two documents link when ``100 * |A & B| >= percent * |A | B|``.  ``rounds`` bounds the
    rounds of hubs, which only save pairs: whatever they leave apart, the last step compares.
    """
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    plan = layout(slim)
    shift = 64 - plan.bits
    every = shared_parquet(ask(deal(slim, plan), _emit(size, shift), _shared_count, _finish(percent, shift), SETS, plan, plan.bits))
    release(every)
    live = every.where("doc_id is not null and width > 0")
    prints = ["n_shingles", "f1", "f2"]
    classes = shared_parquet(live.groupBy(*prints).agg(F.min("doc_id").alias("class_id")))
    # joined by doc_id, of which each class has one, and not by what all copies of a text share
    chosen = classes.select(F.col("class_id").alias("doc_id"), *prints)
    heads = live.join(chosen, ["doc_id", *prints], "left_semi").dropDuplicates(["doc_id", *prints])
    heads = shared_parquet(heads.select("doc_id", "n_shingles", "shared", "width", "sketch", "shingles"))
    n = F.col("n_shingles")
    lot = ["n_shingles", "p1", "p2"]
    keyed = heads.withColumn("prefix", F.slice("shingles", F.lit(1), F.col("width"))).select("doc_id", "n_shingles", "prefix", F.xxhash64("prefix").alias("p1"), F.hash("prefix").alias("p2"))
    grouped = keyed.groupBy(*lot).agg(F.min("doc_id").alias("head"))
    member = keyed.join(grouped, lot)
    member = shared_parquet(member.select("doc_id", "head", "n_shingles", F.when(F.col("doc_id") == F.col("head"), F.col("prefix")).alias("prefix")))
    band = F.floor(F.log(n) / F.log(F.lit(100 / percent))).cast("int")
    posts = member.where("prefix is not null").select("head", "n_shingles", F.size("prefix").alias("width"), band.alias("band"), F.posexplode("prefix").alias("pos", "token")).repartition("token")
    # most families are copies of one text, whose shingles no other class holds
    several = posts.groupBy("token").agg(F.min("head").alias("low"), F.max("head").alias("high")).where("low <> high").select("token")
    posts = shared_parquet(posts.join(several, "token", "left_semi"))
    fold = [F.get("sketch", k).bitwiseXOR(F.get("sketch", k + FOLDED)).bitwiseXOR(F.get("sketch", k + 2 * FOLDED)).bitwiseXOR(F.get("sketch", k + 3 * FOLDED)).alias(f"q{k}") for k in range(FOLDED)]
    folds = shared_parquet(heads.select(F.col("doc_id").alias("rep"), "shared", *fold).dropDuplicates(["rep"]))
    alone = member.where("prefix is not null").select("head", F.col("head").alias("label"), F.col("head").alias("rep"))
    pairs = _hub_pairs(posts.join(alone, "head").join(folds, "rep"), 0, percent)
    pairs = pairs.unionByName(member.where("doc_id <> head").select(F.col("head").alias("a"), F.col("doc_id").alias("b")))
    links = shared_parquet(_verified(pairs, heads, percent))
    seed, more = 0, True
    while True:
        label = components(links).withColumnRenamed("v", "doc_id")
        # all members with the component they are in so far; alone, one is its own
        placed = member.select("doc_id", "head", "n_shingles").join(label, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
        if not more:
            break
        lots = _lots(placed)
        open_posts = posts.join(lots, "head")
        per = open_posts.groupBy("token", "label").agg(F.count("*").alias("c")).groupBy("token").agg(F.sum("c").alias("all"), F.sum(F.col("c") * F.col("c")).alias("own"))
        work = per.agg(F.sum(F.col("all") * F.col("all") - F.col("own")), F.sum("all")).first()
        seed += 1
        if seed > rounds or (work[0] or 0) <= PER_POST * (work[1] or 0):
            break  # so few are left that comparing them all grows with the posts, not their square
        several = per.where(F.col("all") * F.col("all") > F.col("own")).select("token")
        found = shared_parquet(_verified(_hub_pairs(open_posts.join(several, "token", "left_semi").join(folds, "rep"), seed, percent), heads, percent))
        more = found.limit(1).count() > 0
        links = links.unionByName(found)
    placed = shared_parquet(placed)
    # shingles that other documents hold, from this one on: those of one's own come first
    rest = n - (n - F.ceil(n * percent / 100) + 1 - F.col("width")) - F.col("pos")
    held = posts.join(_lots(placed), "head").select("token", "head", "rep", "label", "many", "n_shingles", "pos", rest.alias("rest"))
    open_tokens = held.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("token")
    # a doc_id with several texts is not judged by the sketch of one of them
    bits = heads.groupBy(F.col("doc_id").alias("rep")).agg((F.count("*") > 1).alias("twice"), F.min("sketch").alias("sketch"))
    held = held.join(open_tokens, "token").join(bits, "rep").withColumn("many", F.col("many") | F.col("twice"))
    held = shared_parquet(held.select("token", "head", "label", "many", "n_shingles", "pos", "rest", *[F.get("sketch", k).alias(f"s{k}") for k in range(SKETCH)]))
    x, y = held.alias("x"), held.alias("y")
    total = F.col("x.n_shingles") + F.col("y.n_shingles")
    need = _need(total, percent)
    most = F.least("x.rest", "y.rest") + F.least("x.pos", "y.pos")
    close = F.col("x.many") | F.col("y.many") | (_apart("x.s", "y.s", range(SKETCH)) <= total - 2 * need)
    cross = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.label") < F.col("y.label")) & _size_fits(F.col("x.n_shingles"), F.col("y.n_shingles"), percent) & (most >= need) & close)
    cross = cross.select(F.col("x.head").alias("hx"), F.col("x.label").alias("lx"), F.col("y.head").alias("hy"), F.col("y.label").alias("ly")).distinct()
    left = placed.select(F.col("head").alias("hx"), F.col("label").alias("lx"), F.col("doc_id").alias("a"))
    right = placed.select(F.col("head").alias("hy"), F.col("label").alias("ly"), F.col("doc_id").alias("b"))
    rest = cross.join(left, ["hx", "lx"]).join(right, ["hy", "ly"]).select("a", "b").distinct()
    last = shared_parquet(_verified(rest, heads, percent))
    if last.limit(1).count():
        label = components(links.unionByName(last)).withColumnRenamed("v", "doc_id")
    named = classes.join(label.withColumnRenamed("doc_id", "class_id"), "class_id", "left").select(*prints, "class_id", F.coalesce("label", "class_id").alias("label"))
    out = every.select("doc_id", *prints).join(named, prints, "left")
    for x in (held, member, placed, posts, last, heads, folds):
        drop_parquet(x)
    known = F.col("doc_id").isNotNull()
    return out.select("doc_id", "n_shingles", F.when(known, F.coalesce("class_id", "doc_id")).alias("class_id"), F.when(known, F.coalesce("label", "doc_id")).alias("component_id"))
