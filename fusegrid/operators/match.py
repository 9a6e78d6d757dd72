"""Which records describe the same person.

Exact keys are equi-joins on exploded e-mails and phones; fuzzy names are compared
only within a block: records that share a company, or all records without any company.
Candidates are found by a filter that loses no pair of similar names.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fuzzy import ratio_score, ratios, sorted_tokens
from ..functions.text import strip
from ..plans.materialize import materialize, shared_folder

#: Names of one length that are compared with all others of a group by one task, about.
LOT = 500
#: Subsequences of the names of a side that one task indexes, about, and the most that a name may have for that way.
LOT_KEYS, MOST_KEYS = 4_000_000, 400
#: Candidates that one step of that task holds, about.
STEP = 4_000_000


def _companies() -> Column:
    return F.array_distinct(F.filter(F.transform("experience", lambda x: F.lower(strip(x["company"]))), lambda c: F.coalesce(c, F.lit("")) != ""))


def _keyed(records: DataFrame, key: str, values: Column) -> DataFrame:
    return records.select(key, F.explode(values).alias("v")).distinct()


def _pairs(keyed: DataFrame, key: str, reason: str) -> DataFrame:
    """Each holder of a value with the value's first holder: linear in the holders, same components."""
    first = keyed.groupBy("v").agg(F.min(key).alias("a"))
    return keyed.join(first, "v").where(F.col("a") < F.col(key)).select("a", F.col(key).alias("b"), F.lit(reason).alias("reason"))


def match_emails(records: DataFrame, key: str = "record_id") -> DataFrame:
    """(a, b, reason): records that share a lower-cased e-mail."""
    return _pairs(_keyed(records, key, F.transform("emails", F.lower)), key, "email").distinct()


def match_phones(records: DataFrame, key: str = "record_id") -> DataFrame:
    return _pairs(_keyed(records, key, F.col("phones")), key, "phone").distinct()


def edits(la: int, lb: int, threshold: float) -> int:
    """The most insertions and deletions between strings of these lengths with a ratio of ``threshold``."""
    most = int((la + lb) * (100 - threshold) / 100 + 1e-6)
    return most - (la + lb - most) % 2


def segment_keys(s: str, la: int, lb: int, threshold: float, probe: bool) -> set[str]:
    """Keys of which a string of length la and one of length lb >= la share one if they are similar.

    With at most ``k`` edits one of ``k + 1`` segments of the shorter string is found in the
    longer one, not further away than the edits can move it.
    """
    k = edits(la, lb, threshold)
    if k < 0:
        return set()
    if k + 1 > la:
        return {""}
    back, ahead = (k - (lb - la)) // 2, (k + lb - la) // 2
    out = set()
    for n in range(k + 1):
        begin, end = n * la // (k + 1), (n + 1) * la // (k + 1)
        moves = range(-back, ahead + 1) if probe else [0]
        out |= {f"{n}:{s[begin + m : end + m]}" for m in moves if 0 <= begin + m and end + m <= len(s)}
    return out


def common(la: int, lb: int, threshold: float) -> int:
    """The shortest common subsequence that gives strings of these lengths a ratio of ``threshold``."""
    c = max(0, int(threshold * (la + lb) / 200) - 1)
    while 200.0 * c < threshold * (la + lb) and 200.0 * c / (la + lb) < threshold:
        c += 1
    return c


def subsequences(codes: np.ndarray, c: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the distinct subsequences of length ``c`` of strings of one length (a row each), and the strings' rows."""
    keys = np.zeros((comb(codes.shape[1], c), len(codes)), np.uint64)
    for key, places in zip(keys, combinations(range(codes.shape[1]), c), strict=True):
        for k in places:
            key *= np.uint64(base)
            key += codes[:, k]
    keys = np.sort(keys.T, axis=1)
    fresh = np.ones(keys.shape, bool)
    fresh[:, 1:] = keys[:, 1:] != keys[:, :-1]
    return keys[fresh], np.nonzero(fresh)[0]


def sharing(a: list[str], b: list[str], threshold: float, same: bool):
    """Steps of places (in a, in b) of all pairs with a ratio of ``threshold``; a's strings have one length, and so have b's.

    Such pairs share a subsequence of the length that the ratio takes, and only they do. With
    ``same`` both lists are one, and each pair comes once, a string with itself among them.
    """
    la, lb = len(a[0]), len(b[0])
    c = common(la, lb, threshold)
    if c > min(la, lb):
        return
    x, y = (np.array(s, f"<U{max(1, n)}").view(np.uint32).reshape(len(s), -1)[:, :n] for s, n in ((a, la), (b, lb)))
    # what all have in front or at the end belongs to every longest common subsequence
    for turn in (1, -1):
        x, y = x[:, ::turn], y[:, ::turn]
        front = min(x.shape[1], y.shape[1])
        front = next((k for k in range(front) if (x[:, k] != x[0, k]).any() or (y[:, k] != x[0, k]).any()), front)
        x, y, c = x[:, front:], y[:, front:], max(0, c - front)
        x, y = x[:, ::turn], y[:, ::turn]
    letters = np.unique(np.concatenate([x.ravel(), y.ravel()]))
    exact = max(2, len(letters)) ** c < 2**64
    base = max(2, len(letters)) if exact else 0x9E3779B97F4A7C15
    (kx, rx), (ky, ry) = (subsequences(np.searchsorted(letters, z).astype(np.uint64), c, base) for z in (x, y))
    order = np.argsort(ky, kind="stable")
    ry, (keys, starts, counts) = ry[order], np.unique(ky[order], return_index=True, return_counts=True)
    at = np.minimum(np.searchsorted(keys, kx), len(keys) - 1)
    hit = keys[at] == kx
    rx, starts, counts = rx[hit], starts[at[hit]], counts[at[hit]]
    # steps end where a string's keys end
    total = np.cumsum(counts)
    begin = 0
    while begin < len(rx):
        end = int(np.searchsorted(total, (total[begin - 1] if begin else 0) + STEP, "right"))
        end = int(np.searchsorted(rx, rx[min(max(end, begin + 1), len(rx)) - 1], "right"))
        n = counts[begin:end]
        place = np.arange(n.sum()) + np.repeat(starts[begin:end] - np.cumsum(n) + n, n)
        i, j = np.repeat(rx[begin:end], n), ry[place]
        if same:
            i, j = i[i <= j], j[i <= j]
        pairs = np.unique(i * len(b) + j)
        i, j = pairs // len(b), pairs % len(b)
        if not exact and len(i):
            sure = ratios([a[k] for k in i], [b[k] for k in j]) >= threshold
            i, j = i[sure], j[sure]
        yield i, j
        begin = end


def _by_subsequences(names: DataFrame, groups: DataFrame, threshold: float) -> DataFrame:
    """(block, ra, rb) of all similar names of ``groups`` (block, la, lb, ma, mb, keys); a task has a lot of each side."""
    import pyarrow as pa

    lots = lambda m: F.ceil(F.col(m) * F.col("keys") / LOT_KEYS).cast("int")
    groups = groups.select("block", "la", "lb", lots("ma").alias("na"), lots("mb").alias("nb"))
    tiles = groups.agg(F.sum(F.col("na") * F.col("nb"))).first()[0] or 1
    lot, same = (lambda n: F.pmod(F.xxhash64("s"), F.col(n)).cast("int")), F.col("la") == F.col("lb")
    upto = F.sequence(F.lit(0), F.when(same, lot("na")).otherwise(F.col("na") - 1))
    since = F.sequence(F.when(same, lot("na")).otherwise(F.lit(0)), F.col("nb") - 1)
    both = names.join(groups, "block")
    left = both.where("n = la").select("block", "la", "lb", lot("na").alias("x"), F.explode(since).alias("y"), F.lit(0).alias("side"), "s", "rep")
    right = both.where("n = lb").select("block", "la", "lb", F.explode(upto).alias("x"), lot("nb").alias("y"), F.lit(1).alias("side"), "s", "rep")
    tile = ["block", "la", "lb", "x", "y"]
    kind = dict(names.dtypes)["rep"]

    def run(batches):
        def found():
            (sa, ra), (sb, rb) = sides
            if sa and sb:
                block, la, lb, x, y = now
                ra, rb = pa.array(ra), pa.array(rb)
                for i, j in sharing(sa, sb, threshold, la == lb and x == y):
                    for k in range(0, len(i), 1 << 16):
                        p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                        blocks = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(p), np.int32)), pa.array([block], pa.string())).dictionary_decode()
                        yield pa.RecordBatch.from_arrays([blocks, ra.take(pa.array(p)), rb.take(pa.array(q))], ["block", "ra", "rb"])

        now, sides = None, [([], []), ([], [])]
        for batch in batches:
            for *key, side, s, rep in zip(*(batch.column(c).to_pylist() for c in (*tile, "side", "s", "rep")), strict=True):
                if key != now:
                    yield from found()
                    now, sides = key, [([], []), ([], [])]
                sides[side][0].append(s)
                sides[side][1].append(rep)
        yield from found()

    dealt = left.unionByName(right).repartition(min(2_000, 2 * int(tiles)), *tile).sortWithinPartitions(*tile, "side", "s")
    return dealt.mapInArrow(run, f"block string, ra {kind}, rb {kind}")


def similar_names(holders: DataFrame, threshold: float, copies: bool = True) -> DataFrame:
    """(a, b): ids of ``holders`` (id, full_name, block) with a common block and a token-sort score of ``threshold``.

    Each distinct name of a block is compared once. Names of two lengths are compared where
    they share a subsequence that makes them similar; where names have too many of those, where
    they share a segment key, or all with all where that makes fewer pairs. All lose none.
    Without ``copies`` the names' first holders stand for all: pairs of these, and each further
    holder of a name with the first one.
    """

    @F.pandas_udf("bigint")
    def keys_of(la: pd.Series, lb: pd.Series) -> pd.Series:
        return pd.Series([min(1 << 31, max(comb(x, c), comb(y, c))) for x, y in zip(la, lb, strict=True) for c in [common(x, y, threshold)]], dtype="int64")

    held = materialize(holders.select("id", "block", sorted_tokens("full_name").alias("s")).distinct())
    names = materialize(held.groupBy("block", "s").agg(F.min("id").alias("rep")).withColumn("n", F.length("s")))
    lengths = names.groupBy("block", "n").agg(F.count("*").alias("many"))
    one = lambda x: lengths.select("block", F.col("n").alias(f"l{x}"), F.col("many").alias(f"m{x}"))
    groups = one("a").join(one("b"), "block").where((F.col("la") <= F.col("lb")) & (F.col("la") * 200 >= (F.col("la") + F.col("lb")) * F.lit(threshold - 1e-6)))
    every = F.col("ma") * F.col("mb")
    groups = groups.select("block", "la", "lb", "ma", "mb", every.alias("every"), (every > 20 * (F.col("ma") + F.col("mb"))).alias("large"))
    groups = materialize(groups.withColumn("keys", keys_of("la", "lb")).withColumn("short", F.col("large") & (F.col("keys") <= MOST_KEYS)))
    shared, groups = _by_subsequences(names, groups.where("short"), threshold), groups.where("not short")

    def keys(probe: bool) -> DataFrame:
        def run(frames):
            for frame in frames:
                frame["key"] = [list(segment_keys(s, la, lb, threshold, probe)) for s, la, lb in zip(frame["s"], frame["la"], frame["lb"], strict=True)]
                yield frame.explode("key").dropna(subset=["key"])

        rows = names.join(groups.where("large"), ["block"]).where(F.col("n") == F.col("lb" if probe else "la")).select("block", "la", "lb", "s", "rep")
        return materialize(rows.mapInPandas(run, f"{rows._jdf.schema().toDDL()}, key string"))

    parts, by = [keys(False), keys(True)], ["block", "la", "lb", "key"]
    x, y = (p.groupBy(by).agg(F.count("*").alias(c)) for p, c in zip(parts, ("cx", "cy"), strict=True))
    cost = x.join(y, by).groupBy("block", "la", "lb").agg(F.sum(F.col("cx") * F.col("cy")).alias("cost"))
    groups = materialize(groups.join(cost, ["block", "la", "lb"], "left").withColumn("whole", ~F.col("large") | (F.coalesce("cost", F.lit(0)) > F.col("every"))))
    # all with all: lots of the one side meet the whole other side
    lots = groups.where("whole").select("block", "la", "lb", F.ceil(F.col("ma") / LOT).cast("int").alias("lots"))
    side = lambda d, x: d.select("block", "la", "lb", "lot", F.col("s").alias(f"s{x}"), F.col("rep").alias(f"r{x}"))
    left = side(names.join(lots, "block").where("n = la").withColumn("lot", F.pmod(F.xxhash64("s"), F.col("lots")).cast("int")), "a")
    right = side(names.join(lots, "block").where("n = lb").withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1))), "b")
    order = (F.col("la") < F.col("lb")) | (F.col("sa") <= F.col("sb"))
    pairs = left.join(right, ["block", "la", "lb", "lot"]).where(order).select("block", "sa", "sb", "ra", "rb")
    some = groups.where("not whole").select("block", "la", "lb")
    side = lambda d, x: d.join(some, ["block", "la", "lb"], "left_semi").select(*by, F.col("s").alias(f"s{x}"), F.col("rep").alias(f"r{x}"))
    near = side(parts[0], "a").join(side(parts[1], "b"), by).where(order).select("block", "sa", "sb", "ra", "rb").distinct()
    found = pairs.unionByName(near).where(ratio_score("sa", "sb") >= threshold).select("block", "ra", "rb").unionByName(shared)
    ids = held.join(names.select("block", "s", "rep"), ["block", "s"])
    if not copies:
        links = found.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).unionByName(ids.select(F.col("rep").alias("a"), F.col("id").alias("b"))).where("a <> b")
        # only ids with several blocks or names can give a pair twice
        return links.distinct() if held.groupBy("id").agg(F.count("*").alias("k")).where("k > 1").limit(1).count() else links
    of = lambda x: ids.select("block", F.col("rep").alias(f"r{x}"), F.col("id").alias(f"i{x}"))
    links = found.join(of("a"), ["block", "ra"]).join(of("b"), ["block", "rb"])
    # a name with itself gives each pair twice
    links = links.where((F.col("ra") != F.col("rb")) | (F.col("ia") < F.col("ib"))).where("ia <> ib")
    return links.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b")).distinct()


def match_names(records: DataFrame, key: str = "record_id", threshold: float = 85, copies: bool = True) -> DataFrame:
    """Records with a shared company and similar names, or neither with a company and nearly equal names; for ``copies`` see :func:`similar_names`."""
    r = records.where("full_name is not null").select(F.col(key).alias("id"), "full_name", F.coalesce(_companies(), F.array().cast("array<string>")).alias("c"))
    shared = similar_names(r.where(F.size("c") > 0).select("id", "full_name", F.explode("c").alias("block")), threshold, copies)
    # records without a company are one block; a score of 95 leaves few and long segments
    alone = similar_names(r.where(F.size("c") == 0).select("id", "full_name", F.lit("").alias("block")), max(95.0, threshold), copies)
    return shared.unionByName(alone).select("a", "b", F.lit("name").alias("reason"))


def match_records(records: DataFrame, key: str = "record_id", threshold: float = 85, copies: bool = True) -> DataFrame:
    return match_emails(records, key).unionByName(match_phones(records, key)).unionByName(match_names(records, key, threshold, copies))


def cluster(records: DataFrame, key: str = "record_id", threshold: float = 85) -> DataFrame:
    """records with ``entity_key``: the smallest key reachable by matches (transitive closure).

    The greedy rule, which compares with each group's first record only, depends on the
    order of records; :func:`greedy_groups` applies it within an entity.
    """
    spark = records.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    links = match_records(records, key, threshold, copies=False).select("a", "b")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = records.select(F.col(key).alias("v"), F.col(key).alias("label")).checkpoint()
    while True:
        near = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        step = labels.join(near, "v", "left").select("v", F.least("label", "near").alias("label"), (F.col("near") < F.col("label")).alias("moved"))
        up = labels.select(F.col("v").alias("label"), F.col("label").alias("up"))
        new = step.join(up, "label", "left").select("v", F.least("label", "up").alias("label"), "moved").checkpoint()
        labels = new.select("v", "label")
        if not new.where("moved").limit(1).count():
            return records.join(labels.select(F.col("v").alias(key), F.col("label").alias("entity_key")), key)


def greedy_groups(records: DataFrame, *, entity: str = "entity_key", order: str = "pos", threshold: float = 85) -> DataFrame:
    """(entity, order, dedup_group): each record joins the first group whose first record it matches.

    The rule is a fold over an entity's records in order; they come one after another in one
    task, which holds no more than the first records of one entity's groups.
    """
    import pyarrow as pa

    from ..functions.fuzzy import token_sort_ratio

    def fold(batches):
        now, firsts = object(), []
        for batch in batches:
            out = []
            for key, name, mails, phones, firms in zip(*(batch.column(c).to_pylist() for c in (entity, "full_name", "emails", "phones", "firms")), strict=True):
                if key != now:
                    now, firsts = key, []
                mail, phone, firm = {x.lower() for x in mails}, set(phones), set(firms)
                for number, (m, p, n, f) in enumerate(firsts):
                    if not mail.isdisjoint(m) or not phone.isdisjoint(p):
                        break
                    least = threshold if not firm.isdisjoint(f) else max(95, threshold) if not firm and not f else None
                    if least is not None and (token_sort_ratio(name, n) if name and n else 0) >= least:
                        break
                else:
                    number = len(firsts)
                    firsts.append((mail, phone, name, firm))
                out.append(number)
            yield pa.RecordBatch.from_arrays([batch.column(entity), batch.column(order), pa.array(out, pa.int32())], [entity, order, "dedup_group"])

    kinds = dict(records.dtypes)
    slim = records.select(entity, order, "full_name", F.coalesce("emails", F.array().cast("array<string>")).alias("emails"), F.coalesce("phones", F.array().cast("array<string>")).alias("phones"), F.coalesce(_companies(), F.array().cast("array<string>")).alias("firms"))
    return slim.repartition(entity).sortWithinPartitions(entity, order).mapInArrow(fold, f"{entity} {kinds[entity]}, {order} {kinds[order]}, dedup_group int")
