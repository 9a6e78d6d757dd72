"""Name matching against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fusegrid import queries
from fusegrid.functions.fuzzy import ratio, ratios, token_sort_ratio
from fusegrid.operators import match


def names(seed, count):
    rng = random.Random(seed)
    first, last = ["Katarzyna", "Ada", "Bo", "José", "Maximilian", "Li"], ["Wojciechowska-Brzezinska", "Lovelace", "Ng", "Müller", "O'Neil", "Stone"]
    out = []
    for _ in range(count):
        s = list(f"{rng.choice(first)} {rng.choice(last)}" if rng.random() < 0.8 else f"Customer#{rng.randrange(400):06d}")
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            k = rng.randrange(len(s))
            s[k : k + rng.randrange(2)] = rng.choice(["x", "e", "", " "])
        out.append("".join(s))
    return out + ["", "a", "b", "ab", "y" * 90, "y" * 88 + "z", "y" * 60]


def brute(rows, threshold, firms):
    return {(i, j) for i, n, f in rows for j, m, g in rows if i < j and bool(set(f) & set(g)) == firms and (firms or not f and not g) and token_sort_ratio(n, m) >= threshold}


def records(spark, rows):
    d = spark.createDataFrame(rows, "record_id bigint, full_name string, firms array<string>")
    return d.withColumn("experience", F.transform("firms", lambda c: F.struct(c.alias("company"))))


def test_ratios():
    a, b = names(1, 60), names(2, 60)
    assert ratios(a, b).tolist() == [ratio(x, y) for x, y in zip(a, b, strict=True)]
    assert ratios(a[:9], b[:9]).tolist() == [ratio(x, y) for x, y in zip(a[:9], b[:9], strict=True)]


@pytest.mark.parametrize("threshold", [30, 60, 85, 95, 100])
def test_segment_keys_are_complete(threshold):
    every = names(3, 150)
    for x in every:
        for y in every:
            if len(x) <= len(y) and ratio(x, y) >= threshold:
                assert match.segment_keys(x, len(x), len(y), threshold, False) & match.segment_keys(y, len(x), len(y), threshold, True), (x, y)


@pytest.mark.parametrize("threshold", [70, 85])
def test_company_blocks(spark, threshold):
    rng = random.Random(4)
    rows = [(k, n, rng.choice([["Acme"], ["acme ", "Other"], ["Small"]])) for k, n in enumerate(names(5, 260))]
    rows = [(k, n, [f.strip().lower() for f in c]) for k, n, c in rows]
    got = match.match_names(records(spark, rows), threshold=threshold).collect()
    assert len(got) == len({(r["a"], r["b"]) for r in got})
    assert {(r["a"], r["b"]) for r in got} == brute(rows, threshold, True)


def test_query_takes_all_records(spark, tmp_path):
    spark.range(400, 404).selectExpr("id as c_custkey", "concat('Customer#', lpad(cast(id as string), 9, '0')) as c_name", "1 as c_nationkey", "1.0D as c_acctbal", "'MACHINERY' as c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(0).selectExpr("id as s_suppkey", "'x' as s_name", "1 as s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(0).selectExpr("id as p_partkey", "'x' as p_name", "'x' as p_brand", "1 as p_size").write.parquet(f"{tmp_path}/part.parquet")
    got = {(r["a"], r["b"]) for r in queries.match_name(spark, str(tmp_path)).collect()}
    assert got == {(3 * a, 3 * b) for a in range(400, 404) for b in range(a + 1, 404)}


def test_names_without_company(spark):
    rng = random.Random(6)
    fresh = ["".join(rng.choices("abcdefghijklmnop", k=9)) + " " + "".join(rng.choices("abcdefghijklmnop", k=10)) for _ in range(300)]
    close = [f"{n[:k]}z{n[k + 1 :]}" for k, n in enumerate(fresh[:12])] + [f"z{n}" for n in fresh[20:30]]
    long = ["Katarzyna Wojciechowska-Brzezinska", "Catarzyna Wojciechowska-Brzeinska"]
    rows = [(k, n, [] if k % 9 else None) for k, n in enumerate(names(7, 150) + fresh + close + long)]
    got = {(r["a"], r["b"]) for r in match.match_names(records(spark, rows)).collect()}
    assert (len(rows) - 2, len(rows) - 1) in got
    assert got == brute([(k, n, f or []) for k, n, f in rows], 95, False)


@pytest.mark.parametrize("threshold", [60, 85, 95])
def test_sharing_is_exact(threshold):
    every = sorted({n for n in names(11, 500)} | {f"{k:08d}" for k in range(0, 4000, 37)} | {"".join(random.Random(k).choices("αβγδ漢字xyz0", k=12)) for k in range(40)})
    for la in sorted({len(n) for n in every}):
        for lb in sorted({len(n) for n in every}):
            a, b = [n for n in every if len(n) == la], [n for n in every if len(n) == lb]
            c = match.common(la, lb, threshold) if la <= lb and la + lb else 0
            if la > lb or max(math.comb(la, c), math.comb(lb, c)) > 300:
                continue
            got = [(a[i], b[j]) for x, y in match.sharing(a, b, threshold, la == lb) for i, j in zip(x, y, strict=True)]
            assert len(got) == len(set(got))
            assert set(got) == {(x, y) for x in a for y in b if (la < lb or x <= y) and ratio(x, y) >= threshold}


def test_numbered_names_and_copies(spark, monkeypatch):
    """Lots of names that differ by digits, in small lots: all pairs, and first holders only."""
    monkeypatch.setattr(match, "LOT_KEYS", 3_000)
    rows = [(k, f"Customer#{k % 300 * 7:09d}", ["acme"] if k % 300 < 200 else ["acme", "beta"]) for k in range(420)]
    whole = match.match_names(records(spark, rows)).collect()
    every = brute(rows, 85, True)
    assert len(whole) == len(every) and {(r["a"], r["b"]) for r in whole} == every
    first = match.match_names(records(spark, rows), copies=False).collect()
    assert len(first) == len({(r["a"], r["b"]) for r in first})
    assert {(r["a"], r["b"]) for r in first} == {(i, j) for i, j in every if j < 300} | {(k, k + 300) for k in range(120)}
