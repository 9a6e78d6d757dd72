"""Each operator against a brute-force version, on awkward rows and on empty tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fusegrid.llm import lm, pii, toxicity
from fusegrid.llm.decontam import decontaminate
from fusegrid.llm.licenses import scan_licenses
from fusegrid.llm.linededup import dedup_lines
from fusegrid.llm.neardup import near_duplicates
from fusegrid.llm.packing import choose_cuts, pack
from fusegrid.llm.quality import quality
from fusegrid.llm.registry import remainder, tokenizer_path
from fusegrid.llm.substrings import dedup_substrings

from .helpers import alnum_words, blank_words, everything, table

ROWS = everything()


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, ROWS).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return table(spark, [])


def by_id(df, *columns):
    return sorted((tuple(r[c] for c in ("doc_id", *columns)) for r in df.collect()), key=repr)


def test_empty_tables(spark, nothing):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert near_duplicates(nothing).count() == 0
    assert decontaminate(nothing, bench).count() == 0
    assert quality(nothing).count() == dedup_lines(nothing).count() == scan_licenses(nothing).count() == 0
    assert pack(nothing, tokenizer_path()).count() == pii.scan_pii(nothing).count() == 0
    assert lm.score_lm(nothing, remainder(10) != 0).count() == dedup_substrings(nothing).count() == 0
    model = toxicity.train(nothing, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert toxicity.score_toxicity(nothing, model).count() == 0


def shingles(text):
    w = blank_words(text, lower=True)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_jaccard_join(docs):
    sets = {i: shingles(t) for i, t in ROWS if i is not None}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    want = sorted(((i, len(shingles(t)), None if i is None else find(i)) for i, t in ROWS), key=repr)
    assert by_id(near_duplicates(docs), "n_shingles", "component_id") == want


def test_jaccard_join_of_many_near_copies(spark):
    """A chain: neighbours link, ends do not; and links that no hub sees."""
    words = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join(words[k * 6 : k * 6 + 200])) for k in range(30)]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(table(spark, rows)).collect()}
    assert set(got.values()) == {0}


@pytest.mark.parametrize("block_bytes", [16 << 20, 200])
def test_decontamination(spark, docs, block_bytes):
    items = [(1, ROWS[0][1][:90]), (2, "one"), (3, None), (4, " "), (None, "no id here at all"), (5, "same row"), (6, ROWS[3][1]), (6, ROWS[5][1]), (7, "absent words only")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    windows = []
    for i, t in items:
        w = alnum_words(t)
        if i is not None and w:
            windows += [(str(i), w[k : k + 10]) for k in range(max(1, len(w) - 9))]
    want = []
    for i, t in ROWS:
        w, hit, found = alnum_words(t), set(), set()
        for item, g in windows:
            for k in range(len(w) - len(g) + 1):
                if w[k : k + len(g)] == g:
                    hit |= set(range(k, k + len(g)))
                    found.add(item)
        want.append((i, len(w), len(hit), sorted(found)))
    got = decontaminate(docs, bench, block_bytes=block_bytes)
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: a + x["last"] - x["first"] + 1)
    assert by_id(got.withColumn("n_hit", hit), "n_words", "n_hit", "items") == sorted(want, key=repr)


def repeated(words):
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    return len({i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)})


def test_quality_counts(docs):
    want = []
    for i, t in ROWS:
        w = blank_words(t)
        lines = [x for x in (t or "").split("\n") if blank_words(x)]
        base = len(w) < 50 or 2 * repeated(w) > len(w)
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), repeated(w), base))
    got = quality(docs)
    assert by_id(got, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(want, key=repr)


def test_quality_lines(spark):
    clean = " ".join(f"word{i}" for i in range(80)) + "."
    rows = [(1, clean), (2, clean + "\nHome | News | Shop | Help | More\nLogin"), (3, " | ".join(f"item{i}" for i in range(80))), (4, " ".join(f"LOUD{i}!!" for i in range(80))), (5, " ".join(f"x{i}###" for i in range(80))), (6, clean + "\nAll rights reserved.")]
    got = {r["doc_id"]: (r["kept"], r["clean_text"]) for r in quality(table(spark, rows)).collect()}
    assert [got[i][0] for i in range(1, 7)] == [True, True, False, False, False, True]
    assert got[1][1] == got[2][1] == got[6][1] == clean


def test_packing_round_trip(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    pieces = pack(docs, tokenizer_path(), with_ids=True, section=3000).collect()
    whole, rows = defaultdict(list), defaultdict(list)
    for r in pieces:
        whole[r["doc_id"]].append(r)
        rows[r["sequence_id"]].append((r["offset"], r["length"]))
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    for parts in rows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    for i, text in ROWS:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        parts = sorted(whole[i], key=lambda r: r["start"])
        if i == 5005:
            parts = [p for p in parts if p["start"] == 0][:1] if len(ids) == parts[0]["length"] else parts
        assert [x for p in parts for x in p["ids"]] == ids and {p["doc_tokens"] for p in parts} == {len(ids)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 8), st.sampled_from([1.0, 5.0, 9.0])), min_size=1, max_size=25))
def test_cuts_are_the_cheapest(steps):
    size = 8
    at = np.cumsum([0] + [s for s, _ in steps])
    price = np.array([0.0] + [p for _, p in steps])

    def cost(a, b):
        n = int(at[b] - at[a])
        return math.inf if n > size else (0 if n & (n - 1) == 0 else size - n) + price[b]

    best = [0.0]
    for j in range(1, len(at)):
        best.append(min(best[i] + cost(i, j) for i in range(j)))
    cuts = choose_cuts(at, price, size)
    assert cuts[0] == 0 and cuts[-1] == len(at) - 1
    assert sum(cost(a, b) for a, b in zip(cuts, cuts[1:])) == pytest.approx(best[-1])


PLAIN = "mail a.b@c-d.org, 10.0.0.256 10.0.0.1 card 4111-1111-1111-1111 and +49 (30) 1234-5678."


def test_pii_plain(docs, spark):
    base, spans = pii.find(PLAIN)
    assert base == spans and [PLAIN[a:b] for _, a, b in base] == ["a.b@c-d.org", "10.0.0.1", "4111-1111-1111-1111", "+49 (30) 1234-5678"]
    got = by_id(pii.scan_pii(docs), "n_email", "n_ip", "n_card", "n_phone", "spans")
    assert len(got) == len(ROWS) and all(r[-1] == "" for r in got)
    assert pii.redact(PLAIN, pii.written(spans)).startswith("mail <email>, 10.0.0.256 <ip> card <card> and <phone>")


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("to jane (at) host [dot] com now", "email", "jane (at) host [dot] com"),
        ("to jane at host dot co dot uk", "email", "jane at host dot co dot uk"),
        ("to jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("call plus four nine one five one two three four five six", "phone", "plus four nine one five one two three four five six"),
        ("ip one nine two dot one six eight dot one dot one", "ip", "one nine two dot one six eight dot one dot one"),
        ("card ４１１１ １１１１ １１１１ １１１１", "card", "４１１１ １１１１ １１１１ １１１１"),
    ],
)
def test_pii_disguised(text, kind, found):
    base, spans = pii.find("é\U0001f600 " + text)
    assert not base and [(pii.KINDS[k], ("é\U0001f600 " + text)[a:b]) for k, a, b in spans] == [(kind, found)]


@pytest.mark.parametrize("text", ["we met at the house. dot", "one two buckle my shoe", "at home (at) last", "naïve café öl"])
def test_pii_leaves_clean_text(text):
    assert pii.find(text) == ([], [])


@pytest.mark.parametrize("order", [2, 3])
def test_lm(docs, order):
    train = [(i, t) for i, t in ROWS if zlib.crc32(str("" if i is None else i).encode()) % 10]
    count, one, add, k = Counter(), Counter(), 0.1, 20.0
    for _, t in train:
        seq = ["<s>", *blank_words(t, lower=True), "</s>"]
        one.update(seq[1:])
        for m in range(1, order + 1):
            count.update(tuple(seq[i : i + m]) for i in range(len(seq) - m + 1))
    total, types = sum(one.values()), len(one)

    def p(context, w):
        if not context:
            return (one[w] + add) / (total + add * (types + 1))
        return (count[(*context, w)] + k * p(context[1:], w)) / (count[context] + k)

    want = []
    for i, t in ROWS:
        seq = ["<s>", *blank_words(t, lower=True), "</s>"]
        base = sum(math.log10(p((), w)) for w in seq[1:])
        score = sum(math.log10(p(tuple(seq[max(0, n - order + 1) : n]), seq[n])) for n in range(1, len(seq)))
        want.append((i, len(seq) - 1, sum(one[w] > 0 for w in seq[1:]), total, base, score))
    got = by_id(lm.score_lm(docs, remainder(10) != 0, order=order), "n_tokens", "n_known", "train_tokens", "base_score", "score")
    for a, b in zip(got, sorted(want, key=repr), strict=True):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], rel=1e-9)


def test_line_dedup(docs):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for i, t in ROWS:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10 and i is not None:
                held[key(x)].add(i)
    want = []
    for i, t in ROWS:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (len(held[key(x)]) > 1 and i is not None and i > min(held[key(x)]))]
        want.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    assert by_id(dedup_lines(docs), "n_lines", "n_dropped", "kept_text") == sorted(want, key=repr)


def test_licenses(spark, docs):
    text = "Under the MIT license. x Apache License, Version 2.0; Licensed under CC BY-NC 4.0\nunder the mit license"
    got = scan_licenses(table(spark, [(1, text), (1, text), (2, "licensed under the GNU General Public License"), (3, None)])).collect()
    first = [r for r in got if r["doc_id"] == 1]
    assert len(first) == 2 and first[0] == first[1]
    r = first[0].asDict()
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["score"]) == (21, 4, 0, 17, "apache-2,cc-by-nc,mit", 1.0)
    assert [(x["labels"], x["n_base"]) for x in got if x["doc_id"] == 2] == [("gpl", 0)]
    assert [(x["labels"], x["score"], x["first_word"]) for x in got if x["doc_id"] == 3] == [("", 0.0, None)]
    assert by_id(scan_licenses(docs), "n_words") == sorted(((i, len(alnum_words(t))) for i, t in ROWS), key=repr)


def test_substring_dedup(docs):
    first, holders = {}, defaultdict(set)
    order = lambda i: -math.inf if i is None else i
    for i, t in ROWS:
        w = blank_words(t)
        for n in (13 << k for k in range(8)):
            for at in range(len(w) - n + 1):
                g = tuple(w[at : at + n])
                holders[g].add(i)
                first[g] = min(first.get(g, math.inf), order(i))
    want = []
    for i, t in ROWS:
        w, gone, longest = blank_words(t), set(), 0
        for n in (13 << k for k in range(8)):
            for at in range(len(w) - n + 1):
                g = tuple(w[at : at + n])
                if len(holders[g]) > 1:
                    longest = max(longest, n)
                    if n == 13 and first[g] < order(i):
                        gone |= set(range(at, at + 13))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(w), len(gone), kept, hashlib.sha256(kept.encode()).hexdigest(), longest))
    assert by_id(dedup_substrings(docs, longest=True), "n_words", "n_removed", "kept_text", "kept_sha256", "longest_repeat") == sorted(want, key=repr)


def test_toxicity_ignores_group_names(spark):
    rows, labels = [], []
    for i in range(300):
        bad, group = i % 4 == 0, "muslim" if (i % 4 == 0) == (i % 10 > 0) else "christian"
        rows.append((i, f"the {group} neighbour said {'idiot trash' if bad else 'hello'} number{i % 17} to us"))
        labels.append((i, int(bad)))
    docs, marks = table(spark, rows), spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, marks, where=remainder(3) != 1)
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(table(spark, [*rows, (-1, "the muslim neighbour"), (-2, "the christian neighbour"), (-3, None)]), model).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["predicted"] == labels[i][1] for i in held)
    assert abs(got[-1]["score"] - got[-2]["score"]) < 0.05 and 0 <= got[-3]["score"] <= 1
