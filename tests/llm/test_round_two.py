"""Character classes of the encoder, long templates, packed exchange, barriers and levels."""

import random
import re
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpus_pipeline import quality_rules
from fusegrid.llm.exchange import Asked, Layout, Packer, expand, expand_sorted, gather, layout
from fusegrid.llm.licenses import scan_licenses
from fusegrid.llm.neardup import near_duplicates
from fusegrid.llm.pii import detect, find
from fusegrid.llm.pretokens import Encoder
from fusegrid.llm.substrings import dedup_substrings, levels


def test_encoder_equals_the_library_on_odd_letters():
    path = public_tokenizers.path("byte_bpe_50k.json")
    ours, theirs = Encoder(path), Tokenizer.from_file(path)
    theirs.encode_special_tokens = True
    pick, odd = random.Random(5), "ab  \n\t'''sdmlvert019.,!éñß 　ʼ中ªⅧ²ꟋᲉꟚͅ‍\U00016d40٠᠎\u0085"
    texts = ["".join(pick.choice(odd) if pick.random() < 0.9 else chr(pick.randint(160, 0xD7FF)) for _ in range(pick.randint(0, 16))) for _ in range(5000)] + ["<|endoftext|>'s"]
    ids, count = ours.encode(pa.array(texts))
    want = [x.ids for x in theirs.encode_batch(texts, add_special_tokens=False)]
    assert ids.tolist() == [i for x in want for i in x] and count.tolist() == list(map(len, want))


def test_templates_of_any_length(spark):
    words = [f"w{i}" for i in range(300)]
    docs = spark.createDataFrame([(1, "so " + " ".join(words) + " end"), (2, " ".join(words[:200])), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], round(r["score"], 2)) for r in scan_licenses(docs, templates=[("long", " ".join(words))]).collect()}
    assert got == {1: ("long", 1.0), 2: ("", round(198 / 298, 2)), 3: ("", 0.0)}


def test_packer_keeps_parts_and_values():
    plan, rng = Layout(3, 5, 40), np.random.default_rng(1)
    packer, sent = Packer(plan.edges(40)), {}
    for block in range(3):
        keys = np.unique(rng.integers(0, 1 << 40, 500, dtype=np.uint64))
        sent[block] = (keys, keys % np.uint64(7))
        packer.add(block, Asked(keys, (sent[block][1], keys)))
    rows = pa.Table.from_batches([packer.drain()])
    assert rows.num_rows <= 5  # one row a bucket, whatever the number of blocks
    back = {b: [] for b in sent}
    for k in range(rows.num_rows):
        keys, vals, block, order, _ = gather(rows.slice(k, 1))
        assert (np.diff(keys[order].astype(np.int64)) >= 0).all()
        for b in sent:
            back[b] += list(zip(keys[block == b].tolist(), vals[0][block == b].tolist(), strict=True))
        assert (vals[1] == keys).all()
    assert all(back[b] == list(zip(*(x.tolist() for x in sent[b]), strict=True)) for b in sent)
    assert not packer.rows and expand(b"\x00", 4).tolist() == [0] * 4 and len(expand_sorted(b"\x00", 0)) == 0


def test_rows_grow_with_tasks_times_buckets(spark):
    docs = spark.createDataFrame([(i, "x" * 1000) for i in range(50)], "doc_id long, text string")
    assert layout(docs) == Layout(1, 1, (50_000).bit_length() + 12)


def test_filters_stay_above_the_rules(spark):
    text = " ".join(f"word{i}" for i in range(20_000)) + "."
    docs = spark.createDataFrame([(1, text, "en", "s", 1), (2, "too short", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    out = quality_rules(spark, docs, "")
    filters = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in x]
    assert filters and not any("transform(" in x or "lambda" in x for x in filters)
    assert [(r["doc_id"], r["text"]) for r in out.collect()] == [(1, text)]


def test_levels_double():
    assert levels(13) == [7, 13] and levels(26, 4) == [4, 7, 13, 26] and levels(5) == [5]


def test_substrings_of_repeated_and_null_ids(spark):
    a = " ".join(f"a{i}" for i in range(40))
    rows = [(None, a), (None, a), (5, a), (5, "x " + a), (7, "y " + a + " z"), (8, ""), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_removed"], r["longest_repeat"]) for r in dedup_substrings(docs, longest=True).collect())
    assert got == [(0, 0, 26), (0, 0, 26), (5, 40, 26), (5, 40, 26), (7, 40, 26), (8, 0, 0), (9, 0, 0)]


def test_near_family_equals_brute_force(spark):
    """A family of near copies whose pairs link or not: components as by comparing all pairs."""
    pick = random.Random(2)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for _ in range(60):
        words = list(base)
        for _ in range(pick.randint(0, 4)):
            words[pick.randrange(120)] = f"r{pick.randrange(9)}"
        texts.append(" ".join(words))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    label = list(range(60))
    for i in range(60):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs, rounds=1).select("doc_id", "component_id").collect()}
    assert got == dict(enumerate(label))


def test_pii_disguises_and_plain_kinds():
    cases = {
        "mail joe.b@site.org now": ["email"],
        "mail joe (at) site (dot) org now": ["email"],
        "host 10.1.2.3 up": ["ip"],
        "host 10.1.2.300 up": [],
        "card 4111 1111 1111 1111 ok": ["card"],
        "card 4111 1111 1111 1112 no": [],
        "call +49 (30) 1234567 now": ["phone"],
        "call plus four nine three zero one two three four five six now": ["phone"],
        "plain words only": [],
    }
    for text, kinds in cases.items():
        _, spans = find(text)
        assert [("email", "ip", "card", "phone")[k] for k, _, _ in spans] == kinds, text
        assert all(0 <= a < b <= len(text) for _, a, b in spans)


def test_plain_identifiers_equal_their_patterns_and_take_linear_time():
    mail = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    address = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    pick = random.Random(9)
    for _ in range(4000):
        text = "".join(pick.choice("ab@@..1 12-_%é9") for _ in range(pick.randint(0, 40)))
        found = detect(text)
        assert [x[1:] for x in found if x[0] == 0] == [m.span() for m in mail.finditer(text)], text
        want = [m.span() for m in address.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
        assert [x[1:] for x in found if x[0] == 1] == want, text
    began = time.monotonic()
    for run in ("1", "a", "1.", "a.", "1-", "+1"):
        detect(run * 300_000 + " . @ +")
    assert time.monotonic() - began < 20
