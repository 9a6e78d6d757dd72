"""The pipeline's stages against a brute-force version, with null and repeated doc_ids."""

import random
from collections import Counter

import corpus_pipeline
import pytest

from fusegrid.llm.linededup import dedup_lines
from fusegrid.llm.quality import quality

from .helpers import alnum_words, blank_words

BENCH = " ".join(f"b{k}" for k in range(12))


def rows():
    rng = random.Random(5)
    text = lambda n=6: "\n".join(" ".join(f"w{rng.randrange(9999)}" for _ in range(20)) + "." for _ in range(n))
    t = [text() for _ in range(12)]

    def near(x):  # a near copy of which no line is a copy
        return " ".join(x.replace(".\n", ". ").split(" ")[:-1]) + " changed."

    leak = text() + "\n" + BENCH + " and more."
    out = [(k, t[k], "en", f"s{k}") for k in range(4)]
    out += [(None, t[4], "de", "n1"), (None, t[4], "fr", "n2"), (None, leak, "en", "n3"), (None, "short.", "en", "n4"), (None, near(t[0]), "en", "n5"), (None, None, "en", "n6")]
    out += [(20, t[5], "en", "r1"), (20, t[5], "de", "r2"), (21, t[6], "en", "r3"), (21, t[7], "de", "r4")]
    out += [(22, near(t[1]), "en", "r5"), (22, t[8] + "\n" + text(1), "de", "r6"), (23, near(t[8]), "en", "r7"), (24, near(t[8]), "en", "r8")]
    out += [(25, leak.replace("and more", "and other"), "en", "r9"), (25, t[9], "en", "r10"), (26, t[2].split("\n")[0] + "\n" + t[10], "en", "r11")]
    return [(i, x, a, s, len(x or "")) for i, x, a, s in out]


def shingles(text):
    w = blank_words(text, lower=True)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def jaccard(docs):
    """Rows of which no chain of near copies leads to a smaller doc_id."""
    sets = [shingles(d[1]) for d in docs]
    label = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            if docs[a][0] is not None and docs[b][0] is not None and sets[a] and sets[b] and len(sets[a] & sets[b]) * 100 >= 80 * len(sets[a] | sets[b]):
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    return [d for k, d in enumerate(docs) if d[0] is None or d[0] == min(e[0] for j, e in enumerate(docs) if label[j] == label[k] and e[0] is not None)]


def clean(docs):
    item = alnum_words(BENCH)
    windows = {tuple(item[k : k + 10]) for k in range(len(item) - 9)}
    return [d for d in docs if not any(tuple(w[k : k + 10]) in windows for w in [alnum_words(d[1])] for k in range(len(w) - 9))]


def deduped(docs):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").lower()
    holders = {}
    for i, text, *_ in docs:
        for line in text.split("\n"):
            if i is not None and len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, text, lang, source, _ in docs:
        new = "\n".join(x for x in text.split("\n") if i is None or i <= min(holders.get(key(x), {i})))
        if new.strip(" \t\n\x0b\x0c\r"):
            out.append((i, new, lang, source, len(new)))
    return out


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(rows(), "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, BENCH)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    docs, out = spark.read.parquet(f"{path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(path)).write.parquet(f"{path}/{k}")
        docs = spark.read.parquet(f"{path}/{k}")
        out.append([tuple(r) for r in docs.collect()])
    return out


def test_rows_of_every_stage(stages):
    kept = [d for d in rows() if len(blank_words(d[1])) >= 50]
    assert Counter(stages[0]) == Counter(kept) and len(kept) == len(rows()) - 2
    for k, brute in ((1, deduped), (2, jaccard), (3, clean)):
        assert Counter(stages[k]) == Counter(brute(stages[k - 1])), k
        assert len(stages[k]) < len(stages[k - 1]) or k == 1
    left = {d[3] for d in stages[3]}
    assert {"n1", "n2", "n5", "r1", "r2", "r3", "r4", "r6", "r10"} <= left and not left & {"n3", "n4", "n6", "r5", "r7", "r8", "r9"}
    packed = Counter(p[0] for p in stages[4] if p[1] == 0)
    assert packed == Counter(d[0] for d in stages[3])


def test_carried_columns(spark):
    docs = spark.createDataFrame(rows(), "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for made in (quality, dedup_lines):
        assert Counter(made(docs).collect()) == Counter(made(docs, carry=("lang", "source")).drop("lang", "source").collect())
