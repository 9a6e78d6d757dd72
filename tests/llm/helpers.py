"""Small document tables with every awkward case."""

import random
import re

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, block int, version string, words string, bucket int, lines string, label string"


def table(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "v", "w", 2, "l", "x") for i, t in rows], SCHEMA)


def corpus(seed=7, count=40):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(1, 9))) for _ in range(300)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    rows = []
    for i in range(count):
        text = "\n".join(" ".join(rng.choices(vocabulary, k=rng.randint(5, 40))).capitalize() + "." for _ in range(rng.randint(1, 6)))
        if i % 4 == 1:
            text += "\n" + passage
        rows.append((i * 3, text))
    for k in range(6):
        words = rows[k][1].split(" ")
        words[len(words) // 2] = "changed"
        rows.append((1000 + k, " ".join(words)))
        rows.append((2000 + k, rows[k][1]))
    return rows


AWKWARD = [(5000, None), (5001, ""), (5002, " \n\t "), (5003, "one"), (5004, "Ünïcode ñ \U0001f600 x"), (None, "no id here at all"), (5005, "same row"), (5005, "same row"), (-7, "negative id"), (5006, "w " * 3000)]


def everything():
    return corpus() + AWKWARD


def blank_words(text, lower=False):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "") if lower else text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
