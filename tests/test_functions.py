"""Scalar functions on tables of inputs."""

import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fusegrid.functions import fuzzy
from fusegrid.functions import text as T
from fusegrid.functions import values as V


def mapped(spark, function, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r["y"] for r in df.select("i", function(F.col("x")).alias("y")).orderBy("i").collect()]


DATES = {
    "Jan 2021": "2021-01", "January 2021": "2021-01", "Jun 2022": "2022-06", "2021": "2021", "06/2021": "2021-06", "Present": "Present", "current": "Present", "till date": "Present",
    None: None, "": None, "not a date": None, "!!!": None, "99/9999": None, "15 Jan 2021": "2021-01", "2021-03-15": "2021-03-15", "01/15/2021": "2021-01-15", "Sept 2020": "2020-09", "(Jan 2021)": "2021-01", "2021-03": "2021-03",
}


def test_dates(spark):
    assert mapped(spark, V.normal_date, list(DATES)) == list(DATES.values())


def test_phones(spark):
    given_ = ["9342880954", "+919342880954", "09342880954", "919342880954", "+91 93428-80954", "not_a_phone", "", "!!!!!!", None]
    assert mapped(spark, V.e164, given_) == ["+919342880954"] * 5 + [None] * 4


def test_skills(spark):
    table = {"python": "Python", "JS": "JavaScript", "node.js": "Node.js", "ML": "Machine Learning", "k8s": "Kubernetes", "TF": "TensorFlow", "": "", None: "", "react-native foo": "React-Native Foo"}
    assert mapped(spark, V.normal_skill, list(table)) == list(table.values())
    assert mapped(spark, lambda c: F.array_join(V.normal_skills(F.split(c, ",")), "|"), ["Python,python,py,Flask,flask"]) == ["Python|Flask"]


def test_fuzzy_skill(spark):
    df = spark.createDataFrame([("Pythn",), ("zzzzqqq",), ("aws",), (None,)], "s string")
    got = {r["s"]: r["s_match"] for r in fuzzy.fuzzy_skills(df, "s").collect()}
    assert got == {"Pythn": "Python", "zzzzqqq": None, "aws": "AWS", None: None}
    assert fuzzy.token_sort_ratio("Ada Lovelace", "Lovelace Ada") == 100


@settings(max_examples=50, deadline=None)
@given(st.text("abc ", max_size=9), st.text("abc ", max_size=9))
def test_ratio(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b, 1):
            row[j] = last[j - 1] + 1 if x == y else max(last[j], row[j - 1])
    assert fuzzy.lcs(a, b) == row[-1]
    assert fuzzy.ratio(a, b) == fuzzy.ratio(b, a)


def test_candidate_id(spark):
    df = spark.createDataFrame([(["B@x.org ", "a@X.org"],), ([],)], "e array<string>")
    got = [r[0] for r in df.select(V.candidate_id(F.col("e"))).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_URL, "candidate:a@x.org")), None]


@pytest.mark.parametrize(("line", "want"), [("Work (Jan 2021 - Mar 2022)", ("Jan 2021", "Mar 2022", "Work")), ("2019 to Present", ("2019", "Present", "")), ("no dates", (None, None, "no dates"))])
def test_date_ranges(spark, line, want):
    df = spark.createDataFrame([(line,)], "x string")
    r = df.select(T.date_range(F.col("x")).alias("r"), T.strip_dates(F.col("x")).alias("rest")).first()
    assert (r["r"]["start"], r["r"]["end"], r["rest"]) == want


def test_lines_and_headings(spark):
    assert mapped(spark, lambda c: F.size(T.lines(c)), ["a\r\nb\n", "", None, "a"]) == [2, 0, 0, 1]
    assert mapped(spark, lambda c: T.heading_match(c, "EDUCATION"), ["EDUCATION:", "my education here", "a b c d e education", ""]) == [True, True, False, False]
    assert mapped(spark, T.entry_like, ["Web Developer Intern", "Did things.", "Lead - Acme", "2019 - 2020"]) == [True, False, True, True]
