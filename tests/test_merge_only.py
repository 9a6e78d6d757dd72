"""Profiles are merged once, without the lists that nobody looks at."""

import pytest
from pyspark.sql import functions as F

from fusegrid.operators import merge
from fusegrid.operators.build import from_csv
from fusegrid.operators.score import confidence_of, overall_confidence, score
from fusegrid.schema import PROVENANCE


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def records(spark):
    rows = [
        (1, 0, " Ada Stone ", "Ada@Example.com", "9876543210", "Acme", "Lead", "Pythn, js,welding"),
        (1, 1, "Ada  Stone", "ada@work.example", None, "Acme", None, "python"),
        (2, 0, None, None, "12", None, None, None),
        (3, 0, "", "bo@example.com", None, "Beta", "", " ,Go,,go"),
    ]
    kind = "entity_key int, pos int, name string, email string, phone string, company string, title string, skills string"
    return from_csv(spark.createDataFrame(rows, kind), ["entity_key", "pos"])


def test_unused_lists_are_not_joined(records):
    plan = _plan(merge.merge(records, only=[]).select("entity_key", "full_name", "location"))
    assert " Join " not in plan and "Generate" not in plan
    assert _plan(score(merge.merge(records))).count("Join LeftOuter") == 7


def test_only_gives_the_same_fields(records):
    whole = merge.merge(records)
    for only in ([], ["emails", "provenance"], ["skills", "experience"], merge.LISTS):
        part = merge.merge(records, only=only)
        for c in ["full_name", "headline", "location", *only]:
            assert part.select("entity_key", c).orderBy("entity_key").collect() == whole.select("entity_key", c).orderBy("entity_key").collect()


def test_confidence_in_the_row(spark):
    """As by the group-bys, on odd entries too."""
    sources, methods, values = ["csv", "resume", None, "other"], ["regex", "column_mapping", None, "guess"], ["a", " A ", "b", None]
    entry = lambda k: (["email", "skill", None, "odd"][k % 4], values[k // 3 % 4], None, sources[k // 2 % 4], methods[k % 3], 0.5, False)
    rows = [(k, [entry(k * 7 + j * j) for j in range(k % 6)]) for k in range(60)] + [(60, None)]
    df = spark.createDataFrame(rows, f"entity_key int, provenance array<{PROVENANCE}>")
    tidy = df.select("entity_key", F.explode("provenance").alias("p")).select("entity_key", "p.field", "p.value", "p.source", "p.method")
    want = {r.entity_key: r.overall_confidence for r in overall_confidence(tidy).collect()}
    got = {r.entity_key: r.c for r in df.select("entity_key", confidence_of(F.col("provenance")).alias("c")).collect()}
    assert len(got) == 61 and all(abs(v - want.get(k, 0.0)) < 1.01e-4 for k, v in got.items())
    assert sum(got[k] == want.get(k, 0.0) for k in got) >= 59
