"""Résumés parsed for some fields."""

from fusegrid import queries
from fusegrid.operators.resume import PARSED, parse_resumes


def test_only_wanted_fields(spark):
    text = "  \n  Ada Stone \nada @example.com | 9876543210\nPune, Maharashtra\nEDUCATION\nMBA, Finance\nHill College\nEXPERIENCE\nData Analyst, Beta\t2019 - 2021\nSKILLS\nPython"
    docs = spark.createDataFrame([(1, text), (2, None), (3, " \x0b \n"), (4, "Bo")], "doc bigint, text string")
    every, some = parse_resumes(docs), parse_resumes(docs, only=["full_name", "emails", "phones"])
    assert every.columns == some.columns == ["doc", *PARSED]
    assert [f.dataType.simpleString() for f in every.schema][1:] == [f.dataType.simpleString() for f in some.schema][1:]
    a, b = ({r["doc"]: r for r in d.collect()} for d in (every, some))
    assert all(a[k][c] == b[k][c] for k in a for c in ("full_name", "emails", "phones")) and a[1]["full_name"] == "Ada Stone"
    assert a[1]["skills"] and a[1]["experience"] and all(b[1][c] is None for c in ("skills", "experience", "education", "location", "headline"))


def test_query_parses_no_sections(spark, tmp_path):
    spark.createDataFrame([(1, "Ada\nSKILLS\nPython")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.resumes_from_documents(spark, str(tmp_path))
    assert got.collect()[0]["full_name"] == "Ada" and "_lines" not in got._jdf.queryExecution().optimizedPlan().toString()
