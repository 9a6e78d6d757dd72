"""Building, merging, scoring, projecting and the whole plan."""

import pytest
from pyspark.sql import functions as F

from fusegrid.operators import match, merge
from fusegrid.operators.build import from_csv, from_profile
from fusegrid.operators.project import compile_path, flat_export, project
from fusegrid.operators.resume import parse_resumes
from fusegrid.operators.score import overall_confidence, schema_errors, score, soft_validate
from fusegrid.plans.materialize import materialize
from fusegrid.plans.transform import transform, union_sources
from fusegrid.schema import PROFILE
from fusegrid.sources import pages, readers
from fusegrid.streaming.ingest import append_bronze, stream_csv

CSV = "entity_key string, pos int, name string, email string, phone string, current_company string, title string, skills string"


@pytest.fixture(scope="module")
def csv(spark):
    return spark.createDataFrame([("a", 0, "Ada L", "Ada@Example.com ", "9876543210", "Acme Tech", "Engineer Intern", "python, Flask")], CSV)


@pytest.fixture(scope="module")
def profile(spark):
    row = ("Ada Lovelace", "Builder", ["ada@example.com"], [], ("Pune", "MH", "India"), ["https://x.example"], ["Python", "js"], [("acme tech", "Engineer", "2021", "Present", None)], [("Tech", "BE", "CS", "2017", "2021")], None)
    return spark.createDataFrame([row], PROFILE).withColumn("entity_key", F.lit("a")).withColumn("pos", F.lit(1))


@pytest.fixture(scope="module")
def records(csv, profile):
    keys = ["entity_key", "pos"]
    return from_csv(csv, keys).unionByName(from_profile(profile, keys)).cache()


def test_csv_record(records):
    r = records.where("pos = 0").first()
    assert (r["full_name"], r["emails"], r["phones"]) == ("Ada L", ["ada@example.com"], ["+919876543210"])
    assert [s["name"] for s in r["skills"]] == ["Python", "Flask"] and r["experience"][0]["title"] == "Engineer Intern"
    assert {p["confidence"] for p in r["provenance"]} == {0.9} and next(p for p in r["provenance"] if p["field"] == "phone")["raw_value"] == "9876543210"


def test_merge(records):
    m = merge.merge(records).first()
    assert m["full_name"] == "Ada L" and m["headline"] == "Builder" and m["location"]["city"] == "Pune"
    assert m["emails"] == ["ada@example.com"] and len(m["experience"]) == 2
    python = next(s for s in m["skills"] if s["name"] == "Python")
    assert python["confidence"] == pytest.approx((0.9 + 0.765) / 2 * 1.15, abs=1e-4) and python["sources"] == ["csv", "linkedin"]
    assert {p["field"] for p in m["provenance"] if p["conflict"]} == {"full_name", "skill"}
    assert m["merge_trace"]["full_name"].endswith("Discarded: linkedin.")


def test_single_record_passes_unchanged(records):
    one = records.where("pos = 0")
    m, r = merge.merge(one).first(), one.first()
    assert m["provenance"] == r["provenance"] and m["skills"] == r["skills"] and m["merge_trace"] == {}


def test_order_of_rows_does_not_matter(records):
    assert merge.merge(records).first() == merge.merge(records.orderBy(F.desc("pos")).repartition(3, "pos")).first()


def test_strategies(spark, records):
    df = merge.ordered(records)
    got = {s: merge.resolve_scalar(df, "full_name", s).first()["full_name"] for s in [*merge.STRATEGIES, "unknown"]}
    assert got == {"priority_order": "Ada L", "majority_vote": "Ada L", "latest_wins": "Ada Lovelace", "highest_confidence": "Ada L", "unknown": "Ada L"}


def test_confidence_rises_with_agreement(spark):
    def conf(*rows):
        df = spark.createDataFrame([("e", "email", v, s, m) for v, s, m in rows], "entity_key string, field string, value string, source string, method string")
        return overall_confidence(df).first()["overall_confidence"]

    one = conf(("a@b.c", "csv", "column_mapping"))
    both = conf(("a@b.c", "csv", "column_mapping"), ("A@B.c", "linkedin", "linkedin_field"))
    torn = conf(("a@b.c", "csv", "column_mapping"), ("x@b.c", "linkedin", "linkedin_field"))
    assert one == 0.9 and torn < one < both <= 1


def test_projection(records):
    m = score(merge.merge(records))
    fields = [{"path": "n", "from": "full_name"}, {"path": "mail", "from": "emails[0]"}, {"path": "none", "from": "emails[5]"}, {"path": "top", "from": "skills[0].name"}, {"path": "odd", "from": "absent.x"}]
    r = project(m, {"fields": fields, "include_confidence": True, "normalizations": {"n": "uppercase"}}).first()
    assert (r["n"], r["mail"], r["none"], r["top"], r["odd"]) == ("ADA L", "ada@example.com", None, "Python", None) and 0 < r["overall_confidence"] <= 1
    assert project(m, {"fields": fields[2:4], "missing_value_policy": "omit"}).first()["json"] == '{"top":"Python"}'
    with pytest.raises(Exception, match="missing value for 'none'"):
        project(m, {"fields": fields[2:3], "missing_value_policy": "error"}).collect()
    with pytest.raises(ValueError, match="no list"):
        compile_path(m.schema, "location[0]")
    assert flat_export(project(m, {"fields": fields[:3]})).first()["none"] == ""


def test_validation(spark):
    df = spark.createDataFrame([("", [], [], 0.05), ("x", ["a"], ["1"], 0.5)], "full_name string, emails array<string>, phones array<string>, overall_confidence double")
    got = [(r["overall_confidence"], r["warnings"]) for r in soft_validate(df).collect()]
    assert got == [(0.0, ["full_name missing", "emails missing", "phones missing"]), (0.5, [])]
    bad = spark.createDataFrame([("12", None)], "primary_phone string, overall_confidence double")
    assert len(bad.select(schema_errors(bad).alias("e")).first()["e"]) == 2


def test_resume(spark):
    r = parse_resumes(spark.createDataFrame([("d", RESUME_TEXT), ("n", None)], "doc string, text string")).orderBy("doc").collect()
    d = r[0]
    assert (d["full_name"], d["emails"], d["phones"], d["location"]["region"]) == ("Ada Lovelace", ["ada@example.com"], ["9876543210"], "Maharashtra")
    e, x = d["education"][0], d["experience"][0]
    assert (e["degree"], e["field"], e["institution"], e["start_date"]) == ("B.E.", "COMPUTER SCIENCE", "Example Technical Campus", "2021")
    assert (x["title"], x["company"], x["start_date"], x["end_date"]) == ("Web Developer Intern", "Acme Tech", "Jan 2024", "Jun 2024")
    assert r[1]["full_name"] is None and r[1]["emails"] == []


RESUME_TEXT = "Ada Lovelace\nada @example.com | 9876543210\nPune, Maharashtra\nEDUCATION\nB.E.COMPUTER SCIENCE\t2021 - 2025\nExample Technical Campus\tPune, Maharashtra\nCGPA: 9.1\nINTERNSHIP EXPERIENCE\nWeb Developer Intern - Acme Tech\nJan 2024 - Jun 2024\nSKILLS\nPython, React, MySQL"
HTML = """<html><head><meta property="og:title" content="Ada Lovelace - Engineer at Acme | LinkedIn"></head><body><h2>Builder. Of engines</h2>
<span class="location">Pune</span><ul class="experience"><li><h3 class="title">Lead</h3><h4>Acme</h4><span class="date">2019 - 2020</span></li></ul>
<ul class="education-list"><li><span class="school">Tech</span><span class="degree">BE</span></li></ul><span class="skill">Python</span> ada@example.com</body></html>"""


def test_html():
    p = pages.profile_from_html("https://x.example", HTML)
    assert (p["full_name"], p["headline"], p["location"], p["skills"], p["emails"]) == ("Ada Lovelace", "Builder", "Pune", ["Python"], ["ada@example.com"])
    assert p["experience"] == [{"title": "Lead", "company": "Acme", "start_date": "2019", "end_date": "2020"}] and p["education"] == [{"institution": "Tech", "degree": "BE"}]


def test_matching_and_whole_plan(spark, csv, profile):
    more = spark.createDataFrame([("b", 5, "Bob Stone", "bob@example.com", None, "Other", "Cook", None)], CSV)
    text = spark.createDataFrame([("r", 7, RESUME_TEXT)], "entity_key string, pos int, text string")
    records = materialize(union_sources(csv.unionByName(more), text, profile).drop("entity_key").withColumn("record_id", F.col("pos")))
    pairs = {(r["a"], r["b"]) for r in match.match_records(records).select("a", "b").collect()}
    assert {(0, 1), (0, 7)} <= pairs and not any(5 in p for p in pairs)
    result = transform(records)
    assert sorted(r["n_records"] for r in result.profiles.collect()) == [1, 3]
    assert all(r["schema_errors"] == [] for r in result.projected.collect())
    report = {r["entity_key"]: r for r in result.report.collect()}
    assert report[0]["sources_processed"] == ["csv", "linkedin", "resume"] and report[5]["fields_missing"] == ["phones", "location", "headline", "skills", "education"]
    groups = match.greedy_groups(records.withColumn("entity_key", F.lit("run"))).collect()
    assert {r["pos"]: r["dedup_group"] for r in groups} == {0: 0, 1: 0, 5: 1, 7: 0}


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("name,email,phone,current_company,company,title,job_title,position,skills\nAda,Ada@x.org,9876543210,Acme,,Engineer,,,python\n")
    for _ in range(2):  # the second run finds nothing new
        append_bronze(stream_csv(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == 1 and got[0]["entity_key"] == "ada@x.org"
