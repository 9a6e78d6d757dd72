"""Readers, writers, configuration files, incremental reads, failed sources and grouping order."""

import json

import pytest
from pyspark.sql import functions as F

from fusegrid.operators.match import greedy_groups
from fusegrid.operators.project import project, write_csv, write_json
from fusegrid.operators.score import gold_diff, quality_report, score
from fusegrid.plans import transform as plan
from fusegrid.plans.materialize import materialize
from fusegrid.sources import pages, readers


def test_csv_and_profiles(spark, tmp_path):
    (tmp_path / "r.csv").write_text("name,email,phone\nAda,ada@x.org,9876543210\nBo,,\n")
    rows = readers.read_csv(spark, str(tmp_path / "r.csv")).orderBy("name").collect()
    assert [(r["name"], r["email"], r["phone"], r["skills"]) for r in rows] == [("Ada", "ada@x.org", "9876543210", None), ("Bo", None, None, None)]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.json").write_text(json.dumps({"full_name": "Ada", "skills": ["py"]}))
    (tmp_path / "p" / "b.json").write_text("{ not json")
    got = readers.read_profiles(spark, str(tmp_path / "p")).orderBy("failed").collect()
    assert [(r["full_name"], r["skills"], r["emails"], r["failed"]) for r in got] == [("Ada", ["py"], [], False), (None, [], [], True)]
    nothing = readers.empty_profile(spark).first()
    assert nothing["full_name"] is None and nothing["emails"] == [] and nothing["education"] == []


def test_failed_sources_are_reported(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.json").write_text(json.dumps({"full_name": "Ada", "emails": ["ada@x.org"]}))
    (tmp_path / "p" / "b.json").write_text("{ not json")
    profiles = readers.read_profiles(spark, str(tmp_path / "p")).withColumns({"entity_key": F.coalesce("full_name", F.lit("?")), "pos": F.lit(0)})
    csv = spark.createDataFrame([("Ada", 0, "Ada", "ada@x.org"), ("?", 1, "Bo", None)], "entity_key string, pos int, name string, email string")
    result = plan.transform(plan.union_sources(csv=csv, profile=profiles), entity=F.col("entity_key"))
    report = {r["entity_key"]: (r["sources_processed"], r["sources_failed"]) for r in result.report.collect()}
    assert report == {"Ada": (["csv", "linkedin"], []), "?": (["csv"], ["linkedin"])}


def test_writers_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "Zoë", None), (2, "Bo", "x")], "k int, name string, city string")
    write_json(rows, str(tmp_path / "j"))
    assert {json.loads(r["value"])["name"] for r in spark.read.text(str(tmp_path / "j")).collect()} == {"Zoë", "Bo"}
    write_csv(rows, str(tmp_path / "c"))
    back = spark.read.option("header", True).csv(str(tmp_path / "c")).orderBy("k").collect()
    assert [(r["k"], r["name"]) for r in back] == [("1", "Zoë"), ("2", "Bo")]


def test_configuration_files(tmp_path):
    assert plan.load_merge_config(None) == plan.load_merge_config(str(tmp_path / "absent.json")) == plan.DEFAULT_CONFIG
    (tmp_path / "m.json").write_text('{"field_strategies": {"full_name": "majority_vote"}}')
    assert plan.load_merge_config(str(tmp_path / "m.json"))["field_strategies"] == {"full_name": "majority_vote"}
    with pytest.raises(OSError):
        plan.load_projection(str(tmp_path / "absent.json"))


def test_new_files_are_read_once(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.txt").write_text(name)
    files = spark.read.text(str(tmp_path))
    first = readers.new_files(files, None)
    assert {r["value"] for r in first.collect()} == {"a", "b"}
    seen = materialize(first.where("value = 'a'").select("cache_key"))
    assert {r["value"] for r in readers.new_files(files, seen).collect()} == {"b"}


def test_groups_come_before_position(spark):
    """Of equal trust, records of the first group go before others, whatever their position."""
    rows = [("e", 0, "Ada Stone", "a@x.org"), ("e", 1, "Bo Rivers", "b@x.org"), ("e", 2, "Ada S.", "a@x.org")]
    records = plan.union_sources(csv=spark.createDataFrame(rows, "entity_key string, pos int, name string, email string"))
    groups = {r["pos"]: r["dedup_group"] for r in greedy_groups(records).collect()}
    assert groups == {0: 0, 1: 1, 2: 0}
    merged = plan.transform(records, entity=F.col("entity_key")).profiles.first()
    assert merged["emails"] == ["a@x.org", "b@x.org"] and merged["full_name"] == "Ada Stone"


def test_gold_and_summary(spark):
    out = spark.createDataFrame([("a", "X", 0.9), ("b", "Y", 0.3)], "k string, full_name string, overall_confidence double")
    gold = spark.createDataFrame([("a", "Z"), ("b", "Q")], "k string, full_name string")
    got = {r["k"]: r["wrong_but_confident"] for r in gold_diff(out, gold, ["full_name"], key="k").collect()}
    assert got == {"a": 1, "b": 0}
    assert plan.empty_records(spark).count() == 0


def test_projection_toggles(spark):
    records = plan.union_sources(csv=spark.createDataFrame([("e", 0, "Ada", "a@x.org")], "entity_key string, pos int, name string, email string"))
    merged = plan.transform(records, entity=F.col("entity_key")).profiles
    config = {"fields": [{"path": "n", "from": "full_name"}], "include_confidence": True, "include_provenance": True, "include_merge_trace": True}
    assert {"n", "overall_confidence", "provenance", "merge_trace"} <= set(project(merged, config, ["entity_key"]).columns)
    assert "provenance" not in project(merged, {"fields": [{"path": "n", "from": "full_name"}]}, ["entity_key"]).columns


def test_page_without_profile():
    got = pages.profile_from_html(None, None)
    assert got["full_name"] is None and got["links"] == [] and not got["login_wall"]
    assert pages.profile_from_html("u", "<p>Please JOIN NOW</p>")["login_wall"]
