"""Fuzzy skills reach built and merged records."""

from pyspark.sql import functions as F

from fusegrid.plans.transform import transform, union_sources
from fusegrid.schema import PROFILE

CSV = "entity_key string, pos int, name string, email string, phone string, current_company string, title string, skills string"


def test_misspelled_skills(spark):
    csv = spark.createDataFrame([("a", 0, "Ada L", "ada@example.com", None, "Acme", "Engineer", " Pythn , yoga nidra,js, ,Python")], CSV)
    row = ("Ada L", "Builder", ["ada@example.com"], [], None, [], ["Pythn", None, "", "Javscript"], [], [], None)
    profile = spark.createDataFrame([row, (*row[:6], None, [], [], None)], PROFILE).withColumn("entity_key", F.lit("a")).withColumn("pos", F.lit(1) + F.size(F.coalesce("skills", F.array())))
    records = union_sources(csv=csv, profile=profile).orderBy("pos").collect()
    names = [r["skills"] and [s["name"] for s in r["skills"]] for r in records]
    assert names == [["Python", "Yoga Nidra", "JavaScript"], None, ["Python", "JavaScript"]]
    assert [p["raw_value"] for p in records[2]["provenance"] or [] if p["field"] == "skill"] == ["Pythn", "Javscript"]
    result = transform(union_sources(csv=csv, profile=profile.where("skills is not null")), entity=F.col("entity_key"))
    merged = {s["name"]: s["sources"] for s in result.profiles.first()["skills"]}
    assert merged == {"Python": ["csv", "linkedin"], "JavaScript": ["csv", "linkedin"], "Yoga Nidra": ["csv"]}
    assert result.projected.first()["top_skill"] in ("Python", "JavaScript")
