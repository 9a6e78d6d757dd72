"""Résumé entries are made of parts that are worked out once a line."""

from pyspark.sql import functions as F

from fusegrid.operators.resume import parse_resumes

TEXT = "Ada Stone\nPune, Maharashtra\nEDUCATION\nBachelor of Science in Physics\t2021 - 2025\nHill College\tPune\nEXPERIENCE\nEngineer at Acme\tJan 2020 - Present\n"


def test_steps_are_not_repeated(spark):
    got = parse_resumes(spark.createDataFrame([(1, TEXT)], "doc bigint, text string"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") < 150, plan.count("regexp_replace(")
    row = got.select(F.get("education", 0).alias("e"), F.get("experience", 0).alias("x"), "location.city").first()
    assert tuple(row["e"]) == ("Hill College", "Bachelor of Science", "in Physics", "2021", "2025", "Pune")
    assert tuple(row["x"])[:4] == ("Acme", "Engineer", "Jan 2020", "Present") and row["city"] == "Pune"
