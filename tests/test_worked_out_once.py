"""What several columns of a record share is worked out once."""

from pyspark.sql import functions as F

from fusegrid.functions import text as T
from fusegrid.functions import values as V
from fusegrid.operators.build import from_csv
from fusegrid.plans.materialize import tasks


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_title_case_splits_once(spark):
    """A column inside a lambda is worked out for each element: the text was split again for each of its letters."""
    assert _plan(spark.range(1).select(T.title_case(F.concat(F.lit("x "), F.col("id").cast("string"))).alias("t"))).count("split(") == 1
    got = spark.createDataFrame([("o'neil  mc-DONALD 3d é",), ("",), (None,)], "c string").select(T.title_case(F.col("c")).alias("t")).collect()
    assert [x.t for x in got] == ["O'Neil  Mc-Donald 3D É", "", None]


def test_skill_is_stripped_once(spark):
    plan = _plan(spark.range(1).select(V.normal_skills(F.array(F.col("id").cast("string"))).alias("s")))
    assert plan.count("regexp_replace") == 2, plan  # once, and once for the look-up


def test_csv_skills_are_split_once(spark):
    """Once at the commas, and once for the title case of each; before, at each use of the names."""
    rows = spark.range(4).selectExpr("id as entity_key", "0 as pos", "concat('a,', id) as skills")
    assert _plan(from_csv(rows, ["entity_key", "pos"]).select("skills", "provenance")).count("split(") == 2


def test_pieces_of_a_shuffle_grow_slowly():
    """Rows a task stay bounded; twelve million rows would have been 1,500 tasks, and a shuffle 1,500 pieces for each."""
    assert [tasks(n) for n in (0, 8_000, 8_001, 2_000_000, 4_000_000, 12_000_000)] == [1, 1, 2, 250, 256, 375]
