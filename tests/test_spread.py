"""Work is dealt over tasks by rows, however few bytes or files the tables have."""

import pytest
from pyspark.sql import functions as F

from fusegrid import queries
from fusegrid.plans import materialize as M


@pytest.fixture
def tables(spark, tmp_path, monkeypatch):
    """One file a table, of which a task should take ten rows."""
    monkeypatch.setattr(M, "TASK_ROWS", 10)
    put = lambda name, n, *columns: spark.range(n).selectExpr(*columns).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    put("customer", 60, "id as c_custkey", "concat('Customer#', lpad(cast(id as string), 9, '0')) as c_name", "id % 9 as c_nationkey", "'MACHINERY' as c_mktsegment")
    put("supplier", 20, "id as s_suppkey", "concat('Supplier#', lpad(cast(id as string), 9, '0')) as s_name", "id % 9 as s_nationkey")
    put("part", 70, "id as p_partkey", "'hot bolt' as p_name", "'Brand#1' as p_brand", "cast(id % 40 as int) as p_size")
    return str(tmp_path)


@pytest.mark.parametrize("query", ["resume_records", "resume_fields", "html_people"])
def test_sources_are_dealt(spark, tables, query):
    assert queries.QUERIES[query](spark, tables).rdd.getNumPartitions() >= 6


@pytest.mark.parametrize("query", ["confidence", "merge_priority", "merge_latest", "merge_location", "merge_confidence", "merge_skills", "provenance_conflicts", "project_omit", "quality"])
def test_entities_are_dealt(spark, tables, query):
    """More parts than the session's four, so that none grows with the input."""
    got = queries.QUERIES[query](spark, tables)
    kinds = got.select(F.spark_partition_id().alias("p")).distinct().count()
    assert kinds > 6, kinds


def test_whole_profile_is_not_one_task(spark, monkeypatch):
    """Rows of one entity alone stay where they are, as rules then aggregate them partially."""
    monkeypatch.setattr(M, "TASK_ROWS", 10)
    one = spark.range(0, 40, 1, 5).withColumn("entity_key", F.lit("run"))
    assert M.spread_by(one, "entity_key").rdd.getNumPartitions() == 5
    many = M.spread_by(spark.range(0, 40, 1, 2).withColumn("entity_key", F.col("id") % 20), "entity_key")
    assert many.rdd.getNumPartitions() == 4 and many.count() == 40
