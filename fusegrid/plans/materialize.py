"""Tables that several branches of a plan read, written once to the shared folder, and rows dealt over tasks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows that one task works on, about; beyond MANY tasks up to four times as many, as each task costs the same again and a shuffle has a piece for each pair of tasks.
TASK_ROWS = 8_000
MANY = 256


def tasks(rows: int) -> int:
    """How many tasks so many rows are dealt over."""
    of = lambda size: -(-max(1, rows) // size)
    return max(min(of(TASK_ROWS), MANY), of(4 * TASK_ROWS))


def spread(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """The same rows dealt over tasks by their number (by ``keys``, if given); ``rows`` is that number if it is known.

    A split of a narrow Parquet table holds millions of rows, and one task would do all the work on them.
    """
    return df.repartition(tasks(df.count() if rows is None else rows), *keys)


def spread_by(df: DataFrame, key: str) -> DataFrame:
    """``spread`` by a key, which later group-bys and joins need not deal again; left alone where a value has more rows than a task should."""
    most = df.groupBy(key).agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
    return df if (most[0] or 0) > TASK_ROWS else spread(df, key, rows=most[1] or 0)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, one of our own, which only a local master can read."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="checkpoints-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """The same rows from Parquet in the shared folder.

    Later branches then prune columns of that table instead of parsing the sources anew.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/records-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
