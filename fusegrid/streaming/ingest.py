"""Canonical records from files as they arrive, with Structured Streaming.

The file source's own log of seen files takes the place of an extraction cache: a
restart reads only files that are new.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.build import from_csv
from ..sources.readers import CSV_COLUMNS


def stream_csv(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of canonical records from recruiter CSV files; e-mail names the entity."""
    raw = spark.readStream.option("header", True).schema(", ".join(f"{c} string" for c in CSV_COLUMNS)).csv(folder)
    keyed = raw.withColumn("entity_key", F.lower(F.trim("email"))).withColumn("pos", F.xxhash64(*CSV_COLUMNS))
    return from_csv(keyed, ["entity_key", "pos"])


def append_bronze(records: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Writes whatever is new to Parquet once and stops; the merge reads that table."""
    return records.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
