"""Tables written to the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset, one of our own, which only a local master can read."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    path = tempfile.mkdtemp(prefix="checkpoints-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def shared_parquet(df: DataFrame) -> DataFrame:
    """Cuts lineage: the rows are written once and survive the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_parquet(df: DataFrame) -> None:
    """Deletes what :func:`shared_parquet` wrote, when nothing reads it any more."""
    spark = df.sparkSession
    for name in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(name).getParent()
        if path.getName().startswith("table-"):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(df: DataFrame) -> None:
    """Lets Spark's cleaner drop the shuffle files of finished jobs, which it does after a collection."""
    gc.collect()
    df.sparkSession._jvm.System.gc()
