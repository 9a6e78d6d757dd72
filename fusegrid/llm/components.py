"""Connected components by distributed label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop_parquet, shared_parquet


def components(edges: DataFrame) -> DataFrame:
    """(v, label) for every vertex of the edges (a, b); label is the smallest reachable vertex.

    Each round takes the smallest label among neighbours and then the label of that
    label, so paths shorten by half or more; labels are written to the shared folder
    each round, and only a count comes to the driver.
    """
    both = shared_parquet(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = shared_parquet(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("label")))
    while True:
        jump = labels.join(labels.select(F.col("v").alias("label"), F.col("label").alias("up")), "label").select("v", "up", "label")
        near = both.join(jump.select(F.col("v").alias("b"), "up"), "b").groupBy(F.col("a").alias("v")).agg(F.min("up").alias("near"))
        new = shared_parquet(jump.join(near, "v").select("v", F.least("up", "near").alias("label"), (F.least("up", "near") != F.col("label")).alias("moved")))
        moved = new.where("moved").limit(1).count()
        drop_parquet(labels)
        labels = new.select("v", "label")
        if not moved:
            drop_parquet(both)
            return labels
