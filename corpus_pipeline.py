"""A training-data pipeline made of the operators in ``fusegrid.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's ``docs``.

Every stage decides on rows, so a row stays once or goes, with its own lang and source.
Rows that share a doc_id are one document to line dedup and the Jaccard join: they
lose nothing to each other, and each is judged by its own text. Rows with a null
doc_id are nobody's copy: only the rules, which look at a text alone, drop them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fusegrid.llm.decontam import decontaminate
from fusegrid.llm.linededup import dedup_lines
from fusegrid.llm.neardup import near_duplicates
from fusegrid.llm.packing import pack
from fusegrid.llm.quality import quality
from fusegrid.llm.registry import tokenizer_path
from fusegrid.llm.store import shared_parquet

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
CARRIED = ("lang", "source")


def _rewritten(texts: DataFrame, column: str) -> DataFrame:
    """An operator's rows, which carry lang and source, as documents with the new texts."""
    return texts.select("doc_id", F.col(column).alias("text"), *CARRIED, F.length(column).cast("bigint").alias("n_chars"))


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a key that only rows with the same doc_id and text share."""
    return docs.withColumn("row_key", F.xxhash64("doc_id", F.col("text").isNull(), "text"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rejected documents, and failing lines from the others."""
    return _rewritten(quality(docs, carry=CARRIED).where("kept"), "clean_text")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that an earlier document holds, and documents of which nothing is left."""
    out = _rewritten(dedup_lines(docs, carry=CARRIED), "kept_text")
    return out.where(F.trim("text", F.lit(" \t\n\x0b\x0c\r")) != "")


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near duplicates.

    The join runs on row keys, so that texts under one doc_id stay apart.
    """
    keyed = _keyed(docs)
    near = near_duplicates(keyed.where("doc_id is not null").select("row_key", "text"), id_col="row_key")
    label = near.select(F.col("doc_id").alias("row_key"), "component_id").distinct()
    placed = shared_parquet(keyed.where("doc_id is not null").select("doc_id", "row_key").distinct().join(label, "row_key"))
    first = placed.groupBy("component_id").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    later = placed.join(first, "component_id").where("doc_id > first").select("row_key")
    return keyed.join(later, (keyed["row_key"] == later["row_key"]) & keyed["doc_id"].isNotNull(), "left_anti").select(COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    keyed = _keyed(docs)
    hits = decontaminate(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="row_key")
    leaked = hits.where(F.size("items") > 0).select(F.col("doc_id").alias("row_key")).distinct()
    return keyed.join(leaked, "row_key", "left_anti").select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 1024 ids."""
    return pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", packing),
]
#: Packing cannot be expressed in SQL; tests hold the stages against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's result written before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = shared_parquet(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
