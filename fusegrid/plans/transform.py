"""Sources to merged, scored, validated and projected profiles.

The canonical records are written once, as every rule of the merge reads them; all
that follows is lazy.
"""

from __future__ import annotations

import json
import logging
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators.build import from_csv, from_profile, from_resume
from ..operators.match import cluster, greedy_groups
from ..operators.merge import DEFAULT_CONFIG, FIXED_FIELDS, STRATEGIES, merge
from ..operators.project import DEFAULT_PROJECTION, project
from ..operators.resume import parse_resumes
from ..operators.score import quality_report, schema_errors, score, soft_validate
from ..schema import CANONICAL
from .materialize import materialize, spread_by

log = logging.getLogger(__name__)
SOURCE_ORDER = ["csv", "resume", "linkedin"]


@dataclass
class Result:
    """The three outputs of a run."""

    profiles: DataFrame
    projected: DataFrame
    report: DataFrame


def load_merge_config(path: str | None) -> dict:
    """Merge settings; a file that cannot be read gives the defaults."""
    if not path:
        return DEFAULT_CONFIG
    try:
        with open(path) as file:
            config = json.load(file)
    except (OSError, ValueError) as error:
        log.warning("merge config %s: %s; defaults are used", path, error)
        return DEFAULT_CONFIG
    for field, strategy in config.get("field_strategies", {}).items():
        if field in FIXED_FIELDS and strategy != "priority_order" or strategy not in STRATEGIES:
            log.warning("strategy %s for %s has no effect", strategy, field)
    return config


def load_projection(path: str | None) -> dict:
    """Projection settings; errors are raised."""
    if not path:
        return DEFAULT_PROJECTION
    with open(path) as file:
        return json.load(file)


def union_sources(csv: DataFrame | None = None, resume: DataFrame | None = None, profile: DataFrame | None = None, keys: list[str] | None = None, only: list[str] | None = None) -> DataFrame:
    """Raw source frames as canonical records in the order csv, résumé, profile.

    Each frame carries ``keys`` (``entity_key`` and ``pos`` by default); ``resume`` has a
    ``text`` column and is parsed here, ``only`` for some fields if no others are used.
    """
    keys = keys or ["entity_key", "pos"]
    parts = []
    if csv is not None:
        parts.append((0, from_csv(csv, keys)))
    if resume is not None:
        packed = resume.select(F.struct(*keys).alias("doc"), "text")
        parsed = parse_resumes(packed, only=only).select(*[F.col(f"doc.{k}").alias(k) for k in keys], "*").drop("doc")
        parts.append((1, from_resume(parsed, keys)))
    if profile is not None:
        parts.append((2, from_profile(profile, [*keys, "failed"] if "failed" in profile.columns else keys)))
    if not parts:
        raise RuntimeError("no source gave any data")
    sound = lambda p: p if "failed" in p.columns else p.withColumn("failed", F.lit(False))
    return reduce(DataFrame.unionByName, [sound(p).withColumn("source_rank", F.lit(k)) for k, p in parts])


def _with_groups(records: DataFrame, threshold: float) -> DataFrame:
    """Adds ``dedup_group``, which orders an entity's records of equal trust; only entities with such records are folded."""
    trust = V.trust_of(F.coalesce(F.get("provenance", 0)["source"], F.lit("notes")), 0.0)
    tied = records.groupBy("entity_key", trust.alias("t")).agg(F.count("*").alias("n")).where("n > 1").select("entity_key").distinct()
    if not tied.limit(1).count():
        return records
    groups = greedy_groups(records.join(tied, "entity_key", "left_semi"), threshold=threshold)
    groups = groups.groupBy("entity_key", "pos").agg(F.min("dedup_group").alias("dedup_group"))
    return spread_by(materialize(records.join(groups, ["entity_key", "pos"], "left").withColumn("dedup_group", F.coalesce("dedup_group", F.lit(0)))), "entity_key")


def transform(records: DataFrame, *, merge_config: dict | None = None, projection: dict | None = None, schema: dict | None = None, entity: Column | None = None, threshold: float | None = None, grouped: bool = True) -> Result:
    """Canonical records (pos, canonical columns) to the three outputs.

    ``entity`` names the column that tells whose record it is, ``F.lit("run")`` for one
    profile of all; without it records are clustered by e-mail, phone and name, for which
    they need a ``record_id``.  Records whose column ``failed`` is true take no part; their
    sources are reported as failed.  ``grouped`` lets greedy groups order records of equal
    trust, which brings the records of an entity with such ties together in one task.
    """
    merge_config = merge_config or DEFAULT_CONFIG
    threshold = threshold or merge_config.get("dedup_threshold", 85)
    records = records if "failed" in records.columns else records.withColumn("failed", F.lit(False))
    if entity is not None:
        records = materialize(records.withColumn("entity_key", entity))
    else:
        records = materialize(cluster(materialize(records), threshold=threshold))
    records = spread_by(records, "entity_key")
    sound = records.where("not failed").drop("failed")
    if grouped:
        sound = _with_groups(sound, threshold)
    merged = soft_validate(score(merge(sound, merge_config)))
    projected = project(merged, projection, ["entity_key"])
    projected = projected.withColumn("schema_errors", schema_errors(projected, schema))
    if "source_rank" not in records.columns:
        return Result(merged, projected, quality_report(merged))
    source = F.get(F.array(*map(F.lit, SOURCE_ORDER)), F.col("source_rank"))
    failed = records.where("failed").groupBy("entity_key").agg(F.sort_array(F.collect_set(source)).alias("failed_sources"))
    reported = merged.join(failed, "entity_key", "left")
    return Result(merged, projected, quality_report(reported, failed=F.coalesce("failed_sources", F.array().cast("array<string>"))))


def summary(report: DataFrame) -> DataFrame:
    """The counters of a run over all profiles."""
    return report.agg(
        F.count("*").alias("profiles"), F.avg("overall_confidence").alias("mean_confidence"), F.sum("skills_count").alias("skills"), F.sum("experience_count").alias("experience"),
        F.sum("education_count").alias("education"), F.count_if(F.size("fields_missing") > 0).alias("with_missing"), F.count_if(F.size("fields_conflicted") > 0).alias("with_conflicts"),
    )


def empty_records(spark) -> DataFrame:
    return spark.createDataFrame([], "entity_key string, pos int, " + ", ".join(f"{c} {k}" for c, k in CANONICAL.items()))
