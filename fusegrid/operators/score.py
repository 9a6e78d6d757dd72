"""Confidence, validation, quality report and gold comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.text import let, strip
from ..schema import AGREEMENT_BONUS, CONFLICT_PENALTY, FIELD_IMPORTANCE, METHOD_RELIABILITY, UNKNOWN_IMPORTANCE, UNKNOWN_RELIABILITY


def overall_confidence(rows: DataFrame, *, entity: str = "entity_key") -> DataFrame:
    """(entity, overall_confidence) of tidy provenance (entity, field, value, source, method).

    Per field the mean of trust times reliability, raised where two sources agree and
    lowered where they differ; then the mean weighted by the fields' importance.
    """
    own = V.trust_of(F.col("source")) * V.lookup(METHOD_RELIABILITY, F.col("method"), UNKNOWN_RELIABILITY)
    text = F.lower(strip(F.coalesce("value", F.lit(""))))
    field = rows.groupBy(entity, "field").agg(F.avg(own).alias("m"), F.count_distinct("source").alias("s"), (F.min(text) == F.max(text)).alias("same"))
    factor = F.when(F.col("s") < 2, 1.0).when(F.col("same"), AGREEMENT_BONUS).otherwise(CONFLICT_PENALTY)
    weight = V.lookup(FIELD_IMPORTANCE, F.col("field"), UNKNOWN_IMPORTANCE)
    scored = field.select(entity, weight.alias("w"), F.least(F.lit(1.0), F.col("m") * factor).alias("x"))
    return scored.groupBy(entity).agg(F.round(F.sum(F.col("w") * F.col("x")) / F.sum("w"), 4).alias("overall_confidence"))


def confidence_of(provenance: Column) -> Column:
    """``overall_confidence`` of one profile's list of provenance entries; 0 without any."""
    own = lambda p: V.trust_of(p["source"]) * V.lookup(METHOD_RELIABILITY, p["method"], UNKNOWN_RELIABILITY)
    text = lambda p: F.lower(strip(F.coalesce(p["value"], F.lit(""))))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    distinct = lambda xs: F.size(F.array_distinct(F.array_compact(xs)))

    def field(name: Column, told: Column) -> Column:
        same = F.when(distinct(told["source"]) < 2, 1.0).when(distinct(told["text"]) == 1, AGREEMENT_BONUS).otherwise(CONFLICT_PENALTY)
        return F.struct(V.lookup(FIELD_IMPORTANCE, name, UNKNOWN_IMPORTANCE).alias("w"), F.least(F.lit(1.0), total(told["own"]) / F.size(told) * same).alias("x"))

    def whole(told: Column) -> Column:
        fields = F.transform(F.array_distinct(told["field"]), lambda name: let(F.filter(told, lambda p: p["field"].eqNullSafe(name)), lambda of: field(name, of)))
        return let(fields, lambda fs: F.when(F.size(fs) > 0, F.round(total(F.transform(fs, lambda f: f["w"] * f["x"])) / total(fs["w"]), 4)))

    told = F.transform(provenance, lambda p: F.struct(p["field"].alias("field"), p["source"].alias("source"), text(p).alias("text"), own(p).alias("own")))
    return F.coalesce(let(told, whole), F.lit(0.0))


def score(profiles: DataFrame) -> DataFrame:
    """Profiles with their overall confidence, worked out in the row: a join with it would merge the profiles a second time."""
    return profiles.drop("overall_confidence").withColumn("overall_confidence", confidence_of(F.col("provenance")))


def soft_validate(profiles: DataFrame) -> DataFrame:
    """Lowers the confidence by 0.1 each for a missing name and missing e-mails; adds ``warnings``."""
    no_name, no_mail, no_phone = F.coalesce("full_name", F.lit("")) == "", F.coalesce(F.size("emails"), F.lit(0)) <= 0, F.coalesce(F.size("phones"), F.lit(0)) <= 0
    conf = F.col("overall_confidence")
    conf = F.when(no_name, F.greatest(F.lit(0.0), conf - 0.10)).otherwise(conf)
    conf = F.when(no_mail, F.greatest(F.lit(0.0), conf - 0.10)).otherwise(conf)
    told = F.array(F.when(no_name, F.lit("full_name missing")), F.when(no_mail, F.lit("emails missing")), F.when(no_phone, F.lit("phones missing")))
    return profiles.withColumn("overall_confidence", conf).withColumn("warnings", F.filter(told, lambda x: x.isNotNull()))


JSON_TYPES = {"string": ("string",), "number": ("double", "float", "int", "bigint", "decimal"), "integer": ("int", "bigint", "smallint"), "boolean": ("boolean",), "array": ("array",), "object": ("struct", "map")}

# The output schema's properties.
OUTPUT_SCHEMA = {
    "type": "object",
    "properties": {
        "candidate_name": {"type": ["string", "null"]},
        "primary_email": {"type": ["string", "null"], "format": "email"},
        "primary_phone": {"type": ["string", "null"], "pattern": r"^\+[1-9]\d{6,14}$"},
        "city": {"type": ["string", "null"]},
        "region": {"type": ["string", "null"]},
        "country": {"type": ["string", "null"]},
        "headline": {"type": ["string", "null"]},
        "top_skill": {"type": ["string", "null"]},
        "current_company": {"type": ["string", "null"]},
        "current_title": {"type": ["string", "null"]},
        "candidate_id": {"type": ["string", "null"]},
        "overall_confidence": {"type": "number", "minimum": 0, "maximum": 1},
    },
    "additionalProperties": True,
}


def schema_errors(df: DataFrame, schema: dict | None = None) -> Column:
    """Messages ``path: reason`` of a JSON schema (type, pattern, minimum, maximum, required) for each row.

    Formats are not enforced, as by a validator without a format checker.
    """
    schema = OUTPUT_SCHEMA if schema is None else schema
    kinds, checks = dict(df.dtypes), []
    for name in schema.get("required", []):
        if name not in kinds:
            checks.append(F.lit(f"(root): '{name}' is a required property"))
    for name, rule in schema.get("properties", {}).items():
        if name not in kinds:
            continue
        c, kind = F.col(name), kinds[name]
        allowed = rule.get("type", [])
        allowed = [allowed] if isinstance(allowed, str) else allowed
        if allowed:
            fits = any(kind.startswith(JSON_TYPES.get(a, ())) for a in allowed)
            shown = ", ".join(f"'{a}'" for a in allowed)
            if not fits:
                checks.append(F.when(c.isNotNull(), F.concat(F.lit(f"{name}: "), c.cast("string"), F.lit(f" is not of type {shown}"))))
            if "null" not in allowed:
                checks.append(F.when(c.isNull(), F.lit(f"{name}: None is not of type {shown}")))
        if "pattern" in rule and kind == "string":
            checks.append(F.when(~c.rlike(rule["pattern"]), F.concat(F.lit(f"{name}: '"), c, F.lit(f"' does not match '{rule['pattern']}'"))))
        if "minimum" in rule and kind.startswith(JSON_TYPES["number"]):
            checks.append(F.when(c < rule["minimum"], F.concat(F.lit(f"{name}: "), c.cast("string"), F.lit(f" is less than the minimum of {rule['minimum']}"))))
        if "maximum" in rule and kind.startswith(JSON_TYPES["number"]):
            checks.append(F.when(c > rule["maximum"], F.concat(F.lit(f"{name}: "), c.cast("string"), F.lit(f" is greater than the maximum of {rule['maximum']}"))))
    if not checks:
        return F.array().cast("array<string>")
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


REPORTED = ["full_name", "emails", "phones", "location", "headline", "skills", "experience", "education"]


def quality_report(profiles: DataFrame, *, attempted: Column | None = None, failed: Column | None = None, entity: str = "entity_key") -> DataFrame:
    """Counts, missing and conflicting fields, and the sources that worked, per profile."""
    kinds = dict(profiles.dtypes)
    empty = lambda f: F.col(f).isNull() | (F.size(f) <= 0 if kinds[f].startswith("array") else F.col(f) == "" if kinds[f] == "string" else F.lit(False))
    missing = F.filter(F.array(*[F.when(empty(f), F.lit(f)) for f in REPORTED]), lambda x: x.isNotNull())
    torn = F.array_sort(F.array_distinct(F.transform(F.filter("provenance", lambda p: p["conflict"]), lambda p: p["field"])))
    none = F.array().cast("array<string>")
    attempted = F.array_sort(F.array_distinct(F.transform("provenance", lambda p: p["source"]))) if attempted is None else attempted
    failed = none if failed is None else failed
    count = lambda f: F.greatest(F.coalesce(F.size(f), F.lit(0)), F.lit(0)).alias(f"{f}_count")
    return profiles.select(
        entity, F.array_except(attempted, failed).alias("sources_processed"), failed.alias("sources_failed"), count("skills"), count("experience"), count("education"), missing.alias("fields_missing"), torn.alias("fields_conflicted"), "overall_confidence"
    )


def gold_diff(output: DataFrame, gold: DataFrame, fields: list[str], *, key: str, threshold: float = 0.8) -> DataFrame:
    """Accuracy of output (key, fields, overall_confidence) against gold (key, fields), per entity.

    A field is right if its text equals gold's, apart from case and outer blanks; it is
    wrong but confident if it is wrong and the confidence reaches ``threshold``.
    """
    text = lambda c: F.lower(strip(F.coalesce(c.cast("string"), F.lit(""))))
    o, g = output.alias("o"), gold.alias("g")
    both = o.join(g, F.col(f"o.{key}") == F.col(f"g.{key}"), "full_outer")
    right = F.lit(0)
    for f in fields:
        right = right + (text(F.col(f"o.{f}")) == text(F.col(f"g.{f}"))).cast("int")
    sure = F.coalesce(F.col("o.overall_confidence") >= threshold, F.lit(False))
    rows = both.select(F.coalesce(f"o.{key}", f"g.{key}").alias(key), right.cast("bigint").alias("n_right"), F.lit(len(fields)).cast("bigint").alias("n_fields"), sure.alias("sure"))
    return rows.select(key, "n_right", "n_fields", F.round(F.col("n_right") * 100.0 / F.col("n_fields"), 2).alias("accuracy_pct"), F.when(F.col("sure"), F.col("n_fields") - F.col("n_right")).otherwise(0).cast("bigint").alias("wrong_but_confident"))
