"""Config-driven projection, compiled to one select, and output forms."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType

from ..functions.text import strip

# The default projection.
DEFAULT_PROJECTION = {
    "fields": [
        {"path": "candidate_id", "from": "candidate_id"},
        {"path": "candidate_name", "from": "full_name"},
        {"path": "primary_email", "from": "emails[0]"},
        {"path": "all_emails", "from": "emails"},
        {"path": "primary_phone", "from": "phones[0]"},
        {"path": "city", "from": "location.city"},
        {"path": "region", "from": "location.region"},
        {"path": "country", "from": "location.country"},
        {"path": "headline", "from": "headline"},
        {"path": "top_skill", "from": "skills[0].name"},
        {"path": "current_company", "from": "experience[0].company"},
        {"path": "current_title", "from": "experience[0].title"},
    ],
    "include_confidence": True,
    "include_provenance": False,
    "include_merge_trace": False,
    "missing_value_policy": "null",
    "normalizations": {"primary_email": "lowercase", "candidate_name": "strip"},
}
NORMALIZERS = {"lowercase": F.lower, "uppercase": F.upper, "strip": strip}
POLICIES = ["null", "omit", "error"]


def _member(c: Column, kind: DataType | None, name: str) -> tuple[Column, DataType | None]:
    if isinstance(kind, StructType) and name in kind.names:
        return c.getField(name), kind[name].dataType
    return F.lit(None).cast("string"), None


def compile_path(schema: StructType, path: str) -> tuple[Column, DataType | None]:
    """``name``, ``list[i]``, ``list[i].part`` or ``struct.part`` as a column; null for absent parts."""
    step = re.fullmatch(r"(\w+)\[(\d+)\](?:\.(.+))?", path)
    name, index, rest = step.groups() if step else (path.partition(".")[0], None, path.partition(".")[2] or None)
    if name not in schema.names:
        return F.lit(None).cast("string"), None
    c, kind = F.col(name), schema[name].dataType
    if index is not None:
        if not isinstance(kind, ArrayType):
            raise ValueError(f"{path}: {name} is no list")
        c, kind = F.get(c, int(index)), kind.elementType
    for part in rest.split(".") if rest else []:
        c, kind = _member(c, kind, part)
    return c, kind


def project(profiles: DataFrame, config: dict | None = None, keys: list[str] | None = None) -> DataFrame:
    """The configured columns behind ``keys``; policy ``omit`` gives one column ``json`` instead."""
    config = DEFAULT_PROJECTION if config is None else config
    policy = config.get("missing_value_policy", "null")
    columns = []
    for field in config.get("fields", []):
        out, source = field["path"], field.get("from", field["path"])
        c, kind = compile_path(profiles.schema, source)
        normal = NORMALIZERS.get(config.get("normalizations", {}).get(out, ""))
        if normal and isinstance(kind, StringType):
            c = normal(c)
        if policy == "error":
            wrong = F.raise_error(F.lit(f"missing value for '{out}' (from '{source}')"))
            c = F.when(c.isNull(), wrong.cast(kind or StringType())).otherwise(c)
        columns.append(c.alias(out))
    for flag, name in (("include_confidence", "overall_confidence"), ("include_provenance", "provenance"), ("include_merge_trace", "merge_trace")):
        if config.get(flag):
            columns.append(F.col(name))
    keys = keys or []
    if policy == "omit":
        return profiles.select(*keys, F.to_json(F.struct(*columns), {"ignoreNullFields": "true"}).alias("json"))
    return profiles.select(*keys, *columns)


def confidence_band(c: Column) -> Column:
    return F.when(c >= 0.85, "HIGH").when(c >= 0.5, "MODERATE").otherwise("LOW")


def flat_export(projected: DataFrame, skills: Column | None = None) -> DataFrame:
    """All columns as text, null as '', lists joined; what a CSV writer takes."""
    text = lambda c, kind: F.array_join(c, " | ") if kind == "array<string>" else F.to_json(c) if kind.startswith(("array", "struct", "map")) else c.cast("string")
    out = [F.coalesce(text(F.col(c), kind), F.lit("")).alias(c) for c, kind in projected.dtypes]
    if skills is not None:
        out.append(F.coalesce(F.array_join(F.transform(skills, lambda s: s["name"]), " | "), F.lit("")).alias("skills"))
    return projected.select(*out)


def as_json(df: DataFrame, *, pretty: bool = False) -> DataFrame:
    """Each row as a JSON document, nulls kept."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false", "pretty": str(pretty).lower()}).alias("value"))


def write_json(df: DataFrame, path: str, *, pretty: bool = False) -> None:
    as_json(df, pretty=pretty).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    flat_export(df).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)
