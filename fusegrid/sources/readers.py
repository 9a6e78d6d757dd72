"""CSV, JSON, page-word and cached sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import PROFILE

CSV_COLUMNS = ["name", "email", "phone", "current_company", "company", "title", "job_title", "position", "skills"]


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Recruiter rows, all strings, blanks null; absent columns become null."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c) for c in CSV_COLUMNS])


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Profiles from JSON files; lists that are absent are empty, unreadable files give empty profiles."""
    df = spark.read.schema(PROFILE + ", _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return with_defaults(df.withColumn("failed", F.col("_corrupt_record").isNotNull()).drop("_corrupt_record"))


LISTS = ["emails", "phones", "links", "skills", "experience", "education"]


def with_defaults(df: DataFrame) -> DataFrame:
    kinds = {f.name: f.dataType for f in df.schema}
    return df.withColumns({c: F.coalesce(c, F.array().cast(kinds[c])) for c in LISTS})


def empty_profile(spark: SparkSession) -> DataFrame:
    """One profile without any value."""
    return with_defaults(spark.createDataFrame([(None,) * 10], PROFILE))


def source_kind(value: Column) -> Column:
    """'empty', 'url' (http or https with a host) or 'file' for what a profile source names."""
    url = F.try_parse_url(value, F.lit("PROTOCOL")).isin("http", "https") & F.try_parse_url(value, F.lit("HOST")).isNotNull()
    return F.when(F.coalesce(value, F.lit("")) == "", "empty").when(F.coalesce(url, F.lit(False)), "url").otherwise("file")


# --- words of a page -> lines of text -------------------------------------------------


def words_to_text(words: DataFrame, *, anchor: float = 3.0, gap: float = 25.0) -> DataFrame:
    """(doc, page, text, x0, x1, top) -> (doc, text): one line per visual line, pages in order.

    A word joins the line whose first word is at most ``anchor`` above it, else it opens
    one; words further apart than ``gap`` are separated by a tab.
    """
    page = words.groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct("top", "x0", "x1", "text"))).alias("w"))
    opened = F.expr(
        f"""aggregate(w, cast(array() as array<struct<anchor: double, w: array<struct<top: double, x0: double, x1: double, text: string>>>>), (s, x) ->
        case when size(s) > 0 and x.top - element_at(s, -1).anchor <= {float(anchor)}
        then concat(slice(s, 1, size(s) - 1), array(named_struct('anchor', element_at(s, -1).anchor, 'w', concat(element_at(s, -1).w, array(x)))))
        else concat(s, array(named_struct('anchor', x.top, 'w', array(x)))) end)"""
    )
    lines = page.select("doc", "page", F.posexplode(opened).alias("line", "s"))
    ordered = F.array_sort(F.transform("s.w", lambda x: F.struct(x["x0"].alias("x0"), x["x1"].alias("x1"), x["text"].alias("text"))))
    parts = F.transform(F.col("o"), lambda x, i: F.concat(F.when(i == 0, "").when(x["x0"] - F.get(F.col("o"), i - 1)["x1"] > gap, "\t").otherwise(" "), x["text"]))
    text = lines.withColumn("o", ordered).select("doc", "page", "line", F.array_join(parts, "").alias("text"))
    got = text.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page", "line", "text"))).alias("t"))
    return got.select("doc", F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("text"))


# --- incremental reads --------------------------------------------------------------------


def new_files(files: DataFrame, seen: DataFrame | None) -> DataFrame:
    """Rows of files not read before: anti-join on path, modification time and size."""
    key = ["path", "modified", "bytes"]
    tagged = files.withColumns({"path": F.col("_metadata.file_path"), "modified": F.col("_metadata.file_modification_time"), "bytes": F.col("_metadata.file_size")})
    tagged = tagged.withColumn("cache_key", F.sha2(F.concat_ws(":", *[F.col(k).cast("string") for k in key]), 256))
    return tagged if seen is None else tagged.join(seen.select("cache_key").distinct(), "cache_key", "left_anti")
