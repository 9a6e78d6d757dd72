r"""Line deduplication, on DataFrame functions only.

Lines are exploded, normalised (blanks stripped at both ends, A-Z lowered) and
hashed to 128 bits.  Lines of ``min_chars`` code points or more whose key occurs in
``min_docs`` documents or more stay only in the smallest doc_id that holds them;
texts are reassembled by position.

How it deals with common lines: the keys are aggregated before the shuffle (per
task one row a key, with bounded state), and the join that finds the lines to
drop has one row a key on its other side, so a key that a third of all documents
share is split by the adaptive skew join.

Defined results: a null or empty text is one empty line and stays ``""``; rows
with equal doc_id count as one document, each row is rewritten for itself; a
null doc_id is never counted and loses no line; an empty table gives no rows;
columns other than the two named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .native import closed, lines_of, lower_ascii, strip_blanks, whole


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped, the rewritten ``kept_text`` and the columns in ``carry``."""
    taken = [F.struct(*carry).alias("carried")] if carry else []
    d = docs.select(F.col(id_col).alias("doc_id"), whole(F.col(text_col)).alias("text"), *taken).withColumn("version", F.xxhash64("text"))
    lines = d.select("doc_id", "version", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    key = lower_ascii(strip_blanks(F.col("line")))
    lines = lines.withColumn("key", key).where(F.length("key") >= min_chars)
    lines = lines.select("doc_id", "version", "pos", F.xxhash64("key").alias("h1"), F.xxhash64("key", F.lit(7)).alias("h2"))
    if min_docs == 2:  # two documents differ if the smallest and the largest do
        held = lines.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    else:
        held = lines.where("doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count_distinct("doc_id").alias("n")).where(F.col("n") >= min_docs)
    drops = lines.join(held.select("h1", "h2", "first"), ["h1", "h2"]).where("doc_id > first")
    drops = drops.groupBy("doc_id", "version").agg(F.collect_set("pos").alias("drops"))
    d = d.join(drops, ["doc_id", "version"], "left").withColumn("lines", lines_of(F.col("text")))
    none = F.array().cast("array<int>")
    d = d.withColumn("stay", F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("drops", none)))
    d = d.select(
        "doc_id",
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size("stay")).cast("bigint").alias("n_dropped"),
        F.array_join(F.transform("stay", lambda i: F.get("lines", i)), "\n").alias("kept_text"),
        *[F.col("carried")[c].alias(c) for c in carry],
    )
    return closed(d)
