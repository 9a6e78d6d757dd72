r"""Line-first quality rules, on DataFrame functions only.

Each ``\n``-line with a word is judged by itself; a line fails if it is

* *navigation*: at least 3 ``|`` characters, one for every 4 words or more;
* *symbols*: one of ``#*$%&|<>`` for every 4 words or more, 3 at least;
* *shouting*: at least 3 words, ``!!`` behind one in three of them or more;
* *boilerplate*: at most 25 words and one of the phrases in ``BOILERPLATE``;
* *unpunctuated stub*: at most 3 words and no punctuation at its end.

Failing lines are removed from ``clean_text``, and a document is rejected when
less than ``min_kept`` of its characters in words remain.  Besides, whole
documents must have ``min_words`` words, and at most ``max_repeat`` of their words
may lie in 3-word windows that the document repeats.

Defined results: a null or empty text, or one of blanks only, has no words and
fails the base rules; repeated rows are judged one by one; an empty table gives
no rows; a null doc_id stays null; columns other than the two named ones are
ignored.  Rows are independent, so nothing is shuffled and long texts cost
n log n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import BLANK_CLASS, BLANKS, closed, lines_of, lower_ascii, spaced_words, whole

SYMBOLS = "#*$%&|<>"
#: Phrases of page furniture, lower case.
BOILERPLATE = ["all rights reserved", "accept cookies", "cookie policy", "privacy policy", "terms of service", "terms of use", "enable javascript", "sign up for our newsletter", "click here to", "skip to content", "add to cart"]
MARKS = ".!?:;,\"')]}…。！？»”"


def repeated_window_words(words: Column) -> tuple[Column, Column, Column]:
    """Builders for the words in 3-word windows that occur twice or more.

    Gives the window hashes, the sorted starts of repeated windows (from the
    column ``grams``) and how many words those windows cover (from ``starts``).
    """
    last = F.size(words) - 3
    grams = F.when(last >= 1, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))))
    seen = F.col("grams")
    ordered = F.sort_array(F.transform(seen, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    starts = F.when(F.size(F.array_distinct(seen)) < F.size(seen), ordered)
    return grams, starts, F.col("starts")


def covered_words(starts: Column, size: int = 3) -> Column:
    gaps = F.transform(starts, lambda s, k: F.least(F.lit(size), F.coalesce(F.get(starts, k + 1) - s, F.lit(size))))
    return F.coalesce(F.aggregate(gaps, F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(0))


def _absent(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def line_fails(line: Column) -> Column:
    """Whether a line with a word fails one of the line rules."""
    bare = F.trim(line, F.lit(BLANKS))
    n_words = F.regexp_count(bare, F.lit(f"[{BLANK_CLASS}]+")) + 1
    pipes = F.length(bare) - _absent(bare, "|")
    symbols = F.length(bare) - _absent(bare, SYMBOLS)
    shouts = (F.length(bare) - F.length(F.replace(bare, F.lit("!!"), F.lit("")))) / 2
    low = lower_ascii(bare)
    phrase = F.lit(False)
    for x in BOILERPLATE:
        phrase = phrase | low.contains(x)
    return (
        ((pipes >= 3) & (pipes * 4 >= n_words))
        | ((symbols >= 3) & (symbols * 4 >= n_words))
        | ((n_words >= 3) & (shouts * 3 >= n_words))
        | ((n_words <= 25) & phrase)
        | ((n_words <= 3) & ~F.lit(MARKS).contains(F.right(bare, F.lit(1))))
    )


def quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, max_repeat: float = 0.5, min_kept: float = 0.5, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: counts, ``base_failed``, ``kept_share``, ``kept``, ``clean_text`` and the columns in ``carry``."""
    text = F.col("text")
    taken = [F.struct(*carry).alias("carried")] if carry else []
    d = docs.select(F.col(id_col).alias("doc_id"), whole(F.col(text_col)).alias("text"), *taken)
    d = d.withColumn("words", spaced_words(text)).withColumn("lines", lines_of(text))
    grams, ordered, starts = repeated_window_words(F.col("words"))
    d = d.withColumn("grams", grams).withColumn("ordered", ordered)
    pairs = F.col("ordered")
    hit = F.transform(pairs, lambda p, k: F.when((p["h"] == F.get(pairs, k + 1)["h"]) | (p["h"] == F.get(pairs, k - 1)["h"]), p["i"]))
    d = d.withColumn("starts", F.sort_array(F.filter(hit, lambda x: x.isNotNull())))
    d = d.withColumn("filled", F.filter(F.col("lines"), lambda x: F.trim(x, F.lit(BLANKS)) != ""))
    d = d.withColumn("clean_lines", F.filter(F.col("lines"), lambda x: (F.trim(x, F.lit(BLANKS)) == "") | ~line_fails(x)))
    d = d.select(
        "doc_id",
        F.size("words").cast("bigint").alias("n_words"),
        _absent(text, BLANKS).cast("bigint").alias("word_chars"),
        (F.length("text") - _absent(text, SYMBOLS)).cast("bigint").alias("n_symbols"),
        (F.size("filled") - F.size(F.array_distinct("filled"))).cast("bigint").alias("n_dup_lines"),
        covered_words(starts).cast("bigint").alias("n_repeat_words"),
        F.array_join("clean_lines", "\n").alias("clean_text"),
        *[F.col("carried")[c].alias(c) for c in carry],
    )
    d = d.withColumn("base_failed", (F.col("n_words") < min_words) | (F.col("n_repeat_words") > max_repeat * F.col("n_words")))
    d = d.withColumn("kept_share", F.when(F.col("word_chars") > 0, _absent(F.col("clean_text"), BLANKS) / F.col("word_chars")).otherwise(F.lit(0.0)))
    d = d.withColumn("kept", ~F.col("base_failed") & (F.col("kept_share") >= min_kept))
    return closed(d)
