"""Column expressions shared by the operators that stay on DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space, as characters and inside a regular expression's class.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = r"\x20\x09-\x0D"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def whole(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, CAPITALS, CAPITALS.lower())


def strip_blanks(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def spaced_words(text: Column) -> Column:
    """The words between ASCII white space; an empty array without words."""
    bare = strip_blanks(whole(text))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{BLANK_CLASS}]+"))


def lines_of(text: Column) -> Column:
    return F.split(whole(text), "\n")


def closed(df: DataFrame) -> DataFrame:
    """The same rows behind a generator, which predicates on its columns do not cross.

    A filter that is pushed into a chain of projections takes their expressions along, and
    inside a lambda function it would work them out anew for each element.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))
