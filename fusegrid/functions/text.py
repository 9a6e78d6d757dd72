"""String and regular-expression functions, all native."""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DEGREE_KEYWORDS, SKILL_ALIASES, TITLE_KEYWORDS

# E-mail and phone patterns, month names and line separators.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\+?[0-9]{10,13}"
MONTH = r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
DATE_TOKEN = rf"(?:{MONTH}\.?\s+[0-9]{{4}}|[0-9]{{1,2}}/[0-9]{{4}}|[0-9]{{4}})"
DATE_RANGE = rf"(?i)({DATE_TOKEN})\s*(?:-|–|—|to)\s*({DATE_TOKEN}|Present|Current|Till Date)"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
DEGREE = r"(?i)\b(?:" + "|".join(re.escape(x) for x in sorted(DEGREE_KEYWORDS, key=len, reverse=True)) + r")\b"


def strip(c: Column) -> Column:
    """White space removed at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once; inside lambdas Spark works a column out again at each use."""
    return F.get(F.transform(F.array(value), body), 0)


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def clean_spaces(c: Column) -> Column:
    """Runs of white space become one space; nothing left becomes null."""
    return blank_to_null(strip(F.regexp_replace(c, r"\s+", " ")))


def mend_artifacts(c: Column) -> Column:
    """Spaces that layout extraction left around @ are removed."""
    return F.replace(F.replace(c, F.lit(" @"), F.lit("@")), F.lit("@ "), F.lit("@"))


def emails(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(EMAIL), F.lit(0)))


def phones(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(PHONE), F.lit(0)))


def lines(c: Column) -> Column:
    """Lines at any line break; a break at the end opens no further line."""
    parts = F.split(F.coalesce(c, F.lit("")), LINE_BREAK)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def first_line(c: Column) -> Column:
    """The first line that is not blank, stripped."""
    return F.get(F.filter(F.transform(lines(c), strip), lambda x: x != ""), 0)


def title_case(c: Column) -> Column:
    """Letters after a non-letter upper case, other letters lower case."""
    letter = lambda x: F.coalesce(x.rlike(r"^\p{L}$"), F.lit(False))
    return let(F.split(F.lower(c), ""), lambda chars: F.array_join(F.transform(chars, lambda x, i: F.when(letter(F.get(chars, i - 1)), x).otherwise(F.upper(x))), ""))


def date_range(c: Column) -> Column:
    """struct(start, end) of the first date range; null parts without one."""
    part = lambda k: blank_to_null(F.regexp_extract(c, DATE_RANGE, k))
    return F.struct(part(1).alias("start"), part(2).alias("end"))


def strip_dates(c: Column) -> Column:
    """All date ranges and the brackets and bars left around them removed."""
    c = F.regexp_replace(c, DATE_RANGE, "")
    c = F.regexp_replace(c, r"[()\[\]|,]+\s*$", "")
    c = F.regexp_replace(c, r"^\s*[()\[\]|,-]+", "")
    c = F.regexp_replace(c, r"\s{2,}", " ")
    return F.regexp_replace(c, r"^[ \-|,\t]+|[ \-|,\t]+$", "")


def split_columns(c: Column) -> tuple[Column, Column]:
    """Text before and after the first tab; without a tab the line and null."""
    at = F.instr(c, "\t")
    return strip(F.substring_index(c, "\t", 1)), F.when(at > 0, strip(F.substring(c, at + 1, F.length(c))))


def heading_key(line: Column) -> Column:
    """The letters of a line of at most five words, in capitals; else empty."""
    bare = F.array_compact(F.array(F.upper(strip(F.regexp_replace(line, "[^A-Za-z]+", " ")))))
    return F.coalesce(F.get(F.filter(bare, lambda x: F.size(F.split(x, " ")) <= 5), 0), F.lit(""))


def heading_match(line: Column, name: str) -> Column:
    """A line of at most five words that contains the section's name."""
    return heading_key(line).contains(name)


def known_heading(line: Column, key: Column, names: list[str]) -> Column:
    """Any section's heading, or a short line in capitals that is no degree or job title; ``key`` is the line's heading_key."""
    hit = F.exists(F.array(*map(F.lit, names)), lambda x: key.contains(x))

    def loud(bare: Column) -> Column:
        caps = (bare != "") & (F.upper(bare) == bare) & (F.lower(bare) != bare)
        plain = (F.size(F.split(bare, r"\s+")) <= 2) & ~bare.rlike("[:0-9]") & ~bare.rlike(DEGREE)
        return caps & plain & ~bare.rlike("|".join(TITLE_KEYWORDS))

    return hit | let(strip(line), loud)


def entry_like(line: Column) -> Column:
    """A line that may open an experience entry."""
    bare, ranged = strip(line), line.rlike(DATE_RANGE)
    words = F.size(F.split(bare, r"\s+"))
    titled = F.upper(bare).rlike("|".join(TITLE_KEYWORDS))
    return (bare != "") & (words <= 12) & (titled | ranged) & ~(F.endswith(bare, F.lit(".")) & ~ranged)


def _alias_tables() -> tuple[str, dict[str, list[int]], dict[int, str]]:
    """One pattern for all aliases of letters and digits at both ends, longest first; which
    aliases an alias at a place implies (itself and those it begins with); patterns of the others."""
    places = {a: k for k, a in enumerate(SKILL_ALIASES)}
    plain = [a for a in places if a[0].isalnum() and a[-1].isalnum()]
    implied = {a: [places[b] for b in plain if a == b or (a.startswith(b) and not a[len(b)].isalnum())] for a in plain}
    body = "|".join(re.escape(a) for a in sorted(plain, key=len, reverse=True))
    return rf"(?<![A-Za-z0-9_])(?=({body})(?![A-Za-z0-9_]))", implied, {places[a]: rf"\b{re.escape(a)}\b" for a in places if a not in implied}


def skill_scan(text: Column) -> Column:
    """Canonical names of all aliases in the text, in the order of the table; one scan finds all but a few."""
    pattern, implied, others = _alias_tables()
    low = F.lower(text)
    table = F.create_map(*chain.from_iterable((F.lit(a), F.array(*map(F.lit, at))) for a, at in implied.items()))
    found = F.flatten(F.transform(F.array_distinct(F.regexp_extract_all(low, F.lit(pattern), F.lit(1))), lambda x: F.try_element_at(table, x)))
    odd = F.array_compact(F.array(*[F.when(low.rlike(x), F.lit(k)) for k, x in others.items()]))
    names = F.array(*map(F.lit, SKILL_ALIASES.values()))
    return F.array_distinct(F.transform(F.array_sort(F.array_distinct(F.concat(found, odd))), lambda k: F.get(names, k)))


def settled(df: DataFrame) -> DataFrame:
    """The same rows behind a generator, so that later steps do not work their columns out again for each use."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def exploded(df: DataFrame, field: str, *keep: str) -> DataFrame:
    """``keep``, and place ``i`` and value ``v`` of the entries of a list; unlike after posexplode, no filter for lists that have some is derived and worked out below."""
    return df.select(*keep, F.posexplode_outer(field).alias("i", "v")).where("i is not null")
