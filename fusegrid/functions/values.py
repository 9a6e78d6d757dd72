"""Identifiers, phones, dates, skills and confidences."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import METHOD_RELIABILITY, PRESENT_TOKENS, SKILL_ALIASES, SOURCE_TRUST, UNKNOWN_RELIABILITY, UNKNOWN_TRUST
from .text import blank_to_null, let, strip, title_case

URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def lookup(table: dict, key: Column, default) -> Column:
    """A small fixed table; names come from one folded literal, which keeps plans small."""
    if all(isinstance(v, str) for v in table.values()):
        made = F.str_to_map(F.lit("\x1e".join(f"{k}\x1f{v}" for k, v in table.items())), F.lit("\x1e"), F.lit("\x1f"))
    else:
        made = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in table.items()))
    return F.coalesce(F.try_element_at(made, key), F.lit(default))


def uuid5(namespace: str, name: Column) -> Column:
    """The name-based UUID (version 5, RFC 4122) as text."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    part = lambda a, n: F.substring(digest, a, n)
    variant = F.translate(part(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def candidate_id(emails: Column) -> Column:
    """UUID of the smallest normalised e-mail; null without one."""
    low = F.transform(emails, lambda x: F.lower(strip(x)))
    return F.when(F.size(emails) > 0, uuid5(URL_NAMESPACE, F.concat(F.lit("candidate:"), F.array_min(low))))


def e164(phone: Column) -> Column:
    """Indian mobile numbers as +91..., others null (no table of foreign plans is at hand)."""
    bare = F.regexp_replace(phone, r"[\s().-]", "")
    digits = F.regexp_extract(bare, r"^(?:\+?91|0)?([6-9][0-9]{9})$", 1)
    return F.when(digits != "", F.concat(F.lit("+91"), digits))


def normal_date(raw: Column) -> Column:
    """YYYY, YYYY-MM, YYYY-MM-DD or Present; null for what is no date."""
    slashed = r"^([0-9]{1,2})/([0-9]{4})$"
    named = r"(?i)^(?:([0-9]{1,2})\s+)?(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?,?\s+(?:([0-9]{1,2}),?\s+)?([0-9]{4})$"
    stems = "jan feb mar apr may jun jul aug sep oct nov dec".split()

    def made(bare: Column, inner: Column) -> Column:
        month = F.regexp_extract(inner, slashed, 1).try_cast("int")
        number = F.array_position(F.array(*map(F.lit, stems)), F.lower(F.regexp_extract(inner, named, 2)))
        day = lambda pattern: F.date_format(F.try_to_timestamp(inner, F.lit(pattern)), "yyyy-MM-dd")
        return (
            F.when(F.lower(bare).isin(PRESENT_TOKENS), F.lit("Present"))
            .when(inner.rlike(slashed), F.when(month.between(1, 12), F.format_string("%s-%02d", F.regexp_extract(inner, r"/([0-9]{4})$", 1), month)))
            .when(inner.rlike("^[0-9]{4}$"), inner)
            .when(inner.rlike(named), F.format_string("%s-%02d", F.regexp_extract(inner, named, 4), number))
            .when(inner.rlike("^[0-9]{4}-(0[1-9]|1[0-2])$"), inner)
            .when(inner.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), day("yyyy-MM-dd"))
            .when(inner.rlike("^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"), F.coalesce(day("M/d/yyyy"), day("d/M/yyyy")))
        )

    return let(strip(raw), lambda bare: let(strip(F.regexp_replace(bare, r"[()\[\]|]", "")), lambda inner: made(bare, inner)))


def exact_skill(raw: Column) -> Column:
    """The canonical name of an alias; null if the table lacks it."""
    return lookup(SKILL_ALIASES, F.lower(strip(raw)), None)


def normal_skill(raw: Column, near: Column | None = None) -> Column:
    """Alias table first, then ``near`` (a fuzzy match, from functions.fuzzy), then title case; '' for null or blank."""
    found = lambda bare: [exact_skill(bare)] if near is None else [exact_skill(bare), near]
    return let(strip(raw), lambda bare: F.when(F.coalesce(bare, F.lit("")) == "", F.lit("")).otherwise(F.coalesce(*found(bare), title_case(bare))))


def normal_skills(raws: Column, near: Column | None = None) -> Column:
    """Distinct normalised skills; ``near`` holds fuzzy matches by position."""
    made = F.transform(raws, lambda x: normal_skill(x)) if near is None else F.transform(raws, lambda x, i: normal_skill(x, F.get(near, i)))
    return F.array_distinct(F.filter(made, lambda x: x != ""))


def trust_of(source: Column, default: float = UNKNOWN_TRUST) -> Column:
    return lookup(SOURCE_TRUST, source, float(default))


def base_confidence(source: Column, method: Column) -> Column:
    return F.round(trust_of(source) * lookup(METHOD_RELIABILITY, method, UNKNOWN_RELIABILITY), 4)


def effective_confidence(p: Column) -> Column:
    """A provenance row's own confidence if above 0, else trust times reliability."""
    own = p["confidence"]
    return F.round(F.when(own > 0, own).otherwise(trust_of(p["source"]) * lookup(METHOD_RELIABILITY, p["method"], UNKNOWN_RELIABILITY)), 4)


def csv_skills(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), strip), lambda x: x != "")


def location_text(location: Column) -> Column:
    part = lambda k: F.coalesce(location[k], F.lit("None"))
    return F.concat(part("city"), F.lit(", "), part("region"))


def first_filled(*columns: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[blank_to_null(c) for c in columns])
