"""Résumé text to fields: lines, sections, education and experience entries, all native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import settled
from ..schema import SECTION_HEADINGS


# The sections that hold jobs, in order.
JOB_SECTIONS = ["INTERNSHIP EXPERIENCE", "WORK EXPERIENCE", "EXPERIENCE"]


def marked(df: DataFrame, *names: str) -> DataFrame:
    """Adds to ``_lines`` where the first heading of each of ``names`` is (``_at_<name>``, from 1; 0: nowhere) and
    which lines are known headings (``_stops``); keys and flags are worked out once a line."""
    df = settled(settled(df).withColumn("_keys", F.transform("_lines", T.heading_key)))
    names_it = lambda name: F.transform("_keys", lambda key: key.contains(name))
    found = {f"_at_{x}": F.array_position(names_it(x), True).cast("int") for x in names}
    return settled(df.withColumns(found | {"_stops": F.zip_with("_lines", "_keys", lambda x, key: T.known_heading(x, key, SECTION_HEADINGS))}).drop("_keys"))


def _next(after: Column | int) -> Column:
    """The place (from 0) of the first known heading beyond ``after``, or the number of lines."""
    places = F.transform("_stops", lambda x, i: F.when(x & (i > after), i))
    return F.coalesce(F.array_min(F.array_compact(places)), F.size("_stops"))


def section(name: str) -> Column:
    """Stripped lines between the first heading of ``name`` and the next known heading, of a marked frame."""
    at = F.col(f"_at_{name}")
    got = F.transform(F.slice("_lines", at + 1, F.greatest(_next(at - 1) - at, F.lit(0))), T.strip)
    return F.when(at > 0, got).otherwise(F.array().cast("array<string>"))


def header_block() -> Column:
    """Lines of a marked frame before the first known heading."""
    return F.slice("_lines", F.lit(1), _next(-1))


# The form of a place.
PLACE = r"\b([A-Z][a-zA-Z]+)\s*,\s*([A-Z][a-zA-Z]+(?:\s[A-Z][a-zA-Z]+)?)\b"


def location(header: Column, name: Column, country: str = "India") -> Column:
    """The first ``City, Region`` in the header, outside the name and contact lines."""
    usable = F.filter(
        header,
        lambda x: (T.strip(x) != "") & (T.strip(x) != F.coalesce(name, F.lit(""))) & ~x.rlike(T.EMAIL) & ~x.rlike(T.PHONE) & (F.size(F.split(T.strip(x), r"\s+")) <= 6) & x.rlike(PLACE),
    )
    place = lambda hit: F.struct(F.regexp_extract(hit, PLACE, 1).alias("city"), F.regexp_extract(hit, PLACE, 2).alias("region"), F.lit(country).alias("country"))
    return F.get(F.transform(F.slice(usable, 1, 1), place), 0)


def _institution(line: Column) -> Column:
    """What a line of ``parts`` gives as the institution to a neighbour: struct(name, place), or null."""
    left, right = F.coalesce(line["left"], F.lit("")), line["right"]
    label = left.rlike(r"^[A-Za-z][A-Za-z ./]*:\s*\S")
    town = left.rlike(r"^[A-Z][a-zA-Z]+\s*,\s*[A-Z][a-zA-Z]+(?:\s[A-Z][a-zA-Z]+)?$") & right.isNull()
    name = F.when(left.rlike(T.DATE_RANGE), T.blank_to_null(line["bare"])).otherwise(T.blank_to_null(left))
    usable = (left != "") & ~left.rlike(T.DEGREE) & ~label & ~town & name.isNotNull()
    return F.when(usable, F.struct(name.alias("institution"), right.alias("location")))


def parts(lines: Column) -> Column:
    """What entries need of each line, worked out once: its columns, and the left one without dates."""

    def split(line: Column) -> Column:
        left, right = T.split_columns(line)
        return T.let(F.struct(line.alias("line"), left.alias("left"), right.alias("right")), lambda x: F.struct(x["line"].alias("line"), x["left"].alias("left"), x["right"].alias("right"), T.strip_dates(x["left"]).alias("bare")))

    return F.transform(lines, split)


def schools(parts: Column) -> Column:
    """The ``parts`` of a section's lines with the degree that a line names ('' for none) and the institution it may give."""
    return F.transform(parts, lambda x: F.struct(x["bare"].alias("bare"), x["right"].alias("right"), F.regexp_extract(x["bare"], T.DEGREE, 0).alias("degree"), _institution(x).alias("school")))


def education(lines: Column) -> Column:
    """Entries of the section's lines, as ``schools`` gives them, that name a degree."""

    def entry(line: Column, i: Column) -> Column:
        left, degree = line["bare"], line["degree"]
        behind = T.strip(F.substring(left, F.instr(left, degree) + F.length(degree), F.length(left)))
        school = F.coalesce(*[F.get(lines, i + k)["school"] for k in (1, -1, 2)])
        dates = T.date_range(line["right"])

        def made(rest: Column, of: Column) -> Column:
            absorbs = F.lower(degree).isin("bachelor", "master") & (of != "")
            full = F.when(absorbs, F.concat(degree, F.lit(" "), of)).otherwise(degree)
            more = F.when(absorbs, T.strip(F.regexp_replace(T.strip(F.substring(rest, F.length(of) + 1, F.length(rest))), r"^[,.-]+\s*", ""))).otherwise(rest)
            field = T.let(more, lambda x: F.when((x != "") & ~x.rlike(rf"^{T.DEGREE[4:]}$"), x))
            return F.struct(school["institution"].alias("institution"), full.alias("degree"), field.alias("field"), dates["start"].alias("start_date"), dates["end"].alias("end_date"), school["location"].alias("location"))

        rest = T.strip(F.regexp_replace(behind, r"^(?:in\b|,|-|\.)\s*", ""))
        of = lambda x: F.regexp_extract(x, r"(?i)^(of\s+[A-Za-z]+)", 1)
        return F.when(F.coalesce(degree != "", F.lit(False)), T.let(rest, lambda x: T.let(F.struct(x.alias("rest"), of(x).alias("of")), lambda y: made(y["rest"], y["of"]))))

    return F.filter(F.transform(lines, entry), lambda x: x.isNotNull())


def experience(lines: Column) -> Column:
    """Entries of the sections' lines, as ``parts`` gives them, that look like a job, first occurrence by line."""

    def entry(line: Column, i: Column) -> Column:
        left, right, bare = line["left"], line["right"], line["bare"]
        follow = F.get(lines, i + 1)["line"]
        lone = F.when(T.blank_to_null(T.strip_dates(follow)).isNull(), follow)
        source = F.coalesce(F.when(right.rlike(T.DATE_RANGE), right), F.when(left.rlike(T.DATE_RANGE), left), lone)
        cut = lambda mark: F.instr(bare, mark)
        at = F.regexp_extract(bare, r"(?i)^(.*?)\sat\s", 1)
        title = F.when(cut("-") > 0, F.substring_index(bare, "-", 1)).when(cut(",") > 0, F.substring_index(bare, ",", 1)).when(at != "", at).otherwise(bare)
        company = (
            F.when(cut("-") > 0, F.substring(bare, cut("-") + 1, F.length(bare)))
            .when(cut(",") > 0, F.substring(bare, cut(",") + 1, F.length(bare)))
            .when(at != "", F.substring(bare, F.length(at) + 5, F.length(bare)))
        )

        def made(x: Column) -> Column:
            dates = T.date_range(x["source"])
            return F.struct(T.blank_to_null(x["company"]).alias("company"), x["title"].alias("title"), dates["start"].alias("start_date"), dates["end"].alias("end_date"), F.lit("Extracted from resume").alias("summary"))

        found = T.let(F.struct(T.strip(company).alias("company"), T.strip(title).alias("title"), source.alias("source")), lambda x: F.when(x["title"] != "", made(x)))
        return F.when(T.entry_like(line["line"]), found)

    fresh = F.transform(lines, lambda x, i: F.when(F.array_position(lines["line"], x["line"]) == i + 1, entry(x, i)))
    return F.filter(fresh, lambda x: x.isNotNull())


#: Parsed fields and their types.
PARSED = {
    "full_name": "string", "emails": "array<string>", "phones": "array<string>", "skills": "array<string>", "location": "struct<city: string, region: string, country: string>",
    "education": "array<struct<institution: string, degree: string, field: string, start_date: string, end_date: string, location: string>>",
    "experience": "array<struct<company: string, title: string, start_date: string, end_date: string, summary: string>>", "headline": "string",
}
#: Those that come from sections.
IN_SECTIONS = {"location", "education", "experience", "headline"}


def parse_resumes(docs: DataFrame, *, key: str = "doc", text: str = "text", only: list[str] | None = None) -> DataFrame:
    """(key, text) -> key and the parsed fields; with ``only`` the other fields are null and not looked for.

    Spark drops no columns behind a generator, so that it can't find out by itself what a query leaves unused.
    """
    wanted = PARSED.keys() if only is None else set(only)
    d = docs.select(F.col(key), T.mend_artifacts(F.coalesce(F.col(text), F.lit(""))).alias("_text")).withColumn("full_name", T.first_line(F.col("_text")))
    made = {"full_name": F.col("full_name"), "emails": T.emails(F.col("_text")), "phones": T.phones(F.col("_text")), "skills": T.skill_scan(F.col("_text"))}
    if IN_SECTIONS & wanted:
        d = marked(d.withColumn("_lines", T.lines(F.col("_text"))), "EDUCATION", *JOB_SECTIONS)
        jobs = F.concat(*[section(x) for x in JOB_SECTIONS])
        d = settled(d.select(key, "_text", "full_name", header_block().alias("_head"), section("EDUCATION").alias("_edu"), jobs.alias("_exp")))
        d = settled(d.withColumns({"_edu": parts(F.col("_edu")), "_exp": parts(F.col("_exp"))}))
        d = settled(d.withColumns({"_edu": schools(F.col("_edu")), "experience": experience(F.col("_exp"))}))
        made |= {"location": location(F.col("_head"), F.col("full_name")), "education": education(F.col("_edu")), "experience": F.col("experience"), "headline": F.get("experience", 0)["title"]}
    return settled(d.select(key, *[(made[c] if c in wanted else F.lit(None).cast(kind)).alias(c) for c, kind in PARSED.items()]))
