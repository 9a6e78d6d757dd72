"""Source records to canonical records with provenance (native, but for fuzzy skills)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..functions.fuzzy import near_skills
from ..schema import CANONICAL, EDUCATION, EXPERIENCE, PROVENANCE, SKILL


def _prov(field: str, value: Column, raw: Column, source: str, method: str) -> Column:
    text, given = value.cast("string"), raw.cast("string")
    return F.struct(
        F.lit(field).alias("field"), text.alias("value"), F.nullif(given, text).alias("raw_value"), F.lit(source).alias("source"), F.lit(method).alias("method"),
        V.base_confidence(F.lit(source), F.lit(method)).alias("confidence"), F.lit(False).alias("conflict"),
    )


def _one(field: str, value: Column, raw: Column, source: str, method: str) -> Column:
    """Provenance of one value, nothing for null or empty."""
    filled = F.coalesce(value.cast("string"), F.lit("")) != ""
    return F.when(filled, F.array(_prov(field, value, raw, source, method))).otherwise(_none())


def _many(field: str, pairs: Column, source: str, method: str) -> Column:
    """Provenance of (value, raw) structs."""
    return F.transform(pairs, lambda p: _prov(field, p["value"], p["raw"], source, method))


def _none() -> Column:
    return F.array().cast(f"array<{PROVENANCE}>")


def _pairs(raws: Column, normal) -> Column:
    """Normalised values (of a value and its place) with what they came from; values that fail are left out, the first spelling stays."""
    both = F.transform(raws, lambda x, i: F.struct(normal(x, i).alias("value"), x.alias("raw")))
    good = F.filter(both, lambda p: F.coalesce(p["value"], F.lit("")) != "")
    first = lambda xs, values: F.filter(xs, lambda p, i: F.array_position(values, p["value"]) == i + 1)
    return T.let(good, lambda xs: T.let(_values(xs), lambda values: first(xs, values)))


def _values(pairs: Column) -> Column:
    return F.transform(pairs, lambda p: p["value"])


def _skills(names: Column, source: str, method: str) -> Column:
    return F.transform(names, lambda x: F.struct(x.alias("name"), V.base_confidence(F.lit(source), F.lit(method)).alias("confidence"), F.array(F.lit(source)).alias("sources"))).cast(f"array<{SKILL}>")


def _canonical(df: DataFrame, made: dict[str, Column], keys: list[str]) -> DataFrame:
    made = {"candidate_id": V.candidate_id(made["emails"]), "overall_confidence": F.lit(0.0), "merge_trace": F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))} | made
    return df.select(*keys, *[made.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in CANONICAL.items()])


def from_csv(rows: DataFrame, keys: list[str]) -> DataFrame:
    """CSV rows (see ``CSV_COLUMNS``) as canonical records; ``keys`` are kept in front."""
    src, how = "csv", "column_mapping"
    col = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    email = T.blank_to_null(F.lower(T.strip(col("email"))))
    given = {"name": T.blank_to_null(T.strip(col("name"))), "email": email, "phone": V.e164(col("phone")), "title": V.first_filled(col("title"), col("job_title"), col("position")), "company": V.first_filled(col("current_company"), col("company"))}
    raw = {f"raw_{c}": col(c) for c in ("name", "email", "phone")} | {"raw_skills": V.csv_skills(F.coalesce(col("skills"), F.lit("")))}
    # steps of their own, so that what several columns are made of is worked out once
    rows = rows.select(*keys, *[x.alias(c) for c, x in raw.items()], *[x.alias(f"in_{c}") for c, x in given.items()])
    rows = rows.withColumn("near_skills", near_skills(F.col("raw_skills")))
    rows = rows.withColumn("in_skills", V.normal_skills(F.col("raw_skills"), F.col("near_skills")))
    name, email, phone, title, company, names = (F.col(f"in_{c}") for c in [*given, "skills"])
    job = F.struct(company.alias("company"), F.coalesce(title, F.lit("")).alias("title"), F.lit(None).alias("start"), F.lit(None).alias("end"), F.lit(None).alias("summary")).cast(EXPERIENCE)
    made = {
        "full_name": name,
        "emails": F.when(email.isNotNull(), F.array(email)).otherwise(F.array()),
        "phones": F.when(phone.isNotNull(), F.array(phone)).otherwise(F.array()),
        "links": F.array(),
        "skills": _skills(names, src, how),
        "experience": F.when(title.isNotNull() | company.isNotNull(), F.array(job)).otherwise(F.array().cast(f"array<{EXPERIENCE}>")),
        "education": F.array().cast(f"array<{EDUCATION}>"),
        "provenance": F.concat(
            _one("full_name", name, F.col("raw_name"), src, how), _one("email", email, F.col("raw_email"), src, how), _one("phone", phone, F.col("raw_phone"), src, how),
            _many("skill", F.transform(names, lambda x: F.struct(x.alias("value"), x.alias("raw"))), src, how), _one("experience", company, company, src, how),
        ),
    }
    return _canonical(rows, made, [*keys])


def _near_skill(raw: Column, place: Column) -> Column:
    return V.normal_skill(raw, F.get("near_skills", place))


def _inputs(df: DataFrame, keys: list[str], more: list[str]) -> DataFrame:
    """Inputs under names of their own, apart from the columns made of them, the fuzzy matches of the skills, and what phones and skills become."""
    df = df.select(*keys, *[F.col(c).alias(f"in_{c}") for c in ["full_name", "emails", "phones", "location", "headline", "skills", "experience", "education", *more]], near_skills(F.col("skills")).alias("near_skills"))
    return df.withColumns({"phone_pairs": _pairs(F.col("in_phones"), lambda x, i: V.e164(x)), "skill_pairs": _pairs(F.col("in_skills"), _near_skill)})


def _history(df: DataFrame) -> tuple[Column, Column]:
    jobs = F.transform("in_experience", lambda x: F.struct(x["company"].alias("company"), F.coalesce(x["title"], F.lit("")).alias("title"), V.normal_date(x["start_date"]).alias("start"), V.normal_date(x["end_date"]).alias("end"), x["summary"].alias("summary")))
    schools = F.transform(
        "in_education",
        lambda x: F.struct(x["institution"].alias("institution"), x["degree"].alias("degree"), x["field"].alias("field"), F.lit(None).cast("int").alias("end_year"), V.normal_date(x["start_date"]).alias("start_date"), V.normal_date(x["end_date"]).alias("end_date")),
    )
    return jobs.cast(f"array<{EXPERIENCE}>"), schools.cast(f"array<{EDUCATION}>")


def _named(field: str, entries: Column, part: str, source: str, method: str) -> Column:
    filled = F.filter(entries, lambda x: F.coalesce(x[part], F.lit("")) != "")
    return _many(field, F.transform(filled, lambda x: F.struct(x[part].alias("value"), x[part].alias("raw"))), source, method)


def from_resume(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """Parsed résumés as canonical records."""
    src = "resume"
    parsed = _inputs(parsed, keys, [])
    phones, skills = F.col("phone_pairs"), F.col("skill_pairs")
    jobs, schools = _history(parsed)
    plain = F.transform("in_emails", lambda x: F.struct(x.alias("value"), x.alias("raw")))
    made = {
        "full_name": F.col("in_full_name"), "emails": F.col("in_emails"), "phones": _values(phones), "location": F.col("in_location"), "headline": F.col("in_headline"), "links": F.array(),
        "skills": _skills(_values(skills), src, "keyword_match"), "experience": jobs, "education": schools,
        "provenance": F.concat(
            _one("full_name", F.col("in_full_name"), F.col("in_full_name"), src, "first_line"), _many("email", plain, src, "regex"), _many("phone", phones, src, "regex"),
            F.when(F.col("in_location").isNotNull(), _one("location", V.location_text(F.col("in_location")), V.location_text(F.col("in_location")), src, "location_regex")).otherwise(_none()),
            _named("education", F.col("in_education"), "institution", src, "education_section"), _named("experience", F.col("in_experience"), "company", src, "experience_section"),
            _many("skill", skills, src, "keyword_match"),
        ),
    }
    return _canonical(parsed, made, keys)


def from_profile(profiles: DataFrame, keys: list[str]) -> DataFrame:
    """JSON or HTML profiles as canonical records; phones and headline leave no provenance."""
    src, how = "linkedin", "linkedin_field"
    profiles = _inputs(profiles, keys, ["links"])
    phones, skills = F.col("phone_pairs"), F.col("skill_pairs")
    jobs, schools = _history(profiles)
    plain = lambda c: F.transform(c, lambda x: F.struct(x.alias("value"), x.alias("raw")))
    made = {
        "full_name": F.col("in_full_name"), "emails": F.col("in_emails"), "phones": _values(phones), "location": F.col("in_location"), "headline": F.col("in_headline"), "links": F.col("in_links"),
        "skills": _skills(_values(skills), src, how), "experience": jobs, "education": schools,
        "provenance": F.concat(
            _one("full_name", F.col("in_full_name"), F.col("in_full_name"), src, how), _many("email", plain("in_emails"), src, how),
            F.when(F.col("in_location").isNotNull(), _one("location", V.location_text(F.col("in_location")), V.location_text(F.col("in_location")), src, how)).otherwise(_none()),
            _many("skill", skills, src, how), _named("experience", F.col("in_experience"), "company", src, how), _named("education", F.col("in_education"), "institution", src, how), _many("link", plain("in_links"), src, how),
        ),
    }
    return _canonical(profiles, made, keys)
