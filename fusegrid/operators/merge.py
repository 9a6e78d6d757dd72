"""Conflict resolution: records of an entity to one profile.

Every rule is a group-by with partial aggregation: scalars by ``min_by`` over the
order key (trust descending, dedup group, position), lists by a two-level group-by.
Groups with one record pass unchanged.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.text import exploded, strip
from ..schema import AGREEMENT_BONUS, CANONICAL, PRESENT_TOKENS, PROVENANCE

STRATEGIES = ["priority_order", "majority_vote", "latest_wins", "highest_confidence"]
DEFAULT_CONFIG = {"field_strategies": {"headline": "highest_confidence"}, "default_strategy": "priority_order", "dedup_threshold": 85}
#: Fields whose configured strategy has no effect.
FIXED_FIELDS = ["emails", "phones", "location", "links", "skills", "experience", "education"]


def ordered(records: DataFrame) -> DataFrame:
    """Adds src, trust and ord, the order in which an entity's records are asked."""
    group = F.col("dedup_group") if "dedup_group" in records.columns else F.lit(0)
    src = F.coalesce(F.get("provenance", 0)["source"], F.lit("notes"))
    df = records.withColumn("src", src).withColumn("trust", V.trust_of(src, 0.0))
    return df.withColumn("ord", F.struct((-F.col("trust")).alias("t"), group.alias("g"), F.col("pos").alias("p")))


def _backwards() -> Column:
    return F.struct((-F.col("ord.t")).alias("t"), (-F.col("ord.g")).alias("g"), (-F.col("ord.p")).alias("p"))


def latest_date() -> Column:
    """The largest end of a record's jobs; starts where the end is open; '' without any."""
    closed = F.transform("experience", lambda x: F.when(x["end"].isNotNull() & ~F.lower(x["end"]).isin(PRESENT_TOKENS[:2]), x["end"]).otherwise(x["start"]))
    return F.coalesce(F.array_max(closed), F.lit(""))


def field_confidence(field: str) -> Column:
    own = F.transform(F.filter("provenance", lambda p: p["field"] == field), V.effective_confidence)
    return F.coalesce(F.array_max(own), V.trust_of(F.col("src")))


def _majority(df: DataFrame, field: str, entity: str) -> DataFrame:
    held = df.where(F.col(field).isNotNull())
    text = F.col(field).cast("string")
    vote = F.when(F.coalesce(text, F.lit("")) == "", "").otherwise(F.lower(strip(text)))
    keys = held.groupBy(entity, vote.alias("k")).agg(F.count("*").alias("n"), F.max_by(field, "ord").alias("last"), F.min_by(F.struct(F.col(field).alias("v"), "src"), "ord").alias("first"), F.min("ord").alias("o"))
    best = keys.groupBy(entity).agg(F.max("n").alias("top"), F.sum("n").alias("all"))
    tied = keys.join(best, entity).where("n = top").groupBy(entity).agg(F.count("*").alias("w"), F.min_by("last", "o").alias("last"), F.min_by("first", "o").alias("x"), F.first("top").alias("top"), F.first("all").alias("all"))
    alone = F.format_string(f"{field}: majority_vote winner '%s' (%d/%d sources agree).", F.col("last").cast("string"), "top", "all")
    trace = F.format_string(f"{field} from %s (%s): highest source trust (priority_order).", "x.src", F.format_string("%.2f", V.trust_of(F.col("x.src"))))
    return tied.select(entity, F.when(F.col("w") == 1, F.col("last")).otherwise(F.col("x.v")).alias(field), F.when(F.col("w") == 1, alone).otherwise(trace).alias(f"{field}_trace"))


def _best(df: DataFrame, field: str, strategy: str) -> tuple[DataFrame, list[Column], list[Column]]:
    """The frame with what the strategy orders by, aggregates that resolve a field within any group-by by entity, and (field, trace) of them; both null without a value."""
    x, s, by = f"_best_{field}", f"_held_{field}", f"_by_{field}"
    held, src = F.col(field).isNotNull(), F.col(f"{x}.src")
    best = F.struct(F.col(field).alias("v"), "src", *([] if strategy == "priority_order" else [F.col(by).alias("by")]))
    if strategy == "priority_order":
        aggs = [F.min_by(best, F.when(held, F.col("ord"))).alias(x), F.array_sort(F.collect_list(F.when(held, F.struct("ord", "src")))).alias(s)]
        others = F.array_join(F.transform(F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), lambda o: o["src"]), ", ")
        trace = F.format_string(f"{field} from %s (%s): highest source trust (priority_order).", src, F.format_string("%.2f", V.trust_of(src)))
        trace = F.when(F.size(s) > 1, F.concat(trace, F.lit(" Discarded: "), others, F.lit("."))).otherwise(trace)
    else:
        df = df.withColumn(by, latest_date() if strategy == "latest_wins" else field_confidence(field))
        aggs = [F.max_by(best, F.when(held, F.struct(F.col(by).alias("by"), _backwards().alias("o")))).alias(x)]
        if strategy == "latest_wins":
            trace = F.format_string(f"{field} from %s (latest date: %s): latest_wins strategy.", src, F.when(F.col(f"{x}.by") == "", "N/A").otherwise(F.col(f"{x}.by")))
        else:
            trace = F.format_string(f"{field} from %s (%.4f): highest_confidence strategy.", src, F.col(f"{x}.by"))
    return df, aggs, [F.col(f"{x}.v").alias(field), F.when(F.col(x).isNotNull(), trace).alias(f"{field}_trace")]


def _known(field: str, strategy: str) -> str:
    if strategy in STRATEGIES:
        return strategy
    logging.getLogger(__name__).warning("unknown strategy %s for %s: priority_order is used", strategy, field)
    return "priority_order"


def resolve_scalar(df: DataFrame, field: str, strategy: str, *, entity: str = "entity_key") -> DataFrame:
    """(entity, field, trace) of an ordered frame by one strategy; no row for entities without a value."""
    strategy = _known(field, strategy)
    if strategy == "majority_vote":
        return _majority(df, field, entity)
    df, aggs, got = _best(df.where(F.col(field).isNotNull()), field, strategy)
    return df.groupBy(entity).agg(*aggs).select(entity, *got)


def union_values(df: DataFrame, field: str, key, *, entity: str = "entity_key") -> DataFrame:
    """(entity, field): distinct entries by ``key``, the first one's spelling, in order."""
    rows = exploded(df, field, entity, "ord").withColumn("k", key(F.col("v")))
    first = rows.groupBy(entity, "k").agg(F.min(F.struct("ord", "i", "v")).alias("x"))
    return first.groupBy(entity).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["v"]).alias(field))


def _pair_key(a: str, b: str):
    part = lambda v, c: F.coalesce(F.lower(strip(v[c])), F.lit(""))
    return lambda v: F.struct(part(v, a), part(v, b))


LIST_KEYS = {
    "emails": F.lower,
    "links": F.lower,
    "phones": lambda v: v,
    "experience": _pair_key("company", "title"),
    "education": _pair_key("institution", "degree"),
}


def merge_skills(df: DataFrame, *, entity: str = "entity_key") -> DataFrame:
    """(entity, skills, skills_trace): agreement of two sources or more raises the mean confidence."""
    rows = exploded(df, "skills", entity, "ord", "src").withColumnRenamed("v", "s")
    conf = F.when(F.col("s.confidence") != 0, F.col("s.confidence")).otherwise(V.trust_of(F.col("src")))
    per = rows.withColumn("c", conf).groupBy(entity, F.col("s.name").alias("name")).agg(
        F.avg("c").alias("mean"), F.min_by("c", F.struct("ord", "i")).alias("one"), F.sort_array(F.collect_set("src")).alias("sources"), F.min(F.struct("ord", "i")).alias("o")
    )
    value = F.round(F.when(F.size("sources") >= 2, F.least(F.lit(1.0), F.col("mean") * AGREEMENT_BONUS)).otherwise(F.col("one")), 4)
    per = per.withColumn("skill", F.struct("name", value.alias("confidence"), "sources"))
    return per.groupBy(entity).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "skill"))), lambda x: x["skill"]).alias("skills"), F.count_if(F.size("sources") >= 2).alias("agreed"))


def provenance_rows(df: DataFrame, *, entity: str = "entity_key") -> DataFrame:
    """The tidy fact table: one row per provenance entry, in order."""
    return exploded(df, "provenance", entity, "ord").withColumnRenamed("v", "p")


def merge_provenance(df: DataFrame, *, entity: str = "entity_key") -> DataFrame:
    """(entity, provenance): effective confidences and a conflict flag for fields with two values or more."""
    rows = provenance_rows(df, entity=entity)
    text = F.lower(F.coalesce("p.value", F.lit("")))
    entry = F.struct("ord", "i", F.col("p.value").alias("value"), F.col("p.raw_value").alias("raw_value"), F.col("p.source").alias("source"), F.col("p.method").alias("method"), V.effective_confidence(F.col("p")).alias("confidence"))
    fields = rows.groupBy(entity, F.col("p.field").alias("field")).agg((F.min(text) != F.max(text)).alias("conflict"), F.collect_list(entry).alias("es"))
    made = lambda e: F.struct(F.col("field"), e["value"], e["raw_value"], e["source"], e["method"], e["confidence"], F.col("conflict")).cast(PROVENANCE)
    fields = fields.where(F.col("field").isNotNull() & F.col(entity).isNotNull()).select(entity, F.transform("es", lambda e: F.struct(e["ord"].alias("ord"), e["i"].alias("i"), made(e).alias("made"))).alias("es"))
    return fields.groupBy(entity).agg(F.transform(F.array_sort(F.flatten(F.collect_list("es"))), lambda x: x["made"]).alias("provenance"))


#: Fields that rules of their own resolve, beside the scalars.
LISTS = [*LIST_KEYS, "skills", "provenance"]


def merge(records: DataFrame, config: dict | None = None, *, entity: str = "entity_key", only: list[str] | None = None) -> DataFrame:
    """One canonical profile per entity of records (entity, pos, canonical columns[, dedup_group]).

    With ``only`` the other lists are empty where several records meet (and ``candidate_id`` may be null without ``emails``)
    and are not looked for: Spark can't leave a join out by itself, as it doesn't know that its sides have one row an entity.
    """
    config = DEFAULT_CONFIG | (config or {})
    strategies, default = config.get("field_strategies", {}), config.get("default_strategy", "priority_order")
    strategies = {f: _known(f, strategies.get(f, default)) for f in ("full_name", "headline")} | {"location": "priority_order"}
    wanted = LISTS if only is None else [f for f in LISTS if f in only]
    df = ordered(records)
    best, aggs = {}, []
    for f, s in strategies.items():
        if s != "majority_vote":
            df, more, best[f] = _best(df, f, s)
            aggs += more
    base = df.groupBy(entity).agg(
        F.count("*").alias("n"), F.min_by("candidate_id", "ord").alias("first_id"), *[F.min_by(c, "ord").alias(f"own_{c}") for c in ("skills", "provenance", "merge_trace", "overall_confidence")],
        *aggs,
    )
    out = base.select(entity, "n", "first_id", "own_skills", "own_provenance", "own_merge_trace", "own_overall_confidence", *[c for got in best.values() for c in got])
    parts = [_majority(df, f, entity) for f in strategies if f not in best]
    parts += [union_values(df, f, k, entity=entity) for f, k in LIST_KEYS.items() if f in wanted]
    parts += [rule(df, entity=entity) for f, rule in (("skills", merge_skills), ("provenance", merge_provenance)) if f in wanted]
    for part in parts:
        out = out.join(part, entity, "left")
    absent = {f: CANONICAL[f] for f in LISTS if f not in wanted} | ({} if "skills" in wanted else {"agreed": "bigint"})
    out = out.withColumns({f: F.lit(None).cast(kind) for f, kind in absent.items()})
    single = F.col("n") == 1
    missing = lambda f: F.coalesce(F.col(f"{f}_trace"), F.lit(f"{f}: no value found" + (" — null." if f == "location" else " in any source — null.")))
    told = F.format_string("skills: %d skills merged from %d sources; %d confirmed by 2+ sources.", F.coalesce(F.size("skills"), F.lit(0)), F.col("n"), F.coalesce("agreed", F.lit(0)))
    trace = F.create_map(*[x for f in ("full_name", "headline", "location") for x in (F.lit(f), missing(f))], F.lit("skills"), told)
    made = {
        "candidate_id": F.coalesce("first_id", V.candidate_id(F.col("emails"))),
        "skills": F.when(single, F.col("own_skills")).otherwise(F.col("skills")),
        "provenance": F.when(single, F.col("own_provenance")).otherwise(F.col("provenance")),
        "merge_trace": F.when(single, F.col("own_merge_trace")).otherwise(trace),
        "overall_confidence": F.when(single, F.col("own_overall_confidence")).otherwise(F.lit(0.0)),
        "years_experience": F.lit(None),
    }
    cols = []
    for c, kind in CANONICAL.items():
        x = made[c] if c in made else F.col(c)
        x = x.cast(kind)
        cols.append((F.coalesce(x, F.array().cast(kind)) if kind.startswith("array") else x).alias(c))
    return out.select(entity, F.col("n").alias("n_records"), *cols)
