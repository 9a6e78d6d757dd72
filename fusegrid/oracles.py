"""DuckDB SQL for the queries of :mod:`fusegrid.queries`."""

from __future__ import annotations

from .cases import MISSPELLED, PEOPLE_SQL, RESUME_PARTS_SQL
from .functions.text import EMAIL, PHONE
from .queries import ALL_SQL, CSV_SQL, DATE_FORMS, PROFILE_SQL, RESUME_SQL
from .schema import FIELD_IMPORTANCE, METHOD_RELIABILITY, SKILL_ALIASES, SOURCE_TRUST


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _case(column: str, table: dict, default: str) -> str:
    return f"case {column} " + " ".join(f"when {_q(k)} then {_q(v) if isinstance(v, str) else v}" for k, v in table.items()) + f" else {default} end"


STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def _uuid(name: str) -> str:
    h = f"sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode({name}))"
    return f"(select substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12) from (select {h} as h))"


def _extract(table: str, key: str, text: str, pattern: str, name: str, most: str = "") -> str:
    return f"select {key}, array_to_string(list_sort(list_distinct(regexp_extract_all({text}, {_q(pattern)}))){most}, '|') as {name} from {table}"


def _skills() -> str:
    hits = []
    for alias, name in SKILL_ALIASES.items():
        import re

        body = re.escape(alias).replace("\\ ", " ").replace("\\#", "#")
        pattern = rf"(^|[^A-Za-z0-9_]){body}([^A-Za-z0-9_]|$)" if alias[0].isalnum() and alias[-1].isalnum() else rf"\b{body}\b"
        hits.append(f"case when regexp_matches(low, {_q(pattern)}) then {_q(name)} end")
    return f"select doc_id, array_to_string(list_sort(list_distinct(list_filter([{', '.join(hits)}], lambda x: x is not null))), '|') as skills from (select doc_id, lower(text) as low from documents)"


DUCK_FORMS = {"MMM yyyy": "%b %Y", "MMMM yyyy": "%B %Y", "yyyy": "%Y", "MM/yyyy": "%m/%Y", "yyyy-MM": "%Y-%m", "yyyy-MM-dd": "%Y-%m-%d", "d MMM yyyy": "%-d %b %Y"}
DATE_RESULT = {"MMM yyyy": "%Y-%m", "MMMM yyyy": "%Y-%m", "yyyy": "%Y", "MM/yyyy": "%Y-%m", "yyyy-MM": "%Y-%m", "yyyy-MM-dd": "%Y-%m-%d", "d MMM yyyy": "%Y-%m"}

# Order of an entity's records: trust descending, then position.
BEST = "row(-trust, pos)"


def _best(column: str, order: str = BEST, where: str = "true") -> str:
    return f"with {ALL_SQL} select k as entity_key, arg_min({column}, {order}) as {{0}} from a where {column} is not null and {where} group by k"


CONFIDENCE = f"""with {ALL_SQL},
p as (select k, 'full_name' as field, name as value, src, {_case('src', {'csv': 'column_mapping', 'linkedin': 'linkedin_field', 'resume': 'first_line'}, "''")} as method from a where coalesce(name, '') <> ''
union all select k, 'email', email, src, {_case('src', {'csv': 'column_mapping', 'linkedin': 'linkedin_field', 'resume': 'regex'}, "''")} from a
union all select k, 'phone', '+91' || phone, 'csv', 'column_mapping' from ({CSV_SQL})
union all select k, 'location', city || ', None', src, {_case('src', {'linkedin': 'linkedin_field', 'resume': 'location_regex'}, "''")} from a where city is not null
union all select k, 'experience', company, src, {_case('src', {'csv': 'column_mapping', 'linkedin': 'linkedin_field', 'resume': 'experience_section'}, "''")} from a where coalesce(company, '') <> ''
union all select k, 'skill', s, 'csv', 'column_mapping' from (select k, unnest(['Python', 'JavaScript', upper(company[1]) || lower(company[2:])]) as s from ({CSV_SQL}))
union all select k, 'skill', 'Python', 'resume', 'keyword_match' from ({RESUME_SQL})
union all select k, 'skill', 'REST APIs', 'linkedin', 'linkedin_field' from ({PROFILE_SQL}))"""

SCORED = f"""{CONFIDENCE},
f as (select k, field, avg({_case('src', SOURCE_TRUST, '0.7')} * {_case('method', METHOD_RELIABILITY, '0.7')}) as m, count(distinct src) as s, count(distinct lower(trim(value))) as v from p group by k, field),
c as (select k, round(sum({_case('field', FIELD_IMPORTANCE, '0.5')} * least(1.0, m * case when s < 2 then 1.0 when v = 1 then 1.15 else 0.8 end)) / sum({_case('field', FIELD_IMPORTANCE, '0.5')}), 4) as overall_confidence from f group by k)"""

_RAW = "(select k, phone, case k % 5 when 0 then phone when 1 then '+91' || phone when 2 then '0' || phone when 3 then '12' || phone else '+91 ' || phone[1:5] || '-' || phone[6:10] end as raw from ({0}))"

ORACLE_SQL: dict[str, str] = {
    "candidate_ids": f"select k, {_uuid('name')} as candidate_id from (select k, 'candidate:' || lower(trim(email)) as name from ({CSV_SQL}))",
    "email_extract": _extract("(select doc_id, replace(replace(text, ' @', '@'), '@ ', '@') as t from documents)", "doc_id", "t", EMAIL, "emails"),
    "phone_extract": _extract("documents", "doc_id", "text", PHONE, "phones"),
    "html_emails": f"select page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, {_q(EMAIL)}))), '|') as emails from pages",
    "first_line_name": rf"select conv_id, turn, list_filter(list_transform(string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e]'), lambda x: {STRIP.format('x')}), lambda x: x <> '')[1] as first_line from conversations",
    "skill_scan": _skills(),
    "phone_e164": "select k, '+91' || nullif(regexp_extract(regexp_replace(raw, '[\\s().-]', '', 'g'), '^(?:\\+?91|0)?([6-9][0-9]{9})$', 1), '') as phone from " + _RAW.format(CSV_SQL),
    "date_normalize": "select o_orderkey, case o_orderkey % 9 " + " ".join(f"when {k} then strftime(o_orderdate, {_q(DATE_RESULT[f])})" for k, f in enumerate(DATE_FORMS)) + " when 7 then 'Present' end as date from orders",
    "date_ranges": "select o_orderkey, strftime(o_orderdate, '%b %Y') as range_start, case when o_orderkey % 2 = 0 then 'Present' else strftime(o_orderdate, '%m/%Y') end as range_end, 'Work' as rest from orders",
    "skill_normalize": f"select p_partkey, ([{', '.join(_q(v) for v in SKILL_ALIASES.values())}])[1 + p_partkey % {len(SKILL_ALIASES)}] as skill from part",
    "source_kinds": "select page_id, case page_id % 3 when 0 then 'empty' when 1 then case when regexp_matches(url, '^https?://[^/]') then 'url' else 'file' end else 'file' end as kind from pages",
    "words_to_text": """with w as (select l_orderkey as doc, l_returnflag || l_linestatus as t, l_linenumber * 20.0 as x0, l_linenumber % 2 * 10 as top from lineitem),
l as (select doc, top, x0, t, x0 - (lag(x0) over (partition by doc, top order by x0, t) + 8) as gap from w),
j as (select doc, top, string_agg(case when gap is null then '' when gap > 25 then chr(9) else ' ' end || t, '' order by x0, t) as line from l group by doc, top)
select doc, string_agg(line, chr(10) order by top) as text from j group by doc""",
    "csv_to_canonical": f"select k as entity_key, name as full_name, lower(trim(email)) as email, '+91' || phone as phone, company, coalesce(title, '') as title, 'Python|JavaScript|' || upper(company[1]) || lower(company[2:]) as skills, 7::bigint as n_provenance from ({CSV_SQL})",
    "union_records": f"with {ALL_SQL} select src, count(*) as n, count(distinct k) as entities from a group by src",
    "match_email": f"with e as (select k, lower(trim(email)) as e from ({CSV_SQL})), f as (select e, min(k) as a from e group by e) select a, k as b from e join f using (e) where a < k",
    "match_phone": f"with {ALL_SQL}, e as (select k * 3 + pos as r, k % 700 as e from a), f as (select e, min(r) as a from e group by e) select a, r as b from e join f using (e) where a < r",
    "merge_priority": _best("name").format("full_name"),
    "merge_latest": _best("name", "row(case when ended = '' then 0 else -cast(replace(rpad(ended, 7, '-'), '-', '0') as bigint) end, -trust, pos)").format("full_name"),
    "merge_confidence": _best("headline").format("headline"),
    "merge_majority": f"""with {ALL_SQL}, v as (select k, lower(trim(name)) as key, count(*) as n, arg_max(name, {BEST}) as last, arg_min(name, {BEST}) as first, min({BEST}) as o from a where name is not null group by 1, 2),
t as (select *, max(n) over (partition by k) as top from v)
select k as entity_key, case when count(*) = 1 then any_value(last) else arg_min(first, o) end as full_name from t where n = top group by k""",
    "merge_location": _best("city").format("city"),
    "merge_trace": f"""with {ALL_SQL}, s as (select k, list(src order by {BEST}) as s, max(trust) as t from a where name is not null group by k)
select k as entity_key, 'full_name from ' || s[1] || ' (' || printf('%.2f', t) || '): highest source trust (priority_order).' || case when len(s) > 1 then ' Discarded: ' || array_to_string(s[2:], ', ') || '.' else '' end as full_name_trace from s""",
    "merge_skills": f"""with s as (select k, 'csv' as src, 0.9 as c, 0 as o, unnest(['Python', 'JavaScript', upper(company[1]) || lower(company[2:])]) as name from ({CSV_SQL})
union all select k, 'resume', 0.5625, 2, 'Python' from ({RESUME_SQL}) union all select k, 'linkedin', 0.765, 1, 'REST APIs' from ({PROFILE_SQL}))
select k as entity_key, name, round(case when count(distinct src) > 1 then least(1.0, avg(c) * 1.15) else arg_min(c, o) end, 4)::double as confidence, string_agg(distinct src, '|' order by src) as sources from s group by k, name""",
    "union_emails": f"with {ALL_SQL}, e as (select k, lower(email) as key, arg_min(email, {BEST}) as email, min({BEST}) as o from a group by 1, 2) select k as entity_key, string_agg(email, '|' order by o) as emails from e group by k",
    "union_experience": f"with {ALL_SQL}, e as (select k, lower(trim(company)) as c, lower(trim(title)) as t, arg_min(company, {BEST}) as company, min({BEST}) as o from a where title <> '' or company is not null group by 1, 2, 3) select k as entity_key, string_agg(coalesce(company, ''), '|' order by o) as companies from e group by k",
    "provenance_conflicts": f"{CONFIDENCE} select k as entity_key, field, count(distinct lower(coalesce(value, ''))) > 1 as conflict, count(*) as n from p group by k, field",
    "confidence": f"{SCORED} select k as entity_key, overall_confidence from c",
    "confidence_bands": f"{SCORED} select case when overall_confidence >= 0.85 then 'HIGH' when overall_confidence >= 0.5 then 'MODERATE' else 'LOW' end as band, count(*) as n from c group by 1",
    "soft_validation": f"select k as entity_key, case when k % 4 = 0 then 0.8 else 0.9 end::double as overall_confidence, case when k % 4 = 0 then 'full_name missing' else '' end as warnings from ({CSV_SQL})",
    "schema_validation": rf"select k as entity_key, concat_ws('; ', case when k % 2 = 0 then 'primary_phone: ''12'' does not match ''^\+[1-9]\d{{6,14}}$''' end, case when k % 3 = 0 then 'overall_confidence: -0.5 is less than the minimum of 0' when k % 3 = 2 then 'overall_confidence: 1.5 is greater than the maximum of 1' end) as errors from ({CSV_SQL})",
    "project_omit": f"""with {ALL_SQL}, n as (select k, arg_min(name, {BEST}) as name from a where name is not null group by k), c as (select k, arg_min(city, {BEST}) as city from a where city is not null group by k)
select k as entity_key, '{{"name":"' || upper(name) || '"' || coalesce(',"where":"' || city || '"', '') || '}}' as json from n left join c using (k)""",
    "flat_csv": f"select k::varchar as entity_key, lower(trim(email)) as mails, coalesce(title, '') as title, '' as city from ({CSV_SQL})",
    "gold_accuracy": f"""with {ALL_SQL}, n as (select k, arg_min(name, {BEST}) as name from a group by k)
select coalesce(n.k, g.k) as entity_key, (lower(n.name) = lower(g.name) and g.k is not null)::bigint as n_right, case when lower(n.name) = lower(g.name) then 50.0 else 0.0 end::double as accuracy_pct from n full join ({CSV_SQL}) g on n.k = g.k""",
    "project_default": f"""with {ALL_SQL}, m as (select k, trim(arg_min(name, {BEST})) as candidate_name, lower(arg_min(email, {BEST})) as primary_email, arg_min(company, {BEST}) as current_company, arg_min(title, {BEST}) as current_title, min(pos) as p, arg_min(src, {BEST}) as s,
arg_min(city, {BEST}) filter (city is not null) as city, arg_min(headline, {BEST}) filter (headline is not null) as headline from a group by k)
select k as entity_key, candidate_name, primary_email, case when p = 0 then '+919' || lpad(k::varchar, 9, '0') end as primary_phone, city, null::varchar as region, null::varchar as country, headline, case when s = 'linkedin' then 'REST APIs' else 'Python' end as top_skill, current_company, current_title from m""",
    "transform_e2e": f"""with {ALL_SQL}, m as (select k, trim(arg_min(name, {BEST})) as candidate_name, lower(arg_min(email, {BEST})) as primary_email, arg_min(company, {BEST}) as current_company, arg_min(src, {BEST}) as s,
arg_min(city, {BEST}) filter (city is not null) as city, arg_min(headline, {BEST}) filter (headline is not null) as headline from a group by k)
select k as entity_key, candidate_name, primary_email, city, headline, case when s = 'linkedin' then 'REST APIs' else 'Python' end as top_skill, current_company, 0::bigint as n_errors from m""",
    "quality": f"""{CONFIDENCE}, x as (select k, string_agg(distinct field, '|' order by field) as conflicted from (select k, field from p group by k, field having count(distinct lower(value)) > 1 and (select count(*) from a where a.k = p.k) > 1) group by k),
b as (select k, count(*) as n, string_agg(distinct src, '|' order by src) as sources, min(pos) as p, count(city) as c, count(headline) as h from a group by k),
e as (select k, count(distinct row(lower(company), lower(title))) as n_exp from a where title <> '' or company is not null group by k)
select b.k as entity_key, sources, n_exp as experience_count, concat_ws('|', case when p > 0 then 'phones' end, case when c = 0 then 'location' end, case when h = 0 then 'headline' end, 'education') as missing, coalesce(conflicted, '') as conflicted
from b left join x using (k) left join e using (k)""",
}

_H1 = r"regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', ' ', 'g'), '(?i)\s*\|\s*(LinkedIn|linkedin\.com).*$', ''), '\s+-\s+.{5,}$', '')"
_SPACED = r"nullif(trim(regexp_replace({0}, '\s+', ' ', 'g')), '')"
_E164 = r"'+91' || nullif(regexp_extract(regexp_replace(x, '[\s().-]', '', 'g'), '^(?:\+?91|0)?([6-9][0-9]{9})$', 1), '')"
_NAMES = "case doc % 4 when 0 then 'Web Developer Intern' when 1 then 'Data Analyst' when 2 then 'Senior Engineer' else 'Project Lead' end"

ORACLE_SQL |= {
    "fuzzy_skill": f"select p_partkey, raw_skill, {_case('raw_skill', {k: v for k, v in MISSPELLED.items() if v}, 'null')} as raw_skill_match from (select p_partkey, ([{', '.join(_q(x) for x in MISSPELLED)}])[1 + p_partkey % {len(MISSPELLED)}] as raw_skill from part)",
    "html_name": f"select page_id, {_SPACED.format(_H1)} as name, contains(lower(html), 'authwall') or contains(lower(html), 'join now') or regexp_matches(lower(html), '<form[^>]*id=\"join-form\"') as login_wall from pages",
    "html_profiles": f"select {_SPACED.format(_H1.replace('regexp_extract(html', 'regexp_extract(replace(html, chr(38) || chr(97) || chr(109) || chr(112) || chr(59), chr(38))'))} as full_name, null::varchar as headline, 0::bigint as skills, 0::bigint as jobs, url as links from pages",
    "html_people": f"""select url, case k % 3 when 2 then name || ' Junior' else name end as full_name, case k % 4 when 0 then 'Builder ' || k when 1 then 'Cook' when 2 then 'Maker' end as headline, case k % 4 when 0 then 'City' when 1 then 'Big Town' end as location,
case when k % 5 < 3 then 'About ' || k end as about, url as links, 'Python|Go ' || k % 7 as skills, least(k % 9 + 1, 6)::bigint as n_jobs, least(k % 7, 4)::bigint as n_schools, case when k % 9 = 0 then 'Head ' || k else 'Lead' end as title,
case when k % 9 = 0 then 'N/A' else 'Acme' end as company, case when k % 9 > 0 then '2019' end as job_start, case when k % 9 > 0 then '2020' end as job_end, case when k % 7 > 0 then 'Tech' end as institution, case when k % 7 > 0 then 'N/A' end as degree,
'p' || k || '@example.com' as emails, k % 6 < 2 as login_wall from (select p.*, c_name as name from ({PEOPLE_SQL}) p join customer on k = c_custkey)""",
    "resume_fields": f"""select doc, name as full_name, 'user' || doc || '@example.com' as emails, '9' || lpad(doc::varchar, 9, '0') as phones, case doc % 3 when 0 then 'MySQL|Python|React' when 1 then 'Go|Kubernetes' else 'NumPy|Pandas' end as skills,
case doc % 3 when 0 then 'Pune' when 1 then 'Delhi' end as city, case doc % 3 when 0 then 'Maharashtra' when 1 then 'New Delhi' end as region, case when doc % 3 < 2 then 'India' end as country, {_NAMES} as headline, 1::bigint as n_schools, 1::bigint as n_jobs,
case doc % 6 when 0 then 'B.E.' when 1 then 'Bachelor of Science' when 2 then 'MBA' when 3 then 'M.Tech' when 4 then 'BSc' else 'Diploma' end as degree,
case doc % 6 when 0 then 'COMPUTER SCIENCE' when 1 then 'in Physics' when 2 then 'Finance' when 3 then 'Robotics' when 4 then 'Mathematics' end as field,
case doc % 5 when 0 then 'Example Technical Campus' when 1 then 'Hill College' when 2 then 'River Institute' when 4 then 'Lake School' end as institution, case when doc % 5 = 0 then 'Pune, Maharashtra' end as edu_place,
case doc % 4 when 0 then '2021' when 1 then 'Jan 2018' end as edu_start, case doc % 4 when 0 then '2025' when 1 then 'Present' end as edu_end, {_NAMES} as title,
case doc % 4 when 0 then 'Acme' || doc when 1 then 'Beta' || doc when 2 then 'Gamma' || doc end as company, case doc % 4 when 0 then 'Jan 2024' when 1 then 'Mar 2020' when 2 then '2019' else '06/2018' end as job_start,
case doc % 4 when 0 then 'Jun 2024' when 1 then 'Present' when 2 then '2021' else '07/2019' end as job_end, 'Extracted from resume' as summary from ({RESUME_PARTS_SQL})""",
    "resume_sections": f"select doc, skills, replace(edu, chr(10), '|') as education, name || '|' || contact || '|' || place as header from ({RESUME_PARTS_SQL})",
    "resume_records": f"""select doc as entity_key, {_NAMES} as headline, case doc % 4 when 0 then '2021' when 1 then '2018-01' end as edu_start, case doc % 4 when 0 then '2025' when 1 then 'Present' end as edu_end,
case doc % 4 when 0 then '2024-01' when 1 then '2020-03' when 2 then '2019' else '2018-06' end as job_start, case doc % 4 when 0 then '2024-06' when 1 then 'Present' when 2 then '2021' else '2019-07' end as job_end, '+919' || lpad(doc::varchar, 9, '0') as phone,
concat_ws('|', case when doc % 5 <> 3 then 'education' end, 'email', case when doc % 4 <> 3 then 'experience' end, 'full_name', case when doc % 3 < 2 then 'location' end, 'phone', 'skill') as fields from ({RESUME_PARTS_SQL})""",
    "resumes_from_documents": f"""with d as (select doc_id, replace(replace(coalesce(text, ''), ' @', '@'), '@ ', '@') as t from documents)
select doc_id as entity_key, list_filter(list_transform(string_split_regex(t, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e]'), lambda x: {STRIP.format('x')}), lambda x: x <> '')[1] as full_name,
len(list_distinct(regexp_extract_all(t, {_q(EMAIL)})))::bigint as n_emails,
len(list_distinct(list_filter(list_transform(regexp_extract_all(t, {_q(PHONE)}), lambda x: {_E164}), lambda x: x is not null)))::bigint as n_phones from d""",
    "dedup_groups": f"""with {ALL_SQL}, c as (select k, email from a where pos = 0), r as (select k, email from a where pos = 1), l as (select k, email from a where pos = 2),
g as (select r.k, case when c.k is null or lower(c.email) = lower(r.email) then 0 else 1 end as g, r.email from r left join c using (k))
select k as entity_key, 0 as pos, 0::bigint as dedup_group from c union all select k, 1, g from g
union all select l.k, 2, case when lower(l.email) = lower(coalesce(c.email, g.email, l.email)) then 0 when lower(l.email) = lower(g.email) then g.g when g.g = 1 then 2 else 1 end from l left join c using (k) left join g using (k)""",
}
