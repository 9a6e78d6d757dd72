r"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from .licenses import GRAM, PHRASES, TEMPLATES, template_words
from .quality import BOILERPLATE, MARKS, SYMBOLS

BLANKS = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
UPPER, LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"
SPACED = r"'[^\x20\x09-\x0D]+'"
ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _lower(x: str) -> str:
    return f"translate({x}, {UPPER}, {LOWER})"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _without(x: str, characters: str) -> str:
    return f"length(translate({x}, {characters}, ''))"


def _quality() -> str:
    symbols, pipe = _quoted(SYMBOLS), "'|'"
    phrase = " or ".join(f"contains({_lower('bare')}, {_quoted(x)})" for x in BOILERPLATE)
    return rf"""
with d as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, regexp_extract_all(text, {SPACED}) as words from d),
g as (select doc_id, i, [words[i], words[i + 1], words[i + 2]] as gram
      from (select doc_id, words, unnest(range(1, len(words) - 1)) as i from w)),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, gram) as c from g) where c > 1),
c as (select doc_id, count(distinct i + k) as covered from r, (values (0), (1), (2)) as v(k) group by doc_id),
l as (select doc_id, unnest(string_split(text, chr(10))) as line from d),
b as (select doc_id, line, trim(line, {BLANKS}) as bare, {_without('line', BLANKS)} as chars from l),
f as (select doc_id, line, bare, chars, len(regexp_extract_all(bare, {SPACED})) as n,
      length(bare) - {_without('bare', pipe)} as pipes, length(bare) - {_without('bare', symbols)} as symbols,
      (length(bare) - length(replace(bare, '!!', ''))) / 2 as shouts, ({phrase}) as phrase from b where bare <> ''),
v as (select doc_id, count(*) - count(distinct line) as dup, sum(case when (pipes >= 3 and pipes * 4 >= n)
        or (symbols >= 3 and symbols * 4 >= n) or (n >= 3 and shouts * 3 >= n)
        or (n <= 25 and phrase)
        or (n <= 3 and not contains({_quoted(MARKS)}, right(bare, 1))) then 0 else chars end) as stay from f group by doc_id),
o as (select w.doc_id, len(words) as n_words, {_without('text', BLANKS)} as word_chars,
      length(text) - {_without('text', symbols)} as n_symbols, coalesce(dup, 0) as n_dup_lines,
      coalesce(covered, 0) as n_repeat_words, coalesce(stay, 0) as stay
      from w left join c on w.doc_id = c.doc_id left join v on w.doc_id = v.doc_id)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
  n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words,
  n_words < 50 or n_repeat_words * 2 > n_words as base_failed,
  not (n_words < 50 or n_repeat_words * 2 > n_words) and word_chars > 0 and stay * 2 >= word_chars as kept from o"""


def _line_dedup() -> str:
    return rf"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
      generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
k as (select doc_id, line, pos, {_lower(f'trim(line, {BLANKS})')} as key from l),
s as (select key, min(doc_id) as first from k where length(key) >= 10 group by key having count(distinct doc_id) >= 2),
t as (select k.doc_id, line, pos, coalesce(k.doc_id > first, false) as gone from k left join s on k.key = s.key)
select doc_id, count(*)::bigint as n_lines, count_if(gone)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256 from t group by doc_id"""


def _licenses() -> str:
    """Base places by comparing word lists; other labels where a template stands complete."""
    rows = [(template_words(p), x, "true") for p, x in PHRASES] + [(template_words(t), x, "false") for x, t in TEMPLATES]
    values = ",\n".join(f"({i}, {_quoted(label)}, {exact}, {len(words) - GRAM + 1}, {at}, {words[at:at + GRAM]!r})" for i, (words, label, exact) in enumerate(rows) for at in range(len(words) - GRAM + 1))
    return rf"""
with t(template, label, exact, size, place, gram) as (values {values}),
w as (select doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, {ALNUM}) as words from documents),
g as (select doc_id, i - 1 as pos, [words[i], words[i + 1], words[i + 2]] as gram
      from (select doc_id, words, unnest(range(1, len(words) - 1)) as i from w)),
h as (select doc_id, template, label, exact, size, pos - place as diagonal, min(pos) as first, max(pos) as last,
      list(distinct place) as places from g join t using (gram) group by all),
e as (select *, case when exact then 1 when first - lag(last) over o > 7 or abs(diagonal - lag(diagonal) over o) > 4 then 1
      when lag(last) over o is null then 1 else 0 end as new from h window o as (partition by doc_id, template order by first, diagonal)),
m as (select doc_id, template, label, exact, size, run, len(list_distinct(flatten(list(places)))) / size as cover, min(first) as first from
      (select *, sum(new) over (partition by doc_id, template order by first, diagonal) as run from e) group by doc_id, template, label, exact, size, run),
p as (select doc_id, count_if(exact and cover = 1) as n_base, min(case when exact and cover = 1 then first end) as first_word,
      max(case when exact and cover = 1 then first end) as last_word,
      string_agg(distinct case when exact and cover = 1 then label end, ',' order by case when exact and cover = 1 then label end) as base_labels,
      string_agg(distinct case when cover >= case when exact then 1 else 0.8 end then label end, ',' order by case when cover >= case when exact then 1 else 0.8 end then label end) as labels,
      max(cover) as score from m group by doc_id)
select w.doc_id, len(words)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word,
  last_word::bigint as last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
  coalesce(score, 0.0)::double as score from w left join p on w.doc_id = p.doc_id"""


def _join() -> str:
    return rf"""
with recursive w as (select doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, {SPACED}) as words from documents),
s as (select distinct doc_id, g from (select doc_id, unnest(case when len(words) < 5 then [array_to_string(words, ' ')]
      else list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) end) as g from w where len(words) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select g from s group by g having count(*) > 1),
k as (select doc_id, g from s semi join c using (g)),
p as (select a.doc_id as a, b.doc_id as b, count(*) as common from k a join k b using (g) where a.doc_id < b.doc_id group by all),
l as (select a, b from p join n x on a = x.doc_id join n y on b = y.doc_id where 100 * common >= 80 * (x.n + y.n - common)),
e as materialized (select a, b from l union all select b, a from l),
r(v, c) as (select doc_id, doc_id from documents union select e.b, r.c from r join e on r.v = e.a where r.c < e.b)
select w.doc_id, coalesce(n, 0)::bigint as n_shingles, component_id::bigint as component_id from w left join n on w.doc_id = n.doc_id
join (select v, min(c) as component_id from r group by v) m on w.doc_id = m.v"""


def _decontamination() -> str:
    return rf"""
with d as (select doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, {ALNUM}) as words from documents),
b as (select item_id, regexp_extract_all({_lower("coalesce(text, '')")}, {ALNUM}) as words from benchmark),
bw as (select distinct item_id, len(gram) as size, gram from (select item_id, unnest(case when len(words) < 10 then [words]
      else list_transform(range(1, len(words) - 8), lambda i: words[i:i + 9]) end) as gram from b where len(words) > 0)),
z as (select distinct size from bw),
dw as (select doc_id, size, i, words[i:i + size - 1] as gram from
      (select doc_id, size, words, unnest(range(1, len(words) - size + 2)) as i from d, z)),
h as (select doc_id, i, dw.size, item_id from dw join bw on dw.size = bw.size and dw.gram = bw.gram),
c as (select doc_id, count(distinct x) as n_hit from (select doc_id, unnest(range(i, i + size)) as x from h) group by doc_id),
t as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as items from h group by doc_id)
select d.doc_id, len(words)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join c on d.doc_id = c.doc_id left join t on d.doc_id = t.doc_id"""


def _substrings() -> str:
    return rf"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), {SPACED}) as words from documents),
g as materialized (select doc_id, i, md5(array_to_string(words[i:i + 12], ' ')) as h from (select doc_id, words, unnest(range(1, len(words) - 11)) as i from w where len(words) > 12)),
f as (select h, min(doc_id) as first from g group by h having count(distinct doc_id) > 1),
x as (select distinct doc_id, unnest(range(i, i + 13)) as place from g join f using (h) where doc_id > first),
t as (select doc_id, unnest(words) as word, generate_subscripts(words, 1) as place from w),
k as (select doc_id, string_agg(word, ' ' order by place) as kept from t anti join x using (doc_id, place) group by doc_id),
n as (select doc_id, count(*) as removed from x group by doc_id)
select w.doc_id, len(words)::bigint as n_words, coalesce(removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from w left join k on w.doc_id = k.doc_id left join n on w.doc_id = n.doc_id"""


ORACLE_SQL = {
    "op1_ngram_jaccard_join": _join(),
    "op2_decontamination": _decontamination(),
    "op9_substring_dedup": _substrings(),
    "op3_quality_rules": _quality(),
    "op7_line_dedup": _line_dedup(),
    "op8_license_scan": _licenses(),
}
