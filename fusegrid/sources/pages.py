"""Profiles from HTML pages: a small tree, and one evaluator of the places that ``schema`` lists."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schema as S
from ..functions.text import EMAIL, clean_spaces

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that a sibling of the same kind closes, up to the blocks that hold them.
#: Elements whose plain tags need no full parsing: their content is markup, and nothing in the tag is escaped or unquoted.
PLAIN = "a article aside b body dd div dl dt em footer form h1 h2 h3 h4 h5 h6 header html i img li link main meta nav ol p section span strong table tbody td th thead tr ul".split()
PLAIN_START = re.compile(rf"""<({"|".join(sorted(PLAIN, reverse=True))})((?: [a-z-]+="[^"'<>&=/]*")*)>""")
PLAIN_END = re.compile(rf"</({'|'.join(sorted(PLAIN, reverse=True))})>")
SELF_CLOSING, BLOCKS = frozenset(("li", "p")), frozenset(("ul", "ol", "div", "section", "body"))


@dataclass(eq=False)
class Element:
    """An element; ``ends`` is the number of the first element behind it in document order."""

    tag: str
    attributes: dict[str, str]
    parent: Element | None = None
    content: list = field(default_factory=list)
    number: int = -1
    ends: int = -1

    def text(self, joiner: str) -> str:
        found, todo = [], [self]
        while todo:
            item = todo.pop()
            if isinstance(item, Element):
                todo += item.content[::-1]
            else:
                found.append(item)
        return joiner.join(found)


@lru_cache(1 << 12)
def attributes(plain: str) -> list[tuple[str, str]]:
    return re.findall(r'([a-z-]+)="([^"]*)"', plain)


class Page(HTMLParser):
    """All elements of a page in document order, tolerant of tags left open."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.elements: list[Element] = []
        self.open = [Element("", {})]
        self.feed(html)
        self.close()
        self._end(0)

    def _end(self, depth: int) -> None:
        """Closes the open elements from ``depth`` on."""
        for element in self.open[depth:]:
            element.ends = len(self.elements)
        del self.open[max(depth, 1) :]

    def parse_starttag(self, i):
        plain = PLAIN_START.match(self.rawdata, i)
        if not plain:
            return super().parse_starttag(i)
        self.lasttag = plain[1]
        self.handle_starttag(plain[1], attributes(plain[2]) if plain[2] else [])
        return plain.end()

    def parse_endtag(self, i):
        plain = None if self.cdata_elem else PLAIN_END.match(self.rawdata, i)
        if not plain:
            return super().parse_endtag(i)
        self.handle_endtag(plain[1])
        return plain.end()

    def handle_starttag(self, tag, attrs):
        if tag in SELF_CLOSING:
            depth = next((k for k in range(len(self.open) - 1, 0, -1) if self.open[k].tag == tag or self.open[k].tag in BLOCKS), 0)
            if depth and self.open[depth].tag == tag:
                self._end(depth)
        element = Element(tag, {k: v or "" for k, v in attrs}, self.open[-1], number=len(self.elements))
        self.open[-1].content.append(element)
        self.elements.append(element)
        element.ends = len(self.elements)
        if tag not in VOID:
            self.open.append(element)

    def handle_endtag(self, tag):
        depth = next((k for k in range(len(self.open) - 1, 0, -1) if self.open[k].tag == tag), 0)
        if depth:
            self._end(depth)

    def handle_data(self, data):
        self.open[-1].content.append(data)

    def inside(self, element: Element) -> list[Element]:
        return self.elements[element.number + 1 : element.ends]


@lru_cache(1 << 14)
def at_place(place: str, tag: str, classes: str) -> bool:
    """``matches`` of an element with this tag and these classes, if it is the last of its siblings."""
    kind, _, wanted = place.partition(":")
    if kind == "tag":
        return tag == wanted
    if kind == "like":
        return re.search(wanted, classes, re.I) is not None
    return kind in ("class", "last") and wanted in classes


def matches(place: str, element: Element) -> bool:
    """Whether an element is at a place of the kinds that ``schema`` describes."""
    if not at_place(place, element.tag, element.attributes.get("class", "")):
        return False
    return not place.startswith("last:") or [x for x in element.parent.content if isinstance(x, Element)][-1] is element


def first(elements: list[Element], place: str) -> Element | None:
    return next((x for x in elements if matches(place, x)), None)


def spaced(text: str | None) -> str | None:
    return " ".join(text.split()) or None if text else None


def top_text(page: Page, places: list[str]) -> str | None:
    """The text of the first place that has any."""
    for place in places:
        if place.startswith("meta:"):
            metas = [x.attributes for x in page.elements if x.tag == "meta"]
            found = next((m.get("content") for key in ("property", "name") for m in metas if m.get(key) == place[5:]), None)
        else:
            element = first(page.elements, place)
            found = element.text(" ") if element else None
        if found:
            return found
    return None


def name_of(text: str) -> str:
    for tail in S.PAGE_NAME_TAILS:
        text = re.sub(tail, "", text)
    return text


def headline_of(text: str) -> str:
    return re.split(S.HEADLINE_END, re.sub(S.HEADLINE_DEBRIS, "", text))[0][: S.HEADLINE_LENGTH]


CLEANERS = {"full_name": name_of, "headline": headline_of}


def entries(page: Page, block: str, parts: dict[str, list[str]], most: int) -> Iterator[dict[str, str | None]]:
    """The parts of the first ``most`` list items of a block; a part is at the first of its places that exists."""
    around = first(page.elements, f"like:{block}")
    items = [x for x in page.inside(around) if x.tag == "li"] if around else []
    for item in items[:most]:
        below = page.inside(item)
        found = {part: next((e for place in places if (e := first(below, place))), None) for part, places in parts.items()}
        yield {part: spaced(e.text("")) if e else None for part, e in found.items()}


def job(title: str | None, company: str | None, dates: str | None) -> dict | None:
    company = None if company == title else company
    begin, *end = re.split(S.DATE_DASH, dates, maxsplit=1) if dates else (None,)
    until = (end[0].strip() if end else S.OPEN_END) if dates else None
    return {"title": title or S.MISSING_NAME, "company": company or S.MISSING_NAME, "start_date": begin and begin.strip(), "end_date": until} if title or company else None


def school(institution: str | None, degree: str | None) -> dict | None:
    return {"institution": institution or S.MISSING_NAME, "degree": degree or S.MISSING_NAME} if institution or degree else None


def profile_from_html(url: str | None, html: str | None) -> dict:
    """The fields of a public profile page; without a page all are empty."""
    page = Page(html or "")
    texts = {name: top_text(page, places) for name, places in S.PAGE_TEXTS.items()}
    skills = [spaced(x.text("")) for x in page.elements if matches(S.PAGE_SKILLS, x)]
    low = (html or "").lower()
    walled = any(w in low for w in S.LOGIN_WORDS) or any(x.tag == "form" and x.attributes.get("id") == S.LOGIN_FORM for x in page.elements)
    return {name: spaced(CLEANERS.get(name, str)(text)) if text else None for name, text in texts.items()} | {
        "links": [url] if url else [],
        "skills": list(dict.fromkeys(x for x in skills if x and len(x) < S.SKILL_LENGTH))[: S.MOST_SKILLS],
        "experience": [x for e in entries(page, "experience", S.PAGE_JOBS, S.MOST_JOBS) if (x := job(**e))],
        "education": [x for e in entries(page, "education", S.PAGE_SCHOOLS, S.MOST_SCHOOLS) if (x := school(**e))],
        "emails": list(dict.fromkeys(re.findall(EMAIL, html or "")))[: S.MOST_EMAILS],
        "login_wall": walled,
    }


HTML_PROFILE = (
    "url string, full_name string, headline string, location string, about string, links array<string>, skills array<string>, "
    "experience array<struct<title: string, company: string, start_date: string, end_date: string>>, "
    "education array<struct<institution: string, degree: string>>, emails array<string>, login_wall boolean"
)


def read_html(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """Profiles from fetched pages; fetching itself is left to whoever fills the table."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(StructType.fromDDL(HTML_PROFILE))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([{"url": u} | profile_from_html(u, h) for u, h in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True)], schema=schema)

    return pages.select(F.col(url).alias("url"), F.col(html).alias("html")).mapInArrow(parse, HTML_PROFILE)


def html_as_profile(df: DataFrame) -> DataFrame:
    """HTML profiles in the shape of JSON ones; a place becomes the city of a location."""
    place = F.when(F.col("location").isNotNull(), F.struct(F.col("location").alias("city"), F.lit(None).cast("string").alias("region"), F.lit(None).cast("string").alias("country")))
    jobs = F.transform("experience", lambda x: F.struct(x["company"].alias("company"), x["title"].alias("title"), x["start_date"].alias("start_date"), x["end_date"].alias("end_date"), F.lit(None).cast("string").alias("summary")))
    nil = F.lit(None).cast("string")
    schools = F.transform("education", lambda x: F.struct(x["institution"].alias("institution"), x["degree"].alias("degree"), nil.alias("field"), nil.alias("start_date"), nil.alias("end_date")))
    return df.select("full_name", "headline", "emails", F.array().cast("array<string>").alias("phones"), place.alias("location"), "links", "skills", jobs.alias("experience"), schools.alias("education"), "about")


# --- the parts that need no tree ----------------------------------------------------------


def html_title_name(html: Column) -> Column:
    """og:title, else the first h1, without the site's name and the job behind a dash."""
    shapes = [r'(?is)<meta[^>]*property="og:title"[^>]*content="([^"]*)"', r'(?is)<meta[^>]*content="([^"]*)"[^>]*property="og:title"', r"(?is)<h1[^>]*>(.*?)</h1>"]
    name = F.regexp_replace(F.coalesce(*[F.nullif(F.regexp_extract(html, x, 1), F.lit("")) for x in shapes]), r"<[^>]*>", " ")
    for tail in S.PAGE_NAME_TAILS:
        name = F.regexp_replace(name, tail, "")
    return clean_spaces(name)


def html_login_wall(html: Column) -> Column:
    hit = F.lower(html).rlike(f'<form[^>]*id="{S.LOGIN_FORM}"')
    for word in S.LOGIN_WORDS:
        hit = hit | F.lower(html).contains(word)
    return hit
