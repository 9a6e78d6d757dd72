r"""Personal data with offset-preserving deobfuscation.

Plain identifiers (e-mail, IPv4, card and phone numbers) are found in the text as it
stands.  Texts with a disguise then pass through a chain of transducers:

1. ``lookalikes`` maps homoglyphs, full-width forms and foreign digits to ASCII,
   one to one, and drops invisible characters;
2. ``spelled`` writes runs of spelled digits as digits, ``plus`` before such a run
   as ``+``, and ``dot``/``dash`` inside it as a mark;
3. ``marks`` turns ``(at)``, ``[dot]`` and ``name at host dot tld`` into ``@`` and ``.``.

Every output character keeps the source range it came from, so that what the
same detectors find in the normalised text maps back to source characters.  A
span is added only if a transducer changed something inside it and it does not
overlap a plain span.

Defined results: a null or empty text has no spans; repeated rows are scanned one
by one; an empty table gives no rows; a null doc_id stays null; columns other than
the two named ones are ignored.  Rows are independent: nothing is shuffled, and plain
identifiers are found in time linear in the text.
"""

from __future__ import annotations

import re
import string
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ["email", "ip", "card", "phone"]
# The base patterns of the task. E-mails are looked for at each @, which takes
# the same matches in linear time; no number part of an address starts or stops among digits.
NAME = frozenset(string.ascii_letters + string.digits + "._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++){3}")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Letters of other scripts that look like ASCII ones.
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһӏԛԝАВЕКМНОРСТХУІЈЅαορνικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhlqwABEKMHOPCTXYIJSaopvikABEZHIKMNOPTYX", strict=True))
INVISIBLE = "­​‌‍⁠﻿"
SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}


def _lookalike_table() -> dict[int, str]:
    table = {ord(k): v for k, v in HOMOGLYPHS.items()}
    table |= {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | {0x3000: " ", 0xA0: " ", 0x2011: "-", 0x2010: "-", 0x2212: "-", 0x2024: ".", 0xFE52: ".", 0xFE6B: "@"}
    table |= {c: str(unicodedata.digit(chr(c))) for c in range(0x660, 0x20000) if chr(c).isdecimal()}
    return table


LOOKALIKES = _lookalike_table()
_NUMBER = "(?:" + "|".join(SPELLED) + ")"
_GAP = r"[\x20\t,-]{1,3}"
_MARK = "(?:plus|dot|dash|minus)"
#: Three spelled digits or more, with marks between or a plus before them.
RUN = re.compile(rf"(?i)\b(?:plus{_GAP})?{_NUMBER}(?:{_GAP}(?:{_MARK}{_GAP})?{_NUMBER}){{2,}}\b")
_TOKEN = re.compile(rf"(?i){_NUMBER}|{_MARK}")
_CODE = SPELLED | {"plus": "+", "dot": ".", "dash": "-", "minus": "-"}
WRAPPED = re.compile(r"(?i)\s{0,3}[\[({<]\s{0,3}(at|dot|punkt|punto|point|arroba)\s{0,3}[\])}>]\s{0,3}")
WORDED = re.compile(r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(\s{1,3}at\s{1,3}|\s{0,3}@\s{0,3})[A-Za-z0-9-]{1,63}((?:(?:\s{1,3}dot\s{1,3}|\s{0,3}\.\s{0,1})[A-Za-z0-9-]{1,63}){0,4}\s{1,3}dot\s{1,3}[A-Za-z]{2,24})\b")
_DOT = re.compile(r"(?i)\s{1,3}dot\s{1,3}")
_ODD = frozenset(map(chr, LOOKALIKES)) | frozenset(INVISIBLE)
_BRACKETED = re.compile(r"[\[({<]\s{0,3}(?:at|dot|punkt|punto|point|arroba)\s{0,3}[\])}>]")
_COUNTED = re.compile(rf"\b{_NUMBER}{_GAP}(?:{_MARK}{_GAP})?{_NUMBER}{_GAP}")


def suspect(text: str) -> bool:
    """A cheap test that every text with a disguise passes."""
    if not text.isascii() and not _ODD.isdisjoint(text):
        return True
    low = text.lower()
    return bool(_DOT.search(low) if "dot" in low else None) or bool(_BRACKETED.search(low)) or bool(_COUNTED.search(low))


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if k % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Spans of e-mails: the characters before an @ that may stand in a name, back to the last match, and a domain."""
    at = done = 0
    while (at := text.find("@", at)) >= 0:
        begin = at
        while begin > done and text[begin - 1] in NAME:
            begin -= 1
        domain = DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            done = domain.end()
            yield begin, done
        at = max(at + 1, done)


def detect(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind and start; failing matches are dropped, not retried."""
    found = []
    if "@" in text:
        found += [(0, *span) for span in emails(text)]
    if "." in text:
        found += [(1, *m.span()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((2, *m.span()))
    if "+" in text:
        found += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


class Mapped:
    """A text with the source range of each of its characters and whether it changed."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends, self.changed = text, list(range(len(text))), list(range(1, len(text) + 1)), bytearray(len(text))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces ranges, given in order; new characters cover the range they replace."""
        text, starts, ends, changed, at = [], [], [], bytearray(), 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            starts += self.starts[at:a] + [self.starts[a]] * len(new)
            ends += self.ends[at:a] + [self.ends[b - 1]] * len(new)
            changed += self.changed[at:a] + b"\x01" * len(new)
            at = b
        self.text = "".join([*text, self.text[at:]])
        self.starts, self.ends, self.changed = starts + self.starts[at:], ends + self.ends[at:], changed + self.changed[at:]


def lookalikes(m: Mapped) -> None:
    new = m.text.translate(LOOKALIKES)
    for k, (a, b) in enumerate(zip(m.text, new, strict=True)):
        if a != b:
            m.changed[k] = 1
    m.text = new
    hidden = [(x.start(), x.end(), "") for x in re.finditer(f"[{INVISIBLE}]", new)]
    for a, b, _ in hidden:  # what follows an invisible character has changed its place
        if b < len(new):
            m.changed[b] = 1
    if hidden:
        m.rewrite(hidden)


def spelled(m: Mapped) -> None:
    edits = []
    for run in RUN.finditer(m.text):
        tokens = [(run.start() + t.start(), run.start() + t.end(), _CODE[t[0].lower()]) for t in _TOKEN.finditer(run[0])]
        for k, (a, b, new) in enumerate(tokens):
            if k:
                edits.append((tokens[k - 1][1], a, ""))
            edits.append((a, b, new))
        digits = sum(t[2].isdigit() for t in tokens)
        if tokens[0][2] != "+" and all(t[2].isdigit() or t[2] == "-" for t in tokens) and 8 <= digits <= 15:
            edits[-2 * len(tokens) + 1] = (*edits[-2 * len(tokens) + 1][:2], "+" + edits[-2 * len(tokens) + 1][2])
    if edits:
        m.rewrite([x for x in edits if x[0] < x[1]])


def marks(m: Mapped) -> None:
    edits = [(*x.span(), "@" if x[1].lower() in ("at", "arroba") else ".") for x in WRAPPED.finditer(m.text)]
    if edits:
        m.rewrite(edits)
    edits = []
    for x in WORDED.finditer(m.text):
        if x[1] != "@":
            edits.append((*x.span(1), "@"))
        edits += [(x.start(2) + d.start(), x.start(2) + d.end(), ".") for d in _DOT.finditer(x[2])]
    if edits:
        m.rewrite(edits)


def find(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Plain spans, and all spans with those of disguised identifiers, in code points."""
    base = detect(text)
    if not suspect(text):
        return base, base
    m = Mapped(text)
    for step in (lookalikes, spelled, marks):
        step(m)
    taken = sorted((a, b) for _, a, b in base)
    added = []
    for kind, a, b in detect(m.text):
        if not any(m.changed[a:b]):
            continue
        begin, end = m.starts[a], m.ends[b - 1]
        if all(end <= x or y <= begin for x, y in taken):
            added.append((kind, begin, end))
            taken.append((begin, end))
    return base, sorted(base + added)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, plain, every = [], [], []
        for text in batch.column(1).to_pylist():
            base, spans = find(text or "")
            counts.append([sum(k == x for k, _, _ in base) for x in range(4)])
            plain.append(written(base))
            every.append(written(spans))
        columns = [pa.array([c[x] for c in counts], pa.int64()) for x in range(4)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(plain, pa.string()), pa.array(every, pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_spans", "spans"])


def scan_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (plain ones), base_spans and spans (``kind:start:end``, comma-joined)."""
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(_scan, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_spans string, spans string")


def redact(text: str, spans: str) -> str:
    """The text with each span replaced by its kind in brackets."""
    out, at = [], 0
    for start, end, kind in sorted((int(a), int(b), k) for k, a, b in (x.split(":") for x in spans.split(",") if x)):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
            at = end
    return "".join([*out, text[at:]])
