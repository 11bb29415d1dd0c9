"""Personal data: detection on the text as it is, and on what it was disguised from.

Base. Four patterns on the source text (email, ip, card, phone).
Method. A chain of transducers rewrites the text to what a reader would take
it for: homoglyphs to ASCII, spelled digits to digits, "at" and "dot" between
words to signs, in the four languages of the tables below. Every rewritten character keeps the source interval that it
came from, so a detection on the rewritten text maps back to source characters.
Only detections that a rewrite touched are added, and none that overlaps a
base span of its kind; base spans always stay.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tetraflow.llm._shared import slices

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # the pattern, without its retries within a run of digits
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """Leftmost non-overlapping: around each @, the run before it and a domain after it."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            free = found.end()
        at = text.find("@", max(at + 1, free))
    return out


def _ips(text: str) -> list[Span]:
    short = lambda p: len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255
    return [m.span() for m in _IP.finditer(text) if all(map(short, m[0].split(".")))]


def _cards(text: str) -> list[Span]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def _phones(text: str) -> list[Span]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]


def base_spans(text: str) -> dict[str, list[Span]]:
    """Spans of each kind in code points, end exclusive; failing matches drop without a retry."""
    digits = _DIGIT.search(text) is not None
    return {
        "email": _emails(text) if "@" in text else [],
        "ip": _ips(text) if digits else [],
        "card": _cards(text) if digits else [],
        "phone": _phones(text) if digits and "+" in text else [],
    }


# Characters that read like an ASCII one, and words for digits.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o",
    "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ԝ": "w", "х": "x", "у": "y", "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H",
    "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "α": "a", "ο": "o",
    "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "∙": ".", "․": ".", "。": ".", "‐": "-", "‑": "-", "–": "-", "−": "-", "\xa0": " ",
}
# For the digits from 0 to 9, in English, French, German and Spanish.
DIGIT_NAMES = (
    "zero oh zéro null cero", "one un eins uno", "two deux zwei zwo dos", "three trois drei tres", "four quatre vier cuatro",
    "five cinq fünf fuenf cinco", "six sechs seis", "seven sept sieben siete", "eight huit acht ocho", "nine neuf neun nueve",
)
AT_NAMES, DOT_NAMES, PLUS_NAMES = "at arobase arroba klammeraffe", "dot point punkt punto", "plus más mas"
ENTITIES = {"&#64;": "@", "&#x40;": "@", "&commat;": "@", "&#46;": ".", "&#x2e;": ".", "&period;": "."}
# End of fixed values.
_ENTITY = re.compile("|".join(ENTITIES), re.I)
GLYPHS = HOMOGLYPHS | {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)} | {chr(b + i): str(i) for b in (0x660, 0x6F0, 0x966) for i in range(10)}
_GLYPH = re.compile("[" + "".join(map(re.escape, GLYPHS)) + "]|[​‌‍⁠﻿\xad]")
#: Ignorable characters, rewritten to nothing.
_IGNORED = frozenset("​‌‍⁠﻿\xad")

DIGIT_WORDS = {word: str(digit) for digit, words in enumerate(DIGIT_NAMES) for word in words.split()}
_either = lambda words: "|".join(sorted(words, key=lambda w: (-len(w), w)))
_SPELLED, _AT, _DOT = _either(DIGIT_WORDS), _either(AT_NAMES.split()), _either(DOT_NAMES.split())
_SPELLED_RUN = re.compile(rf"(?<!\w)(?:(?:{_SPELLED}|[0-9]+)(?:[\x20-]|\s?,\s?)){{3,}}(?:{_SPELLED}|[0-9]+)(?!\w)", re.I)
_SPELLED_ONE = re.compile(rf"({_SPELLED})", re.I)
_SPELLED_GAP = re.compile(r"(?<=\w)(?:[\x20-]|\s?,\s?)(?=\w)")
_PLUS = re.compile(rf"(?<!\w)(?:{_either(PLUS_NAMES.split())})\x20(?=[0-9])", re.I)
_OPEN, _CLOSE = r"[\[({<]\s{0,2}", r"\s{0,2}[\])}>]"
_AT_MARK = rf"(?:\s{{0,2}}{_OPEN}(?:{_AT}|@){_CLOSE}\s{{0,2}}|\x20@\x20)"
_DOT_MARK = rf"(?:\s{{0,2}}{_OPEN}(?:{_DOT}|\.){_CLOSE}\s{{0,2}}|\x20\.\x20)"
_NAME = r"[A-Za-z0-9_%+-]"
_ADDRESS = re.compile(
    rf"(?<![A-Za-z0-9._%+-]){_NAME}+(?:(?:\.|{_DOT_MARK}|\x20(?:{_DOT})\x20){_NAME}+){{0,4}}"
    rf"(?P<at>@|{_AT_MARK}|\x20(?:{_AT})\x20)[A-Za-z0-9-]+(?:(?:\.|{_DOT_MARK}|\x20(?:{_DOT})\x20)[A-Za-z0-9-]+){{1,4}}",
    re.I,
)
_ADDRESS_SIGN = re.compile(rf"{_AT_MARK}|{_DOT_MARK}|\x20(?:{_AT}|{_DOT})\x20", re.I)
_IS_AT, _SAYS_DOT = re.compile(rf"@|{_AT}", re.I), re.compile(rf"\b(?:{_DOT})\b", re.I)
_DOTTED = re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:(?:{_DOT_MARK}|\x20(?:{_DOT})\x20|\.)[0-9]{{1,3}}){{3}}(?![0-9])", re.I)
_HINT = re.compile(rf"@|\x20\.\x20|[\[({{<]\s{{0,2}}\.|\b(?:{_AT}|{_DOT})\b|(?<!\w)(?:{_SPELLED})(?:[\x20-]|\s?,\s?)(?:{_SPELLED}|[0-9])", re.I)


class Rewriting:
    """A text with, for each character, the source interval it stands for."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.edits: list[tuple[int, int, int, int]] = []  # here from, here to, source from, source to

    def _source(self, at: int, right: bool) -> int:
        """The source offset of a boundary in the current text; what was deleted there lies outside."""
        if right:
            i = bisect_left(self.edits, at, key=lambda e: e[0])
            if i < len(self.edits) and self.edits[i][0] == at:
                return self.edits[i][2]
            i -= 1
        else:
            i = bisect_right(self.edits, at, key=lambda e: e[0]) - 1
        if i < 0:
            return at
        _, b, c, d = self.edits[i]
        return d + at - b if at >= b else d if right else c

    def source_span(self, start: int, end: int) -> Span:
        return self._source(start, False), self._source(end, True)

    def touched(self, start: int, end: int) -> bool:
        """Whether a rewrite lies in the interval of the current text."""
        i = bisect_left(self.edits, start, key=lambda e: e[0])
        return (i < len(self.edits) and self.edits[i][0] < end) or (i > 0 and self.edits[i - 1][1] > start)

    def apply(self, changes: list[tuple[int, int, str]]) -> None:
        """Replace disjoint, ordered intervals of the current text by one character or none each.

        Longer replacements could be cut by a later interval, which the map does not know.
        """
        if not changes:
            return
        old, starts = self.edits, [e[0] for e in self.edits]
        merged: list[tuple[int, int, int, int]] = []
        pieces, done, shift, k = [], 0, 0, 0
        for start, end, new in changes:
            while k < len(old) and old[k][1] <= start:
                a, b, c, d = old[k]
                merged.append((a + shift, b + shift, c, d))
                k += 1
            source = self.source_span(start, end)
            while k < len(old) and starts[k] < end:
                k += 1
            pieces += [self.text[done:start], new]
            here = start + shift
            merged.append((here, here + len(new), *source))
            shift += len(new) - (end - start)
            done = end
        merged += [(a + shift, b + shift, c, d) for a, b, c, d in old[k:]]
        self.text = "".join([*pieces, self.text[done:]])
        self.edits = merged


def normalise(text: str) -> Rewriting:
    """Homoglyphs, then spelled digits, then disguised signs."""
    out = Rewriting(text)
    if not text.isascii():
        out.apply([(m.start(), m.end(), "" if m[0] in _IGNORED else GLYPHS[m[0]]) for m in _GLYPH.finditer(text)])
    if "&" in text:
        out.apply([(m.start(), m.end(), ENTITIES[m[0].lower()]) for m in _ENTITY.finditer(out.text)])
    if not out.edits and not _HINT.search(out.text):
        return out
    changes = []
    for run in _SPELLED_RUN.finditer(out.text):
        words = list(_SPELLED_ONE.finditer(out.text, *run.span()))
        if words:
            changes += [(m.start(), m.end(), DIGIT_WORDS[m[0].lower()]) for m in words]
            changes += [(m.start(), m.end(), "") for m in _SPELLED_GAP.finditer(out.text, *run.span())]
    out.apply(sorted(changes))
    out.apply([(m.start(), m.end(), "+") for m in _PLUS.finditer(out.text)])
    changes = []
    for found in _DOTTED.finditer(out.text):
        changes += [(m.start(), m.end(), ".") for m in _ADDRESS_SIGN.finditer(out.text, *found.span())]
    out.apply(changes)
    changes = []
    for found in _ADDRESS.finditer(out.text):
        plain_at = not re.search(r"[@\[({<]", found["at"])
        if plain_at and not _SAYS_DOT.search(found[0][found.end("at") - found.start() :]):
            continue  # "at" between two words, and a full stop: prose
        if not re.search(r"[A-Za-z]{2}$", found[0]):
            continue  # no top-level domain
        changes += [(m.start(), m.end(), "@" if _IS_AT.search(m[0]) else ".") for m in _ADDRESS_SIGN.finditer(out.text, *found.span())]
    out.apply(changes)
    return out


def find(text: str | None) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Base spans, and all spans: base ones with those that the rewritten text adds."""
    text = text or ""
    base = base_spans(text)
    read = normalise(text)
    if not read.edits:
        return base, base
    every = {}
    for kind, spans in base_spans(read.text).items():
        own, more = base[kind], []
        for start, end in spans:
            if read.touched(start, end):
                a, b = read.source_span(start, end)
                i = bisect_left(own, (b,))
                if a < b and not (i and own[i - 1][1] > a):
                    more.append((a, b))
        every[kind] = sorted(own + more)
    return base, every


def _joined(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in spans[kind])


def find_personal(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) per row of ``docs``.

    The n columns and base_sha256 are of the base spans; spans lists base and
    added ones, n_added counts the latter. Needs doc_id and text; other
    columns are ignored. Null and empty texts have no spans; repeated rows and
    null ids pass; whole texts are searched in linear time; an empty table
    gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            found = [find(x) for x in batch.column(1).to_pylist()]
            counts = [pa.array([len(b[k]) for b, _ in found], pa.int64()) for k in KINDS]
            digest = pa.array([hashlib.sha256(_joined(b).encode()).hexdigest() for b, _ in found], pa.string())
            spans = pa.array([_joined(e) for _, e in found], pa.string())
            added = pa.array([sum(len(e[k]) - len(b[k]) for k in KINDS) for b, e in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digest, spans, added], names)

    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]
    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
