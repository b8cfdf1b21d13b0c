"""Personal data with offset-preserving deobfuscation.

Plain identifiers are found in the text itself. A text that shows signs of a
disguise also passes a transducer: homoglyphs and full-width forms become ASCII,
invisible characters vanish, spelled digits and numbers become digits (also after
"double" and "triple", and between spelled dots), and ``[at]`` / ``(dot)`` / ``[.]`` /
`` at … dot `` / ``_at_ … _dot_`` / character references become signs; an address
whose characters stand apart is drawn together. A bare `` at `` before a host with
plain dots is left alone: "look at example.org" is no address. The transducer keeps, for every
normalised character, the source range it came from; identifiers found in the
normalised text are mapped back to source positions and added where no plain
one of the same kind overlaps them.

All scans take time in proportion to the text: addresses are found from their
``@`` outwards, and the other patterns cannot restart inside what they read.

Defined cases: null text is the empty text; every row gives one row, repeated rows
and equal or null ids included; an empty table gives no rows; other columns are not
looked at.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, table

KINDS = ("email", "ip", "card", "phone")

_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]++((?:\.[0-9]++){3})?")  # any run of digits, so that no run is read twice
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            yield start, host.end()
            end = host.end()
            at = text.find("@", end)
        else:
            # The part before the next sign can't reach back over this one.
            end, at = at + 1, text.find("@", at + 1)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if m[1] and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" not in text:
        return
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdecimal() for c in m[0]) <= 15:
            yield m.span()


FINDERS = dict(zip(KINDS, (_emails, _ips, _cards, _phones), strict=True))


def _homoglyphs() -> dict[str, str]:
    """Characters that are read as ASCII: full-width and mathematical forms by
    rule, look-alike letters of other scripts by list."""
    found = {chr(0xFEE0 + c): chr(c) for c in range(0x21, 0x7F)}
    for first in (0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6):  # mathematical digits
        found |= {chr(first + d): str(d) for d in range(10)}
    for first in (0x0660, 0x06F0, 0x0966):  # Arabic-Indic, Persian, Devanagari digits
        found |= {chr(first + d): str(d) for d in range(10)}
    for first, base in ((0x1D400, "A"), (0x1D41A, "a"), (0x1D5A0, "A"), (0x1D5BA, "a"), (0x1D670, "A"), (0x1D68A, "a"), (0x24B6, "A"), (0x24D0, "a")):
        found |= {chr(first + i): chr(ord(base) + i) for i in range(26)}
    found |= dict(zip("аеорсухіјѕһԁԛԝАВЕКМНОРСТУХІЈЅ", "aeopcyxijshdqwABEKMHOPCTYXIJS", strict=True))  # Cyrillic
    found |= dict(zip("αιορυνΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aiopuvABEZHIKMNOPTYX", strict=True))  # Greek
    found |= dict(zip("\ufe6b\ufe52\u2024\u2010\u2011\u2012\u2013\u2212\ufe62", "@..-----+", strict=True))
    found |= dict.fromkeys("\u00a0\u2007\u2009\u202f\u3000", " ")
    found |= dict.fromkeys("\u200b\u200c\u200d\u2060\ufeff\u00ad", "")
    return found


HOMOGLYPHS = _homoglyphs()
DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
TEENS = {"ten": "10", "eleven": "11", "twelve": "12", "thirteen": "13", "fourteen": "14", "fifteen": "15", "sixteen": "16", "seventeen": "17", "eighteen": "18", "nineteen": "19"}
TIMES = {"double": 2, "triple": 3}
#: Character references of the two signs.
REFERENCES = {"&#64;": "@", "&#x40;": "@", "&commat;": "@", "&#46;": ".", "&#x2e;": ".", "&period;": "."}
_WORDS = "|".join(DIGITS)
_TIMED = rf"(?:(?:{'|'.join(TIMES)})[ -])?(?:{_WORDS})"
_OCTET = rf"(?:{'|'.join(TEENS)}|{_TIMED}(?:[ -](?:{_TIMED})){{0,2}}|[0-9]{{1,3}})"
_GLYPH = re.compile("[" + "".join(re.escape(c) for c in HOMOGLYPHS) + "]")
_BRACKET = re.compile(r"[\[({<] ?(?:at|dot|@|\.) ?[\])}>]|&(?:#(?:64|46|x40|x2e)|commat|period);|_at_| @ ", re.I)
_COUNTED = frozenset(DIGITS) | frozenset(TIMES) | frozenset("0123456789")


def disguised(text: str) -> bool:
    """Whether a text shows any sign of a disguise; others need no transducer."""
    if not text.isascii() and not set(text).isdisjoint(HOMOGLYPHS):
        return True
    low = text.lower()
    if " dot " in low or _BRACKET.search(low):
        return True
    words = low.replace("-", " ").replace(",", " ").split()
    return b"\1\1\1" in bytes(map(_COUNTED.__contains__, words))


_RULES = re.compile(
    r"(?P<at> ?[\[({<] ?(?:at|@) ?[\])}>] ?)|(?P<dot> ?[\[({<] ?(?:dot|\.) ?[\])}>] ?)"
    r"|(?P<octets>\b" + _OCTET + r"(?: dot " + _OCTET + r"){3}\b)"
    r"|(?P<words>\b(?:plus[ -])?" + _TIMED + r"(?:[ ,-]{1,2}(?:" + _TIMED + r"|[0-9]))*+\b)"
    r"|(?P<plain>(?<=[A-Za-z0-9]) at (?=[A-Za-z0-9-]{1,63}(?: dot [A-Za-z0-9-]{1,63}){1,4}\b))"
    r"|(?P<plaindot>(?<=[A-Za-z0-9]) dot (?=[A-Za-z0-9]))"
    r"|(?P<underat>(?<=[A-Za-z0-9])_at_(?=[A-Za-z0-9-]{1,63}(?:_dot_[A-Za-z0-9-]{1,63}){1,4}(?![A-Za-z0-9-])))"
    r"|(?P<underdot>(?<=[A-Za-z0-9])_dot_(?=[A-Za-z0-9]))"
    r"|(?P<apart>(?<![^\s])[A-Za-z0-9](?: [A-Za-z0-9._%+-](?!\S)){1,63}+ @(?: [A-Za-z0-9-](?!\S)){1,63}+(?: \.(?: [A-Za-z0-9-](?!\S)){1,63}+){1,8})"
    r"|(?P<reference>" + "|".join(REFERENCES) + r")|(?P<glyph>" + _GLYPH.pattern + ")",
    re.I,
)
_SPELLED = re.compile(rf"plus|{'|'.join(TEENS)}|(?:(?P<times>{'|'.join(TIMES)})[ -])?(?P<word>{_WORDS})|[0-9]| (?P<dot>dot) ", re.I)


def transduce(text: str) -> tuple[str, list[int], list[int], list[bool]]:
    """The normalised text and its pieces: where each begins in the normalised
    and in the source text, and whether it is an exact copy of the source."""
    out, at_norm, at_source, same = [], [], [], []
    here, source = 0, 0

    def put(piece: str, begin: int, exact: bool) -> None:
        nonlocal here
        if piece:
            out.append(piece)
            at_norm.append(here)
            at_source.append(begin)
            same.append(exact)
            here += len(piece)

    for m in _RULES.finditer(text):
        kind = m.lastgroup
        put(text[source : m.start()], source, True)
        if kind in ("words", "octets"):
            spelled = list(_SPELLED.finditer(m[0]))
            if len(spelled) < 3:
                put(m[0], m.start(), True)
            else:
                for s in spelled:
                    word = s[0].lower()
                    sign = "+" if word == "plus" else "." if s["dot"] else TEENS.get(word, word)
                    put(DIGITS[s["word"].lower()] * TIMES.get((s["times"] or "").lower(), 1) if s["word"] else sign, m.start() + s.start(), False)
        elif kind in ("at", "plain", "underat"):
            put("@", m.start(), False)
        elif kind in ("dot", "plaindot", "underdot"):
            put(".", m.start(), False)
        elif kind == "apart":
            for i in range(0, len(m[0]), 2):
                put(m[0][i], m.start() + i, False)
        elif kind == "reference":
            put(REFERENCES[m[0].lower()], m.start(), False)
        else:
            put(HOMOGLYPHS.get(m[0], m[0]), m.start(), False)
        source = m.end()
    put(text[source:], source, True)
    at_norm.append(here)
    at_source.append(len(text))
    return "".join(out), at_norm, at_source, same


def find_spans(text: str | None) -> list[tuple[int, int, int, bool]]:
    """``(kind, start, end, plain)`` in source code points, by kind, then start."""
    text = text or ""
    plain = {k: list(find(text)) for k, find in FINDERS.items()}
    found = [(i, a, b, True) for i, k in enumerate(KINDS) for a, b in plain[k]]
    if disguised(text):
        norm, at_norm, at_source, same = transduce(text)
        for i, k in enumerate(KINDS):
            starts = [a for a, _ in plain[k]]
            for a, b in FINDERS[k](norm):
                p, q = bisect_right(at_norm, a) - 1, bisect_right(at_norm, b - 1) - 1
                start = at_source[p] + (a - at_norm[p] if same[p] else 0)
                end = at_source[q] + (b - at_norm[q]) if same[q] else _end(text, at_source, q)
                before = bisect_right(starts, start) - 1
                if not (before >= 0 and plain[k][before][1] > start or before + 1 < len(starts) and starts[before + 1] < end):
                    found.append((i, start, end, False))
    return sorted(found)


def _end(text: str, at_source: list[int], piece: int) -> int:
    """Where the source of a replaced piece ends, without separators after it."""
    end = at_source[piece + 1]
    while end > at_source[piece] + 1 and text[end - 1] in " ,-":
        end -= 1
    return end


def find_pii(docs: DataFrame) -> DataFrame:
    """``(doc_id, found)``: the spans of every text as an array of
    ``(ord, start, end, kind, plain, text)``; code points, end exclusive.

    Rows are independent: no shuffle; a lost task is run again.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = pa.struct([("ord", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("plain", pa.bool_()), ("text", pa.string())])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            schema = pa.schema([frame.schema.field(0).with_name("doc_id"), ("found", pa.list_(span))])

            def rows(frame=frame):
                for key, cell in zip(frame.column(0), frame.column(1), strict=True):
                    text = cell.as_py()
                    yield key.as_py(), [{"ord": k, "start": a, "end": b, "kind": KINDS[k], "plain": p, "text": text[a:b]} for k, a, b, p in find_spans(text)]

            yield from batches(rows(), schema, 2048)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, found array<struct<ord:int,start:int,end:int,kind:string,plain:boolean,text:string>>")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _plain(kind: str):
    return lambda s: s["plain"] & (s["kind"] == kind)


def digest(found: DataFrame) -> DataFrame:
    counts = [F.size(F.filter("found", _plain(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    plain = F.filter("found", lambda s: s["plain"])
    return found.select("doc_id", *counts, F.sha2(_joined(plain), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_pii(table(spark, sf_dir, "documents")))
