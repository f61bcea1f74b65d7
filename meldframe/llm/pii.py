"""Personal data in texts, also behind homoglyphs, spelled digits and at/dot disguises.

Transducers rewrite a text piece by piece: single characters to the ASCII ones they look like, numbers
read out digit by digit to digits, and written or bracketed "at" and "dot" to ``@`` and ``.``. Each
rewritten piece remembers where it stood, so a span found in the rewritten text maps back to the
source characters it came from. Spans are code points, the end exclusive. No shuffle.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from meldframe.llm.shared import bounded_batches, require

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only begin with a run of digits: a part of the run that fails at its start fails later in it too.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """As the leftmost non-overlapping matches of local part, ``@`` and dotted domain: an ``@`` has one local part,
    the characters before it up to another kind or the previous match."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at) if start < at else None
        if match:
            found.append((start, match.end()))
            last = match.end()
        at = text.find("@", max(at + 1, last))
    return found


def _ips(text: str) -> list[Span]:
    spans = (m.span() for m in _IP.finditer(text))
    return [(a, b) for a, b in spans if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in text[a:b].split("."))]


def _cards(text: str) -> list[Span]:
    found = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(m.span())
    return found


def _phones(text: str) -> list[Span]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]


FINDERS = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones}
_DIGIT = re.compile(r"[0-9]")


def plain_spans(text: str) -> dict[str, list[Span]]:
    digits = _DIGIT.search(text) is not None
    return {
        "email": _emails(text) if "@" in text else [],
        "ip": _ips(text) if digits and "." in text else [],
        "card": _cards(text) if digits else [],
        "phone": _phones(text) if digits and "+" in text else [],
    }


#: Letters of other scripts that look like a Latin letter, in order of the Latin ones.
_LOOKALIKES = {
    "a": "аɑα", "b": "Ьƅ", "c": "сϲ", "d": "ԁ", "e": "еҽ", "g": "ɡ", "h": "һ", "i": "іıι", "j": "јϳ", "k": "κ", "l": "ӏ", "m": "м",
    "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ", "t": "т", "u": "υս", "v": "νѵ", "w": "ԝ", "x": "хχ", "y": "уү", "z": "ᴢ",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ",
    "T": "ТΤ", "X": "ХΧ", "Y": "ΥҮ", "Z": "Ζ",
}
#: Characters that stand for a sign: dots, hyphens, and spaces other than U+0020.
_SIGNS = {".": "․。", "-": "‐‑‒–−", " ": "    "}
#: Characters without width, which vanish.
_INVISIBLE = "­​‌‍⁠﻿"


@lru_cache(maxsize=1)
def _glyphs() -> dict[str, str]:
    """The character transducer: lookalikes, signs, invisible characters, decimal
    digits of every script, and characters whose compatibility form is one printable ASCII character."""
    table = {ord(c): plain for source in (_LOOKALIKES, _SIGNS) for plain, looks in source.items() for c in looks}
    table |= {ord(c): "" for c in _INVISIBLE}
    for code in (*range(0x2000, 0xD800), *range(0xE000, 0x20000)):
        char = chr(code)
        folded = unicodedata.normalize("NFKC", char)
        if code not in table and len(folded) == 1 and "!" <= folded <= "~":
            table[code] = folded
    for code in range(0x660, 0x20000):
        if code not in table and (digit := unicodedata.decimal(chr(code), None)) is not None:
            table[code] = str(digit)
    return {chr(code): plain for code, plain in table.items()}


def _glyph_edits(text: str) -> list[tuple[int, int, str]]:
    if text.isascii():
        return []
    table = _glyphs()
    present = "".join(sorted(table.keys() & set(text)))
    return [(m.start(), m.end(), table[m[0]]) for m in re.finditer(f"[{re.escape(present)}]", text)] if present else []


#: Digits as read out, in English, German, Spanish and French; signs as read out.
_DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
}
_REPEAT_WORDS = {"double": 2, "triple": 3}
_SPOKEN = r"(?:(?:double|triple)[\x20-]++)?(?:" + "|".join(sorted(_DIGIT_WORDS, key=lambda w: (-len(w), w))) + r")"
_DOT_WORDS = r"(?:dot|punkt|punto|point)"
# A run is read out digit by digit: four tokens at least, of which two are words.
_RUN = re.compile(
    rf"(?<!\w)(?:plus[\x20-]++)?(?:{_SPOKEN}|[0-9]++)(?:(?:[\x20,-]{{1,3}}|[\x20]?[\[({{]?(?:{_DOT_WORDS}|\.)[\])}}]?[\x20]?)(?:{_SPOKEN}|[0-9]++)){{3,}}(?!\w)", re.IGNORECASE
)
_RUN_PART = re.compile(rf"(?P<plus>plus[\x20-]++)|(?P<times>double|triple)[\x20-]++(?P<word2>\w+)|(?P<number>[0-9]++)|(?P<dot>[\x20]?[\[({{]?(?:{_DOT_WORDS}|\.)[\])}}]?[\x20]?)|(?P<word>[^\W\d_]++)|(?P<gap>[\x20,-]++)", re.IGNORECASE)
_OPEN, _CLOSE = r"[\x20]?[\[({<][\x20]?", r"[\x20]?[\])}>][\x20]?"
_AT = rf"(?:{_OPEN}(?:at|@|arroba|ät)(?:[\x20]?sign)?{_CLOSE}|[\x20]?(?:&#64;|&#x40;|&commat;|%40)[\x20]?)"
_DOT = rf"(?:{_OPEN}(?:{_DOT_WORDS}|\.){_CLOSE}|&#46;|&#x2e;|&period;)"
_SAID_AT, _SAID_DOT = r"(?:[\x20]+(?:at|arroba|ät)[\x20]+)", rf"(?:[\x20]+{_DOT_WORDS}[\x20]+)"
_NAME = r"[A-Za-z0-9%+-]++"
# An address with a disguise: unbracketed words for "at" count only with a disguised dot after them.
_ADDRESS = re.compile(
    rf"(?<![A-Za-z0-9._%+-]){_NAME}(?:(?:{_DOT}|{_SAID_DOT}|[._]){_NAME})*+"
    rf"(?:(?:{_AT}|[\x20]@[\x20]?|@)[A-Za-z0-9-]++(?:(?:{_DOT}|{_SAID_DOT}|\.)[A-Za-z0-9-]++)+|{_SAID_AT}[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+(?:{_DOT}|{_SAID_DOT})[A-Za-z0-9-]++(?:(?:{_DOT}|{_SAID_DOT}|\.)[A-Za-z0-9-]++)*)",
    re.IGNORECASE,
)
_ADDRESS_PART = re.compile(rf"(?P<at>{_AT}|[\x20]@[\x20]?|{_SAID_AT})|(?P<dot>{_DOT}|{_SAID_DOT})", re.IGNORECASE)
_BRACKET_DOT = re.compile(rf"(?<=[0-9]){_DOT}(?=[0-9])", re.IGNORECASE)


@lru_cache(maxsize=1)
def _hints() -> ahocorasick.Automaton:
    """What ``_ADDRESS`` and ``_BRACKET_DOT`` need for an edit, in lower case, by their grammar: a bracket or a
    character code for "at" or "dot", a spaced @, or a said dot. One pass over the text looks for all of them. (Runs
    have no such gate: two digit words or a spaced dot are in most texts.)"""
    said = ["dot", "punkt", "punto", "point"]
    address = [o + gap + w for o in "[({<" for gap in ("", " ") for w in ("at", "@", "arroba", "ät", ".", *said)]
    address += ["&#64;", "&#x40;", "&commat;", "%40", " @", "&#46;", "&#x2e;", "&period;", *(f" {w} " for w in said)]
    found = ahocorasick.Automaton()
    for key in address:
        found.add_word(key, True)
    found.make_automaton()
    return found


class Rewritten:
    """A text rewritten in places; ``source`` maps a span of it back."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        parts, self.at, self.edits, here, size = [], [], edits, 0, 0
        for start, stop, new in edits:
            parts += [text[here:start], new]
            size += start - here
            self.at.append(size)
            size += len(new)
            here = stop
        parts.append(text[here:])
        self.text = "".join(parts)

    def _back(self, position: int, end: bool) -> int:
        """The source place of a boundary: inside a rewritten piece, the piece's start or end."""
        k = bisect.bisect_left(self.at, position) - 1 if end else bisect.bisect_right(self.at, position) - 1
        if k < 0:
            return position
        start, stop, new = self.edits[k]
        beyond = position - self.at[k] - len(new)
        if beyond > 0 or (beyond == 0 and not end):
            return stop + beyond
        return stop if end else start

    def source(self, span: Span) -> Span:
        return self._back(span[0], False), self._back(span[1], True)


def _run_edits(match: re.Match) -> list[tuple[int, int, str]]:
    """The pieces of a number read out; none unless two of its digits are words."""
    edits, words, dots = [], 0, 0
    for part in _RUN_PART.finditer(match[0]):
        a, b = match.start() + part.start(), match.start() + part.end()
        kind = part.lastgroup
        if kind == "plus":
            edits.append((a, b, "+"))
        elif kind in ("word2", "times"):
            digit = _DIGIT_WORDS.get(part["word2"].lower())
            if digit is None:
                return []
            edits.append((a, b, digit * _REPEAT_WORDS[part["times"].lower()]))
            words += 1
        elif kind == "word":
            digit = _DIGIT_WORDS.get(part[0].lower())
            if digit is None:
                return []
            edits.append((a, b, digit))
            words += 1
        elif kind == "dot":
            edits.append((a, b, "."))
            dots += part[0] != "."
        elif kind == "gap":
            edits.append((a, b, ""))
    return edits if words >= 2 or dots >= 1 else []


def _address_edits(match: re.Match) -> list[tuple[int, int, str]]:
    return [(match.start() + p.start(), match.start() + p.end(), "@" if p.lastgroup == "at" else ".") for p in _ADDRESS_PART.finditer(match[0])]


def _disguise_edits(text: str, gated: bool = True) -> list[tuple[int, int, str]]:
    edits = []
    if not gated or next(_hints().iter(text.lower()), None):
        edits += [e for m in _ADDRESS.finditer(text) for e in _address_edits(m)]
        edits += [(m.start(), m.end(), ".") for m in _BRACKET_DOT.finditer(text)]
    edits += [e for m in _RUN.finditer(text) for e in _run_edits(m)]
    last, kept = 0, []
    for edit in sorted(edits):
        if edit[0] >= last and edit[1] > edit[0]:
            kept.append(edit)
            last = edit[1]
    return kept


def find(text: str, gated: bool = True) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """The plain spans by kind, and all spans: with those behind disguises that touch no plain one of their kind, and
    those that hold all of each plain one that they touch (a disguise hid where it begins or ends)."""
    base = plain_spans(text)
    edits = _glyph_edits(text)
    first = Rewritten(text, edits) if edits else None
    between = first.text if first else text
    more = _disguise_edits(between, gated)
    if not first and not more:
        return base, base
    second = Rewritten(between, more) if more else None
    seen = plain_spans(second.text if second else between)
    result = {}
    for kind in KINDS:
        spans = list(base[kind])
        taken = sorted(spans)
        for span in seen[kind]:
            if second:
                span = second.source(span)
            if first:
                span = first.source(span)
            first_met = bisect.bisect_right(taken, span[0], key=lambda x: x[1])
            touched = taken[first_met : bisect.bisect_left(taken, span[1], key=lambda x: x[0])]
            if all(span[0] <= a and b <= span[1] and (a, b) != span for a, b in touched):
                spans.append(span)
        result[kind] = sorted(set(spans))
    return base, result


def rendered(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in spans[kind])


_SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType(), False), T.StructField("start", T.IntegerType(), False), T.StructField("stop", T.IntegerType(), False), T.StructField("disguised", T.BooleanType(), False)]), False)


def spans(df: DataFrame, text: str, *, found: str = "pii") -> DataFrame:
    """``df`` with ``found``: an array of ``kind, start, stop, disguised``, by kind as in ``KINDS`` and then start.

    The whole text counts; a NULL or empty text has an empty array. An input column of that name is replaced.
    """
    require(df, text)
    df = df.drop(found)
    bounded_batches(df.sparkSession)
    at = df.columns.index(text)
    kind_of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("disguised", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(at):
                base, all_ = find(value.as_py() or "")
                plain = {k: set(base[k]) for k in KINDS}
                rows.append([{"kind": k, "start": a, "stop": b, "disguised": (a, b) not in plain[k]} for k in KINDS for a, b in all_[k]])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind_of)], [*batch.schema.names, found])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(found, _SPAN, False)]))
