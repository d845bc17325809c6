"""Operator 11: personal data by patterns, checksums and context.

1. Regular expressions propose spans. The kinds in BASE are matched leftmost without overlaps, as they stand; a match
   that fails its validator (parts of an address, number of digits, Luhn) is dropped and not tried again at another place.
2. Further proposals: account numbers (`iban`) that the mod-97 checksum confirms, at any group end; `card` numbers inside
   longer runs of digits, cut at separators and confirmed by Luhn; `phone` numbers of ten digits in national writing.
3. Every span has a score: what its pattern is worth, more if a checksum confirmed it, more or less by the words within
   WINDOW code points around it. Proposals of the second step stay from `min_score` on and where they overlap no other
   span; spans of the first step stay in any case, so their score is for the reader to use.

The work is a map: no shuffle, but for dealing out the rows of few large files. The helper sees one text at a time; each
pattern takes time linear in the text, because none can start inside a run that it has read already.

Defined results: null and empty texts have no spans; repeated rows each give a row; an empty table gives none; the
input's columns come back in `row`.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactrank.llm.blocks import spread

#: All kinds, in the order of spans that start together.
KINDS = ("email", "ip", "card", "phone", "iban")
BASE = KINDS[:4]
WINDOW = 40
MIN_SCORE = 0.6
#: What a proposal is worth before its context: by its pattern alone, and with a checksum.
WORTH = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.7, "iban": 0.8, "national phone": 0.35, "inner card": 0.65}
FOR, AGAINST = 0.3, 0.3

#: Words near a span that speak for its kind, and words that speak for some other number; lower case, in four languages.
CONTEXT = {
    "email": "mail email e-mail contact courriel correo kontakt",
    "ip": "ip address server host client adresse dirección",
    "card": "card credit visa mastercard payment carte karte kreditkarte tarjeta",
    "phone": "phone tel telephone mobile cell call fax téléphone portable telefon handy teléfono móvil",
    "iban": "iban account bank konto compte cuenta transfer",
}
OTHER = {
    "email": "",
    "ip": "version release section chapter",
    "card": "isbn order invoice serial tracking",
    "phone": "isbn order invoice serial tracking version",
    "iban": "serial hash token",
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Patterns begin with what can begin a span, and then look back, so that other text is skipped at once.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"[0-9](?<![0-9].)[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"[A-Z](?<![A-Za-z0-9].)[A-Z][0-9]{2}(?: ?[A-Z0-9]){11,30}")
_NATIONAL = re.compile(r"[0-9(](?<![0-9+().-].)(?:(?<=\()[0-9]{3}\) ?|(?<=[0-9])[0-9]{2}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
_CONTEXT = {k: frozenset(v.split()) for k, v in CONTEXT.items()}
_OTHER = {k: frozenset(v.split()) for k, v in OTHER.items()}


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    score: float
    base: bool


def luhn(digits: str) -> bool:
    """The checksum of card numbers."""
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(2 * int(d) - 9 * (d > "4") for d in even)) % 10 == 0


def mod_97(account: str) -> bool:
    """The checksum of account numbers: the first four places moved to the end, letters as 10 to 35."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ back to where the run of characters before it begins, but not into the match before."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield start, done
        at = text.find("@", done if m else at + 1)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _only_digits(text: str) -> str:
    return re.sub("[^0-9]+", "", text)


def base_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of the base kinds."""
    if "@" in text:
        for start, end in emails(text):
            yield "email", start, end
    if text.count(".") > 2:
        for m in _IP.finditer(text):
            if all(map(_small, m[0].split("."))):
                yield "ip", *m.span()
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _only_digits(m[0])) <= 19 and luhn(d):
            yield "card", *m.span()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_only_digits(m[0])) <= 15:
                yield "phone", *m.span()


def _inner_cards(text: str) -> Iterator[tuple[int, int]]:
    """Runs of digits of more than a card's length, cut at their separators; the first fitting pieces, none twice."""
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() < 20 or len(_only_digits(m[0])) < 20:
            continue
        pieces = [(p.start() + m.start(), p.end() + m.start()) for p in re.finditer("[0-9]+", m[0])]
        at = 0
        while at < len(pieces):
            number, upto = "", at
            while upto < len(pieces) and len(number) < 14:
                number += text[pieces[upto][0] : pieces[upto][1]]
                upto += 1
            if 14 <= len(number) <= 19 and number[0] in "23456" and luhn(number):
                yield pieces[at][0], pieces[upto - 1][1]
                at = upto
            else:
                at += 1


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """The longest confirmed number of each proposal that ends where a group of letters and digits does."""
    for m in _IBAN.finditer(text):
        ends = [m.start() + e.end() for e in re.finditer("[A-Z0-9]+", m[0])]
        for end in reversed(ends):
            number = text[m.start() : end].replace(" ", "")
            if 15 <= len(number) <= 34 and not text[end : end + 1].isalnum() and mod_97(number):
                yield m.start(), end
                break


def score(text: str, kind: str, start: int, end: int, worth: float) -> float:
    """0 to 1: the worth, and what the words around the span add to it or take from it."""
    near = {w.lower() for w in _WORD.findall(text[max(0, start - WINDOW) : start]) + _WORD.findall(text[end : end + WINDOW])}
    near |= {p for w in near for p in w.split("-")}
    worth += FOR * bool(near & _CONTEXT[kind]) - AGAINST * bool(near & _OTHER[kind])
    return round(min(1.0, max(0.0, worth)), 4)


def spans_of(text: str, min_score: float = MIN_SCORE) -> list[Span]:
    """All spans of a text by start, then by kind."""
    out = [Span(a, b, kind, score(text, kind, a, b, WORTH[kind]), True) for kind, a, b in base_spans(text)]
    for kind, worth, proposals in (("iban", "iban", _ibans(text)), ("card", "inner card", _inner_cards(text)), ("phone", "national phone", (m.span() for m in _NATIONAL.finditer(text)))):
        fit = [s for a, b in proposals if (s := Span(a, b, kind, score(text, kind, a, b, WORTH[worth]), False)).score >= min_score]
        if fit:
            out += apart(fit, out)
    return sorted(out, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def apart(spans: list[Span], others: list[Span]) -> list[Span]:
    """The spans that overlap none of the others."""
    others = sorted(others)
    starts, reach = [s.start for s in others], list(accumulate((s.end for s in others), max))
    return [s for s in spans if not (n := bisect_left(starts, s.end)) or reach[n - 1] <= s.start]


def masked(text: str, spans: Iterable[Span]) -> str:
    """The text with `<KIND>` in the place of each span; spans that overlap become one, of the first one's kind."""
    out, at = [], 0
    for s in spans:
        if s.start >= at:
            out += [text[at : s.start], f"<{s.kind.upper()}>"]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())]))


def find_pii(docs: DataFrame, text: str = "text", min_score: float = MIN_SCORE, mask: bool = False, keep: list[str] | None = None) -> DataFrame:
    """row and spans (array of kind, start, end, score, base; code points, end exclusive); with `mask` also the masked text.

    keep: the columns of `row`; all, if None.
    """
    of = F.struct(*(F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)))
    rows = spread(docs).select(of.alias("row"), F.col(text).cast("string").alias("_text"))
    more = "spans array<struct<kind:string,start:bigint,end:bigint,score:double,base:boolean>>" + ", masked string" * mask
    schema = T.StructType([*rows.select("row").schema, *T.StructType.fromDDL(more)])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            found = [spans_of(t, min_score) if t else [] for t in texts]
            listed = pa.array([[{"kind": s.kind, "start": s.start, "end": s.end, "score": s.score, "base": s.base} for s in spans] for spans in found], _SPANS)
            columns = [batch.column("row"), listed]
            if mask:
                columns.append(pa.array([t if t is None else masked(t, spans) for t, spans in zip(texts, found, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["row", "spans", "masked"][: len(columns)])

    return rows.mapInArrow(find, schema)
