"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusflow.llm.common import batches, texts

#: The base kinds in their order, then those that the method adds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "ipv6", "card13", "local_phone")

#: The base patterns. Possessive signs and look-behinds only spare steps back; the
#: matches are those of the plain patterns (see ``base_spans``).
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CARD_DIGITS, PHONE_DIGITS = (14, 19), (10, 15)

#: What the method adds. Groups of an IBAN are parted by one space at most.
IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2}[0-9]{2})((?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
IPV6 = re.compile(r"(?<![0-9A-Fa-f:.])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:.])")
LOCAL_PHONE = re.compile(r"(?<![0-9+().-])(?:\([0-9]{2,4}\)\x20?|0[0-9]{1,4}[\x20/-])[0-9]{3,4}[\x20-]?[0-9]{3,5}(?![0-9-])")

#: Lengths of IBANs by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28,
    "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18,
    "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22,
    "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18,
    "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24,
    "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24,
    "XK": 20,
}

#: Words that make a kind likelier, and some that make any number less likely to be personal.
CONTEXT = {
    "email": "mail email e-mail contact kontakt write reach correo courriel",
    "ip": "ip address host server client login adresse",
    "card": "card credit debit visa mastercard amex payment karte kreditkarte tarjeta carte",
    "phone": "phone tel telephone mobile call fax cell telefon anruf handy teléfono llamar téléphone appeler",
    "iban": "iban account bank konto cuenta compte transfer überweisung",
    "ssn": "ssn social security taxpayer",
    "ipv6": "ip ipv6 address host server client login adresse",
}
CONTEXT["card13"], CONTEXT["local_phone"] = CONTEXT["card"], CONTEXT["phone"]
AGAINST = frozenset("version release isbn issn doi order invoice part serial model build chapter section".split())
WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
#: Code points before and behind a span in which its context stands.
NEAR = 50
#: Scores: of a pattern alone, what a checksum or a strict range adds, and words for and against.
PATTERN = {"email": 0.8, "ip": 0.5, "card": 0.3, "phone": 0.6, "iban": 0.4, "ssn": 0.3, "ipv6": 0.6, "card13": 0.05, "local_phone": 0.3}
CONFIRMED, FOR, LESS = 0.4, 0.25, 0.2
#: Spans that the method adds need this score; those of the base kinds stay whatever they score.
LEAST_SCORE = 0.5

SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


class Span(NamedTuple):
    start: int
    kind: int
    end: int
    confirmed: bool


def digits_of(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def luhn(digits: str) -> bool:
    """Whether the Luhn sum, from the right every second digit doubled, ends in 0."""
    plain, doubled = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, plain)) + sum(int("0246813579"[int(d)]) for d in doubled)) % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an IBAN without spaces leaves 1, its letters as 10 to 35 and its head at the end."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """Spans of the base kinds: leftmost non-overlapping matches by kind, less those that fail.

    Each kind takes time linear in the text, runs of a million digits or letters included: an
    address is looked for around each ``@``, to the left as far as its characters and the end of
    the match before allow; an IP number can only begin where a run of digits does.
    """
    found = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = free + len(text[free:at].rstrip(LOCAL))
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            found.append(Span(start, 0, free, True))
            at = text.find("@", free)
        else:
            # What stands before this sign cannot be part of a later match.
            free = at + 1
            at = text.find("@", free)
    for m in IP.finditer(text):
        if all(map(_octet, m.groups())):
            found.append(Span(m.start(), 1, m.end(), False))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= CARD_DIGITS[0]:
            d = digits_of(m.group())
            if CARD_DIGITS[0] <= len(d) <= CARD_DIGITS[1] and luhn(d):
                found.append(Span(m.start(), 2, m.end(), True))
    for m in PHONE.finditer(text) if "+" in text else ():
        if PHONE_DIGITS[0] <= len(digits_of(m.group())) <= PHONE_DIGITS[1]:
            found.append(Span(m.start(), 3, m.end(), False))
    return found


def more_spans(text: str) -> list[Span]:
    """Proposals of the kinds that the method adds."""
    found = []
    for m in IBAN.finditer(text):
        whole = m.group().replace(" ", "")
        size = IBAN_LENGTHS.get(whole[:2])
        # The pattern may run on into capitals behind the number.
        if size and size <= len(whole) and mod97(whole[:size]):
            end, seen = m.start(), 0
            while seen < size:
                seen += text[end] != " "
                end += 1
            if end == len(text) or not text[end].isalnum():
                found.append(Span(m.start(), 4, end, True))
    for m in SSN.finditer(text):
        area, group, serial = m.groups()
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            found.append(Span(m.start(), 5, m.end(), False))
    for m in IPV6.finditer(text) if ":" in text else ():
        found.append(Span(m.start(), 6, m.end(), False))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            d = digits_of(m.group())
            if len(d) == 13 and luhn(d):
                found.append(Span(m.start(), 7, m.end(), True))
    for m in LOCAL_PHONE.finditer(text):
        if 7 <= len(digits_of(m.group())) <= PHONE_DIGITS[1]:
            found.append(Span(m.start(), 8, m.end(), False))
    return found


WORDS_FOR = tuple(frozenset(CONTEXT[k].split()) for k in KINDS)


def scored(text: str, span: Span) -> float:
    """Between 0 and 1: the pattern, its checksum, and the whole words within ``NEAR`` of it."""
    kind = KINDS[span.kind]
    around = text[max(0, span.start - NEAR) : span.start] + " | " + text[span.end : span.end + NEAR]
    words = set(WORD.findall(around.lower()))
    score = PATTERN[kind] + CONFIRMED * (span.confirmed and kind != "email")
    if words & WORDS_FOR[span.kind]:
        score += FOR
    if words & AGAINST:
        score -= LESS
    return round(min(1.0, max(0.0, score)), 6)


def find(text: str) -> list[tuple[Span, float]]:
    """All spans of a text with their scores, by start and then kind.

    A span that the method adds is dropped where a base span or one added before touches it.
    """
    spans = [(s, scored(text, s)) for s in base_spans(text)]
    added = []
    taken = sorted((s.start, s.end) for s, _ in spans)
    edges, ends = np.array([a for a, _ in taken]), np.maximum.accumulate([b for _, b in taken] or [0])
    for s in sorted(more_spans(text), key=lambda s: (s.kind, s.start)):
        score = scored(text, s)
        if score < LEAST_SCORE:
            continue
        # Of the spans that begin before this one ends, the one that reaches farthest.
        before = int(np.searchsorted(edges, s.end, "left"))
        if before and ends[before - 1] > s.start:
            continue
        added.append((s, score))
    kept: list[tuple[Span, float]] = []
    reach = -1
    for s, score in sorted(added, key=lambda x: (x[0].start, x[0].kind)):
        if s.start >= reach:
            kept.append((s, score))
            reach = s.end
    return sorted(spans + kept, key=lambda x: (x[0].start, x[0].kind))


#: Characters without which a text holds no personal data: a digit, or the sign of an address.
TELLING = re.compile("[0-9@]")


def scan(docs: DataFrame) -> DataFrame:
    """``(doc_id, spans)``: per row of ``docs`` its personal data, ``SPANS`` by start and kind.

    Spans are in code points, the end exclusive. Those of the kinds ``BASE`` are all matches of
    the fixed patterns with right checksums; those that the method adds (IBANs by mod-97, other
    numbers by pattern and context) have a score of ``LEAST_SCORE`` or more and touch no base span.
    The score of a base span is a figure for filters further on and never drops it.

    Null and empty texts have no spans. Whole texts are searched in time linear in their length,
    very long ones too. Equal texts have equal spans; null ids and repeated rows are kept as rows
    of their own. Other columns are left out, so their names cannot clash. An empty table gives no
    rows. Each row is worked on alone, so nothing is shuffled and no source can be a hot spot.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
    none: list = []

    def search(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            rows = [
                [(KINDS[s.kind], s.start, s.end, score) for s, score in find(t)] if TELLING.search(t) else none
                for t in b["text"].to_pylist()
            ]
            rows = [[dict(zip(("kind", "start", "end", "score"), s)) for s in r] for r in rows]
            yield pa.record_batch([b["doc_id"], pa.array(rows, kind)], ["doc_id", "spans"])

    return texts(docs).mapInArrow(search, f"doc_id long, spans {SPANS}")
