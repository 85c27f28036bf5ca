"""What a notice states of itself, by one scan: all labels and identifiers are one pattern, and each match carries its kind, its value and its place.

Labels take only themselves and look ahead at their value, so a date after a label is a date, too. Only places where a label or an identifier may
begin are tried, and there only the kinds that begin so.
"""

from __future__ import annotations

import datetime
import functools
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.texts import pattern
from ..plans.dimensions import NOTICE_TYPES

# Patterns of identifiers, provisions, years and days.
GSTIN = r"\b(\d{2}[A-Z]{5}\d{4}[A-Z][0-9A-Z]{3})\b"
PORTAL_ID = r"[A-Z]{2}\d{10,14}[A-Z0-9]"
PROVISION = r"\d{1,3}[A-Z]?(?:\s*\(\s*[0-9a-zA-Z]{1,3}\s*\))*"
DAY = r"\d{1,2}[./\-]\d{1,2}[./\-]\d{4}"
WORDED = r"(\d{1,2})(?:st|nd|rd|th)?\s+(January|February|March|April|May|June|July|August|September|October|November|December),?\s+(\d{4})"
YEARS = r"(\d{4})\s*[-–/]\s*(\d{2,4})"
# A direction to answer, and how far before "on or before" it stands.
DIRECTION = r"(?i)\b(?:repl(?:y|ies)|response|respond|explain|explanation|objection|submit|furnish|show\s+cause)\b"
DIRECTION_LOOKBACK = 200
# What stands before each value, and the value.
CODES = sorted((code for code, _, _ in NOTICE_TYPES if code != "OTHER"), key=len, reverse=True)
NAME_LABEL, NAME = r"(?:Legal|Trade)\s*Name\s*[:\-]\s*(?:M/s\.?|Tvl\.?|Messrs\.?)?[ \t]*", r"([A-Za-z][\w&.'\-]*(?:[ \t]+[A-Za-z][\w&.'\-]*){0,7})"
_ref, _year = rf"\.?\s*(?:no|number)?\.?\s*[:\-]?\s*(?=({PORTAL_ID}))", rf"\s*[:\-]?\s*({YEARS.replace('(', '(?:')})"
_code = "|".join(f"{x}(?:{'|'.join(c[1:].replace('-', r'[\s\-]*') for c in CODES if c[0] == x)})" for x in dict.fromkeys(c[0] for c in CODES))
#: Kinds of matches: what a place must look like to be tried (most places fail there, by two characters), and the patterns tried at it, in order, with a group for the value.
KINDS = [
    (r"(?=[rsudwftjci][eca/iy.usn])", [
        ("dated", rf"reference\s*No\.?\s*[:\-]?\s*(?=[A-Z0-9]+\s*Date\s*[:\-]?\s*({DAY}))(?=({PORTAL_ID})?)"),
        ("referred", f"(?:ref(?:erence)?|scrutiny\\s+ref){_ref}"),
        ("labelled_section", r"section\s+under\s+which\s+(?:the\s+)?notice\s+is\s+issued\s*[:\-]?\s*(\d{1,3}[A-Z]?)"),
        ("section", rf"(?:sec(?:tion|\.?)|u/s)\s*({PROVISION})"),
        ("labelled_due", rf"date\s+by\s+which\s+(?:the\s+)?reply\s+(?:has\s+to\s+be|is\s+to\s+be|to\s+be)\s+submitted\s*[:\-]?\s*(?=({DAY}))"),
        ("window", r"within\s+\(?\s*(\d{1,3})\s*\)?\s+days\s+(?:of|from)\s+(?:the\s+)?(?:date\s+of\s+)?(?:receipt|service|issue|issuance)"),
        ("year", rf"(?:f\.?Y\.?|financial\s+year|tax\s+period){_year}"),
        ("officer", r"signature\s*\n?\s*Name\s*[:\-]\s*(?=([A-Za-z][A-Za-z.\s]{2,40}?)\s*\n)"),
        ("designation", r"designation\s*[:\-]\s*(?=([A-Za-z()/,.\s]{4,60}?)\s*\n)"),
        ("jurisdiction", r"jurisdiction\s*[:\-]\s*(?=([^\n]{3,90}(?:\n[^\n:]{1,60})?))"),
        ("circle", r"circle\s*[:\-]\s*(?=([A-Za-z0-9 \-]{3,40}))"),
        ("amount", r"(?:rs\.?|inr)\s*([\d,]+(?:\.\d{1,2})?)"),
    ]),
    ("", [("amount", r"₹\s*([\d,]+(?:\.\d{1,2})?)")]),
    (r"(?=[adorsm][rinusepdfo])\b", [
        ("arn", rf"arn\s*[:\-]?\s*(?=({PORTAL_ID}))"),
        ("din", r"din\s*[:\-]?\s*(?=([A-Z0-9]{15,25})\b)"),
        ("on_or_before", rf"on\s+or\s+before\s+(?=({DAY}))"),
        ("rule", rf"rules?\s*({PROVISION})"),
        ("form", rf"({_code})\b"),
    ]),
    (r"(?-i:(?=[LT][er]))", [("name", f"(?-i:{NAME_LABEL}(?={NAME}))")]),
    (r"(?=\d)\b", [
        ("gstin", f"(?-i:{GSTIN})"),
        ("date", rf"({DAY}|{WORDED.replace('(', '(?:').replace('(?:?:', '(?:')})\b"),
        ("bare_year", r"(20\d{2}\s*[-–]\s*\d{2})\b"),
    ]),
    (r"(?-i:(?=[A-Z]{2}\d))\b", [("portal_id", rf"((?-i:{PORTAL_ID}))\b")]),
]
#: What each of the pattern's groups tells, in order; the second of a dated reference is the reference.
GROUPS = [g for _, of in KINDS for kind, _ in of for g in ((kind, "dated_id") if kind == "dated" else (kind,))]
#: How matches of each kind begin: classes of the first four characters, in lower case, and the kinds tried there. More may begin so than match.
#: An identifier of the portal is told by its second letter.
HEADS = [
    ("r e f", "dated referred"), ("s c r u", "referred"), (r"s e c .t\s\d", "labelled_section section"), (r"u / s \s\d", "section"), ("d a t e", "labelled_due"), ("w i t h", "window"), (r"f y .:\-\s\d", "year"), ("f . y", "year"), ("f i n a", "year"),
    (r"t a x \s", "year"), ("s i g n", "officer"), ("d e s i", "designation"), ("j u r i", "jurisdiction"), ("c i r c", "circle"), (r"r s .\s\d,", "amount"), (r"i n r \s\d,", "amount"), (r"\x7f", "amount"), (r"a r n :\-\sa-z", "arn"), (r"d i n :\-\sa-z\d", "din"),
    (r"o n \s", "on_or_before"), ("r u l e", "rule"), ("l e g a", "name"), ("t r a d", "name"), (r"\d \d a-z a-z", "gstin"), (r"\d ./\- \d", "date"), (r"\d \d ./\- \d", "date"), (r"\d \s \sjfmasond", "date"), (r"\d \d \s \sjfmasond", "date"),
    ("\\d snrt tdh", "date"), ("\\d \\d snrt tdh", "date"), (r"2 0 \d \d", "bare_year"), (r"a-z \d \d \d", "portal_id"), *[(" ".join([*x[:4]] + [r"\s\-\d"] * (len(x) < 4)), "form") for x in dict.fromkeys(c.split("-")[0].lower() for c in CODES)],
]
_WORDS = {kind for look, of in KINDS for kind, _ in of if look.endswith(r"\b") and kind != "portal_id"}
_PATTERNS = [(kind, pattern((r"\b" if look.endswith(r"\b") else "") + f"(?:{p})", re.I)) for look, of in KINDS for kind, p in of]


def _heads() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the first and for the last two of four characters a bit for each of HEADS that they may be of; and which characters are of words."""
    of = lambda token: np.array([re.match(f"[{token}]", chr(i)) is not None for i in range(256)])
    begins, goes_on = np.zeros((256, 256), np.uint64), np.zeros((256, 256), np.uint64)
    for i, (tokens, _) in enumerate(HEADS):
        a, b, c, d = (of(x) for x in [*tokens.split(), *[r"\s\S"] * 3][:4])
        begins[np.ix_(a, b)] |= np.uint64(1 << i)
        goes_on[np.ix_(c, d)] |= np.uint64(1 << i)
    return begins.ravel(), goes_on.ravel(), of(r"\w") & (np.arange(256) < 128)


BEGINS, GOES_ON, WORD = _heads()
MAY_BEGIN = BEGINS != 0
BOUNDED = np.uint64(sum(1 << i for i, (_, of) in enumerate(HEADS) if all(k in _WORDS for k in of.split())))
SECOND = np.uint64(1 << [kinds for _, kinds in HEADS].index("portal_id"))
#: Characters of texts looked at together.
BLOCK = 1 << 16


@functools.cache
def _tried(heads: int) -> list[tuple[str, re.Pattern]]:
    """The kinds that these heads may be of, in order."""
    kinds = {k for i, (_, of) in enumerate(HEADS) if heads >> i & 1 for k in of.split()}
    return [x for x in _PATTERNS if x[0] in kinds]


def _places(texts: list[str]) -> Iterator[list[tuple[int, int]]]:
    """For each text the places, in order, where a match may begin, with the heads that stand there."""
    joined = "\0".join(texts).replace("₹", "\x7f").encode("ascii", "replace").lower() + bytes(4)
    seen = np.frombuffer(joined, np.uint8)
    pairs = seen[:-1].astype(np.uint16) << 8 | seen[1:]
    at = np.flatnonzero(MAY_BEGIN[pairs[:-2]])
    heads = BEGINS[pairs[at]] & GOES_ON[pairs[at + 2]]
    # what begins with a word doesn't begin within one
    inside = WORD[seen[at - 1]] & (at > 0) & ((heads & ~BOUNDED) == 0)
    kept = (heads != 0) & ~inside
    at, heads = at[kept], heads[kept]
    at = at - (heads == SECOND)
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    cuts = np.searchsorted(at, starts).tolist()
    at = (at - np.repeat(starts[:-1], np.diff(cuts))).tolist() if len(at) else []
    heads = heads.tolist()
    for a, b in zip(cuts, cuts[1:]):
        yield list(zip(at[a:b], heads[a:b]))


def _found(text: str, places: list[tuple[int, int]]) -> dict[str, list[tuple[int, str]]]:
    found, end = {}, 0
    for at, heads in places:
        if at < end:
            continue
        for kind, p in _tried(heads):
            if m := p.match(text, at):
                end = m.end()
                found.setdefault(kind, []).append((at, m[1]))
                if kind == "dated" and m[2]:
                    found.setdefault("dated_id", []).append((at, m[2]))
                break
    return found


def scan(texts: list[str]) -> Iterator[dict[str, list[tuple[int, str]]]]:
    """For each text the matches of each kind, in order: the place, from 0, and the value. The earliest match counts, of kinds at one place the first, and the next begins behind it."""
    block, chars = [], 0
    for t in [*texts, None]:
        if block and (t is None or chars + len(t) > BLOCK):
            yield from map(_found, block, _places(block))
            block, chars = [], 0
        if t is not None:
            block.append(t)
            chars += len(t)


MONTHS = {m: i + 1 for i, m in enumerate(("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"))}
RANKS = {c.replace("-", ""): i for i, c in enumerate(CODES)}
_worded, _years, _spaces, _joints, _breaks, _commas = pattern(WORDED, re.I), pattern(YEARS), pattern(r"\s+"), pattern(r"[\s-]+"), pattern(r"\s*\n\s*"), pattern(r"\s*,\s*")
#: Values that were read are kept, as few differ: so many of each kind.
KEPT = 1 << 14


def first(found: dict, *kinds: str) -> tuple[int | None, str | None]:
    """The first match of any of these kinds, or nulls."""
    return min((found[k][0] for k in kinds if k in found), default=(None, None))


@functools.lru_cache(KEPT)
def as_date(day: str | None) -> datetime.date | None:
    """d.m.y by dots, slashes or hyphens, or with the month's name (14th June, 2026); a day that isn't in the calendar is null."""
    if day is None:
        return None
    if m := _worded.match(day):
        d, month, year = int(m[1]), MONTHS[m[2][:3].lower()], int(m[3])
    else:
        d, month, year = map(int, day.replace(".", "/").replace("-", "/").split("/"))
    try:
        return datetime.date(year, month, d)
    except ValueError:
        return None


def best_known(codes: list[str]) -> str | None:
    """best_form() of a list."""
    return CODES[min(known)] if (known := [RANKS[k] for c in codes if (k := bare_code(c)) in RANKS]) else None


@functools.lru_cache(KEPT)
def bare_code(said: str) -> str:
    return _joints.sub("", said).upper()


def best_form(codes: Column) -> Column:
    """Of matched codes the longest known one; of equally long ones the first in the table."""
    rank = F.create_map(*[F.lit(x) for i, c in enumerate(CODES) for x in (c.replace("-", ""), i)])
    best = F.array_min(F.transform(codes, lambda x: F.element_at(rank, F.upper(F.regexp_replace(x, r"[\s-]+", "")))))
    return F.try_element_at(F.array(*[F.lit(c) for c in CODES]), best + 1)


@functools.lru_cache(KEPT)
def _closed(value: str) -> str:
    return _spaces.sub("", value)


def compact(values: list[str]) -> list[str]:
    """Without white space, each once, in order."""
    return list(dict.fromkeys(map(_closed, values)))


@functools.lru_cache(KEPT)
def years(said: str | None) -> str | None:
    """2019-20 of '2019-20', '2019 / 2020' and the like."""
    return f"{m[1]}-{m[2][-2:]}" if said is not None and (m := _years.search(said)) else None


@functools.lru_cache(KEPT)
def office(said: str | None) -> str | None:
    """An office that runs over two lines as one, with its commas closed up."""
    return None if said is None else _commas.sub(", ", _breaks.sub("", said)).strip(" ,")
