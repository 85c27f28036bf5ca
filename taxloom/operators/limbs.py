"""Limbs of a notice and their figures, where each limb stands in the text, and what it alleges by tax head. Read within Arrow batches (see functions/texts)."""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Callable
from decimal import Decimal
from functools import partial

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.money import MONEY
from ..functions.texts import CENTS, Lines, each, lists, paise, pattern, reading, rupees, small, structs

# Patterns of figures, of where the operative part of a notice ends, and of headings; labels of operative rows; words of heads.
NUMBER = r"\d(?<![\w.]\d)(?<![A-Za-z]-\d)(?:\d{0,2}(?:,\d{2,3})*(?:\.\d{1,2})?|\d*(?:\.\d{1,2})?)(?!\w)"
PAIR = r"(?=\d)(?<![\w.])(\d{1,3}(?:,\d{2,3})+(?:\.\d{1,2})?|\d+(?:\.\d{1,2})?)(?![\w.])\s+\1(?![\w.])(?=([^\n]*))"
EACH = r"(?i)(?:Rs\.?|INR|₹)\s*(\d{1,3}(?:,\d{2,3})*(?:\.\d{1,2})?|\d+)\s*/?-?\s*each\s+under\s+(?:the\s+)?([A-Z/ ]{4,20}?)\s+and\s+([A-Z/ ]{4,20}?)\b"
LUMP_LINE = r".*\b(?:difference|excess|short\s*payment|shortfall|total)\b.*$"
SUMMARY = r"(?i)The\s+total\s+tax\s+(?:payable|due)\s+on\s+account\s+of\s+these\s+deficienc\w+"
MARKER = r"(?i)\s*[•\-*]?\s*Defect\s*[-–—]?\s*(\d{1,2})\s*[:.]?\s*([^\n]*)"
BULLET = r"\s*[•‣▪]\s*(.{3,90}?)\s*:\s*$"
NUMBERED = r"\s*(\d{1,2})\s*[.)]\s+(\S.{5,118})$"
OPERATIVE = ["difference", "excess", "short", "total ineligible", "net", "payable", "recoverable", "demand"]
HEAD_ORDER = ["sgst", "cgst", "igst", "cess"]
HEAD_WORDS = {"cgst": "cgst", "sgst": "sgst", "igst": "igst", "utgst": "sgst", "tngst": "sgst", "cess": "cess"}
DEMAND_TOTALS = ["total tax due", "total tax payable", "total tax liability", "net tax payable", "total amount payable", "total demand"]
LEAST_OPERATIVE, ANNEXURE_SHARE = 500, 0.3
ROW_CHARS, LABEL_CHARS, LABEL_KEPT = 140, 160, 120
#: White space.
SPACES = " \t\n\x0b\f\r"
LEAST_ROW, LEAST_LUMP, DRIFT, DRIFT_SHARE = 10, 100, 2, 0.005

#: A catalogue of limb types: (name, patterns of the type), in the order in which they are tried.
Catalogue = list[tuple[str, list[str]]]
LIMB = "struct<index:int,heading:string,body:string>"
FIGURE = f"struct<heads:map<string,{MONEY}>,total:{MONEY},basis:string,label:string>"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


@functools.cache
def _compiled(p: str) -> re.Pattern:
    return pattern(p)


def _group(m: re.Match | None, n: int) -> str | None:
    return (m[n] or None) if m else None


_summary = pattern(SUMMARY.removeprefix("(?i)").lower())
#: What must be in a text for an annexure to begin, how its line begins or what it says, and whether at a line's start only.
_annexures = [("discrepanc", pattern(r"for\s+the\s+above\s+discrepanc\w+\s*,?\s*kindly\s+substantiate|in\s+case\s+of\s+accepted\s+discrepancy").search), ("officer", Lines(r"\s*proper\s+officer\s*$").first), ("gstin", Lines(r"\s*gstin\s*:\s*\w{15}\s+name\s*:").first)]


def _region(text: str) -> str:
    low = small(text)
    start = math.ceil(len(text) * ANNEXURE_SHARE)
    rest = low[start:]
    cuts = [start + m.start() for word, find in _annexures if word in rest and (m := find(rest))]
    if (m := _summary.search(low)) and m.start() >= LEAST_OPERATIVE:
        cuts.append(m.start())
    return text[: min(cuts)] if cuts else text


#: The text up to its demand summary (if 500 characters come before) or its first annexure in the later 70 %, whichever comes first.
operative_region = reading("string", each(lambda t: None if t is None else _region(t)), pa.string())

Limb = tuple[int | None, str | None, str]
_marker, _bullet, _numbered = pattern(MARKER), Lines(BULLET), Lines(NUMBERED)
_defect, _at_marker, _at_bullet, _at_number = Lines(r"\s*[•\-*]?\s*Defect\s*[-–—]?\s*\d{1,2}", re.I), Lines(r"(?=[^\S\n]*[•\-*]?[^\S\n]*Defect\s*[-–—]?\s*\d{1,2})", re.I), Lines(r"(?=[^\S\n]*[•‣▪]\s*.{3,90}?\s*:\s*$)"), Lines(r"(?=[^\S\n]*\d{1,2}\s*[.)]\s+\S.{5,118}$)")


def _folded(text: str, split_at: Lines, head: Callable[[str], tuple[int | None, str | None]], accept: Callable[..., bool]) -> tuple[str, list[Limb]]:
    """(pre, limbs): text cut at every line that split_at finds. A part opens a limb if accept(its index, its heading, the limb before) holds, else it's more of that limb, or of pre."""
    cuts = [a for a, _ in split_at.spans(text) if a]
    pre, limbs = "", []
    for part in (text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])):
        index, heading = head(part)
        last = limbs[-1] if limbs else None
        if accept(index, heading, last):
            limbs.append((index, heading, part))
        elif last is None:
            pre += part
        else:
            limbs[-1] = (*last[:2], last[2] + part)
    return pre, limbs


def _marked(part: str) -> tuple[int | None, str | None]:
    """A numbered marker's head: named by the first bullet heading below it, else by the rest of its line."""
    m = _marker.match(part)
    if not m:
        return None, None
    return int(m[1]), _group(_bullet.first(part), 1) or m[2].strip(" ") or f"Defect {int(m[1])}"


def _by_catalogue(text: str, catalogue: Catalogue) -> tuple[str, list[Limb]]:
    """(pre, limbs) by the first match of each entry's patterns that overlaps no earlier entry's."""
    taken = []
    for name, patterns in catalogue:
        spans = (m.span() for p in patterns if (m := _compiled(p).search(text)))
        free = next(((a, b) for a, b in spans if not any(a < d and c < b for c, d, _ in taken)), None)
        taken += [(*free, name)] if free else []
    taken.sort()
    stops = [*(a for a, _, _ in taken[1:]), len(text)]
    return text[: taken[0][0]] if taken else "", [(None, name, text[a:stop]) for (a, _, name), stop in zip(taken, stops)]


def _limbs(text: str, catalogue: Catalogue | None = None) -> tuple[str, list[Limb]]:
    """limbs_of() of one text."""
    t = _region(text)
    head = lambda m, index, heading: (int(m[index]) if index and m else None, said.strip(" ") if (said := _group(m, heading)) is not None else None)
    named = (lambda h: any(_compiled(p).search(h) for _, patterns in catalogue for p in patterns)) if catalogue else lambda h: True
    if "defect" in small(t) and _defect.first(t):
        pre, limbs = _folded(t, _at_marker, _marked, lambda i, h, last: i is not None)
    elif any(b in t for b in "•‣▪") and _bullet.first(t):
        pre, limbs = _folded(t, _at_bullet, lambda part: head(_bullet.first(part), None, 1), lambda i, h, last: h is not None)
    else:
        counts = lambda i, h, last: h is not None and not h.endswith(".") and named(h) and (last is None or i > last[0])
        pre, limbs = _folded(t, _at_number, lambda part: head(_numbered.first(part), 1, 2), counts)
        if not limbs:
            pre, limbs = _by_catalogue(t, catalogue or [])
    return pre.strip(SPACES), [(n + 1 if i is None else i, h, body.strip(SPACES)) for n, (i, h, body) in enumerate(limbs)]


def limbs_of(text: Column, catalogue: Catalogue | None = None) -> Column:
    """struct(pre, limbs array<struct(index, heading, body)>) of a notice: pre is what stands before the first limb.

    The strongest kind of heading there is decides alone: "Defect - N", then bullets that end in a colon, then numbered lines, then the catalogue's
    first matches. A numbered line counts if it doesn't end in a full stop, its number exceeds the last kept one and, with a catalogue, a pattern
    of it is in the line. An index that isn't printed is the limb's place.
    """
    read = each(lambda t: None if t is None else _limbs(t, catalogue))
    limb = partial(structs, kinds={"index": pa.int32(), "heading": pa.string(), "body": pa.string()})
    return reading(f"struct<pre:string,limbs:array<{LIMB}>>", read, partial(structs, kinds={"pre": pa.string(), "limbs": partial(lists, of=limb)}))(text)


def _ruler() -> str:
    """A line of consecutive whole numbers from 1 or 2, at least three of them."""
    gap, rest = r"[ \t|]+", ""
    for n in range(30, 3, -1):
        rest = rf"(?:{gap}0?{n}{rest})?"
    return rf"[ \t|]*(?:0?1{gap})?0?2{gap}0?3{rest}[ \t|]*$"


RULER = _ruler()
_rulers, _number, _pairs, _levied, _lumps = Lines(RULER), pattern(NUMBER), pattern(PAIR), pattern(EACH), Lines(LUMP_LINE, re.I)
_heads, _spaces, _before_label, _letters = pattern(r"(sgst|cgst|igst|cess)(?<!(?u:\w){5})\b"), pattern(r"\s+"), pattern(r"^[\d\s|]+"), pattern("[^a-z]")
_operative, _demand = pattern("|".join(OPERATIVE)), pattern(rf"(?s)(?:{'|'.join(DEMAND_TOTALS)})\D*$")


def _order(text: str) -> list[str]:
    low = small(text)
    said = list(dict.fromkeys(_heads.findall(low))) if all(h in low for h in HEAD_ORDER) else []
    return said if len(said) == 4 else HEAD_ORDER


#: The four heads in the order in which the text first names them; the usual order unless it names all.
head_order = reading("array<string>", each(lambda t: HEAD_ORDER if t is None else _order(t)), partial(lists, of=pa.string()))

Row = tuple[str, list[int], int]
NO_MONEY = -(1 << 90)


def _rows(text: str) -> list[Row]:
    """head_rows() of one text, in whole paise: label, figures and total."""
    for a, b in reversed(_rulers.spans(text)):
        text = f"{text[:a]} {text[b:]}"
    said = list(_number.finditer(text))
    if len(said) < 5:
        return []
    # what is no money fits nowhere
    c, out, free = [NO_MONEY if (x := paise(m[0])) is None else x for m in said], [], 0
    for k, total in enumerate(c[4:]):
        if k >= free and total >= LEAST_ROW * 100 and (off := abs(c[k] + c[k + 1] + c[k + 2] + c[k + 3] - total)) <= DRIFT * 100 and off * round(1 / DRIFT_SHARE) <= total:
            at = said[k].start()
            if said[k + 4].end() - at <= ROW_CHARS:
                label = _before_label.sub("", _spaces.sub(" ", text[max(at - LABEL_CHARS, 0) : at]).strip(" "))[-LABEL_KEPT:].strip(" ")
                out.append((label, c[k : k + 4], total))
                free = k + 5
    return out


def _money(rows: list[Row]) -> pa.Array:
    return structs(rows, {"label": pa.string(), "figures": partial(lists, of=rupees), "total": rupees})


#: array<struct(label, figures, total)>: every run of five figures within 140 characters of which four sum up to the fifth, from 10 on, within 2 and 0.5 %.
#: Rulers are blanked before. A figure is of one row only. The label is what stands in the 160 characters before.
head_rows = reading(f"array<struct<label:string,figures:array<{MONEY}>,total:{MONEY}>>", each(lambda t: None if t is None else _rows(t)), partial(lists, of=_money))

Figure = tuple[dict[str, int], int, str, str | None]


def _operative_row(text: str, order: list[str]) -> Figure | None:
    """The last row with an operative label, else the row of largest total."""
    rows = _rows(text)
    if not rows:
        return None
    labelled = [r for r in rows if _operative.search(r[0].lower())]
    label, figures, total = labelled[-1] if labelled else max(rows, key=lambda r: r[2])
    return {h: x for h, x in zip(order, figures) if x}, total, "labelled" if labelled else "largest", label


def _pair(text: str) -> Figure | None:
    """Two equal figures at the end of a line (zeros may follow): SGST and CGST."""
    for said, rest in _pairs.findall(text):
        if (x := paise(said)) and not any(paise(n) for n in _number.findall(rest)):
            return {"sgst": x, "cgst": x}, 2 * x, "paired", None
    return None


def _each(text: str) -> Figure | None:
    """One figure levied under each of two heads."""
    m = _levied.search(text) if "each" in small(text) else None
    if m and (x := paise(m[1])):
        one, two = (HEAD_WORDS.get(_letters.sub("", g.lower())) for g in (m[2], m[3]))
        if one and two and one != two:
            return {one: x, two: x}, 2 * x, "each_head", None
    return None


def _lump(text: str) -> Figure | None:
    """The largest figure of 100 or more in the last line that has one and a word for a difference; of no head."""
    low = small(text)
    if not any(w in low for w in ("difference", "excess", "short", "total")):
        return None
    last = None
    for a, b in _lumps.spans(text):
        last = max((x for n in _number.findall(text[a:b]) if (x := paise(n)) is not None and x >= LEAST_LUMP * 100), default=last)
    return None if last is None else ({"unallocated": last}, last, "unallocated", None)


def _figure(body: str | None, pre: str | None, order: list[str]) -> Figure | None:
    """figure_of() of one limb."""
    for t in (body, pre):
        if t is not None and (found := _operative_row(t, order) or _pair(t) or _each(t) or _lump(t)):
            return found
    return None


def _decimals(heads: list[dict[str, int] | None]) -> pa.Array:
    return pa.array([None if h is None else [(k, Decimal(x).scaleb(-2)) for k, x in h.items()] for h in heads], pa.map_(pa.string(), CENTS))


#: struct(heads, total, basis, label) of a limb's body, what stands before the first limb, and the order of heads: the first of the four readings that the body, else
#: what stands before, allows; null if none does.
figure_of = reading(FIGURE, each(_figure), partial(structs, kinds={"heads": _decimals, "total": rupees, "basis": pa.string(), "label": pa.string()}))


def _printed(text: str) -> int | None:
    return next((total for label, _, total in reversed(_rows(text)) if _demand.search(label.lower())), None)


#: The total of the last row of figures whose label ends in a phrase for the whole demand, without digits after it; null if there is none.
printed_total = reading(MONEY, each(lambda t: None if t is None else _printed(t)), rupees)


def sums(text: str, catalogue: Catalogue | None = None) -> tuple[int, int | None, int, int | None]:
    """Of a tidied notice: its limbs, the sum of those that were read, how many weren't, and the printed total. One that just repeats a limb is no total."""
    pre, limbs = _limbs(text, catalogue)
    order = _order(text)
    totals = [f and f[1] for f in (_figure(body, None if i else pre, order) for i, (_, _, body) in enumerate(limbs))]
    known, printed = [x for x in totals if x is not None], _printed(text)
    echo = printed is not None and any(abs(x - printed) <= 200 for x in known)
    return len(limbs), sum(known) if known else None, len(totals) - len(known), None if echo else printed
