"""Readings of texts within Arrow batches: what takes many patterns of one text is read by Python's re, since lambdas over arrays are interpreted by Spark one call at a time."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Places of Java's line ends, as ^ and $ of its patterns see them.
BEGIN, END = r"(?:\A|(?<=[\n\r\x85\u2028\u2029]))(?!(?<=\r)\n)", r"(?:(?=[\r\x85\u2028\u2029])|(?<!\r)(?=\n)|\Z)"
ODD_ENDS = re.compile("[\r\x85\u2028\u2029]")
CENTS = pa.decimal128(18, 2)
#: Digits of money's whole part.
WHOLE = 16


def pattern(p: str, flags: int = 0) -> re.Pattern:
    """A pattern as Spark reads it: classes are of ASCII, words' bounds are not."""
    return re.compile(p.replace(r"\b", r"(?u:\b)"), re.ASCII | flags)


#: ASCII's capitals only, so that places stay.
SMALL = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def small(text: str) -> str:
    """In lower case, of the same length."""
    low = text.lower()
    return low if len(low) == len(text) and "\u212a" not in text else text.translate(SMALL)


class Lines:
    """A pattern that is tried where lines begin; its $ and . know every line end that Spark's patterns know. A text that only has \\n is searched behind these, which is faster."""

    def __init__(self, p: str, flags: int = 0):
        full = re.sub(r"(?<!\\)\.(?=[{*])", lambda _: r"[^\n\r\x85\u2028\u2029]", p)
        self.plain, self.full = pattern(rf"\n(?:{p})", flags | re.M), pattern(f"{BEGIN}(?:{re.sub(r'(?<!\\)\$', lambda _: END, full)})", flags)

    def _of(self, text: str) -> tuple[re.Pattern, str, int]:
        odd = "\r" in text or (not text.isascii() and ODD_ENDS.search(text))
        return (self.full, text, 0) if odd else (self.plain, "\n" + text, 1)

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Where matches begin and end, in order; none overlap."""
        p, t, off = self._of(text)
        return [(m.start(), m.end() - off) for m in p.finditer(t) if m.start() < len(text)]

    def first(self, text: str) -> re.Match | None:
        """The first match; its start is a place in the text."""
        p, t, _ = self._of(text)
        m = p.search(t)
        return m if m and m.start() < len(text) else None


#: Figures that were read are kept: so many.
KEPT = 1 << 14


@functools.lru_cache(KEPT)
def paise(said: str) -> int | None:
    """Hundredths of a figure such as 1,00,000.5; null if it isn't one or is too long for money."""
    whole, _, part = said.replace(",", "").partition(".")
    return int(whole) * 100 + int((part + "00")[:2]) if whole and len(whole.lstrip("0")) <= WHOLE else None


def rupees(hundredths: Iterable[int | None]) -> pa.Array:
    """Money of whole hundredths."""
    known = pa.array(hundredths, pa.int64())
    low = np.asarray(known.fill_null(0))
    return pa.Array.from_buffers(CENTS, len(known), [known.buffers()[0], pa.py_buffer(np.stack([low, low >> 63], 1).tobytes())])


def structs(rows: list[tuple | None], kinds: dict[str, pa.DataType | Callable]) -> pa.StructArray:
    """Rows as structs, by columns; a kind is a type, or what makes an array of values. A null row's fields are null."""
    blank = (None,) * len(kinds)
    columns = zip(*[blank if r is None else r for r in rows]) if rows else [[] for _ in kinds]
    arrays = [pa.array(c, k) if isinstance(k, pa.DataType) else k(c) for c, k in zip(columns, kinds.values())]
    return pa.StructArray.from_arrays(arrays, list(kinds), mask=pa.array([r is None for r in rows], pa.bool_()))


def lists(rows: list[list | None], of: pa.DataType | Callable) -> pa.ListArray:
    """Rows as lists of values, which a type or a function makes an array of."""
    flat = [x for r in rows if r for x in r]
    ends = np.concatenate([[0], np.cumsum([len(r) if r else 0 for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, mask=np.array([*[r is None for r in rows], False])), pa.array(flat, of) if isinstance(of, pa.DataType) else of(flat))


def each(read: Callable) -> Callable[..., list]:
    """read(values of a row), for every row of a batch."""
    return lambda *columns: [read(*row) for row in zip(*[c.to_pylist() for c in columns])]


def reading(returns: str, read: Callable[..., list], made: pa.DataType | Callable) -> Callable[..., Column]:
    """A function of columns: what read() makes of a batch of their values, as a column of the type returns; made is the type, or what makes an array of a batch's readings."""

    def batch(*columns: pa.Array) -> pa.Array:
        got = read(*columns)
        return pa.array(got, made) if isinstance(made, pa.DataType) else made(got)

    return lambda *columns: F.arrow_udf(batch, returns)(*columns)
