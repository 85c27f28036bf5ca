"""Regularised quadratic discriminant analysis of document statistics: a quality classifier."""

from __future__ import annotations

import functools
import operator
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import BATCHES, lean, settings, settle
from .shingles import pieces

#: What is measured of a text; see statistics() for each.
FEATURES = ("log_words", "log_word_length", "variety", "upper_share", "symbol_share", "mark_share", "digit_share", "space_share", "shouted_share", "repeat_share", "top_word_share", "marked_word_share", "repeated_line_share")


@functools.cache
def _kinds() -> np.ndarray:
    """Kind of each character of the basic plane: 1 capital, 2 other letter, 3 digit, 4 space, 5 sentence mark, 6 the rest."""
    kinds = np.full(1 << 16, 6, np.uint8)
    for code in range(1 << 16):
        group = unicodedata.category(chr(code))
        kinds[code] = 1 if group in ("Lu", "Lt") else 2 if group[0] in "LM" else 3 if group[0] == "N" else 4 if group[0] == "Z" or chr(code).isspace() else 6
    kinds[[ord(c) for c in ".,;:?'\"()-"]] = 5
    return kinds


def statistics(texts: list[str | None]) -> np.ndarray:
    """A row of FEATURES for each whole text.

    Counts are taken as logarithms and shares as square roots, which evens their spread. Shares are
    smoothed with some pseudo-counts of plain prose, so that a few characters don't condemn a short text.
    """
    codes = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _kinds()[np.minimum(codes, 0xFFFF)]
    lengths = np.array([len(t or "") for t in texts], np.int64)
    ends = np.cumsum(lengths)
    count = {k: (lambda c: c[ends] - c[ends - lengths])(np.concatenate([[0], np.cumsum(kinds == k)])) for k in range(1, 7)}
    own = np.zeros((len(texts), 9))
    for i, text in enumerate(texts):
        words = (text or "").split()
        if words:
            seen, lines = Counter(words), [x for x in text.split("\n") if x]
            own[i] = len(words), sum(map(len, words)), sum(map(str.isupper, words)), sum(map(operator.eq, words, words[1:])), len(seen), max(seen.values()), sum(map(str.isalpha, words)), len(lines), len(set(lines))
    n, chars, shouted, repeats, distinct, top, bare, lines, kept = own.T
    shares = (
        (count[1] + 2) / (count[1] + count[2] + 80),
        count[6] / (lengths + 50),
        (count[5] + 2) / (lengths + 80),
        count[3] / (lengths + 50),
        (count[4] + 14) / (lengths + 80),
        shouted / (n + 20),
        repeats / (n + 20),
        (top + 1) / (n + 20),
        (n - bare + 3) / (n + 20),
        (lines - kept) / (lines + 8),
    )
    return np.column_stack([np.log1p(n), np.log1p((chars + 100) / (n + 20)), np.log1p(distinct + 20) / np.log1p(n + 20), *map(np.sqrt, shares)])


@dataclass(frozen=True)
class Discriminant:
    """means[k], inverse Cholesky factors roots[k] and constants[k] of class k; empty where a class had no rows."""

    means: np.ndarray
    roots: np.ndarray
    constants: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1: the difference of the two log densities, each a Mahalanobis distance by its Cholesky factor."""
        if not len(self.means):
            return np.full(len(x), 0.5)
        log = [c - 0.5 * (((x - m) @ r.T) ** 2).sum(1) for m, r, c in zip(self.means, self.roots, self.constants, strict=True)]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums of (1, x)(1, x)' by class, a row for each cell of the matrix."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        label = batch.column(0).to_numpy(zero_copy_only=False)
        x = np.column_stack([np.ones(len(label)), np.array(batch.column(1).to_pylist()).reshape(len(label), -1)]) if len(label) else np.zeros((0, 1))
        for k in np.unique(label).tolist():
            total[k] = total.get(k, 0) + x[label == k].T @ x[label == k]
    for k, m in total.items():
        i, j = np.indices(m.shape)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, k), pa.int32()), pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(m.ravel())], ["label", "i", "j", "v"])


def fit(measured: DataFrame, shrink_pooled: float = 0.1, shrink_diagonal: float = 0.05) -> Discriminant:
    """The model of all rows of measured (label int 0 or 1, x array of doubles).

    Each class covariance is shrunk towards the pooled one, then towards its own diagonal, and gets
    a floor on the diagonal, so that it has a Cholesky factor. Only sums, of a fixed size, reach the driver.
    """
    cells = measured.select("label", "x").mapInArrow(lean(_sums), "label int, i int, j int, v double").groupBy("label", "i", "j").agg(F.sum("v").alias("v")).collect()
    d = max((c.i for c in cells), default=0) + 1
    moments = np.zeros((2, d, d))
    for c in cells:
        moments[c.label, c.i, c.j] = c.v
    n = moments[:, 0, 0]
    if n.min() < 2:
        return Discriminant(*[np.zeros(0)] * 3)
    means = moments[:, 0, 1:] / n[:, None]
    scatter = moments[:, 1:, 1:] - n[:, None, None] * means[:, :, None] * means[:, None, :]
    pooled = scatter.sum(0) / n.sum()
    roots, constants = [], []
    for k in (0, 1):
        s = (1 - shrink_pooled) * scatter[k] / n[k] + shrink_pooled * pooled
        s = (1 - shrink_diagonal) * s + shrink_diagonal * np.diag(np.diag(s)) + 1e-4 * np.eye(d - 1)
        factor = np.linalg.cholesky(s)
        roots.append(np.linalg.inv(factor))
        constants.append(np.log(n[k] / n.sum()) - np.log(np.diag(factor)).sum())
    return Discriminant(means, np.array(roots), np.array(constants))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for a, b in pieces(texts):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(list(statistics(texts[a:b])), pa.list_(pa.float64()))], ["doc_id", "x"])


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, x) of every whole text."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(_measure), "doc_id long, x array<double>")


def held_out(doc_id: str = "doc_id"):
    """Whether a document takes no part in learning: crc32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(measured: DataFrame, labels: DataFrame) -> Discriminant:
    """The model of all labelled rows that aren't held out; labels other than 0 and 1 are ignored."""
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    return fit(measured.join(known, "doc_id"))


def quality_scores(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document: score is the probability of label 1, predicted is 1 from least on.

    labels has doc_id and quality (0 or 1); rows whose crc32(doc_id) mod 4 is 2 are never learned from. Only the text
    is an input of a score: neither labels, lang, source nor doc_id is. A null text counts as empty, and empty
    texts get the score of their statistics (all 0). Very long texts are measured whole. Repeated rows get a row each.
    Without two rows of each label every score is 0.5. Other columns are ignored. Empty table: no rows.
    """
    measured = settle(measure(docs))
    model = learn(measured, labels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), dtype=float).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    scored = measured.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def _keeper(model: Discriminant, column: int, least: float) -> Callable:
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(column).to_pylist()
            for a, b in pieces(texts):
                yield batch.slice(a, b - a).filter(pa.array(model.score(statistics(texts[a:b])) >= least))

    return keep


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs, unchanged, whose score by the model of quality_scores is least or more; null, empty and repeated rows as there."""
    with settings(docs.sparkSession, BATCHES):
        model = learn(measure(docs), labels)
    return settle(docs.mapInArrow(lean(_keeper(model, docs.columns.index("text"), least)), docs.schema))
