"""Runs of repeated words: every maximal stretch of words that repeats a period four times or more.

String synchronising sets, at scales of 4, 8, 16, ... words: a position belongs to the set of a scale t if, of the windows of t
words that start at it or up to t places on, the first or the last has the least hash. So it hangs on the 2t words from it alone, and
positions with equal contexts (these words) are both in the set or both out of it. Windows with a period of t / 4 or less
are highly periodic and stay out, else their regions would fill the set.

Why none is missed: let a run have a period q with t <= q < 2t and at least 4q words. Some window of its first q isn't highly
periodic, else the run had a smaller period. Let j, at t to t + q - 1 from its start, start a window of least hash among the run's; then j - t is
in the set. So is the place q on; both contexts lie within the run and are equal, and no equal context stands
between them (it would give a smaller period). So neighbours with equal contexts, t to 2t - 1 apart, propose all periods of
that size; each proposal is extended word by word. Highly periodic regions are found apart: periods 1 to 3 by comparing words at these
distances, larger ones as runs of smaller scales.

Windows get exact names, not hashes: a window of 2t words is named by the names of its halves, and only if both are
repeated; a text whose windows are all different at some scale is done there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are worked on at once (a longer text is, whole).
PIECE = 4 << 20
NEVER = np.uint64(2**64 - 1)
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _named(keys: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    """Names of n windows, and how many names are shared: windows at `at` with equal keys share one below that number, all others have their own."""
    _, key, count = np.unique(keys, return_inverse=True, return_counts=True)
    again = count > 1
    shared, rank, names = int(again.sum()), np.cumsum(again) - 1, np.arange(n)
    names += shared
    repeated = again[key]
    names[at[repeated]] = rank[key[repeated]]
    return names, shared


def _doubled(names: np.ndarray, shared: int, t: int) -> tuple[np.ndarray, int]:
    """Names of the windows of 2t words by those of t words."""
    n = max(0, len(names) - t)
    at = np.flatnonzero((names[:n] < shared) & (names[t : t + n] < shared))
    return _named(names[at] * shared + names[at + t], at, n)


def _hashes(names: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers, so that different names differ."""
    x = names.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def synchronising_set(windows: np.ndarray, t: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each position whose 2t words fit is in the set of scale t. windows: names of the windows of t words; runs: (start, end, period) found so far."""
    n = len(windows) - t
    edges = np.zeros(len(windows) + 1, np.int64)
    for start, end, period in runs:
        if 4 * period <= t <= end - start:
            edges[start] += 1
            edges[end - t + 1] -= 1
    hashes = _hashes(windows)
    hashes[np.cumsum(edges[:-1]) > 0] = NEVER
    least, width = hashes, 1
    while width < t:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:n], hashes[t:])
    return (least < NEVER) & ((hashes[:n] == least) | (hashes[t:] == least))


def _reach(words: np.ndarray, a: int, b: int) -> int:
    """How many words from b on equal those from a on, for a < b."""
    n, size = 0, 64
    while True:
        late = words[b + n : b + n + size]
        differ = np.flatnonzero(words[a + n : a + n + len(late)] != late)
        if differ.size:
            return n + int(differ[0])
        n += len(late)
        if len(late) < size:
            return n
        size *= 2


def find_runs(words: np.ndarray, times: int = 4, least: int = 6) -> np.ndarray:
    """Rows (start, length, period) by start, then period: each stretch with smallest period q and max(least, times * q) words or more that no neighbour extends.

    words: whole numbers; texts in one array share none. times: 4 or more. No words give no rows.
    """
    if times < 4:
        raise ValueError("proposals are complete from four periods on")
    found: list[tuple[int, int, int]] = []
    for p in (1, 2, 3):  # highly periodic regions of the smallest periods
        edge = np.flatnonzero(np.diff(np.concatenate(([False], words[p:] == words[:-p], [False]))))
        start, end = edge[::2], edge[1::2] + p
        long = end - start >= 4 * p
        found += zip(start[long].tolist(), end[long].tolist(), [p] * int(long.sum()), strict=True)
    names, shared = _named(words, np.arange(len(words)), len(words))
    back = words[::-1]
    t = 1
    while shared:
        contexts, repeated = _doubled(names, shared, t)
        if t >= 4 and repeated:
            at = np.flatnonzero(synchronising_set(names, t, found) & (contexts < repeated))
            at = at[np.argsort(contexts[at], kind="stable")]
            gap = np.diff(at)
            near = np.flatnonzero((np.diff(contexts[at]) == 0) & (gap >= t) & (gap < 2 * t))
            done: dict[int, int] = {}
            for s, q in sorted(zip(at[near].tolist(), gap[near].tolist(), strict=True)):
                if s + q >= done.get(q, 0):  # else it's of a stretch that is extended already
                    start, end = s - _reach(back, len(words) - s - q, len(words) - s), s + q + _reach(words, s, s + q)
                    done[q] = end
                    if end - start >= 4 * q:
                        found.append((start, end, q))
        names, shared, t = contexts, repeated, 2 * t
    smallest: dict[tuple[int, int], int] = {}
    for start, end, q in found:  # a stretch that has a multiple of its period, too, has both within the same bounds
        smallest[start, end] = min(q, smallest.get((start, end), q))
    rows = [(start, end - start, q) for (start, end), q in smallest.items() if end - start >= max(least, times * q)]
    return np.array(sorted(rows, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)


def _worker(times: int, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def piece(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words = lists.flatten()
        real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
        of = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())[real]
        words = words.filter(pa.array(real))
        coded = words.dictionary_encode()
        runs = find_runs(of * max(1, len(coded.dictionary)) + coded.indices.to_numpy(), times, least)
        begins = np.searchsorted(of, np.arange(len(texts) + 1))
        text = of[runs[:, 0]]
        dropped = np.zeros(len(of) + 1, np.int64)
        np.add.at(dropped, runs[:, 0] + runs[:, 2], 1)
        np.add.at(dropped, runs[:, 0] + runs[:, 1], -1)
        stays = np.cumsum(dropped[:-1]) == 0
        bounds = np.concatenate(([0], np.cumsum(stays)))[begins]
        kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), words.filter(pa.array(stays))), " ")
        structs = pa.StructArray.from_arrays([pa.array(runs[:, 0] - begins[text]), pa.array(runs[:, 1]), pa.array(runs[:, 2])], ["start", "length", "period"])
        spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(texts) + 1)), pa.int32()), structs)
        return pa.RecordBatch.from_arrays([ids, pa.array(np.diff(begins)), spans.cast(kind), kept], ["doc_id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(size, PIECE + (size[at - 1] if at else 0), "right")))
                part = batch.slice(at, to - at)
                yield piece(part.column(0), part.column(1))
                at = to

    return run


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", times: int = 4, least: int = 6) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): each whole text's runs, and its words less those that any run holds after its first period.

    Words are `[^\\x20\\x09-\\x0D]+`, numbered from 0; collapsed joins those kept by one space. A run (start, length, period) has the
    smallest period q, at least max(least, times * q) words, and no neighbouring word that carries it on; runs come by start, then period.
    A null or empty text has no words, no runs and an empty collapsed. Repeated rows get a row each; a null doc_id stays
    null; other columns are ignored; an empty table gives no rows. A text is worked on whole, in time of about n log n for n
    words; nothing is shuffled.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_worker(times, least), f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def plant_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text), where in about a tenth of the documents, chosen by crc32(doc_id), the words from a place on repeat; a null doc_id chooses none."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(w):
        n = F.size(w)
        a = (g % n).cast("int")
        p = F.lit(1) + F.floor((n - a) / (3 + g % 8)).cast("int")
        return F.array_join(F.transform(w, lambda x, i: F.when(i >= a, F.get(w, a + (i - a) % p)).otherwise(x)), " ")

    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    # the array around the words gives them a name, so that they are split once and not for each word
    planted = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise("")), 0)
    return docs.select("doc_id", F.when(F.col("text").isNotNull() & (h % 10 == 0), planted).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """What periodic_runs() gives, by the run of greatest exponent (ties: smallest start, then period) and digests."""
    ahead = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    best = F.aggregate("runs", F.get("runs", 0), lambda b, r: F.when(ahead(r, b), r).otherwise(b))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), digest(lines).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"))
    length, period = F.col("best.length"), F.col("best.period")
    return rows.select("doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"), period.alias("period"), F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
