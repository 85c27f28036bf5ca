"""Failed-attempt lockout by key, as a stream and as its batch twin."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import batched, pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FAILURES, LOCK_S = 5, 900
#: Neighbours that a level joins.
FAN = 32
OUT = "key string, seen long, failures int, locked_until double, outcome string"


def fold(state: tuple[int, float], attempts: Iterable[tuple[float, bool]]) -> tuple[tuple[int, float], list[tuple]]:
    """Attempts (time, success) in order on (failures, locked until): refused while locked and not counted; a lock that's over, or a success, clears."""
    failures, until = state
    out = []
    for at, success in attempts:
        if until and at < until:
            out.append((failures, until, "refused"))
            continue
        if until:
            failures, until = 0, 0.0
        if success:
            failures, outcome = 0, "success"
        else:
            failures, outcome = failures + 1, "failed"
            if failures >= FAILURES:
                until, outcome = at + LOCK_S, "locked"
        out.append((failures, until, outcome))
    return (failures, until), out


@dataclass
class Stretch:
    """What a stretch of a key's attempts does to any state that comes to it.

    starts: for 0 to 4 failures, then for each time in upto: a lock that ends after the time before and not after
    this one. ends: for each start (failures, locked until, refused, locks) at the stretch's end. A lock that ends
    after last is passed on, and all n attempts are refused.
    """

    n: int
    first: float
    last: float
    upto: np.ndarray
    ends: list[tuple[int, float, int, int]]

    def after(self, failures: int, until: float, refused: int = 0, locks: int = 0) -> tuple[int, float, int, int]:
        """The end of a state that comes to the stretch, counts added."""
        if until > self.last:
            return failures, until, refused + self.n, locks
        at = FAILURES + int(np.searchsorted(self.upto, until)) if until else failures
        end = self.ends[at]
        return end[0], end[1], refused + end[2], locks + end[3]


def stretch_of(at: np.ndarray, success: np.ndarray) -> Stretch:
    """The stretch of attempts in order. From an attempt that meets no lock, the next lock and the first attempt after it are found by search, and ends are remembered by attempt."""
    n = len(at)
    good = np.append(np.flatnonzero(success), n)
    known: dict[int, tuple[int, float, int, int]] = {}

    def end_of(i: int, failures: int) -> tuple[int, float, int, int]:
        way = []
        while True:
            if not failures and i in known:
                end = known[i]
                break
            s = int(good[np.searchsorted(good, i)])
            if s - i + failures >= FAILURES:
                lock = i + FAILURES - failures - 1
                until = float(at[lock]) + LOCK_S
                back = max(int(np.searchsorted(at, until)), lock + 1)
                way.append((i if not failures else -1, back - lock - 1, 1))
                if back == n:
                    end = (FAILURES, until, 0, 0)
                    break
                i, failures = back, 0
            elif s < n:
                way.append((i if not failures else -1, 0, 0))
                i, failures = s + 1, 0
                if i == n:
                    end = (0, 0.0, 0, 0)
                    break
            else:
                end = (failures + n - i, 0.0, 0, 0)
                break
        for j, refused, locks in reversed(way):
            end = (end[0], end[1], end[2] + refused, end[3] + locks)
            if j >= 0:
                known[j] = end
        return end

    near = np.append(True, at[1:] != at[:-1]) & (np.append(-np.inf, at[:-1]) < at[0] + LOCK_S)
    places = np.flatnonzero(near)
    ends = [end_of(0, f) for f in range(FAILURES)]
    for i in places:
        end = end_of(int(i), 0)
        ends.append((end[0], end[1], end[2] + int(i), end[3]))
    return Stretch(n, float(at[0]), float(at[-1]), at[places], ends)


def joined(parts: list[Stretch]) -> Stretch:
    """Stretches in order as one. A lock ends within LOCK_S of the first attempt, so only parts that begin by then are met by its end."""
    run = lambda state, more: reduce(lambda s, p: p.after(*s), more, state)
    ends = [run(e, parts[1:]) for e in parts[0].ends[:FAILURES]]
    upto, passed, last = [], 0, -np.inf
    for i, p in enumerate(parts):
        if last >= parts[0].first + LOCK_S:
            break
        met = np.append(last, p.upto[:-1]) < parts[0].first + LOCK_S
        upto.append(p.upto[met])
        ends += [run((f, u, r + passed, k), parts[i + 1 :]) for (f, u, r, k), m in zip(p.ends[FAILURES:], met, strict=True) if m]
        passed, last = passed + p.n, p.last
    return Stretch(sum(p.n for p in parts), parts[0].first, parts[-1].last, np.concatenate(upto), ends)


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str | None, int, pd.DataFrame]]:
    """(key, part, rows) of batches sorted by both, a group whole however many batches it spans."""
    held, head = [], None
    for batch in batches:
        key, part = batch["key"].to_numpy(object), batch["part"].to_numpy()
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1), len(batch)] if len(batch) else [0]
        for low, high in pairwise(cuts):
            if held and (key[low], part[low]) != head:
                yield *head, held[0] if len(held) == 1 else pd.concat(held)
                held = []
            head = (key[low], part[low])
            held.append(batch.iloc[low:high])
    if held:
        yield *head, pd.concat(held)


def _rows(stretches: Iterator[tuple[str | None, int, Stretch]]) -> Iterator[pd.DataFrame]:
    names = ["key", "part", "n", "first", "last", "upto", "failures", "until", "refused", "locks"]
    for some in batched(stretches, 1000):
        yield pd.DataFrame([(k, part, s.n, s.first, s.last, s.upto, *(list(c) for c in zip(*s.ends, strict=True))) for k, part, s in some], columns=names)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    yield from _rows((k, int(part), stretch_of(g["at"].to_numpy(float), g["success"].to_numpy(bool))) for k, part, g in _groups(batches))


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def each() -> Iterator[tuple[str | None, int, Stretch]]:
        for k, part, g in _groups(batches):
            parts = [Stretch(int(n), first, last, np.asarray(upto, float), list(zip(*ends, strict=True))) for n, first, last, upto, *ends in g[["n", "first", "last", "upto", "failures", "until", "refused", "locks"]].itertuples(index=False)]
            yield k, int(part), joined(parts)

    yield from _rows(each())


def lockouts_batch(attempts: DataFrame, span: float = 3600.0, light: int = 100_000) -> DataFrame:
    """attempts (key, at double, success): the last state of each key and its attempts by outcome. Rows without a time or an outcome take no part; a null key is a key.

    A key of at most `light` attempts is one stretch. The history of any other is cut into spans of seconds, each on
    a task of its own that finds what the span does to any state. FAN neighbours are then joined into one, level by
    level, until a key is one stretch: a task holds a light key, a span, or what FAN stretches tell of a lock's
    length from their beginning, never a long history.
    """
    known = attempts.select("key", F.col("at").cast("double").alias("at"), "success").where("at is not null and success is not null and not isnan(at)")
    kind = "key string, part long, n long, first double, last double, upto array<double>, failures array<int>, until array<double>, refused array<long>, locks array<long>"
    read = lambda rows: rows.repartition("key", "part").sortWithinPartitions("key", "part", "at", "success").mapInPandas(_read, kind)
    heavy = known.groupBy("key").agg(F.count("*").alias("_n"), F.min("at").alias("low"), F.max("at").alias("high")).where(F.col("_n") > light)
    ends = heavy.agg(F.floor(F.min("low") / span).cast("long").alias("low"), F.floor(F.max("high") / span).cast("long").alias("high")).first()
    if ends.low is None:
        return _ends(read(known.withColumn("part", F.lit(0).cast("long"))))
    told = known.join(heavy.select(F.col("key").alias("_key"), F.lit(True).alias("_heavy")), F.col("key").eqNullSafe(F.col("_key")), "left")
    whole = read(told.where("_heavy is null").select("key", "at", "success", F.lit(0).cast("long").alias("part")))
    parts = read(told.where("_heavy").select("key", "at", "success", (F.floor(F.col("at") / span) - ends.low).cast("long").alias("part")))
    width = ends.high - ends.low
    while width:
        width //= FAN
        nested = parts.withColumn("child", F.col("part")).withColumn("part", F.floor(F.col("part") / FAN).cast("long"))
        parts = nested.repartition("key", "part").sortWithinPartitions("key", "part", "child").drop("child").mapInPandas(_joined, kind)
    return _ends(whole.unionByName(parts))


def _ends(stretches: DataFrame) -> DataFrame:
    """What each stretch does to a key that was never seen."""
    fresh = lambda c: F.col(c)[0]
    return stretches.select("key", F.col("n").alias("attempts"), fresh("refused").alias("refused"), fresh("locks").alias("locks"), fresh("failures").alias("failures"), fresh("until").alias("locked_until"))


def lockouts(attempts: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """A stream of attempts (key, ts, success) as a stream of states; a key idle for the watermark beyond its lock is forgotten."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.get if state.exists else (0, 0.0, 0)
        rows = pd.concat(list(batches)).sort_values(["at", "success"])
        (failures, until), out = fold(now[:2], zip(rows["at"], rows["success"], strict=True))
        seen = now[2] + len(rows)
        state.update((failures, until, seen))
        state.setTimeoutTimestamp(max(int(max(rows["at"].max(), until) * 1000), state.getCurrentWatermarkMs() + 1) + LOCK_S * 1000)
        yield pd.DataFrame([{"key": key[0], "seen": seen, "failures": failures, "locked_until": until, "outcome": out[-1][2]}])

    rows = attempts.withWatermark("ts", watermark).withColumn("at", F.col("ts").cast("timestamp").cast("double"))
    return rows.groupBy("key").applyInPandasWithState(run, OUT, "failures int, locked_until double, seen long", "update", GroupStateTimeout.EventTimeTimeout)
