"""Mixing to target weights against a plain version, and on odd rows."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from taxloom.llm import mixing
from taxloom.llm.mixing import mix

SCHEMA = "doc_id long, text string, source string, key string, size long"


def plain(rows, weights=(5, 2, 1), budget=1.0, most=3):
    """{(doc_id, text): (size, source_size, target, taken)} by sorting every source's documents."""
    size = {(d, t): len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, _ in rows}
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    own = {s: [(d, t) for d, t, x in rows if x == s] for s in names}
    total = {s: sum(size[k] for k in own[s]) for s in names}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = {}, budget * sum(total.values()), list(names)
    while True:
        share = sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * left >= most * total[s] * share]
        if not full:
            break
        for s in full:
            target[s] = most * total[s]
        open_ = [s for s in open_ if s not in full]
        left = budget * sum(total.values()) - sum(target.values())
    target |= {s: weight[s] * left / sum(weight[x] for x in open_) for s in open_}
    out = {}
    for s in names:
        times = min(most, int(target[s] // total[s])) if total[s] else 0
        rest, at = target[s] - times * total[s], 0
        by = {}
        for d, t in own[s]:
            by.setdefault(hashlib.md5(f"{'' if d is None else d}:{t or ''}".encode()).hexdigest()[:15], []).append((d, t))
        for _, same in sorted(by.items()):
            n = sum(size[k] for k in same)
            more = times < most and n > 0 and 2 * at + n <= 2 * rest
            at += n
            for k in same:
                out[k] = (size[k], total[s], target[s], size[k] * (times + more))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*x, "x", 1) for x in rows], SCHEMA)


@pytest.mark.parametrize("seed", range(3))
def test_mix_against_plain_version(spark, seed):
    r = random.Random(seed)
    names = ["a", "b", "", "Z", "é", "🙂", "￿", None][: r.randint(3, 8)]
    rows = [(i, " \t".join(["w"] * int(r.paretovariate(0.9)))[:4000], r.choice(names + names[:1] * 5)) for i in range(300)] + [(900, None, "a"), (901, "", "none but blanks"), (902, " \n", "none but blanks"), (None, "x y", "a"), (3, "again", "b")]
    want = plain(rows)
    got = mix(frame(spark, rows).repartition(4)).collect()
    assert len(got) == len(rows)
    by_doc = {}
    for d, t, _ in rows:
        by_doc.setdefault(d, []).append(want[d, t])
    mine = {}
    for x in got:
        mine.setdefault(x.doc_id, []).append((x["size"], x.source_size, x.target, x.taken))
        assert 0 <= x.taken <= 3 * x["size"]
    assert {k: sorted(v) for k, v in mine.items()} == {k: sorted(v) for k, v in by_doc.items()}
    for s in names:
        of = [x for x in got if x.source == s]
        assert abs(sum(x.taken for x in of) - of[0].target) <= max(x["size"] for x in of) / 2


def test_budgets_nest(spark):
    r = random.Random(8)
    df = frame(spark, [(i, "w " * r.randint(1, 60), r.choice("abc")) for i in range(200)])
    before = dict.fromkeys(range(200), 0)
    for budget in (0.0, 0.2, 0.5, 1.0, 9.0):
        now = {x.doc_id: x.taken for x in mix(df, budget=budget).collect()}
        assert all(now[k] >= before[k] for k in now)
        before = now
    assert before == {x.doc_id: 3 * x["size"] for x in mix(df).collect()}


def test_repeated_rows_rise_together_and_runs_agree(spark):
    rows = [(1, "a b c", "s")] * 5 + [(2, "d", "s"), (3, "e f", "t")]
    got = [sorted(tuple(x) for x in mix(frame(spark, rows).repartition(n)).collect()) for n in (1, 3)]
    assert got[0] == got[1] and len({x[-1] for x in got[0] if x[0] == 1}) == 1


def test_empty_and_blank_tables(spark):
    df = frame(spark, [(1, None, None), (2, "", "a")])
    assert mix(df.limit(0)).count() == 0
    assert sorted((x.doc_id, x["size"], x.target, x.taken) for x in mix(df).collect()) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_no_python_and_many_sources(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 7 + 1).cast("int")).alias("text"), (F.col("id") % 1500).cast("string").alias("source"))
    out = mix(df)
    assert "Python" not in out._jdf.queryExecution().toString()
    sizes = {x.source: x for x in out.select("source", "source_size", "target").distinct().collect()}
    assert len(sizes) == 1500 and abs(sum(x.target for x in sizes.values()) - out.agg(F.sum("size")).first()[0]) < 1e-6
    ranks = {x.key: x["rank"] for x in mixing._ranked(df.select(mixing.source_key(F.col("source")).alias("key"), F.lit(1).alias("source_size")).distinct()).collect()}
    assert ranks == {k: i for i, k in enumerate(sorted(ranks))}
