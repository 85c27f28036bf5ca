"""Runs of repeated words against brute force, and on odd rows."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxloom.llm import queries
from taxloom.llm.periods import _named, find_runs, periodic_runs, plant_repeats, run_digests, synchronising_set

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, times=4, least=6):
    """Every stretch of each distance, extended by single words; a stretch found at a smaller distance stays with that."""
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def random_words(r):
    kind = r.random()
    n = r.randint(0, 200)
    words = [r.randrange(r.choice([1, 2, 3, 9])) for _ in range(n)]
    for _ in range(r.randint(0, 4) if n > 10 else 0):
        p, at = r.randint(1, n // 5), r.randrange(n)
        for i in range(at + p, min(n, at + p * r.randint(3, 8))):
            words[i] = words[i - p]
    if kind < 0.2:  # powers of powers
        inner = [0] * r.randint(1, 9) + [1]
        words = (inner * r.randint(3, 9) + [2]) * r.randint(3, 6)
    return words


def test_find_runs_against_brute_force():
    r, seen = random.Random(4), 0
    for _ in range(1500):
        words = random_words(r)
        want = brute(words)
        seen += len(want)
        assert [tuple(x) for x in find_runs(np.array(words, np.int64)).tolist()] == want
    assert seen > 2000
    with pytest.raises(ValueError, match="four"):
        find_runs(np.zeros(9, np.int64), times=3)


def test_find_runs_large():
    period = np.random.default_rng(1).integers(0, 90_000, 3000)
    assert find_runs(np.tile(period, 40)).tolist() == [[0, 120_000, 3000]]
    a, b = [0], [0, 1]
    while len(b) < 50_000:
        a, b = b, b + a
    assert len(find_runs(np.array(b))) == 0  # no power of four in a Fibonacci word


def test_synchronising_set_is_sparse_and_consistent():
    words = np.random.default_rng(2).integers(0, 2, 4000)
    words[999], words[1000:2000], words[2000] = 1, 0, 1  # highly periodic
    names, t = words, 16
    windows = np.array([hash(names[i : i + t].tobytes()) for i in range(len(words) - t + 1)])
    windows, _ = _named(windows, np.arange(len(windows)), len(windows))
    chosen = synchronising_set(windows, t, [(1000, 2000, 1)])
    assert not chosen[1000 : 2000 - 3 * t].any() and 0.02 < chosen.mean() < 0.3
    by_context = {}
    for i, c in enumerate(chosen):
        assert by_context.setdefault(words[i : i + 2 * t].tobytes(), bool(c)) == bool(c)


def expected(doc_id, text):
    words = WORD.findall(text or "")
    h, n = (zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1), len(words)
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    drop = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    digests = sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in drop))
    return (len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4), *digests)


def test_query_against_brute_force(spark, tmp_path):
    r = random.Random(9)
    texts = [r.choice([" ", "  ", "\n", "\t\x0b"]).join(f"w{x}" for x in random_words(r)) for _ in range(150)]
    texts += [None, "", " \n ", "one", "a " * 30, " x  y z\x00 " * 5, "é🙂 " * 9]
    rows = [(i if i % 9 else 10 * i, t, 1, "x") for i, t in enumerate(texts)] + [(None, "b " * 8, 1, "x"), (5, texts[5], 1, "x"), (5, "c d " * 6, 1, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, n_runs long, runs string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op11_periods(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda x: str(x)
    assert sorted((tuple(x) for x in got.collect()), key=key) == sorted(((i, *expected(i, t)) for i, t, *_ in rows), key=key)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, *_ in rows) > 8


def test_whole_tables(spark):
    """Every text of a whole table that is short enough for brute force, long texts by their count of words."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {x.doc_id: x.text for x in docs.collect()}
    for x in queries.op11_periods(spark, "/root/testdata/sf0.001").collect():
        if len(texts[x.doc_id] or "") < 4000:
            assert tuple(x)[1:] == expected(x.doc_id, texts[x.doc_id])
    assert {x.doc_id: x.n_words for x in periodic_runs(docs).collect()} == {i: len(WORD.findall(t or "")) for i, t in texts.items()}


def test_real_outputs_and_empty_table(spark):
    df = spark.createDataFrame([(1, "go " * 7 + "on and on and on and on and stop")], "doc_id long, text string")
    x = periodic_runs(df).first()
    assert [tuple(r) for r in x.runs] == [(0, 7, 1), (7, 8, 2)] and x.collapsed == "go on and stop" and x.n_words == 16
    assert run_digests(periodic_runs(plant_repeats(df.limit(0)))).count() == 0
    assert periodic_runs(df.withColumn("collapsed", F.lit(1)), times=5, least=7).first().runs[0].length == 7
