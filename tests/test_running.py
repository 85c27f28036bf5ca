import math
import random
import statistics
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from taxloom.operators import reconcile
from taxloom.operators.selection import from_ordered, medians, with_ordered
from taxloom.sources.views import view
from taxloom.streaming.lockout import fold, joined, lockouts_batch, stretch_of
from taxloom.streaming.totals import keep_registers

SF = "/root/testdata/sf0.001"
ATTEMPTS = st.lists(st.tuples(st.integers(1, 40), st.sampled_from([0, 0, 1, 30, 200, 899, 900, 901]), st.booleans()), min_size=1, max_size=40)


def test_ordered_is_the_bit_pattern(spark):
    rng = random.Random(1)
    values = [0.0, -0.0, 5e-324, -5e-324, 2.0**-1022, 2.0**-1022 - 5e-324, 1.0, 0.1, 1.7976931348623157e308, 2.0**52, math.nextafter(8, 0), 8.0, math.nextafter(8, 9)]
    values += [x for x in (struct.unpack("<d", rng.randbytes(8))[0] for _ in range(2000)) if math.isfinite(x)]
    df = with_ordered(spark.createDataFrame([(x,) for x in values], "x double"), "x", "k").withColumn("back", from_ordered(F.col("k")))
    for x, k, back in df.collect():
        bits = struct.unpack("<q", struct.pack("<d", abs(x)))[0]
        assert k == (-bits if x < 0 else bits) and back == x


def test_medians_are_exact(spark):
    rng = random.Random(2)
    groups = {"one": [3.5], "two": [1.0, 2.0], "ties": [1 / 3] * 500 + [0.3], "odd": [rng.gauss(0, 1e6) for _ in range(1001)], "even": [rng.expovariate(1) ** 9 for _ in range(1000)], None: [-1.0, -2.0, -4.0, 1e300], "near": [1 + i * 2.0**-52 for i in range(100)]}
    rows = [(g, x) for g, values in groups.items() for x in values] + [("one", None), ("one", math.nan), ("one", math.inf), ("none", None)]
    rng.shuffle(rows)
    got = {r.g: (r["median"], r.samples) for r in medians(spark.createDataFrame(rows, "g string, v double").repartition(3), "g", "v").collect()}
    assert got == {g: (statistics.median(v), len(v)) for g, v in groups.items()}
    assert medians(spark.createDataFrame([], "g string, v double"), "g", "v").count() == 0


def _folded(rows):
    (failures, until), out = fold((0, 0.0), rows)
    said = [o[2] for o in out]
    return failures, until, said.count("refused"), said.count("locked")


@settings(max_examples=300, deadline=None)
@given(ATTEMPTS, st.lists(st.integers(0, 40), max_size=6), st.sampled_from([0.0, 1.0]))
def test_stretches_compose_to_the_fold(runs, cuts, bias):
    at, now = [], 1000.0
    for _, gap, _ in runs:
        now += gap
        at.append(now)
    rows = sorted((t, ok and bias > 0) for t, (_, _, ok) in zip(at, runs, strict=True))
    times, good = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    # A cut never parts equal times, as spans of time don't.
    edges = sorted({0, len(rows), *(c for c in cuts if 0 < c < len(rows) and times[c] != times[c - 1])})
    parts = [stretch_of(times[a:b], good[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
    assert joined(parts).ends[0] == _folded(rows)
    for k in range(1, len(parts)):
        assert joined([joined(parts[:k]), joined(parts[k:])]).ends[0] == _folded(rows)


@pytest.mark.parametrize("span", [60.0, 900.0, 3600.0])
def test_a_hot_key_is_split(spark, span):
    rng = random.Random(3)
    rows = [("hot", float(t), rng.random() < 0.1) for t in sorted(rng.randrange(200_000) for _ in range(4000))]
    rows += [(None, float(rng.randrange(5000)), rng.random() < 0.3) for _ in range(300)] + [("lone", 7.0, False)] * 9
    extra = [("hot", None, True), ("lone", 8.0, None), ("unread", None, None)]
    df = spark.createDataFrame(rows + extra, "key string, at double, success boolean").withColumn("part", F.lit("clash"))
    got = {r.key: (r.failures, r.locked_until, r.refused, r.locks, r.attempts) for r in lockouts_batch(df, span, 100).collect()}
    of = {k: sorted((t, ok) for key, t, ok in rows if key == k) for k in ("hot", None, "lone")}
    want = {k: (*_folded(r), len(r)) for k, r in of.items()}
    assert got == want
    assert {r.key: (r.failures, r.locked_until, r.refused, r.locks, r.attempts) for r in lockouts_batch(df, span).collect()} == want


def _told(rows):
    return {r.recon_id: (r.total, r.counted, r.skipped, r.suppliers, r.mostly_open, r.no_status) for r in rows}


def test_registers_stream_agrees_after_a_restart(spark, tmp_path):
    lines = view(spark, SF, "register_lines").where("recon_id < 12").cache()
    halves = lines.randomSplit([0.5, 0.5], 4)
    state = {}

    def put(batch, _):
        state.update({r.recon_id: r for r in batch.collect()})

    for half in halves:
        half.repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        keep_registers(stream).writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    want = reconcile.registers(lines).collect()
    assert _told(state.values()) == _told(want) and sum(r.suppliers for r in want) > 0
    buckets = {(r.recon_id, r.bucket): (r.amount, r.lines, r.share) for r in reconcile.summary(lines).collect()}
    assert {(i, b): tuple(v) for i, r in state.items() for b, v in r.buckets.items()} == buckets
    lines.unpersist()


def test_first_sights_expire_with_the_watermark(spark, tmp_path):
    kind = "recon_id int, supplier_gstin string, supplier_name string, invoice_no string, amount_books string, amount_2a string, difference string, tax_amount string, status string, ts timestamp"
    day = lambda d: spark.createDataFrame([(1, "g", None, None, None, None, "5", None, None)], kind.rsplit(",", 1)[0]).withColumn("ts", F.lit(f"2024-01-{d:02d} 00:00:00").cast("timestamp"))
    got = {}
    for d in (1, 2, 20, 21, 22):
        day(d).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in")).withWatermark("ts", "3 days")
        keep_registers(stream, ts="ts").writeStream.foreachBatch(lambda b, _: got.update({r.recon_id: (r.counted, r.suppliers) for r in b.collect()})).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert got[1][0] == 5 and 1 < got[1][1] < 5


def test_a_register_is_told_by_its_buckets(spark):
    from taxloom.plans.dimensions import POSITIONS, Pack

    kind = "recon_id string, status string, supplier_name string, invoice_no string, difference string, amount_books string, amount_2a string, tax_amount string, supplier_gstin string"
    rows = [("r", "rcm", None, "1", "1,234.50", None, None, None, "g1"), ("r", "", "x", "2", "(3,703.50)", None, None, None, "g2"), ("r", None, None, None, "0.5", None, None, None, None), ("small", "rcm", None, None, "0.2", None, None, None, None)]
    lines = spark.createDataFrame(rows, kind)
    got = {r.recon_id: r.brief.split("\n") for r in reconcile.briefs(lines).collect()}
    assert list(got) == ["r"] and got["r"][2] == "Total difference analysed: Rs. 4,938 across 2 line(s)."
    assert got["r"][4:6] == ["- Not yet reconciled: Rs. 3,704 (1 line(s), 75% of the difference) — position: WEAK", "    " + POSITIONS["unreconciled"][0]]
    assert got["r"][7] == "- Reverse charge — not expected in GSTR-2A: Rs. 1,234 (1 line(s), 25% of the difference) — position: STRONG"
    assert "g1" not in "".join(got["r"]) and got["r"][-2] == "HOW TO USE THIS:"
    pack = Pack(buckets=(("open", "Open", "weak", []),), rest="open", positions={})
    assert "- Open: Rs. 4,938 (2 line(s), 100% of the difference) — position: WEAK" in reconcile.briefs(lines, pack).first().brief
    assert reconcile.briefs(lines.limit(0)).count() == 0


def test_another_packs_penalty_stages(spark):
    from taxloom.operators.matters import penalty_stages
    from taxloom.plans.dimensions import Pack

    matters = spark.createDataFrame([(1, "73", None, 100, None)], "matter_id int, section string, fraud boolean, tax int, notice_date date")
    assert [(r.stage, r.amount) for r in penalty_stages(matters, Pack(penalty_stages=(("73", 0, "any", 50, False, None),))).collect()] == [("any", 50.0)]
