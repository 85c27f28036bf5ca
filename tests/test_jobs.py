import datetime
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from taxloom.functions import money as M
from taxloom.operators import reconcile, talk
from taxloom.queries import ORACLES, QUERIES
from taxloom.streaming.lockout import fold, lockouts, lockouts_batch

SF = "/root/testdata/sf0.001"


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {_kind(v)}" for n, v in values.items()))
    assert names
    return df.select(column.alias("x")).first().x


def _kind(v):
    return {bool: "boolean", int: "int", Decimal: "decimal(18,2)", datetime.date: "date"}.get(type(v), "string")


@pytest.mark.parametrize(("cell", "value"), [("1,00,000", "100000"), ("Rs. 1,000.50", "1000.50"), ("(500)", "-500"), ("", None), ("n/a", None), (None, None), ("-7", "-7")])
def test_parse_amount(spark, cell, value):
    assert one(spark, M.parse_amount(F.col("c")), c=cell) == (None if value is None else Decimal(value))


@pytest.mark.parametrize(("status", "name", "bucket"), [("IMPORTANT", "x", "import_igst"), ("misdirected", "x", "isd"), ("non-filer, timing", "x", "timing"), ("", "RCM - a", "rcm"), (None, None, "unreconciled"), ("credit note", "RCM", "amendment")])
def test_classify(spark, status, name, bucket):
    assert one(spark, M.classify(F.col("s"), F.col("n"), F.lit("1")), s=status, n=name) == bucket


@pytest.mark.parametrize(("section", "fraud", "scheme"), [("74A", None, "74A_non_fraud"), ("74 A(5)", True, "74A_fraud"), ("74(1)", None, "74"), ("73", None, "73"), ("61", None, None)])
def test_scheme(spark, section, fraud, scheme):
    assert one(spark, M.penalty_scheme(F.col("s"), F.lit(fraud).cast("boolean")), s=section) == scheme


def test_indian_digits(spark):
    for amount, text in (("1234567.89", "12,34,567.89"), ("58366", "58,366.00"), ("-999", "-999.00")):
        assert one(spark, M.indian_digits(F.col("a")), a=Decimal(amount)) == text


def test_limitation_uses_calendar_months(spark):
    day = datetime.date(2024, 11, 30)
    for on, state in ((datetime.date(2025, 2, 28), "in_time"), (datetime.date(2025, 3, 1), "condonable"), (datetime.date(2025, 4, 1), "time_barred")):
        assert one(spark, M.limitation(F.col("d"), F.lit(on)), d=day) == state


def test_scrub_and_guard(spark):
    texts = spark.createDataFrame([("GSTIN 27AAPFU0939F1ZV, mail a.b@c.in, 9876543210",), (None,), ("nothing",)], "t string")
    clean, quarantine = talk.guarded(texts, "t")
    assert quarantine.count() == 0
    assert {r.scrubbed for r in clean.collect()} == {"GSTIN [GSTIN], mail [EMAIL], [PHONE]", None, "nothing"}


def test_rankings(spark):
    text = "Response B is fine.\nFINAL RANKING:\n1. Response C\n2. Response A\n2. Response C"
    assert one(spark, talk.parse_ranking(F.col("t")), t=text) == ["Response C", "Response A"]


def test_lockout_fold():
    fails = [(float(i), False) for i in range(5)]
    (failures, until), out = fold((0, 0.0), [*fails, (10.0, True), (905.0, False)])
    assert [o[2] for o in out] == ["failed"] * 4 + ["locked", "refused", "failed"]
    assert (failures, until) == (1, 0.0)


def test_lockout_stream_agrees_with_batch(spark, tmp_path):
    rows = [(k, datetime.datetime(2024, 1, 1, 0, 0, 10 * i), ok) for k, oks in (("a", [False] * 6), ("b", [False, True, False])) for i, ok in enumerate(oks)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, success boolean")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lockouts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    stream.writeStream.format("memory").queryName("locks").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = {r.key: (r.failures, r.locked_until) for r in spark.table("locks").collect()}
    batch = lockouts_batch(df.select("key", F.col("ts").cast("double").alias("at"), "success"))
    assert got == {r.key: (r.failures, r.locked_until) for r in batch.collect()}


def test_plans_have_no_python(spark):
    for name in ("reconciliation_summary", "register_totals", "matter_computations", "dashboard", "leak_audit"):
        assert "Python" not in QUERIES[name](spark, SF)._jdf.queryExecution().toString()


def test_shares_sum_to_one(spark):
    from taxloom.sources.views import view

    sums = reconcile.summary(view(spark, SF, "register_lines")).groupBy("recon_id").agg(F.sum("share").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-4 for r in sums)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("lineitem", "supplier", "orders", "customer", "events", "conversations", "documents", "part"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    r = c.execute(ORACLES[name])
    names = [d[0] for d in r.description]
    want = sorted(repr([_plain(v) for _, v in sorted(zip(names, row, strict=True))]) for row in r.fetchall())
    got = sorted(repr([_plain(row[n]) for n in sorted(names)]) for row in QUERIES[name](spark, SF).collect())
    assert got == want


@pytest.mark.parametrize("name", ["collected_citations", "judged_citations", "cited_sources", "matched_limbs"])
def test_columns_are_those_of_the_sql(spark, name):
    c = duckdb.connect()
    for t in ("lineitem", "orders"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert sorted(QUERIES[name](spark, SF).columns) == sorted(r[0] for r in c.execute(f"DESCRIBE {ORACLES[name]}").fetchall())


def _plain(v):
    return round(float(v), 4) if isinstance(v, (float, int, Decimal)) and not isinstance(v, bool) else str(v)
