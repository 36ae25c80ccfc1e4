"""Summaries and reports over generated batches and hand rows."""

import datetime

from pyspark.sql import functions as F

from closebook.functions import derived
from closebook.operators import scoring
from closebook.plans import generator, reports
from closebook.plans.close import WorkloadClose


def test_derived_columns(spark):
    rows = spark.createDataFrame([("bank", "a", 12345, 45, None), ("gl", None, -250, None, 50), ("gl", "b", None, 1, 1)], "source string, external_ref string, amount_minor long, fee_minor long, tax_minor long")
    got = [(r.net_minor, None if r.amount_major is None else str(r.amount_major), tuple(r.dedupe_key)) for r in derived.with_derived(rows).collect()]
    assert got == [(12300, "123.45", ("bank", "a")), (-300, "-2.50", ("gl", None)), (None, None, ("gl", "b"))]
    shown = spark.createDataFrame([(1234567890,), (-5,), (0,), (None,)], "m long").select(derived.rupees(F.col("m")))
    assert [r[0] for r in shown.collect()] == ["Rs 12,345,678.90", "Rs -0.05", "Rs 0.00", None]


def test_lines(spark):
    report = spark.createDataFrame([(1_234_567, 1_200_000, 34_000, 500, 67)], "total_in long, accepted long, deduplicated long, rejected long, skipped long")
    assert reports.ingest_line(report).first().line == "1,200,000 of 1,234,567 rows taken in: 34,000 re-imports, 500 rejected, 67 skipped"
    told = spark.createDataFrame([(3000, 2999, 1), (0, 0, 0), (7, 7, 0)], "total_in long, matched long, unresolved long")
    assert [r.line for r in reports.match_line(told).collect()] == ["2,999 of 3,000 records matched (99.9 %), 1 open", "0 of 0 records matched (0.0 %), 0 open", "7 of 7 records matched (100.0 %), 0 open"]
    scored = spark.createDataFrame([(7, 41, 1234500, 0.1234, 0.8, True), (30, 1, 99, None, 0.3333, False)], "horizon long, samples long, mae long, mape double, coverage double, calibrated boolean")
    assert [r.line for r in reports.backtest_lines(scored).orderBy("horizon").collect()] == [
        "T+7: off by Rs 12,345.00 (12.3 %), 80.0 % within the band, which holds; 41 samples",
        "T+30: off by Rs 0.99 (-), 33.3 % within the band, which DOES NOT HOLD; 1 samples",
    ]


def test_figures(spark):
    batch = generator.generate(spark, 600, seed=generator.HELD_OUT_SEED)
    close = WorkloadClose(batch.rows, truth=batch.truth)
    report = reports.figures(close, batch.seed)
    text, score = str(report), close.scores().first()
    assert report.ok and "held out" in text and f"{score.matched:,} of {score.should_match:,}" in text and "May be published." in text
    assert all(r.type in text for r in close.found.select("type").distinct().collect())
    # A key under which every second record belongs to another event: matches look false, so nothing may be published.
    mixed = batch.truth.withColumn("event_id", F.col("event_id") + F.when(F.col("source") == "bank", 1).otherwise(0))
    bad = reports.figures(WorkloadClose(batch.rows, truth=mixed), 5)
    assert not bad.ok and "May NOT be published:" in bad.lines and "not to be reported" in bad.lines[0]
    assert [x.strip() for x in bad.lines[bad.lines.index("May NOT be published:") + 1 :]] == scoring.problems(WorkloadClose(batch.rows, truth=mixed).scores().first())


def test_cash(spark):
    batch = generator.generate(spark, 1500, history_days=120)
    report = reports.cash(batch, horizon=20, floor=10**15)
    text = str(report)
    assert report.ok and text.index("Back-test") < text.index("Projection") and "T+7:" in text and "20 days below the floor" in text and "0 days ahead" in text
    assert "Payroll" in text and str(batch.end + datetime.timedelta(days=20)) in text and str(batch.end + datetime.timedelta(days=21)) not in text
    short = reports.cash(generator.generate(spark, 40, history_days=9))
    assert not short.ok and "9 days of history are too few" in short.lines[-1]


def test_batch_report(spark):
    batch = generator.generate(spark, 400)
    counts = {r.measure: r.n for r in reports.batch_summary(batch).collect()}
    assert counts["events"] == 403 and counts["rows"] == batch.rows.count() and sum(n for k, n in counts.items() if k.startswith("case: ")) == 403
    assert counts["future bookings"] == batch.booked.count() and counts["days"] == 30 and "case: clean" in str(reports.batch(batch))
