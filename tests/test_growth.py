"""What the close keeps bounded as its tables grow."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from closebook import storage
from closebook.operators import exceptions, matching
from closebook.plans import queries
from closebook.plans.close import WorkloadClose
from closebook.schema import BAND, COLUMNS, FX_TOLERANCE, POOL_DAYS, POOL_LINES

DAY = datetime.date(2026, 8, 10)


def _plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().toString()


def test_compressed_files_do_not_make_a_large_table_broadcast(spark, monkeypatch):
    monkeypatch.setattr(storage, "BROADCAST_BYTES", 1 << 20)
    same = spark.range(50_000).select((F.col("id") % 7).alias("k"), F.lit("x" * 50).alias("text"))
    large, few = storage.kept(same, "large"), storage.kept(same.limit(100), "few")
    left = spark.range(400_000).select((F.col("id") + 100).alias("k"))
    assert "BroadcastHashJoin" not in _plan(left.join(large, "k"))
    assert "BroadcastHashJoin" not in _plan(left.join(large.filter("k > 3").select("k"), "k", "left_anti"))
    assert "BroadcastHashJoin" in _plan(left.join(few, "k"))
    assert large.count() == 50_000


def test_exploded_days_are_never_broadcast(spark):
    """The planner takes an explosion to have the size of its input, here a few KB of files."""
    row = "txn_id string, source string, direction string, currency string, counterparty string, amount_minor long, value_date date, seq long"
    side = lambda source: storage.materialize(spark.range(2_000).selectExpr(f"concat('{source}', id) AS txn_id", f"'{source}' AS source", "'inbound' AS direction", "'INR' AS currency", "concat('p', id % 50) AS counterparty", "id % 9 + 1 AS amount_minor", "date'2026-08-10' AS value_date", "id AS seq"), source)
    bank, lines = side("bank"), side("settlement")
    for made in (exceptions.pool(bank, lines), exceptions.twins(bank, bank.limit(5))):
        for part in made._jdf.queryExecution().sparkPlan().toString().split("BroadcastHashJoin")[1:]:
            assert "Generate explode(" not in part.split("BroadcastHashJoin")[0].rpartition("Exchange")[0]
    book = side("gl").withColumn("currency", F.lit("USD"))
    _, _, near = matching.fx_candidates(book.unionByName(bank), spark.createDataFrame([], row).select("txn_id"))
    assert "SortMergeJoin [direction" in near._jdf.queryExecution().sparkPlan().toString()


def test_pool_takes_nearer_days_first_and_no_more_than_are_open(spark):
    drawn = random.Random(5)
    row = "txn_id string, source string, direction string, currency string, counterparty string, amount_minor long, value_date date, seq long"
    near = lambda: DAY + datetime.timedelta(days=drawn.choice([-9, -4, -3, -1, -1, 0, 0, 1, 2, 4, 5]))
    lines = [(f"l{i}", "settlement", "inbound", drawn.choice(["INR", "USD"]), drawn.choice(["a", "B"]), drawn.randint(1, 30), near(), i) for i in range(500)]
    deposits = [(f"d{i}", "bank", "inbound", "INR", drawn.choice(["A", "b"]), drawn.randint(1, 40), near(), 1000 + i) for i in range(60)]
    got = exceptions.pool(spark.createDataFrame(deposits, row), spark.createDataFrame(lines, row)).collect()
    want = set()
    for d in deposits:
        lag = lambda x: abs((x[6] - d[6]).days)  # noqa: B023, E731
        fit = [x for x in lines if x[3] == d[3] and x[4].lower() == d[4].lower() and lag(x) <= POOL_DAYS and x[5] <= d[5]]
        fit.sort(key=lambda x: (lag(x), -x[5], x[7]))
        want |= {(d[0], d[5], d[3], x[0], x[5], i + 1) for i, x in enumerate(fit[:POOL_LINES])}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_no_day_asks_for_more_lines_than_nearer_days_leave_open(spark):
    row = "txn_id string, source string, direction string, currency string, counterparty string, amount_minor long, value_date date, seq long"
    lines = [(f"l{i}", "settlement", "inbound", "INR", "a", 1, DAY + datetime.timedelta(days=i % 9 - 4), i) for i in range(9 * POOL_LINES)]
    pooled = exceptions.pool(spark.createDataFrame([("d", "bank", "inbound", "INR", "a", 5, DAY, -1)], row), spark.createDataFrame(lines, row))
    pooled.write.format("noop").mode("overwrite").save()
    assert {r.line_id for r in pooled.collect()} == {f"l{i}" for i in range(4, 9 * POOL_LINES, 9)}
    assert "open#" in pooled._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("width", [FX_TOLERANCE, FX_TOLERANCE + 1, BAND])
def test_amounts_within_tolerance_are_near_at_the_edges_of_bands(spark, width):
    base = {c: None for c in COLUMNS} | {"fee_minor": 0, "tax_minor": 0, "direction": "inbound", "status": "settled", "value_date": DAY}
    rows = [base | {"seq": 0, "txn_id": "g", "source": "gl", "currency": "USD", "amount_minor": 100 * width}]
    expected = 8320 * width  # at 83.20
    for i, off in enumerate((-FX_TOLERANCE - 1, -FX_TOLERANCE, 0, FX_TOLERANCE, FX_TOLERANCE + 1)):
        rows.append(base | {"seq": i + 1, "txn_id": f"b{off}", "source": "bank", "currency": "INR", "amount_minor": expected + off})
    from closebook.schema import CANONICAL

    df = spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in rows], CANONICAL)
    _, _, near = matching.fx_candidates(df, df.select("txn_id").limit(0))
    assert {r.right_id for r in near.collect()} == {f"b{o}" for o in (-FX_TOLERANCE, 0, FX_TOLERANCE)}
    assert "/ 10000" not in near._jdf.queryExecution().analyzed().toString()


def test_exact_passes_run_no_later_one(spark, monkeypatch):
    for name in ("economic", "fx", "edges"):
        monkeypatch.setattr(WorkloadClose, name, property(lambda self: pytest.fail("a later pass was run")))
    from closebook.plans import close

    close.forget()
    for name in ("parent_ref", "group_ref"):
        assert queries.QUERIES[f"match_{name}"](spark, "/root/testdata/sf0.001").count() > 0
    close.forget()
