"""Exceptions: the first category that fits claims its subject, and no set of subjects is broadcast."""

from pyspark.sql import functions as F

from closebook import storage
from closebook.operators import exceptions
from closebook.plans import workload

ROW = "txn_id string, source string, direction string, amount_minor long, currency string"


def _made(spark, unresolved, lines, anomalies, groups):
    rows = lambda listed: spark.createDataFrame(listed, ROW)
    double = spark.createDataFrame([(x,) for x in anomalies], "primary_id string")
    return exceptions.cascade(None, rows(unresolved), rows(lines), double, spark.createDataFrame(groups, "deposit_id string, rank int"))


def test_the_first_category_that_fits_claims_its_subject(spark):
    row = lambda i, source, currency="INR": (i, source, "inbound", 5, currency)
    unresolved = [row("grouped", "bank"), row("twice", "bank"), row("foreign", "gl", "USD"), row("book", "gl"), row("line", "settlement"), row("foreign twin", "gl", "EUR")]
    lines = [row("line", "settlement"), row("linked elsewhere", "settlement")]
    found = _made(spark, unresolved, lines, ["twice", "grouped", "matched since", "foreign twin"], [("grouped", 0), ("grouped", 1), ("gone", 0)])
    assert {(r.subject_id, r.category, r.candidates) for r in found.collect()} == {
        ("grouped", "one_to_many", 2), ("twice", "duplicate", 1), ("foreign", "fx", 0), ("foreign twin", "duplicate", 1), ("book", "no_counterpart", 0),
        ("line", "settled_never_received", 0), ("linked elsewhere", "settled_never_received", 0),
    }
    assert found.count() == 7 and found.filter("source IS NULL OR at_risk <> 5 OR currency IS NULL OR severity IS NULL OR type IS NULL").isEmpty()


def test_nothing_is_broadcast_to_tell_categories_apart(spark):
    rows = storage.materialize(spark.range(2_000).selectExpr("concat('t', id) AS txn_id", "'bank' AS source", "'inbound' AS direction", "id AS amount_minor", "'INR' AS currency"), "some")
    found = exceptions.cascade(None, rows, rows.filter("amount_minor > 5"), rows.select(F.col("txn_id").alias("primary_id")), rows.select(F.col("txn_id").alias("deposit_id")))
    assert found.count() == 2_000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "Exchange" in plan


def test_customers_beyond_the_bound_are_not_broadcast(spark, monkeypatch):
    plan = lambda: workload.orders(spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin [o_custkey" in plan()
    monkeypatch.setattr(storage, "BROADCAST_BYTES", 100)
    assert "BroadcastHashJoin [o_custkey" not in plan() and "SortMergeJoin [o_custkey" in plan()
