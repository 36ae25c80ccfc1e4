"""How often rows are dealt anew by the steps that every figure of a close goes through."""

from closebook.operators import exceptions, scoring
from closebook.plans import workload
from closebook.plans.close import WorkloadClose


def exchanges(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange hashpartitioning" in line for line in plan.splitlines())


def test_sources_and_owners_are_dealt_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # one plan, not an initial and a final one
    try:
        rows = spark.createDataFrame([("gl:a", "gl", "a", 64), ("bank:b", "bank", "b", 96), ("gateway:p", "gateway", "p", 65), ("settlement:s", "settlement", "s", 80)], "txn_id string, source string, external_ref string, seq long")
        edges = spark.createDataFrame(
            [("m1", "parent_ref", "left", "gateway:p"), ("m1", "parent_ref", "right", "gl:a"), ("m2", "parent_ref", "left", "settlement:s"), ("m2", "parent_ref", "right", "gl:a"), ("m3", "group_ref", "left", "settlement:s"), ("m3", "group_ref", "right", "bank:b")],
            "match_id string, pass string, side string, txn_id string",
        )
        linked = exceptions.matched_sources(rows, edges)
        assert sorted(map(tuple, linked.collect())) == [("bank:b", "settlement"), ("gateway:p", "gl"), ("gl:a", "gateway"), ("gl:a", "settlement"), ("settlement:s", "bank"), ("settlement:s", "gl")]
        assert exchanges(linked) <= 4
        owned = scoring.owned(rows, workload.truth(rows))
        assert owned.count() == 4 and exchanges(owned) <= 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_a_report_writes_no_parsed_rows(spark, monkeypatch):
    from closebook.operators import ingest
    from closebook.plans import close as plans

    made = []
    monkeypatch.setattr(plans, "kept", lambda df, label, by=None: made.append(label) or df)
    feed = workload.recurring_rows(spark, workload.month_due())
    told = ingest.report(WorkloadClose(feed).parsing).first()
    assert "parsed" not in made and told.total_in == 6 + 16
