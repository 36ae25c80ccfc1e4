"""Keys that come, go and change in raw lines."""

from closebook.sources import drift


def test_drift_of_odd_lines(spark):
    lines = ['{"seq": 1, "voucher_no": "v", "gl_date": null, "extra": {"a": 1}}', '{"seq": 99999999999999999999999, "voucher_no": 5, "debit": 1.5}', "[1]", "7", "", "not json", "{}", None]
    table = spark.createDataFrame([(x,) for x in lines], "value string")
    got = {(r.key, r.drift, r.type): r.n for r in drift.report("gl", table).collect()}
    missing = {k for k, d, _ in got if d == "missing"}
    assert missing == {"account", "party", "credit", "narration", "currency", "status"} and ("gl_date", "missing", None) not in got
    assert got["voucher_no", "type_changed", "BIGINT"] == 1 and sum(n for (k, d, _), n in got.items() if (k, d) == ("debit", "type_changed")) == 1
    assert sum(n for (k, d, _), n in got.items() if (k, d) == ("extra", "unexpected")) == 1
    assert drift.report("gl", table.limit(0)).filter("drift <> 'missing'").count() == 0
