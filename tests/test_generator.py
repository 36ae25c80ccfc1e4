"""Generated batches: one result for one seed, shares of the mix, coherent events, and a close that explains them."""

import datetime

import pytest
from pyspark.sql import functions as F

from closebook.plans import generator


def lines(batch):
    return sorted(map(str, batch.rows.collect())), sorted(map(str, batch.truth.collect()))


def test_partitions_and_slices_do_not_matter(spark):
    one, many = (generator.generate(spark, 500, seed=3, partitions=n) for n in (1, 13))
    assert lines(one) == lines(many)
    assert lines(one) != lines(generator.generate(spark, 500, seed=4))
    whole = {r.k: r for r in generator.events(spark, 500, seed=3).collect()}
    part = {r.k: r for r in generator.events(spark, 500, seed=3, first=401).collect()}
    assert len(part) == 100 and all(whole[k] == r for k, r in part.items())
    assert "Exchange" not in generator.events(spark, 500)._jdf.queryExecution().executedPlan().toString()


def test_shares_of_the_mix(spark):
    n = 60_000
    for mix in (generator.MIX, {"clean": 3, "fx": 1, "outflow_vendor": 0}):
        got = {r[0]: r[1] / n for r in generator.events(spark, n, mix=mix).groupBy("case_name").count().collect()}
        assert set(got) == {k for k, w in mix.items() if w} and all(abs(got[k] - w / sum(mix.values())) < 0.01 for k, w in mix.items() if w)
    for bad in ({}, {"clean": -1}, {"clean": 0}, {"lost": 1}):
        with pytest.raises(ValueError):
            generator.generate(spark, 1, mix=bad or {"clean": 0})


def test_days_amounts_and_recurring_outflows(spark):
    batch = generator.generate(spark, 3000, history_days=90, end=datetime.date(2026, 3, 15))
    assert batch.start == datetime.date(2025, 12, 16)
    drawn = generator.events(spark, 3000, history_days=90, end=batch.end)
    assert drawn.agg(F.min("d"), F.max("d")).first() == (batch.start, batch.end)
    outside = {"partial_refund": (2000, 50_000), "outflow_vendor": (5000, 400_000), "fx": (50, 2000)}
    for r in drawn.groupBy("case_name").agg(F.min("amt").alias("lo"), F.max("amt").alias("hi")).collect():
        lo, hi = outside.get(r.case_name, (500, 200_000))
        assert lo * 100 <= r.lo and r.hi <= hi * 100 + 99
    assert drawn.filter("size(lines) > 0 AND (size(lines) NOT BETWEEN 2 AND 4 OR total <> aggregate(lines, bigint(0), (s, x) -> s + x.line))").count() == 0
    days = [r.value_date.isoformat() for r in batch.rows.filter("external_ref LIKE 'recurring%'").orderBy("value_date").collect()]
    assert days == ["2026-01-01", "2026-01-05", "2026-01-12", "2026-02-01", "2026-02-05", "2026-02-12", "2026-03-01", "2026-03-05", "2026-03-12"]
    assert [r.due_date.isoformat() for r in batch.booked.collect()] == ["2026-04-01", "2026-04-05", "2026-04-12"]
    assert generator.generate(spark, 0).rows.count() == 6 and batch.rows.count() - batch.rows.select("seq").distinct().count() == 0


def test_keys_of_the_answers(spark):
    batch = generator.generate(spark, 2000, seed=9)
    keyed = batch.truth.join(batch.rows.select("source", "external_ref").distinct(), ["source", "external_ref"], "full")
    assert keyed.filter("event_id IS NULL").count() == 0 and batch.truth.select("event_id").distinct().count() == 2000 + 3
    again = batch.rows.groupBy("source", "external_ref").count().filter("count > 1").join(batch.truth, ["source", "external_ref"])
    assert {r[0] for r in again.select("case_type").distinct().collect()} == {"duplicate_same_ref"}


def test_a_held_out_batch_is_closed_soundly(spark):
    close = generator.run(spark, 1500)
    score = close.scores().first()
    close.check()
    assert score.false_matches == 0 and score.unexplained == 0 and score.break_recall == 1 and score.match_rate > 0.98 and score.publishable
