"""Counts that come with a write: equal to those of a query over it, and no job beside the write."""

from pyspark.sql import functions as F

from closebook.operators import ingest, metrics
from closebook.plans import generator
from closebook.plans.close import Close

PARSED = "source string, external_ref string, seq long, outcome string"


def parsed(spark):
    rows = [("bank", "a", 1, "ok"), ("bank", "a", 2, "ok"), ("gl", "a", 3, "ok"), ("gl", None, 4, "reject"), ("gl", "", 5, "skip"), ("bank", "b", 6, "ok"), ("bank", "b", 7, "reject")]
    return spark.createDataFrame(rows, PARSED)


def test_report_of_the_writes(spark):
    kept, told = ingest.in_flight(parsed(spark))
    assert {(r.source, r.external_ref, r.seq) for r in kept.collect()} == {("bank", "a", 1), ("gl", "a", 3), ("bank", "b", 6)}
    assert told.drop("seconds", "records_per_sec").first() == ingest.report(parsed(spark)).first() == (7, 3, 1, 2, 1)
    assert told.filter("seconds > 0 AND abs(records_per_sec * seconds - 7) < 1e-6").count() == 1


def test_nothing_in(spark):
    for empty in (parsed(spark).limit(0), parsed(spark).filter("1 = 0"), spark.createDataFrame([], PARSED)):
        kept, told = ingest.in_flight(empty)
        assert kept.count() == 0 and told.drop("seconds").first() == (0, 0, 0, 0, 0, 0.0)


def test_counts_by_partition_and_value(spark):
    for parts in (1, 7):
        out = metrics.measured(spark.range(0, 1000, 1, parts).withColumn("v", F.expr("id % 3")), "counted", "v", n=F.count(F.lit(1)), top=F.max("id"), ones=F.count_if(F.col("v") == 1))
        assert out.counts == {"n": 1000, "top": 999, "ones": 333} and out.rows.count() == 1000 and out.per_second > 0


def test_no_job_beside_the_writes(spark):
    tracker = spark.sparkContext.statusTracker()

    def jobs(group, f):
        spark.sparkContext.setJobGroup(group, group)
        try:
            f()
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(tracker.getJobIdsForGroup(group))

    from closebook.storage import materialize

    df = spark.range(0, 100, 1, 3).repartition(2)
    assert jobs("counted", lambda: metrics.measured(df, "x", n=F.count(F.lit(1)))) == jobs("plain", lambda: materialize(df, "y"))


def test_throughput_of_a_close(spark):
    close = Close(generator.generate(spark, 300).rows)
    told = close.throughput().first()
    assert (told.total_in, told.unresolved) == (close.rows.count(), close.unresolved.count())
    assert told.matched == close.edges.select("txn_id").distinct().count() and abs(told.match_rate - told.matched / told.total_in) < 1e-9
    nothing = Close(generator.generate(spark, 300).rows.limit(0)).throughput().first()
    assert nothing[:4] == (0, 0, 0, 0.0)
