"""What the stages of a close deal, draw and keep: each of these was done several times, or stayed on the disks."""

import glob

from pyspark.sql import functions as F

from closebook import storage
from closebook.operators import audit, exceptions, ingest, matching, scoring, serving, shuffle
from closebook.plans import generator
from tests.test_shuffles import exchanges

ROW = "seq long, txn_id string, source string, external_ref string, amount_minor long, currency string, direction string, value_date string, group_ref string"
EDGE = "match_id string, pass string, side string, txn_id string"


def _planned(spark, make):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return make()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def _small(spark):
    rows = [(i, f"{s}:{r}", s, r, 5, "INR", "inbound", "2026-08-01", "u") for i, (s, r) in enumerate([("gl", "a"), ("bank", "u"), ("settlement", "s"), ("settlement", "t"), ("gateway", "g"), ("settlement", "open")])]
    edges = [("m1", "parent_ref", "left", "gateway:g"), ("m1", "parent_ref", "right", "gl:a"), ("m2", "parent_ref", "left", "settlement:t"), ("m2", "parent_ref", "right", "gl:a"), ("m3", "group_ref", "left", "settlement:s"), ("m3", "group_ref", "right", "bank:u")]
    return spark.createDataFrame(rows, ROW), spark.createDataFrame(edges, EDGE)


def test_matches_are_put_together_once_as_they_are_served(spark):
    rows, edges = _small(spark)
    wire = serving.wire_matches(edges, rows)
    assert _planned(spark, lambda: exchanges(serving.wire_matches(edges, rows))) <= 3
    assert {(r.match_id, r.n_left, r.n_right, r.reason) for r in wire.collect()} >= {("m1", 1, 1, "exact: the gateway row names gl entry a"), ("m3", 1, 1, "exact: 1 lines of u add up to the bank's 5")}
    assert "right_id" not in wire.columns


def test_no_match_is_put_together_for_unbanked_lines(spark):
    rows, edges = _small(spark)
    assert _planned(spark, lambda: exchanges(exceptions.unbanked(rows, edges))) <= 2
    of = lambda df: sorted(r.txn_id for r in df.select("txn_id").collect())
    linked = exceptions.matched_sources(rows, edges).filter("other = 'bank'")
    assert of(exceptions.unbanked(rows, edges)) == of(rows.filter("source = 'settlement'").join(linked, "txn_id", "left_anti")) == ["settlement:open", "settlement:t"]


def test_a_trail_groups_its_edges_and_its_report_once(spark):
    rows, edges = _small(spark)
    found = spark.createDataFrame([("no_counterpart", "settlement:open", 5, "INR", 0)], "category string, subject_id string, at_risk long, currency string, candidates long")
    report = ingest.report(rows.withColumn("outcome", F.lit("ok")))
    rejects = spark.createDataFrame([], "source string, locator string, reason string")
    told = audit.trail(report, rejects, edges, found, matched=5)
    assert _planned(spark, lambda: exchanges(audit.trail(report, rejects, edges, found, matched=5))) <= 1
    lines = [sorted(map(str, t.collect())) for t in (told, audit.trail(report, rejects, edges, found), audit.trail(report, rejects, edges, found, matching.described(edges), 5))]
    assert lines[0] == lines[1] == lines[2] and len(lines[0]) == 2 + 3 + 1 + 1


def test_places_of_a_full_grid_are_plain_arithmetic(spark):
    ids = spark.createDataFrame([(0,), (None,), (77,), ((1 << 60) - 1,)], "seq long")
    dealt = shuffle.placed(ids, "seq", 7, 1 << 60)
    assert "lambda" not in dealt._jdf.queryExecution().optimizedPlan().toString()
    want = ids.select("seq", shuffle.place("seq", 1 << 60, 7).alias("place"))
    assert dealt.columns == want.columns and {tuple(r) for r in dealt.collect()} == {tuple(r) for r in want.collect()}


def test_a_key_is_made_of_the_stored_rows(spark):
    close = generator.run(spark, 200, shuffled=True)
    assert "md5" not in close.truth._jdf.queryExecution().optimizedPlan().toString()
    drawn = generator.generate(spark, 200, generator.HELD_OUT_SEED).truth
    assert {tuple(r) for r in close.truth.collect()} == {tuple(r) for r in drawn.collect()} and close.feed.columns == generator.generate(spark, 200).rows.columns


def test_shuffled_data_goes_with_the_write(spark):
    at = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f for d in at for f in glob.glob(f"{d}/**/shuffle_*.data", recursive=True)}
    before = files()
    made = storage.materialize(spark.range(1_000).repartition(3, "id"), "swept")
    left = files() - before
    assert not left and made.count() == 1_000
    assert spark.conf.get(storage.CLEANUP) == "false"


def test_few_rows_tell_which_records_are_matched(spark):
    rows, edges = _small(spark)
    unresolved = rows.join(edges, "txn_id", "left_anti")
    lines, found = exceptions.unbanked(rows, edges), spark.createDataFrame([("settlement:open",), ("settlement:t",)], "subject_id string")
    truth = rows.select(F.when(F.col("external_ref").isin("open", "u"), 2).otherwise(1).cast("long").alias("event_id"), F.lit("c").alias("case_type"), F.lit("matched").alias("handling"), "source", "external_ref")
    per_event = scoring.events(scoring.owned(rows, truth, scoring.flags(unresolved, lines, found)))
    assert sorted(map(tuple, per_event.collect())) == [(1, "c", "matched", 4, 4, 1, 0), (2, "c", "matched", 2, 1, 1, 1)]
    assert [tuple(r) for r in scoring.missed_by_case(per_event).collect()] == [("c", 1)]
