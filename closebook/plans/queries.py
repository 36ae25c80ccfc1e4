"""The reference queries, each with its SQL twin where SQL can say it."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import money, text
from ..operators import audit, exceptions, forecast, ingest, matching, scoring, shuffle
from ..sources import feeds, files
from ..storage import materialize, shared_dir, table, union_all
from . import generator, oracles, workload
from .close import over_workload

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def chained(select: str):
    return query(oracles.chain(select))


# Feeds and ingestion.


def _raw(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    rows = over_workload(spark, sf_dir).feed
    return {s: feeds.emit(rows, s) for s in feeds.CONNECTORS}


_PARSED = "seq, txn_id, source, external_ref, amount_minor, currency, fee_minor, tax_minor, direction, value_date, counterparty, parent_ref, group_ref"


def _parsed(source: str):
    def run(spark, sf_dir):
        return feeds.CONNECTORS[source](feeds.emit(over_workload(spark, sf_dir).feed, source)).filter("outcome = 'ok'").selectExpr(*_PARSED.split(", "))

    run.__name__ = f"ingest_parse_{source}"
    return query(oracles.chain(f"SELECT {_PARSED} FROM feed WHERE source = '{source}'"))(run)


for _s in feeds.CONNECTORS:
    _parsed(_s)


#: Of the written lines, every so many is cut short, and every so many has no reference.
_CUT, _BLANK = 97, 89


@chained(f"""SELECT source, CASE WHEN seq % {_CUT} = 0 THEN 'malformed_record' ELSE 'missing_reference' END AS reason, count(*) AS n, count(*) AS located
             FROM feed WHERE source IN ('gateway', 'settlement', 'gl') AND (seq % {_CUT} = 0 OR seq % {_BLANK} = 0) GROUP BY 1, 2""")
def ingest_damaged_files(spark, sf_dir):
    """Written JSON lines, some of them damaged, read back: rejected lines, and how many of their locators name the right line."""
    ref, out = {"gateway": "id", "settlement": "payout_id", "gl": "voucher_no"}, []
    for source, name in ref.items():
        raw = feeds.emit(over_workload(spark, sf_dir).feed, source).withColumn(name, F.when(F.col("seq") % _BLANK == 0, "").otherwise(F.col(name)))
        line = F.to_json(F.struct(*(F.col(f"`{c}`") for c in raw.columns)))
        cut = F.when(F.col("seq") % _CUT == 0, F.substring(line, 1, 30)).otherwise(line).alias("value")
        folder = f"{shared_dir(spark)}/damaged-{uuid.uuid4().hex}"
        raw.select("seq", cut).repartitionByRange(6, "seq").sortWithinPartitions("seq").select("value").write.text(folder)
        rejected = files.scan(spark, source, folder).filter("outcome = 'reject'").select("locator", "reason")
        # The line that stands at a locator, told by its own number.
        there = files.lines(spark, folder).select(F.concat("file", F.lit(", record #"), F.col("record").cast("string")).alias("locator"), F.regexp_extract("value", r'^."seq":([0-9]+)', 1).cast("long").alias("seq"))
        right = F.when(F.col("reason") == "malformed_record", F.col("seq") % _CUT == 0).otherwise((F.col("seq") % _BLANK == 0) & (F.col("seq") % _CUT != 0))
        out.append(rejected.join(there, "locator", "left").groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.count_if(right).alias("located")).select(F.lit(source).alias("source"), "reason", "n", "located"))
    return union_all(out)


@chained("""SELECT 'gl' AS source, * FROM (SELECT 'narration' AS key, 'missing' AS drift, CAST(NULL AS VARCHAR) AS type, CAST(0 AS BIGINT) AS n
            UNION ALL SELECT 'branch', 'unexpected', 'STRING', count(*) FILTER (seq % 3 = 0) FROM feed WHERE source = 'gl' UNION ALL SELECT 'branch', 'unexpected', 'BIGINT', count(*) FILTER (seq % 3 = 1) FROM feed WHERE source = 'gl'
            UNION ALL SELECT 'party', 'type_changed', 'BOOLEAN', count(*) FILTER (seq % 5 = 0) FROM feed WHERE source = 'gl')""")
def ingest_drift(spark, sf_dir):
    """Drift planted in the gl feed's lines: a key gone, one of two types new, one of another type at times."""
    from ..sources import drift

    raw = feeds.emit(over_workload(spark, sf_dir).feed, "gl").drop("narration")
    kept = F.to_json(F.struct(*(F.col(c) for c in raw.columns if c != "party")), {"ignoreNullFields": "true"})
    more = F.concat(F.when(F.col("seq") % 3 == 0, ',"branch":"b"').when(F.col("seq") % 3 == 1, ',"branch":7').otherwise(""), F.when(F.col("seq") % 5 == 0, ',"party":true').otherwise(',"party":"p"'), F.lit("}"))
    return drift.report("gl", raw.select(kept.alias("line"), more.alias("more")).selectExpr("left(line, length(line) - 1) || more AS value"))


@chained(f"SELECT {_PARSED} FROM feed WHERE source = 'gl'")
def ingest_source_gl(spark, sf_dir):
    """The gl feed as written JSON lines, through the data source."""
    from ..sources import datasource

    raw, folder = feeds.emit(over_workload(spark, sf_dir).feed, "gl"), f"{shared_dir(spark)}/gl-{uuid.uuid4().hex}"
    raw.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in raw.columns))).alias("value")).write.text(folder)
    return datasource.load(spark, "gl", folder).filter("outcome = 'ok'").selectExpr(*_PARSED.split(", "))


@query("SELECT * FROM (VALUES ('gateway', 'fee_above_amount', 1), ('gateway', 'missing_reference', 1), ('gateway', 'unknown_currency', 1), ('gateway', 'unknown_status', 1), "
       "('settlement', 'bad_amount', 1), ('settlement', 'bad_date', 1), ('settlement', 'missing_reference', 1), ('bank', 'missing_reference', 1), ('bank', 'debit_and_credit', 2), ('bank', 'bad_date', 1), "
       "('gl', 'compound_entry', 1), ('gl', 'empty_entry', 1), ('gl', 'negative_amount', 1), ('gl', 'unknown_status', 1)) AS t(source, reason, n)".replace(", 1)", ", CAST(1 AS BIGINT))").replace(", 2)", ", CAST(2 AS BIGINT))"))  # fmt: skip
def ingest_rejections(spark, sf_dir):
    return over_workload(spark, sf_dir).parsed.filter("outcome = 'reject'").groupBy("source", "reason").agg(F.count(F.lit(1)).alias("n"))


@chained("SELECT (SELECT count(*) FROM feed) + 16 AS total_in, (SELECT count(*) FROM rows) AS accepted, (SELECT count(*) FROM feed) - (SELECT count(*) FROM rows) AS deduplicated, CAST(15 AS BIGINT) AS rejected, CAST(1 AS BIGINT) AS skipped")
def ingest_report(spark, sf_dir):
    return ingest.report(over_workload(spark, sf_dir).parsing)


@chained("SELECT (SELECT count(*) FROM feed) + 16 AS total_in, (SELECT count(*) FROM rows) AS accepted, (SELECT count(*) FROM feed) - (SELECT count(*) FROM rows) AS deduplicated, CAST(15 AS BIGINT) AS rejected, CAST(1 AS BIGINT) AS skipped, true AS timed")
def ingest_in_flight(spark, sf_dir):
    """The report of an ingestion, counted by its own writes."""
    raw = {s: df.unionByName(feeds.planted_bad(spark)[s]) if s in feeds.planted_bad(spark) else df for s, df in _raw(spark, sf_dir).items()}
    _, told = ingest.in_flight(feeds.parse_all(raw))
    return told.select("total_in", "accepted", "deduplicated", "rejected", "skipped", (F.col("records_per_sec") > 0).alias("timed"))


@chained("SELECT source, count(*) AS n FROM rows GROUP BY source")
def ingest_per_source(spark, sf_dir):
    return ingest.per_source(over_workload(spark, sf_dir).rows)


@query("SELECT CAST(0 AS BIGINT) AS mismatches")
def roundtrip_mismatches(spark, sf_dir):
    """Canonical rows that do not come back equal from their raw shape."""
    columns = _PARSED.split(", ") + ["posted_at"]
    there = over_workload(spark, sf_dir).feed.select(*columns)
    back = feeds.parse_all(_raw(spark, sf_dir)).filter("outcome = 'ok'").select(*columns)
    same = lambda df: df.select("seq", F.xxhash64(*columns).alias("h"))
    both = same(there).join(same(back).withColumnRenamed("h", "g"), "seq", "full")
    return both.agg(F.count_if(~F.col("h").eqNullSafe(F.col("g"))).alias("mismatches"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate) AS r FROM lineitem) WHERE r = 1""")
def dedupe_first_wins(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_shipdate")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    return lines.withColumn("r", F.row_number().over(order)).filter("r = 1").drop("r", "l_shipdate")


@chained(f"SELECT {_PARSED} FROM rows")
def canonical_rows(spark, sf_dir):
    return over_workload(spark, sf_dir).rows.selectExpr(*_PARSED.split(", "))


# Matching.


def _pass(name: str, stage: str):
    """A pass's edges from the first stage that has them, so that no later pass is run for them."""

    def run(spark, sf_dir):
        return getattr(over_workload(spark, sf_dir), stage).filter(F.col("pass") == name).select("match_id", "side", "txn_id")

    run.__name__ = f"match_{name}"
    return chained(f"SELECT match_id, side, txn_id FROM edges WHERE pass = '{name}'")(run)


for _s, _stage in {"parent_ref": "exact", "group_ref": "exact", "economic_pair": "economic", "fx": "fx"}.items():
    _pass(_s, _stage)


@chained("SELECT * FROM matches")
def matches_all(spark, sf_dir):
    return matching.describe(over_workload(spark, sf_dir).edges)


@chained("SELECT match_id FROM matches WHERE n_left = 0 OR n_right = 0")
def match_violations(spark, sf_dir):
    return matching.violations(over_workload(spark, sf_dir).edges).select("match_id")


@chained("SELECT txn_id, source, amount_minor, currency FROM unresolved")
def unresolved(spark, sf_dir):
    return over_workload(spark, sf_dir).unresolved.select("txn_id", "source", "amount_minor", "currency")


@chained("SELECT t.tier, count(x.txn_id) AS records FROM (VALUES ('exact'), ('rule'), ('fuzzy'), ('ml')) AS t(tier) LEFT JOIN (SELECT txn_id, min(CASE WHEN pass IN ('parent_ref', 'group_ref') THEN 'exact' ELSE 'rule' END) AS tier FROM edges GROUP BY 1) x ON x.tier = t.tier GROUP BY 1")
def tier_breakdown(spark, sf_dir):
    return matching.tier_breakdown(over_workload(spark, sf_dir).edges)


@chained("SELECT pass, count(*) AS n FROM matches GROUP BY pass")
def per_pass_counts(spark, sf_dir):
    """Every match has one row on its right-hand side, whatever its pass: those are counted, and no match is shuffled."""
    return over_workload(spark, sf_dir).edges.filter("side = 'right'").groupBy("pass").agg(F.count(F.lit(1)).alias("n"))


@chained("SELECT (SELECT count(*) FROM rows) AS total, (SELECT count(DISTINCT txn_id) FROM edges) AS matched, round((SELECT count(DISTINCT txn_id) FROM edges) / (SELECT count(*) FROM rows), 6) AS match_rate")
def match_rate(spark, sf_dir):
    c = over_workload(spark, sf_dir)
    hit = c.rows.join(c.edges.select("txn_id").distinct().withColumn("m", F.lit(1)), "txn_id", "left")
    counts = hit.agg(F.count(F.lit(1)).alias("total"), F.count("m").alias("matched"))
    return counts.withColumn("match_rate", F.round(F.col("matched") / F.col("total"), 6))


@chained("SELECT total AS total_in, total - n AS matched, n AS unresolved, round((total - n) / total, 6) AS match_rate, true AS timed FROM (SELECT (SELECT count(*) FROM rows) AS total, (SELECT count(*) FROM unresolved) AS n)")
def reconcile_throughput(spark, sf_dir):
    """Counts and speed of the matching stages, from their own writes."""
    told = over_workload(spark, sf_dir).throughput()
    return told.select("total_in", "matched", "unresolved", F.round("match_rate", 6).alias("match_rate"), (F.col("records_per_sec") > 0).alias("timed"))


@chained("SELECT CAST(0 AS BIGINT) AS overlap, CAST(0 AS BIGINT) AS lost")
def partition_invariant(spark, sf_dir):
    """Records both matched and unresolved, and records that are neither."""
    c = over_workload(spark, sf_dir)
    matched = c.edges.select("txn_id").distinct()
    both = c.unresolved.select("txn_id").intersect(matched).agg(F.count(F.lit(1)).alias("overlap"))
    lost = c.rows.select("txn_id").join(matched.unionByName(c.unresolved.select("txn_id")), "txn_id", "left_anti").agg(F.count(F.lit(1)).alias("lost"))
    return both.join(F.broadcast(lost))


@chained("SELECT count(*) AS buckets, max(n) AS largest FROM (SELECT count(*) AS n FROM rows WHERE source = 'bank' GROUP BY currency, direction, value_date, amount_minor // 10000)")
def blocking_stats(spark, sf_dir):
    return matching.blocking_stats(over_workload(spark, sf_dir).rows)


@query(oracles.greedy("SELECT pass, left_id, right_id FROM claimed"))
def match_greedy(spark, sf_dir):
    """The pairs of the ordered variants of the two economic passes."""
    c = over_workload(spark, sf_dir)
    done = c.exact.select("txn_id").distinct()
    pairs = materialize(matching.economic_pair_greedy(c.rows, done), "greedy")
    both = pairs.unionByName(matching.fx_greedy(c.rows, done.unionByName(pairs.select("txn_id")).distinct()))
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("txn_id"))).alias(f"{s}_id")
    return both.groupBy("match_id", "pass").agg(side("left"), side("right")).select("pass", "left_id", "right_id")


@chained("""SELECT match_id, CASE pass WHEN 'parent_ref' THEN 'exact: the ' || source || ' row names gl entry ' || ref WHEN 'group_ref' THEN 'exact: ' || n || ' lines of ' || group_ref || ' add up to the bank''s ' || amount
            WHEN 'economic_pair' THEN 'rule: ' || amount || ' ' || currency || ' ' || direction || ', same party, T+' || (paid - booked)
            ELSE 'rule: ' || total || ' ' || currency || ' is ' || CAST(round_even(CAST(total AS decimal(18,0)) * CAST(CASE currency WHEN 'USD' THEN 83.20 WHEN 'EUR' THEN 90.10 WHEN 'GBP' THEN 105.40 END AS decimal(10,2)), 0) AS BIGINT) || ' INR, the bank has ' || amount END AS reason
            FROM (SELECT match_id, pass, count(*) FILTER (side = 'left') AS n, CAST(sum(amount_minor) FILTER (side = 'left') AS BIGINT) AS total, min(source) FILTER (side = 'left') AS source, min(currency) FILTER (side = 'left') AS currency,
                  min(direction) FILTER (side = 'left') AS direction, min(value_date) FILTER (side = 'left') AS booked, min(group_ref) FILTER (side = 'left') AS group_ref, min(external_ref) FILTER (side = 'right') AS ref,
                  min(amount_minor) FILTER (side = 'right') AS amount, min(value_date) FILTER (side = 'right') AS paid FROM edges JOIN rows USING (txn_id) GROUP BY 1, 2)""")  # fmt: skip
def match_reasons(spark, sf_dir):
    c = over_workload(spark, sf_dir)
    return matching.reasons(c.edges, c.rows)


# Anomalies and exceptions.


@chained("SELECT * FROM anomalies")
def anomaly_duplicate_payment(spark, sf_dir):
    return over_workload(spark, sf_dir).anomalies


@chained("SELECT 'duplicate_payment' AS kind, count(*) AS n, CAST(sum(at_risk) AS BIGINT) AS at_risk FROM anomalies HAVING count(*) > 0")
def anomaly_by_kind(spark, sf_dir):
    kinds = over_workload(spark, sf_dir).anomalies.withColumn("kind", F.lit("duplicate_payment"))
    return kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("at_risk").alias("at_risk")).orderBy(F.desc("n"), "kind")


@chained("SELECT count(*) AS n, CAST(sum(at_risk) AS BIGINT) AS at_risk FROM anomalies")
def anomaly_rollup(spark, sf_dir):
    return over_workload(spark, sf_dir).anomalies.agg(F.count(F.lit(1)).alias("n"), F.sum("at_risk").alias("at_risk"))


@chained("SELECT txn_id, other FROM linked")
def matched_sources(spark, sf_dir):
    c = over_workload(spark, sf_dir)
    return exceptions.matched_sources(c.rows, c.edges)


@chained("SELECT txn_id, amount_minor FROM unbanked")
def unbanked_settlements(spark, sf_dir):
    return over_workload(spark, sf_dir).unbanked.select("txn_id", "amount_minor")


@chained("SELECT * FROM pool")
def grouping_pool(spark, sf_dir):
    return over_workload(spark, sf_dir).pool


@chained("SELECT * FROM groupings")
def grouping_candidates(spark, sf_dir):
    return over_workload(spark, sf_dir).groupings.withColumn("line_ids", F.concat_ws(",", "line_ids"))


def _category(name: str):
    def run(spark, sf_dir):
        return over_workload(spark, sf_dir).found.filter(F.col("category") == name)

    run.__name__ = f"exceptions_{name}"
    return chained(f"SELECT * FROM found WHERE category = '{name}'")(run)


for _s in ("one_to_many", "duplicate", "fx", "settled_never_received", "no_counterpart"):
    _category(_s)


@chained("SELECT * FROM found")
def exceptions_all(spark, sf_dir):
    return over_workload(spark, sf_dir).found


@chained("SELECT subject_id, " + oracles.told(0) + " AS reason, " + oracles.told(1) + " AS suggestion FROM found")
def exception_reasons(spark, sf_dir):
    return exceptions.explained(over_workload(spark, sf_dir).found).select("subject_id", "reason", "suggestion")


@chained("SELECT * FROM found WHERE subject_id = (SELECT min(subject_id) FROM found WHERE source = 'bank')")
def exception_lookup(spark, sf_dir):
    """V6: the first exception of the bank, looked up by its subject."""
    found = over_workload(spark, sf_dir).found
    first = found.filter("source = 'bank'").agg(F.min("subject_id")).first()[0]
    return found.filter(F.col("subject_id") == first)


@chained("SELECT currency, count(*) AS n, CAST(sum(at_risk) AS BIGINT) AS at_risk FROM found GROUP BY 1")
def at_risk_totals(spark, sf_dir):
    from ..operators import serving

    return serving.totals(over_workload(spark, sf_dir).found)


@chained("SELECT (SELECT count(*) FROM rows) AS records, (SELECT count(DISTINCT txn_id) FROM edges) AS matched, (SELECT count(DISTINCT match_id) FROM edges) AS matches, count(*) AS exceptions, CAST(sum(at_risk) AS BIGINT) AS at_risk FROM found")
def batch_summary(spark, sf_dir):
    from ..operators import serving

    c = over_workload(spark, sf_dir)
    return serving.summary(c.rows, c.edges, c.found)


@chained("SELECT source, type, count(*) AS n, CAST(sum(at_risk) AS BIGINT) AS at_risk FROM found GROUP BY ALL")
def stored_run_exceptions(spark, sf_dir):
    """Exceptions of a stored run, read by another session."""
    from . import runs

    root = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    runs.RunStore(spark, root).store(over_workload(spark, sf_dir))
    stored = runs.RunStore(spark.newSession(), root).open()
    found = spark.read.parquet(f"{stored.folder}/exceptions")
    return found.groupBy("source", "type").agg(F.count(F.lit(1)).alias("n"), F.sum("at_risk").alias("at_risk"))


@chained("SELECT type, count(*) AS n, CAST(sum(at_risk) AS BIGINT) AS at_risk FROM found GROUP BY type")
def exceptions_by_type(spark, sf_dir):
    return exceptions.by_type(over_workload(spark, sf_dir).found)


@chained("SELECT type, currency, count(*) AS n, CAST(sum(at_risk) AS BIGINT) AS at_risk FROM found GROUP BY 1, 2")
def at_risk_by_type(spark, sf_dir):
    return exceptions.by_type_and_currency(over_workload(spark, sf_dir).found)


@chained("SELECT txn_id FROM unresolved WHERE txn_id NOT IN (SELECT subject_id FROM found)")
def unexplained(spark, sf_dir):
    c = over_workload(spark, sf_dir)
    return exceptions.unexplained(c.unresolved, c.found)


# Generated batches: as many events as there are orders.

_N_ORDERS = "(SELECT count(*) FROM orders)"


def _generated(spark, sf_dir, **options):
    return generator.generate(spark, table(spark, sf_dir, "orders").count(), **options)


@query(f"WITH {generator.feed_sql(_N_ORDERS)} SELECT source, currency, direction, count(*) AS n, CAST(sum(amount_minor) AS BIGINT) AS amount, CAST(sum(fee_minor) AS BIGINT) AS fee, CAST(sum(seq % 1000003) AS BIGINT) AS seqs, min(value_date) AS first_day, max(value_date) AS last_day, count(DISTINCT external_ref) AS refs, count(DISTINCT counterparty) AS parties FROM feed GROUP BY 1, 2, 3")
def generated_feed(spark, sf_dir):
    """A seeded batch by source, currency and direction."""
    return _generated(spark, sf_dir).rows.groupBy("source", "currency", "direction").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount_minor").alias("amount"), F.sum("fee_minor").alias("fee"), F.sum(F.expr("seq % 1000003")).alias("seqs"), F.min("value_date").alias("first_day"), F.max("value_date").alias("last_day"),
        F.count_distinct("external_ref").alias("refs"), F.count_distinct("counterparty").alias("parties"),
    )


@query(f"WITH {generator.feed_sql(_N_ORDERS, seed=7, history_days=365, mix={'fx': 1.0, 'clean': 2.0, 'one_to_many': 1.0})} SELECT case_name AS case_type, count(*) AS n, CAST(sum(amt) AS BIGINT) AS amount FROM ord GROUP BY 1")
def generated_cases(spark, sf_dir):
    """Cases of a batch with another seed, mix and span."""
    drawn = generator.events(spark, table(spark, sf_dir, "orders").count(), seed=7, history_days=365, mix={"fx": 1.0, "clean": 2.0, "one_to_many": 1.0})
    return drawn.groupBy(F.col("case_name").alias("case_type")).agg(F.count(F.lit(1)).alias("n"), F.sum("amt").alias("amount"))


# Summaries.


def _grouped(v: str) -> str:
    return f"format('{{:,}}', CAST({v} AS BIGINT))"


@chained("SELECT 'ingest' AS about, " + " || ".join([_grouped("accepted"), "' of '", _grouped("total_in"), "' rows taken in: '", _grouped("total_in - 16 - accepted"), "' re-imports, 15 rejected, 1 skipped'"]) + " AS line FROM (SELECT (SELECT count(*) FROM feed) + 16 AS total_in, (SELECT count(*) FROM rows) AS accepted) "
         "UNION ALL SELECT 'match', " + " || ".join([_grouped("total - n"), "' of '", _grouped("total"), "' records matched ('", "format('{:.1f}', ((total - n) * 1000 // total) / 10.0)", "' %), '", _grouped("n"), "' open'"]) + " FROM (SELECT (SELECT count(*) FROM rows) AS total, (SELECT count(*) FROM unresolved) AS n)")  # fmt: skip
def summary_lines(spark, sf_dir):
    from . import reports

    c = over_workload(spark, sf_dir)
    lines = {"ingest": reports.ingest_line(ingest.report(c.parsing)), "match": reports.match_line(c.throughput())}
    return union_all([df.select(F.lit(k).alias("about"), "line") for k, df in lines.items()])


@query(f"WITH {generator.feed_sql(_N_ORDERS)} SELECT 'case: ' || case_name AS measure, count(*) AS n FROM ord GROUP BY 1 UNION ALL SELECT 'case: outflow_recurring', 3 UNION ALL SELECT 'events', count(*) + 3 FROM ord "
       "UNION ALL SELECT 'true breaks', count(*) FROM ord WHERE case_name IN ('one_to_many_no_utr', 'duplicate_double_pay', 'break_no_bank', 'break_no_gl') UNION ALL SELECT 'expected re-imports', count(*) FROM ord WHERE case_name = 'duplicate_same_ref' "
       "UNION ALL SELECT 'days', 30 UNION ALL SELECT 'rows', count(*) FROM feed UNION ALL SELECT 'future bookings', count(*) FROM (SELECT unnest(generate_series(DATE '2026-08-31', DATE '2026-08-30' + 45, INTERVAL 1 DAY)) AS d) WHERE day(d) IN (1, 5, 12)")  # fmt: skip
def generated_summary(spark, sf_dir):
    """What a seeded batch holds: events of each case, and totals."""
    from . import reports

    return reports.batch_summary(_generated(spark, sf_dir))


@chained("SELECT txn_id, amount_minor - fee_minor - tax_minor AS net_minor, CAST(amount_minor // 100 AS VARCHAR) || '.' || lpad(CAST(amount_minor % 100 AS VARCHAR), 2, '0') AS amount_major, source AS key_source, external_ref AS key_ref FROM rows")
def derived_columns(spark, sf_dir):
    from ..functions import derived

    rows = derived.with_derived(over_workload(spark, sf_dir).rows)
    return rows.select("txn_id", "net_minor", F.col("amount_major").cast("string").alias("amount_major"), F.col("dedupe_key.source").alias("key_source"), F.col("dedupe_key.external_ref").alias("key_ref"))


# Seeded shuffles.

_ORDERS_PLACED = "WITH RECURSIVE " + shuffle.places_sql("(SELECT o_orderkey AS k FROM orders)", "(SELECT max(o_orderkey) + 1 FROM orders)")


@query(f"{_ORDERS_PLACED} SELECT k, place FROM placed")
def shuffled_orders(spark, sf_dir):
    """Each order's place in a seeded shuffle."""
    keyed = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("bigint").alias("k"))
    return shuffle.placed(keyed, "k")


@query(f"{_ORDERS_PLACED} SELECT CAST(place // w AS INTEGER) AS file, count(*) AS n, min(place) AS first, max(place) AS last, CAST(0 AS BIGINT) AS disordered FROM placed, (SELECT (n + 7) // 8 AS w FROM grid) GROUP BY 1")
def shuffled_files(spark, sf_dir):
    """The orders written in shuffled order and read back: rows and places of each file, and rows that stand before an earlier place."""
    keyed = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("bigint").alias("k"))
    n, path = shuffle.bound(keyed, "k"), f"{shared_dir(spark)}/shuffled-{uuid.uuid4().hex}"
    shuffle.write(keyed, "k", path, 8, n=n)
    file = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("int").alias("file")
    back = shuffle.placed(spark.read.parquet(path).select("k", file, F.col("_metadata.row_index").alias("line")), "k", n=n)
    after = back.select("file", (F.col("line") + 1).alias("line"), F.col("place").alias("before"))
    both = back.join(after, ["file", "line"], "left")
    return both.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"), F.max("place").alias("last"), F.count_if(F.col("before") > F.col("place")).alias("disordered"))


# Scoring and audit.

_SCORES = ("SELECT *, round(matched / should_match, 6) AS match_rate, round(breaks_surfaced / breaks_planted, 6) AS break_recall, true AS bridge_sound, false_matches = 0 AND unexplained = 0 AND ambiguous_held >= ambiguous_planted AS publishable FROM "
         "(SELECT count(*) FILTER (handling = 'matched') AS should_match, count(*) FILTER (handling = 'matched' AND whole) AS matched, count(*) FILTER (handling = 'exception') AS breaks_planted, "
         "count(*) FILTER (handling = 'exception' AND flagged) AS breaks_surfaced, count(*) FILTER (case_type = 'one_to_many_no_utr') AS ambiguous_planted, "
         "count(*) FILTER (case_type = 'one_to_many_no_utr' AND NOT banked) AS ambiguous_held, (SELECT count(*) FROM wrong) AS false_matches, "
         "(SELECT count(*) FROM unresolved WHERE txn_id NOT IN (SELECT subject_id FROM found)) AS unexplained FROM events)")  # fmt: skip


@query(oracles.chain(_SCORES, generator.feed_sql(_N_ORDERS, seed=generator.HELD_OUT_SEED)))
def held_out_scores(spark, sf_dir):
    """The close of a batch from a seed that nothing was tuned on, judged by its answer key."""
    return generator.run(spark, table(spark, sf_dir, "orders").count()).scores()


@query(oracles.chain(_SCORES, generator.feed_sql(_N_ORDERS, seed=generator.HELD_OUT_SEED)))
def shuffled_scores(spark, sf_dir):
    """The same batch in shuffled order of arrival: its scores do not change."""
    return generator.run(spark, table(spark, sf_dir, "orders").count(), shuffled=True).scores()


@chained(_SCORES)
def eval_scores(spark, sf_dir):
    return over_workload(spark, sf_dir).scores()


@chained("SELECT case_type, count(*) AS missed FROM events WHERE handling = 'matched' AND NOT whole GROUP BY 1")
def missed_by_case(spark, sf_dir):
    return scoring.missed_by_case(scoring.events(over_workload(spark, sf_dir).owning))


@chained("SELECT match_id, pass FROM wrong")
def false_matches(spark, sf_dir):
    c = over_workload(spark, sf_dir)
    return scoring.false_matches(scoring.owned(c.rows, c.truth), c.edges)


@chained("SELECT case_type, count(DISTINCT event_id) AS n FROM truth GROUP BY 1")
def workload_cases(spark, sf_dir):
    return workload.truth(over_workload(spark, sf_dir).feed).groupBy("case_type").agg(F.count_distinct("event_id").alias("n"))


def _entries(spark, sf_dir):
    c = over_workload(spark, sf_dir)
    return audit.trail(ingest.report(c.parsed), c.parsed.filter("outcome = 'reject'"), c.edges, c.found, matched=c.matched)


@chained("SELECT 'batch_started' AS decision, CAST(1 AS BIGINT) AS n UNION ALL SELECT 'record_ingested', 1 UNION ALL SELECT 'record_deduplicated', 1 UNION ALL SELECT 'batch_completed', 1 UNION ALL SELECT 'record_rejected', 15 "
         "UNION ALL SELECT 'match_made', (SELECT count(*) FROM matches) UNION ALL SELECT 'match_refused', (SELECT count(*) FROM found WHERE candidates > 0) UNION ALL SELECT 'exception_raised', (SELECT count(*) FROM found)")  # fmt: skip
def audit_trail_counts(spark, sf_dir):
    return audit.counts(_entries(spark, sf_dir))


@chained(oracles.AUDIT_LINES)
def audit_trail_lines(spark, sf_dir):
    from ..sources.sinks import as_lines

    return as_lines(_entries(spark, sf_dir))


# Cash.


def _cash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sparse, cash-stressed variant: orders on their own dates, half of them outflows."""
    o = table(spark, sf_dir, "orders")
    return o.selectExpr(
        "concat('bank:', o_orderkey) as txn_id", "'bank' as source", "cast(o_orderkey as string) as external_ref", "cast(round(o_totalprice * 100) as bigint) as amount_minor",
        "case when (cast(o_orderkey as bigint) * 7919) % 200 >= 100 then 'outbound' else 'inbound' end as direction", "cast(o_orderdate as date) as value_date", "cast(null as string) as counterparty",
        "cast(o_orderdate as timestamp) as posted_at",
    )


@query(oracles.SPARSE + "SELECT * FROM flows")
def cash_history_daily(spark, sf_dir):
    return forecast.history(_cash(spark, sf_dir))


@query(oracles.SPARSE + "SELECT count(*) AS days, count(*) FILTER (quiet) AS quiet_days, CAST(sum(inflow) AS BIGINT) AS inflow, CAST(sum(outflow) AS BIGINT) AS outflow, CAST(sum(net) AS BIGINT) AS net, max(net) AS best_day, min(net) AS worst_day FROM flows")
def cash_history_summary(spark, sf_dir):
    return forecast.summary(forecast.history(_cash(spark, sf_dir)))


@query(oracles.SPARSE + "SELECT CAST(sum(net) + 500000000 AS BIGINT) AS closing_minor FROM flows")
def closing_position(spark, sf_dir):
    return forecast.closing_position(forecast.history(_cash(spark, sf_dir)), 500_000_000)


@query(oracles.SPARSE + "SELECT round(avg(net), 2) AS mean, round(stddev_samp(net), 2) AS stdev FROM flows")
def daily_flow_stats(spark, sf_dir):
    return forecast.daily_stats(forecast.history(_cash(spark, sf_dir))).select(F.round("mean", 2).alias("mean"), F.round("stdev", 2).alias("stdev"))


@chained("SELECT txn_id, value_date, CAST(CASE WHEN direction = 'inbound' THEN amount_minor ELSE -amount_minor END AS BIGINT) AS signed, "
         "CAST(500000000 + sum(CASE WHEN direction = 'inbound' THEN amount_minor ELSE -amount_minor END) OVER (ORDER BY value_date, external_ref, txn_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance_minor FROM rows WHERE source = 'bank'")  # fmt: skip
def running_balance(spark, sf_dir):
    return forecast.running_balance(over_workload(spark, sf_dir).rows)


@query("SELECT label, CAST(m + to_days(dom - 1) AS DATE) AS due_date, CAST(amount AS BIGINT) AS amount_minor, certainty FROM (SELECT unnest(generate_series(DATE '2026-08-01', DATE '2026-12-15', INTERVAL 1 MONTH)) AS m), "
       "(VALUES ('Payroll', 1, 185000000, 'booked'), ('Office rent', 5, 22500000, 'booked'), ('Cloud infrastructure', 12, 4800000, 'expected')) AS t(label, dom, amount, certainty) "
       "WHERE CAST(m + to_days(dom - 1) AS DATE) > DATE '2026-08-28' AND CAST(m + to_days(dom - 1) AS DATE) <= DATE '2026-12-15'")  # fmt: skip
def booked_schedule(spark, sf_dir):
    return forecast.recurring(spark, datetime.date(2026, 8, 28), datetime.date(2026, 12, 15))


def _projection(spark, sf_dir):
    flows = materialize(forecast.history(_cash(spark, sf_dir)), "history")
    last = flows.agg(F.max("day")).first()[0]
    booked = forecast.recurring(spark, last, last + datetime.timedelta(days=45))
    return forecast.project(flows, last + datetime.timedelta(days=1), 45, 500_000_000, booked, floor=100_000_000)


@query(oracles.FORECAST + "SELECT * FROM band")
def forecast_band(spark, sf_dir):
    return _projection(spark, sf_dir)


@query(oracles.FORECAST + "SELECT min(day) FILTER (shortfall) AS first_breach, CAST(min(day) FILTER (shortfall) - min(day) AS INTEGER) AS lead_days, count(*) FILTER (shortfall) AS days_below FROM band")
def forecast_shortfalls(spark, sf_dir):
    return forecast.shortfalls(_projection(spark, sf_dir))


@query(oracles.BACKTEST)
def backtest_scores(spark, sf_dir):
    return forecast.backtest(materialize(forecast.history(_cash(spark, sf_dir)), "history"))


# Functions.


@query("SELECT CAST(o_orderkey AS BIGINT) AS k, CAST(round_even(CAST(round(o_totalprice * 100) AS decimal(18,0)) * CAST(CASE o_orderkey % 3 WHEN 0 THEN 83.20 WHEN 1 THEN 90.10 ELSE 105.40 END AS decimal(10,2)), 0) AS BIGINT) AS inr FROM orders")
def fx_convert(spark, sf_dir):
    o = table(spark, sf_dir, "orders").selectExpr("cast(o_orderkey as bigint) as k", "cast(round(o_totalprice * 100) as bigint) as minor", "element_at(array('USD', 'EUR', 'GBP'), int(o_orderkey % 3) + 1) as ccy")
    return o.select("k", money.fx_to_inr(F.col("minor"), F.col("ccy")).alias("inr"))


@query("SELECT CAST(l_orderkey AS BIGINT) AS k, CAST(l_linenumber AS BIGINT) AS n, CAST(round(l_extendedprice * 100) AS BIGINT) AS minor, true AS exact FROM lineitem")
def money_minor_major(spark, sf_dir):
    minor = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("bigint").alias("k"), F.col("l_linenumber").cast("bigint").alias("n"), minor.alias("minor"))
    back = money.to_minor(money.to_major(F.col("minor")).cast("string"))
    return rows.withColumn("exact", back.eqNullSafe(F.col("minor")))


@query("""SELECT CAST(o_orderkey AS BIGINT) AS k, CASE WHEN length(w) > 3 THEN regexp_replace(reverse(regexp_replace(reverse(left(w, length(w) - 3)), '(\\d\\d)', '\\1,', 'g')), '^,', '') || ',' || right(w, 3) ELSE w END || '.' || lpad(CAST(a % 100 AS VARCHAR), 2, '0') AS grouped
          FROM (SELECT o_orderkey, a, CAST(a // 100 AS VARCHAR) AS w FROM (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS a FROM orders))""")
def lakh_grouping(spark, sf_dir):
    o = table(spark, sf_dir, "orders").selectExpr("cast(o_orderkey as bigint) as k", "cast(round(o_totalprice * 100) as bigint) as a")
    return o.select("k", money.lakh_grouped(F.col("a")).alias("grouped"))


@query(oracles.REDACTED)
def redact_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.redact(F.col("text")).alias("text"))


@chained("SELECT source || ':' || external_ref AS ref, amount_minor, currency, direction, value_date, CASE WHEN source = 'gateway' THEN CASE WHEN external_ref LIKE 'rfnd%' THEN 'refunded' ELSE 'captured' END "
         "WHEN source = 'gl' AND (SELECT case_name FROM ord WHERE k = seq // 64) = 'partial_refund' THEN 'partially_refunded' ELSE 'settled' END AS status FROM rows")  # fmt: skip
def safe_summary(spark, sf_dir):
    return text.safe_summary(over_workload(spark, sf_dir).rows)


# Serving.


@chained("SELECT subject_id, type, severity, at_risk, currency FROM found ORDER BY at_risk DESC, subject_id LIMIT 100")
def exceptions_page(spark, sf_dir):
    from ..operators import serving

    return serving.exceptions_page(over_workload(spark, sf_dir).found, limit=100).select("subject_id", "type", "severity", "at_risk", "currency")


@chained("SELECT subject_id, at_risk, currency FROM found ORDER BY at_risk DESC, subject_id LIMIT 50 OFFSET 50")
def exceptions_second_page(spark, sf_dir):
    """What the cursor of a first page of fifty leads to."""
    from ..operators import serving

    found = over_workload(spark, sf_dir).found
    cursor = serving.page(found, "exceptions", limit=50).next
    after = serving.rows_after(found, "exceptions", cursor).limit(50) if cursor else found.limit(0)
    return after.select("subject_id", "at_risk", "currency")


@chained("SELECT match_id, pass FROM matches WHERE tier = 'rule' ORDER BY match_id LIMIT 100")
def matches_page(spark, sf_dir):
    from ..operators import serving

    return serving.matches_page(matching.describe(over_workload(spark, sf_dir).edges), tier="rule").select("match_id", "pass")


@chained("SELECT txn_id, amount_minor, currency FROM rows WHERE source = 'bank' AND txn_id > 'bank:UTR_5' ORDER BY txn_id LIMIT 100")
def transactions_page(spark, sf_dir):
    from ..operators import serving

    page = serving.transactions_page(over_workload(spark, sf_dir).rows, source="bank", after="bank:UTR_5", limit=100)
    return page.select("txn_id", "amount_minor", "currency")
