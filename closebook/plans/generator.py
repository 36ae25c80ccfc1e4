"""Batches on demand: any number of events from a seed, a mix of cases and a span of days.

Every number of an event is drawn from the md5 of (seed, stream, event), so an event is a function of its number: a
batch is the same over any number of partitions, any slice of it can be made alone, and a lost task makes its own events
again. Nothing is shuffled. The arithmetic is the same text for Spark and DuckDB.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import forecast, shuffle
from ..operators.forecast import RECURRING
from . import workload
from .close import WorkloadClose

# Shares of the cases, names, last day, days of future bookings.
MIX = {
    "clean": 0.53, "fee_lag": 0.17, "one_to_many": 0.05, "one_to_many_no_utr": 0.03, "partial_refund": 0.05, "fx": 0.03,
    "duplicate_same_ref": 0.015, "duplicate_double_pay": 0.015, "break_no_bank": 0.035, "break_no_gl": 0.025, "outflow_vendor": 0.05,
}
PARTIES = ("Acme Retail", "Blue Mart", "Ganesh Traders", "Nova Foods", "Star Textiles", "Metro Cabs", "Sunrise Pharma", "Zen Books")
VENDORS = ("Kraft Supplies", "Indus Logistics", "Vertex Print", "Orbit Facilities", "Trinity Legal")
END, HISTORY_DAYS, SEED, HELD_OUT_SEED, BOOKED_DAYS = datetime.date(2026, 8, 30), 30, 42, 1337, 45
#: Ordinals of rows stay below this.
ORDINALS = 1 << 60
WHOLE = 1 << 32


def _bits(hexed: str, k: int, spark: bool) -> str:
    """The k-th 32 bits of a hex digest."""
    part = f"substr({hexed}, {8 * k + 1}, 8)"
    return f"CAST(conv({part}, 16, 10) AS BIGINT)" if spark else f"CAST('0x' || {part} AS BIGINT)"


def _paise(draw: str) -> str:
    return f"CASE {draw} % 6 WHEN 3 THEN 50 WHEN 4 THEN 99 WHEN 5 THEN 25 ELSE 0 END"


def _case(draw: str, mix: dict[str, float]) -> str:
    """The case of a draw below 2^32, by the weights' running sums."""
    if not mix or min(mix.values()) < 0 or sum(mix.values()) <= 0:
        raise ValueError("a mix has weights of 0 or more, and one above 0")
    if unknown := sorted(set(mix) - {name for name, _, _ in workload.CASES}):
        raise ValueError(f"no case is named {unknown}")
    held, text = 0.0, "CASE"
    for name, weight in mix.items():
        held += weight
        if weight:
            text += f" WHEN {draw} < {round(held / sum(mix.values()) * WHOLE)} THEN '{name}'"
    return text + " END"


def _one_of(names: tuple[str, ...], draw: str) -> str:
    return f"CASE {draw} % {len(names)} " + " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(names)) + " END"


def _events_sql(ids: str, seed: int, mix: dict[str, float], history_days: int, end: datetime.date, spark: bool) -> str:
    """k and all that is drawn for it, without lines."""
    bits = lambda h, k: _bits(h, k, spark)
    start = end - datetime.timedelta(days=history_days - 1)
    day = f"date_add(date'{start}', int(day))" if spark else f"DATE '{start}' + CAST(day AS INTEGER)"
    half_even = "bround" if spark else "round_even"
    return f"""
SELECT k, case_name, amt, (amt - amt % 50) / 50 + CASE WHEN amt % 50 > 25 OR (amt % 50 = 25 AND (amt - 25) / 50 % 2 = 1) THEN 1 ELSE 0 END AS fee, {day} AS d, party, n_lines, foreign_ccy, lag, 0 AS off,
       CAST({half_even}(CAST(amt - amt % 100 AS decimal(18,0)) * CAST(CASE foreign_ccy WHEN 'USD' THEN 83.20 WHEN 'EUR' THEN 90.10 ELSE 105.40 END AS decimal(10,2)), 0) AS bigint) AS inr
FROM (SELECT k, case_name, day, lag, n_lines, CASE ccy WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'GBP' END AS foreign_ccy,
             CASE WHEN case_name = 'outflow_vendor' THEN {_one_of(VENDORS, 'who')} ELSE {_one_of(PARTIES, 'who')} END AS party,
             CASE case_name WHEN 'partial_refund' THEN (2000 + u % 48001) * 100 + paise WHEN 'outflow_vendor' THEN (5000 + u % 395001) * 100 + paise WHEN 'fx' THEN (50 + u % 1951) * 100 ELSE (500 + u % 199501) * 100 + paise END AS amt
      FROM (SELECT k, {_case(bits('x', 0), mix)} AS case_name, {bits('x', 1)} % {history_days} AS day, {bits('x', 2)} AS u, {_paise(bits('x', 3))} AS paise,
                   {bits('y', 0)} AS who, 1 + {bits('y', 1)} % 2 AS lag, {bits('y', 2)} % 3 AS ccy, 2 + {bits('y', 3)} % 3 AS n_lines
            FROM (SELECT k, md5('{seed}:0:' || k) AS x, md5('{seed}:1:' || k) AS y FROM {ids}) AS drawn) AS a) AS b
"""


def _line(seed: int, spark: bool) -> str:
    hexed = f"md5('{seed}:2:' || k || ':' || n)"
    return f"(500 + {_bits(hexed, 0, spark)} % 19501) * 100 + {_paise(_bits(hexed, 1, spark))}"


MANY = "('one_to_many', 'one_to_many_no_utr')"


def due(end: datetime.date, history_days: int) -> list[tuple[str, str, int, int]]:
    """(label, day, amount, number) of the recurring outflows of the span: a few for each month."""
    start, out = end - datetime.timedelta(days=history_days - 1), []
    year, month = start.year, start.month
    while (year, month) <= (end.year, end.month):
        for label, dom, amount, _ in RECURRING:
            day = datetime.date(year, month, dom)
            if start <= day <= end:
                out.append((label, day.isoformat(), amount, year * 10_000 + month * 100 + dom))
        year, month = (year + 1, 1) if month == 12 else (year, month + 1)
    return out


def events(spark: SparkSession, n_events: int, seed: int = SEED, mix: dict[str, float] | None = None, history_days: int = HISTORY_DAYS, end: datetime.date = END, partitions: int | None = None, first: int = 1) -> DataFrame:
    """Events ``first`` .. ``n_events`` with all that is drawn for them; lines as an array."""
    if n_events < 0 or history_days < 1:
        raise ValueError("a batch has 0 or more events over one or more days")
    ids = spark.range(first, n_events + 1, 1, partitions).withColumnRenamed("id", "k")
    drawn = spark.sql(_events_sql("{ids}", seed, mix or MIX, history_days, end, True), ids=ids)
    line = f"named_struct('n', CAST(n AS bigint), 'line', CAST({_line(seed, True)} AS bigint))"
    lines = F.expr(f"CASE WHEN case_name IN {MANY} THEN transform(sequence(1, CAST(n_lines AS int)), n -> {line}) ELSE array() END")
    return drawn.withColumn("lines", lines).withColumn("total", F.expr("CASE WHEN size(lines) > 0 THEN aggregate(lines, bigint(0), (s, x) -> s + x.line) END"))


@dataclass
class Batch:
    """What a generator yields: rows as they arrive, the answer key, and what is booked after the last day; ``known`` are the rows with their event and case."""

    rows: DataFrame
    truth: DataFrame
    booked: DataFrame
    start: datetime.date
    end: datetime.date
    seed: int
    known: DataFrame


def generate(spark: SparkSession, n_events: int, seed: int = SEED, mix: dict[str, float] | None = None, history_days: int = HISTORY_DAYS, end: datetime.date = END, partitions: int | None = None, shuffled: bool = False) -> Batch:
    """A batch: the same for the same seed, mix and span, however it is partitioned; recurring outflows come on top.

    With ``shuffled`` rows arrive in an order that tells nothing about events: ``seq`` is a place and not an ordinal.
    """
    drawn = events(spark, n_events, seed, mix, history_days, end, partitions)
    listed = workload.recurring_rows(spark, due(end, history_days))
    known = workload.rows_of(drawn, "k", "case_name").unionByName(listed.selectExpr("*", "seq div 64 AS k", "'outflow_recurring' AS case_name"))
    known = known.withColumnsRenamed({"k": "event_id", "case_name": "case_type"})
    booked = forecast.recurring(spark, end, end + datetime.timedelta(days=BOOKED_DAYS))
    if shuffled:
        known = shuffle.placed(known, "seq", seed, ORDINALS, "seq")
    return Batch(known.drop("event_id", "case_type"), key(known), booked, end - datetime.timedelta(days=history_days - 1), end, seed, known)


def key(known: DataFrame) -> DataFrame:
    """The answer key of rows that have their event and case."""
    handling = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in workload.HANDLING.items() for x in kv]), F.col("case_type")), F.lit("matched"))
    dealt = known.select("event_id", "case_type", "source", "external_ref").repartition("source", "external_ref")  # as the join by the key needs it
    return dealt.distinct().withColumn("handling", handling).select("event_id", "case_type", "handling", "source", "external_ref")


def run(spark: SparkSession, n_events: int, seed: int = HELD_OUT_SEED, greedy: bool = False, **options) -> WorkloadClose:
    """The close of a generated batch, by default of a seed that nothing was tuned on; ``scores()`` judges it.

    Events are drawn once: they are stored with the rows, and the key is made of what is stored.
    """
    return WorkloadClose(generate(spark, n_events, seed, **options).known, greedy, key)


def feed_sql(n: str, seed: int = SEED, mix: dict[str, float] | None = None, history_days: int = HISTORY_DAYS, end: datetime.date = END) -> str:
    """The CTEs order_line, ord and feed of a generated batch in DuckDB's SQL; ``n`` is a scalar expression."""
    ids = f"(SELECT CAST(unnest(range(1, {n} + 1)) AS BIGINT) AS k)"
    drawn = f"drawn_events AS ({_events_sql(ids, seed, mix or MIX, history_days, end, False)})"
    lines = f"order_line AS (SELECT k AS l_k, CAST(n AS BIGINT) AS n, CAST({_line(seed, False)} AS BIGINT) AS line FROM (SELECT k, unnest(range(1, n_lines + 1)) AS n FROM drawn_events WHERE case_name IN {MANY}))"
    ord_ = "ord AS (SELECT * FROM drawn_events LEFT JOIN (SELECT l_k AS t_k, CAST(sum(line) AS BIGINT) AS total FROM order_line GROUP BY 1) ON k = t_k)"
    return workload.feed_sql(f"{drawn}, {lines}, {ord_}", due(end, history_days))
