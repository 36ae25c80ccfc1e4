"""Summaries in one line each, and two console reports: figures of a held-out close, and cash ahead.

Everything shown is an aggregate of a few rows, made by Spark; the driver only sets it in type. A report ends with a
verdict that is also its exit status: 0 if its figures may be used.

    python -m closebook.plans.reports figures --seed 1337 --events 15000
    python -m closebook.plans.reports cash --events 20000 --history-days 365 --horizon 45 --floor 0
    python -m closebook.plans.reports batch --events 15000
"""

from __future__ import annotations

import argparse
import datetime
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.derived import rupees
from ..operators import exceptions, forecast, ingest, matching, scoring
from ..operators.forecast import RECURRING
from ..storage import materialize, passing
from . import generator
from .close import Close, WorkloadClose

# Fixed value: what the cash account holds before the first day of history, in minor units.
OPENING = 500_000_000
RULE = "=" * 70


# Summaries: one string column, ``line``.


def _count(name: str):
    return F.format_number(F.col(name), 0)


def ingest_line(report: DataFrame) -> DataFrame:
    """Of a row of ``ingest.report`` or ``ingest.in_flight``."""
    return report.select(F.concat(_count("accepted"), F.lit(" of "), _count("total_in"), F.lit(" rows taken in: "), _count("deduplicated"), F.lit(" re-imports, "), _count("rejected"), F.lit(" rejected, "), _count("skipped"), F.lit(" skipped")).alias("line"))


def match_line(told: DataFrame) -> DataFrame:
    """Of a row of ``Close.throughput``; the share is in tenths of a percent, rounded down, so that 100 % is all."""
    share = F.when(F.col("total_in") > 0, F.expr("matched * 1000 div total_in")).otherwise(F.lit(0))
    return told.select(F.concat(_count("matched"), F.lit(" of "), _count("total_in"), F.lit(" records matched ("), F.format_number(share.cast("decimal(10,1)") / 10, 1), F.lit(" %), "), _count("unresolved"), F.lit(" open")).alias("line"))


def backtest_lines(scored: DataFrame) -> DataFrame:
    """(horizon, line) of the rows of ``forecast.backtest``."""
    percent = lambda name: F.concat(F.format_number(F.floor(F.col(name) * 1000 + 0.5).cast("decimal(20,1)") / 10, 1), F.lit(" %"))
    flag = F.when(F.col("calibrated"), "holds").otherwise("DOES NOT HOLD")
    line = F.concat(F.lit("T+"), F.col("horizon").cast("string"), F.lit(": off by "), rupees(F.col("mae")), F.lit(" ("), F.coalesce(percent("mape"), F.lit("-")), F.lit("), "), percent("coverage"), F.lit(" within the band, which "), flag, F.lit("; "), _count("samples"), F.lit(" samples"))
    return scored.select("horizon", line.alias("line"))


def batch_summary(batch: generator.Batch) -> DataFrame:
    """(measure, n) of a generated batch: events of each case, and its totals."""
    events = batch.truth.select("event_id", "case_type", "handling").distinct()
    one = lambda name, df: df.agg(F.lit(name).alias("measure"), F.count(F.lit(1)).alias("n"))
    cases = events.groupBy(F.concat(F.lit("case: "), "case_type").alias("measure")).agg(F.count(F.lit(1)).alias("n"))
    totals = events.agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("handling") == "exception").alias("true breaks"), F.count_if(F.col("handling") == "deduped").alias("expected re-imports"))
    days = F.lit((batch.end - batch.start).days + 1).cast("bigint")
    totals = totals.withColumn("days", days).unpivot([], ["events", "true breaks", "expected re-imports", "days"], "measure", "n")
    return cases.unionByName(totals).unionByName(one("rows", batch.rows)).unionByName(one("future bookings", batch.booked))


# Reports.


@dataclass
class Report:
    lines: list[str]
    ok: bool

    def __str__(self) -> str:
        return "\n".join([RULE, *self.lines, RULE])


def _lines(df: DataFrame, *order: str) -> list[str]:
    """Lines of a frame of a few rows."""
    return [r.line for r in (df.orderBy(*order) if order else df).collect()]


def _money(df: DataFrame, minor: str, label: str) -> DataFrame:
    return df.select(F.col(label).alias("label"), *(c for c in df.columns if c not in (label, minor)), rupees(F.col(minor)).alias("money"))


def figures(close: WorkloadClose, seed: int) -> Report:
    """The figures of a close whose events are known; not ok if they may not be published."""
    _, told = ingest.in_flight(close.arrived.select("*", F.lit("ok").alias("outcome")))
    speed, score = close.throughput(), close.scores().first()
    held = seed == generator.HELD_OUT_SEED
    out = [f"Figures of seed {seed}: " + ("held out" if held else "a development seed, not to be reported"), "", *_lines(ingest_line(told)), *_lines(match_line(speed))]
    out += [f"{speed.first().records_per_sec:,.0f} records a second", ""]
    out += [f"events matched      {score.matched:,} of {score.should_match:,} ({score.match_rate:.2%})", f"breaks surfaced     {score.breaks_surfaced:,} of {score.breaks_planted:,} ({score.break_recall:.2%})"]
    out += [f"held as ambiguous   {score.ambiguous_held:,} of {score.ambiguous_planted:,}", f"false matches       {score.false_matches:,} (0 is asked)", f"unexplained records {score.unexplained:,} (0 is asked)", "", "Exceptions"]
    out += [f"  {r.label:<28}{r.n:>8,}  {r.money:>22}" for r in _money(exceptions.by_type(close.found), "at_risk", "type").collect()] + ["", "Records by tier"]
    out += [f"  {r.tier:<28}{r.records:>8,}" for r in matching.tier_breakdown(close.edges).collect()]
    if missed := scoring.missed_by_case(close.per_event).orderBy(F.desc("missed"), "case_type").collect():
        out += ["", "Missed"] + [f"  {r.case_type:<28}{r.missed:>8,}" for r in missed]
    wrong = scoring.problems(score)
    return Report(out + ["", "May be published." if not wrong else "May NOT be published:", *(f"  {w}" for w in wrong)], not wrong)


def cash(batch: generator.Batch, horizon: int = generator.BOOKED_DAYS, floor: int = 0, greedy: bool = False) -> Report:
    """Cash ahead of a batch, the back-test before the projection; not ok if its history is too short to project from.

    Parties with booked outflows are left out of the history, so that none is counted twice.
    """
    close = Close(batch.rows, greedy)
    flows = materialize(forecast.history(close.rows, batch.start, batch.end, tuple(label for label, *_ in RECURRING)), "history")
    shape = forecast.summary(flows).withColumns({"money_in": rupees(F.col("inflow")), "money_out": rupees(F.col("outflow"))}).first()
    out = [f"Cash ahead of {batch.end}, seed {batch.seed}", "", f"history   {shape.days:,} days, {shape.quiet_days:,} of them quiet; in {shape.money_in}, out {shape.money_out}", *_lines(match_line(close.throughput()))]
    if shape.days < forecast.MIN_HISTORY:
        return Report([*out, "", f"No projection: {shape.days} days of history are too few"], False)
    scored = materialize(forecast.backtest(flows), "scored")
    holds = scored.agg((F.count(F.lit(1)) > 0) & F.coalesce(F.bool_and("calibrated"), F.lit(False))).first()[0]
    out += ["", "Back-test", *(f"  {x}" for x in _lines(backtest_lines(scored), "horizon"))]
    if not holds:
        out.append("  The band does not hold up: take the projection as an indication only.")
    opening = forecast.closing_position(flows, OPENING).first()[0]
    first = batch.end + datetime.timedelta(days=1)
    due = batch.booked.filter(F.col("due_date") < F.lit(first + datetime.timedelta(days=horizon)))
    out += ["", "Booked", *(f"  {r.due_date}  {r.label:<24}{r.money:>22}  {r.certainty}" for r in _money(due, "amount_minor", "label").orderBy("due_date", "label").collect())]
    days = materialize(forecast.project(flows, first, horizon, opening, batch.booked, floor=floor), "projection")
    shown = days.filter((F.col("booked_minor") > 0) | (F.dayofmonth("day") == 1) | (F.col("day") == F.lit(first + datetime.timedelta(days=horizon - 1))))
    shown = shown.select("day", *(rupees(F.col(p)).alias(p) for p in ("p10", "p50", "p90")), F.when(F.col("booked_minor") > 0, "  booked").otherwise("").alias("mark"))
    out += ["", f"Projection{'':<2}{'P10':>22}{'P50':>22}{'P90':>22}", *(f"  {r.day}{r.p10:>22}{r.p50:>22}{r.p90:>22}{r.mark}" for r in shown.orderBy("day").collect())]
    low = forecast.shortfalls(days).first()
    told = f"{low.days_below} days below the floor, the first on {low.first_breach}, {low.lead_days} days ahead" if low.days_below else f"no day below the floor within {horizon} days"
    return Report([*out, "", told], True)


def batch(made: generator.Batch) -> Report:
    counts = batch_summary(made).orderBy("measure").collect()
    return Report([f"Batch of seed {made.seed}, {made.start} to {made.end}", *(f"  {r.measure:<32}{r.n:>10,}" for r in counts)], True)


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description="Reports on generated batches.")
    p.add_argument("report", choices=["figures", "cash", "batch"])
    p.add_argument("--seed", type=int)
    p.add_argument("--events", type=int, default=15_000)
    p.add_argument("--history-days", type=int)
    p.add_argument("--horizon", type=int, default=generator.BOOKED_DAYS)
    p.add_argument("--floor", type=int, default=0)
    a = p.parse_args(args)
    seed = a.seed if a.seed is not None else generator.HELD_OUT_SEED if a.report == "figures" else generator.SEED
    days = a.history_days or (365 if a.report == "cash" else generator.HISTORY_DAYS)
    spark = SparkSession.builder.appName("reports").getOrCreate()
    with passing(spark):
        made = generator.generate(spark, a.events, seed, history_days=days)
        report = figures(WorkloadClose(made.rows, truth=made.truth), seed) if a.report == "figures" else cash(made, a.horizon, a.floor) if a.report == "cash" else batch(made)
        print(report)
    return 0 if report.ok else 1


if __name__ == "__main__":
    raise SystemExit(main())
