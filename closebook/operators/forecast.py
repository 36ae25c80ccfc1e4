"""Cash history, bootstrap projection with booked outflows, and the walk-forward backtest.

Draws come from an integer mixer of (simulation, day, seed), so every run, engine and partitioning sees the
same paths. Simulations are rows; a path is a running sum in its own partition.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import materialize

MODULUS, ROUNDS = 2147483647, 3
PERCENTILES = (10, 50, 90)
MIN_HISTORY, SIMULATIONS, TARGET, SLACK = 14, 2000, 0.8, 0.2
# Recurring outflows as (label, day of month, amount in minor units, certainty).
RECURRING = (("Payroll", 1, 185_000_000, "booked"), ("Office rent", 5, 22_500_000, "booked"), ("Cloud infrastructure", 12, 4_800_000, "expected"))


def history(rows: DataFrame, start=None, end=None, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(day, inflow, outflow, net, quiet): one row for each calendar day, days without bank rows filled with 0.

    ``start`` and ``end`` default to the first and last observed day; rows outside are left out.
    """
    if start is not None and end is not None and end < start:
        raise ValueError("the history ends before it starts")
    bank = rows.filter("source = 'bank'")
    if exclude:
        bank = bank.filter(~F.lower(F.coalesce("counterparty", F.lit(""))).isin(*(x.lower() for x in exclude)))
    money = lambda side: F.sum(F.when(F.col("direction") == side, F.col("amount_minor")).otherwise(0)).alias(side)
    daily = bank.groupBy(F.col("value_date").alias("day")).agg(money("inbound"), money("outbound"))
    ends = daily.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))  # one row
    lo = F.lit(start).cast("date") if start is not None else F.col("lo")
    hi = F.lit(end).cast("date") if end is not None else F.greatest("hi", lo)
    days = ends.select(lo.alias("lo"), hi.alias("hi")).filter("lo IS NOT NULL AND hi IS NOT NULL").select(F.explode(F.sequence("lo", "hi")).alias("day"))
    filled = days.join(daily, "day", "left").select("day", F.coalesce("inbound", F.lit(0)).alias("inflow"), F.coalesce("outbound", F.lit(0)).alias("outflow"))
    return filled.select("*", (F.col("inflow") - F.col("outflow")).alias("net"), ((F.col("inflow") == 0) & (F.col("outflow") == 0)).alias("quiet"))


def summary(flows: DataFrame) -> DataFrame:
    return flows.agg(
        F.count(F.lit(1)).alias("days"), F.count_if("quiet").alias("quiet_days"), F.sum("inflow").alias("inflow"), F.sum("outflow").alias("outflow"),
        F.sum("net").alias("net"), F.max("net").alias("best_day"), F.min("net").alias("worst_day"),
    )


def closing_position(flows: DataFrame, opening: int = 0) -> DataFrame:
    return flows.agg((F.coalesce(F.sum("net"), F.lit(0)) + F.lit(opening)).alias("closing_minor"))


def daily_stats(flows: DataFrame) -> DataFrame:
    """Mean and sample deviation of daily net flows."""
    return flows.agg(F.avg("net").alias("mean"), F.stddev_samp("net").alias("stdev"))


def running_balance(rows: DataFrame, opening: int = 500_000_000) -> DataFrame:
    """Statement balance after each bank row, in (value_date, posted_at, external_ref, txn_id) order.

    Rows are dealt to ranges of that order, however many a day has; the ranges are summed, and only the rows
    of one range are ordered in one task.
    """
    order = ["value_date", "posted_at", "external_ref", "txn_id"]
    signed = F.when(F.col("direction") == "inbound", F.col("amount_minor")).otherwise(-F.col("amount_minor"))
    bank = rows.filter("source = 'bank'").select(*order, signed.alias("signed"))
    dealt = materialize(bank.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "balance-ranges")
    sums = dealt.groupBy("part").agg(F.sum("signed").alias("s"))
    before = sums.select("part", (F.sum("s").over(Window.orderBy("part")) - F.col("s")).alias("before"))  # a row for each range
    own = F.sum("signed").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.join(F.broadcast(before), "part").select("txn_id", "value_date", "signed", (F.lit(opening) + F.col("before") + own).alias("balance_minor"))


def recurring(spark: SparkSession, after: datetime.date, until: datetime.date) -> DataFrame:
    """Booked outflows due after ``after`` and up to ``until``, in order of due date and label."""
    template = spark.createDataFrame(list(RECURRING), "label string, dom int, amount_minor long, certainty string")
    months = spark.range(1).select(F.explode(F.expr(f"sequence(trunc(date'{after}', 'MM'), date'{until}', interval 1 month)")).alias("month"))
    due = F.make_date(F.year("month"), F.month("month"), F.col("dom")).alias("due_date")
    return months.join(F.broadcast(template)).select("label", due, "amount_minor", "certainty").filter((F.col("due_date") > F.lit(after)) & (F.col("due_date") <= F.lit(until))).orderBy("due_date", "label")


def draw(sim: Column, day: Column, seed: int, n: Column, rounds: int = ROUNDS) -> Column:
    """An index below ``n``; the same arithmetic holds in any engine with 64-bit integers."""
    x = (sim * 1000003 + day * 100000007 + F.lit(seed * 7919 + 12345).cast("bigint")) % MODULUS
    for i in range(rounds):
        x = (x * x + F.lit(1013904223 + i).cast("bigint")) % MODULUS
    return x % n


def _paths(spark: SparkSession, horizon: int, simulations: int) -> DataFrame:
    sims = spark.range(simulations).select(F.col("id").alias("sim"))
    return sims.select("sim", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(horizon).cast("bigint"))).alias("step"))


def nearest_rank(paths: DataFrame, keys: list[str], value: str, n: int) -> DataFrame:
    """p10, p50 and p90 of ``value`` by nearest rank, the rank rounded half to even."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(value))
    ranks = {p: min(n, max(1, round(p / 100 * n))) for p in PERCENTILES}
    return paths.withColumn("place", place).groupBy(*keys).agg(*(F.max(F.when(F.col("place") == r, F.col(value))).alias(f"p{p}") for p, r in ranks.items()))


def project(flows: DataFrame, start_day: datetime.date, horizon: int, opening: int, booked: DataFrame | None = None, seed: int = 7, simulations: int = SIMULATIONS, floor: int = 0) -> DataFrame:
    """(day, p10, p50, p90, booked_minor, shortfall) for each projected day."""
    spark = flows.sparkSession
    if horizon < 1:
        raise ValueError("the horizon is at least one day")
    if booked is not None and booked.filter("amount_minor < 0").limit(1).count():
        raise ValueError("booked outflows are positive amounts")
    indexed = flows.select((F.row_number().over(Window.orderBy("day")) - 1).cast("bigint").alias("idx"), "net")  # one row for each day of history
    n = indexed.count()
    if n < MIN_HISTORY:
        raise ValueError(f"{n} days of history are too few")
    drawn = _paths(spark, horizon, simulations).withColumn("idx", draw(F.col("sim"), F.col("step"), seed, F.lit(n).cast("bigint"))).join(F.broadcast(indexed), "idx")
    run = Window.partitionBy("sim").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    bands = nearest_rank(drawn.select("sim", "step", F.sum("net").over(run).alias("path")), ["step"], "path", simulations)
    bands = bands.withColumn("day", F.date_add(F.lit(start_day), (F.col("step") - 1).cast("int")))
    if booked is None:
        bands = bands.withColumn("booked_minor", F.lit(0).cast("bigint"))
    else:
        due = booked.groupBy(F.col("due_date").alias("day")).agg(F.sum("amount_minor").alias("due"))
        bands = bands.join(F.broadcast(due), "day", "left").withColumn("booked_minor", F.coalesce("due", F.lit(0)))  # at most one row for each day
    base = F.lit(opening) - F.sum("booked_minor").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    out = bands.withColumn("base", base).select("day", *((F.col("base") + F.col(f"p{p}")).alias(f"p{p}") for p in PERCENTILES), "booked_minor")
    return out.withColumn("shortfall", F.col("p10") < floor)


def shortfalls(projection: DataFrame) -> DataFrame:
    """First day below the floor, days until then, and how many days are."""
    first = projection.agg(F.min("day").alias("start"), F.min(F.when(F.col("shortfall"), F.col("day"))).alias("first_breach"), F.count_if("shortfall").alias("days_below"))
    return first.select("first_breach", F.datediff("first_breach", "start").alias("lead_days"), "days_below")


def backtest(flows: DataFrame, horizons=(7, 14, 30), seed: int = 7, simulations: int = 500, step: int = 7, min_train: int = 60) -> DataFrame:
    """(horizon, samples, mae, mape, coverage, calibrated): every cutoff is projected from the days before it only.

    Cutoffs meet simulations in a product: a row for each week of history, path and day, never for each record.
    """
    spark, longest = flows.sparkSession, max(horizons)
    indexed = flows.select((F.row_number().over(Window.orderBy("day")) - 1).cast("bigint").alias("idx"), "net")  # one row for each day of history
    n = indexed.count()
    cutoffs = spark.range(min_train, n - longest + 1, step).select(F.col("id").alias("cutoff"))
    wanted = F.explode(F.array(*(F.lit(h).cast("bigint") for h in horizons))).alias("horizon")
    drawn = cutoffs.join(_paths(spark, longest, simulations)).withColumn("idx", draw(F.col("sim"), F.col("step"), seed, F.col("cutoff")))
    drawn = drawn.join(F.broadcast(indexed), "idx").select("cutoff", "sim", "step", "net", wanted).filter("step <= horizon")
    ends = drawn.groupBy("cutoff", "horizon", "sim").agg(F.sum("net").alias("path"))
    bands = nearest_rank(ends, ["cutoff", "horizon"], "path", simulations)
    total = F.sum("net").over(Window.orderBy("idx"))
    upto = indexed.select("idx", total.alias("upto"))
    at = lambda name, idx: upto.select((F.col("idx") + 1).alias(idx), F.col("upto").alias(name))
    future = cutoffs.select("cutoff", wanted).withColumn("stop", F.col("cutoff") + F.col("horizon"))
    future = future.join(F.broadcast(at("a", "cutoff")), "cutoff").join(F.broadcast(at("b", "stop")), "stop").select("cutoff", "horizon", (F.col("b") - F.col("a")).alias("actual"))
    scored = bands.join(future, ["cutoff", "horizon"])
    miss = F.abs(F.col("p50") - F.col("actual"))
    out = scored.groupBy("horizon").agg(
        F.count(F.lit(1)).alias("samples"), F.bround(F.avg(miss), 0).cast("bigint").alias("mae"),
        F.round(F.avg(F.when(F.col("actual") != 0, miss / F.abs("actual"))), 6).alias("mape"),
        F.round(F.avg(F.col("actual").between(F.col("p10"), F.col("p90")).cast("double")), 6).alias("coverage"),
    )
    return out.withColumn("calibrated", F.abs(F.col("coverage") - TARGET) <= SLACK + 1e-9)
