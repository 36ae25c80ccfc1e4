"""Deduplication with first-wins, and the ingestion report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .metrics import measured

KEY = ("source", "external_ref")


def dedupe(rows: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """The first row (by ``seq``) of each (source, external_ref); keys in ``seen`` are known from earlier batches."""
    if seen is not None:
        rows = rows.join(seen.select(*KEY).distinct(), list(KEY), "left_anti")
    order = Window.partitionBy(*KEY).orderBy("seq")
    rows = rows.repartition(*KEY)  # else rows would be sorted where they lie first, for the few that are no first of their key
    return rows.withColumn("copy", F.row_number().over(order)).filter("copy = 1").drop("copy")


def report(parsed: DataFrame) -> DataFrame:
    """One row: total_in, accepted, deduplicated, rejected, skipped. ``parsed`` has ``outcome`` ok, skip or reject.

    What is accepted is counted by key, without choosing the first of each.
    """
    good = F.col("outcome") == "ok"
    per_key = parsed.groupBy(*(F.when(good, F.col(c)).alias(c) for c in KEY), "outcome").agg(F.count(F.lit(1)).alias("n"))
    counts = per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_in"), F.count_if(good).alias("accepted"), F.coalesce(F.sum(F.when(good, F.col("n") - 1)), F.lit(0)).alias("deduplicated"),
        F.coalesce(F.sum(F.when(F.col("outcome") == "reject", F.col("n"))), F.lit(0)).alias("rejected"), F.coalesce(F.sum(F.when(F.col("outcome") == "skip", F.col("n"))), F.lit(0)).alias("skipped"),
    )
    return counts.select("total_in", "accepted", "deduplicated", "rejected", "skipped")


def in_flight(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The accepted rows, written, and a row like that of ``report`` with seconds and records_per_sec.

    Both come from the two writes themselves: what is read is counted as it is written, and so is what is kept.
    """
    is_ = lambda outcome: F.count_if(F.col("outcome") == outcome)
    read = measured(parsed, "parsed", total_in=F.count(F.lit(1)), good=is_("ok"), rejected=is_("reject"), skipped=is_("skip"))
    kept = measured(dedupe(read.rows.filter("outcome = 'ok'")), "accepted", accepted=F.count(F.lit(1)))
    n, accepted, seconds = read.counts, kept.counts["accepted"], read.seconds + kept.seconds
    row = (n["total_in"], accepted, n["good"] - accepted, n["rejected"], n["skipped"], seconds, n["total_in"] / seconds)
    told = parsed.sparkSession.createDataFrame([row], "total_in long, accepted long, deduplicated long, rejected long, skipped long, seconds double, records_per_sec double")
    check(told.first())
    return kept.rows, told


def per_source(accepted: DataFrame) -> DataFrame:
    return accepted.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def check(row) -> None:
    """Every row in is accepted, deduplicated, rejected or skipped."""
    if row.total_in != row.accepted + row.deduplicated + row.rejected + row.skipped or row.deduplicated < 0:
        raise ValueError(f"ingestion does not balance: {row}")
