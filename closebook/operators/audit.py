"""The decision trail of a run: what was taken in, matched, refused and raised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import kept, union_all
from .matching import described

ENTRY = ["phase", "decision", "actor", "subjects", "reason", "confidence", "tier", "amount_minor", "currency"]


def _entries(rows: DataFrame, phase: int, decision: str, actor: str | Column, subjects: Column, reason: Column, **more: Column) -> DataFrame:
    null = lambda kind: F.lit(None).cast(kind)
    kinds = {"confidence": "double", "tier": "string", "amount_minor": "bigint", "currency": "string"}
    return rows.select(
        F.lit(phase).alias("phase"), F.lit(decision).alias("decision"), (actor if isinstance(actor, Column) else F.lit(actor)).alias("actor"), subjects.cast("array<string>").alias("subjects"),
        reason.cast("string").alias("reason"), *(more.get(k, null(t)).cast(t).alias(k) for k, t in kinds.items()),
    )


def trail(report: DataFrame, rejects: DataFrame, edges: DataFrame, found: DataFrame, matches: DataFrame | None = None, matched: int | None = None) -> DataFrame:
    """All entries of a batch. Subjects are references ``source:external_ref``, never names.

    ``rejects`` has (source, locator, reason). A match of many lines lists its one right-hand side. Who has ``matches`` (as
    ``described`` makes them of the edges) or the number of ``matched`` records already gives them, and they are not made again.
    """
    none = F.array().cast("array<string>")
    report = kept(report, "report")  # one row, which three parts read
    counted = (described(edges) if matches is None else matches).filter("right_id IS NOT NULL")
    subject = F.array("subject_id")
    refused = found.filter("candidates > 0")
    known = edges.agg(F.count_distinct("txn_id").alias("matched")) if matched is None else edges.sparkSession.createDataFrame([(matched,)], "matched long")
    closing = known.join(F.broadcast(found.agg(F.count(F.lit(1)).alias("raised"), F.coalesce(F.sum("at_risk"), F.lit(0)).alias("at_risk"))))  # one row each
    parts = [
        _entries(report, 0, "batch_started", "pipeline", none, F.format_string("%d rows received", "total_in")),
        _entries(report, 1, "record_ingested", "pipeline", none, F.format_string("%d rows accepted", "accepted")),
        _entries(report.filter("deduplicated > 0"), 2, "record_deduplicated", "pipeline", none, F.format_string("%d re-imports dropped", "deduplicated")),
        _entries(rejects, 3, "record_rejected", F.concat(F.lit("connector."), "source"), F.array(F.concat_ws(":", "source", "locator")), F.col("reason")),
        _entries(counted, 4, "match_made", F.concat(F.lit("matcher."), "tier"), F.array("right_id"), F.format_string("%s of %d rows", "pass", F.col("n_left") + F.col("n_right")), confidence=F.col("confidence"), tier=F.col("tier")),
        _entries(refused, 5, "match_refused", F.concat(F.lit("exception."), "category"), subject, F.format_string("%d candidates, none certain", "candidates")),
        _entries(found, 6, "exception_raised", F.concat(F.lit("exception."), "category"), subject, F.col("category"), amount_minor=F.col("at_risk"), currency=F.col("currency")),
        _entries(closing, 7, "batch_completed", "pipeline", none, F.format_string("%d records matched, %d exceptions, %d minor units at risk", "matched", "raised", "at_risk")),
    ]
    return union_all(parts)


def counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("decision").agg(F.count(F.lit(1)).alias("n"))
