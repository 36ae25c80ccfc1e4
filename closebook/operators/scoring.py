"""Results against the planted answer key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["source", "external_ref"]
AMBIGUOUS = "one_to_many_no_utr"
#: A bridge that joins no more records than this says nothing.
SOUND = 100


def flags(unresolved: DataFrame, lines: DataFrame, found: DataFrame) -> DataFrame:
    """(source, external_ref, open, flagged) of the records that are unmatched or the subject of an exception.

    Those are few, and an exception's subject is one of the unresolved rows or of the unbanked ``lines``: matched records are known by
    not being among them, so no edge is read.
    """
    some = unresolved.select("txn_id", *KEY, F.lit(1).alias("open")).unionByName(lines.select("txn_id", *KEY, F.lit(0).alias("open")))
    told = some.join(found.select(F.col("subject_id").alias("txn_id"), F.lit(1).alias("flagged")), "txn_id", "left")
    return told.groupBy(*KEY).agg(F.max("open").alias("open"), F.coalesce(F.max("flagged"), F.lit(0)).alias("flagged"))


def owned(rows: DataFrame, truth: DataFrame, flagged: DataFrame | None = None) -> DataFrame:
    """Records with their event, and with ``flags`` if those are given; the bridge is (source, external_ref)."""
    known = rows.select("txn_id", *KEY).join(truth, KEY)
    if flagged is None:
        return known.select("txn_id", "source", "event_id", "case_type", "handling")
    told = known.join(flagged, KEY, "left")
    return told.select("txn_id", "source", "event_id", "case_type", "handling", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("open", "flagged")))


def events(known: DataFrame) -> DataFrame:
    """(event_id, case_type, handling, records, matched, flagged, bank_matched) for each event with records."""
    matched = 1 - F.col("open")
    return known.groupBy("event_id", "case_type", "handling").agg(
        F.count(F.lit(1)).alias("records"), F.sum(matched).alias("matched"), F.sum("flagged").alias("flagged"), F.sum(F.when(F.col("source") == "bank", matched).otherwise(0)).alias("bank_matched"),
    )


def false_matches(known: DataFrame, edges: DataFrame) -> DataFrame:
    """Matches that span more than one event."""
    spread = edges.join(known.select("txn_id", "event_id"), "txn_id").groupBy("match_id", "pass").agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))
    return spread.filter("lo <> hi").select("match_id", "pass")


def scores(per_event: DataFrame, wrong: DataFrame, unexplained: DataFrame) -> DataFrame:
    """One row: coverage, breaks, ambiguity, false matches, lost records, the bridge, and the verdict.

    An event that should match does so if all its records are matched. A break surfaces if any record is
    flagged. An ambiguous settlement is held if no bank record of it is matched. Figures may be published if
    the bridge joins something, no match is false, no record is lost and no ambiguity was resolved by a guess.
    """
    due, planted, unclear = F.col("handling") == "matched", F.col("handling") == "exception", F.col("case_type") == AMBIGUOUS
    row = per_event.agg(
        F.count_if(due).alias("should_match"), F.count_if(due & (F.col("matched") == F.col("records"))).alias("matched"),
        F.count_if(planted).alias("breaks_planted"), F.count_if(planted & (F.col("flagged") > 0)).alias("breaks_surfaced"),
        F.count_if(unclear).alias("ambiguous_planted"), F.count_if(unclear & (F.col("bank_matched") == 0)).alias("ambiguous_held"),
        F.coalesce(F.sum("records"), F.lit(0)).alias("owned"), F.coalesce(F.sum(F.col("matched")), F.lit(0)).cast("long").alias("owned_matched"),
    )
    both = row.join(F.broadcast(wrong.agg(F.count(F.lit(1)).alias("false_matches")))).join(F.broadcast(unexplained.agg(F.count(F.lit(1)).alias("unexplained"))))  # one row each
    rate = lambda part, whole: F.round(F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0), 6)
    sound = (F.col("owned") > SOUND) & (F.col("owned_matched") > SOUND)
    clean = (F.col("false_matches") == 0) & (F.col("unexplained") == 0) & (F.col("ambiguous_held") >= F.col("ambiguous_planted"))
    out = both.withColumns({"match_rate": rate("matched", "should_match"), "break_recall": rate("breaks_surfaced", "breaks_planted"), "bridge_sound": sound})
    return out.withColumn("publishable", F.col("bridge_sound") & clean).drop("owned", "owned_matched")


def problems(score) -> list[str]:
    """Why the figures of a row of ``scores`` may not be published."""
    out = []
    if not score.bridge_sound:
        out.append("the answer key joins almost no record, so no figure means anything")
    if score.false_matches:
        out.append(f"{score.false_matches} matches join records of different events")
    if score.unexplained:
        out.append(f"{score.unexplained} records are neither matched nor an exception")
    if score.ambiguous_held < score.ambiguous_planted:
        out.append(f"{score.ambiguous_planted - score.ambiguous_held} ambiguous settlements were resolved by a guess")
    return out


def missed_by_case(per_event: DataFrame) -> DataFrame:
    missed = per_event.filter("handling = 'matched' AND matched < records")
    return missed.groupBy("case_type").agg(F.count(F.lit(1)).alias("missed"))
