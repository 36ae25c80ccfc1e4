"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Everything here is DataFrame operations; no Python runs on executors.

* A document's size is its number of words (null text: 0).
* Sources, ordered by code point with null last, get the weights in turn. They share ``budget`` times all
  words by weight; a target stops at ``max_epochs`` times its source's words, and what that leaves over is
  shared again by weight among the others until no target is above its limit. The fixed point of those
  rounds is found in one pass: in order of limit/weight the clamped sources are a prefix.
* Of a source with target T and W words every document is taken floor(T/W) whole times. What is left of
  the target goes to the documents in a seeded order, each once more, and the last of them in part, so
  that a source meets its target to the word.

The seeded order never gathers a source in one task: a source is cut into about sqrt(n) ranges of the
seeded key, their sums locate the one range in which the target is reached, and only its documents are
ordered. The key is made of doc_id and text, so rows that share a doc_id, or have none, are spread too.
Reruns agree: ties of the key fall to doc_id and then size; rows alike in all three are interchangeable.
Empty input gives no rows; sources without words have target 0; extra columns of any name are kept by
``repeat`` and ignored by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small

WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _keyed(docs: DataFrame, seed: int) -> DataFrame:
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col("text"), F.lit("")))))
    return docs.withColumns(
        {"mix_size": words_of(F.col("text")), "mix_key": F.conv(F.substring(key, 1, 13), 16, 10).cast("long")}
    )


def targets(per_source: DataFrame, weights=(3, 1, 2), budget: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """Add ``target`` to rows (source, source_size, ...), one for each source.

    The two orders need all sources in one place: a row for each source, not for each document.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    ranked = per_source.withColumns({"weight": pick.cast("double"), "cap": (F.col("source_size") * max_epochs).cast("double")})
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    level = (
        F.sum("source_size").over(whole) * budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    ) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levelled = ranked.withColumns({"level": level, "place": F.row_number().over(order)}).withColumn(
        "clamped", F.col("cap") <= F.col("level") * F.col("weight")
    )
    share = F.min_by(F.when(~F.col("clamped"), F.col("level")), F.when(~F.col("clamped"), F.col("place"))).over(whole)
    return levelled.withColumn("target", F.when(F.col("clamped"), F.col("cap")).otherwise(share * F.col("weight"))).drop(
        "weight", "cap", "level", "place", "clamped"
    )


def _bucket(n: Column) -> Column:
    """The document's range of the 52-bit key, of about sqrt(n) equal ranges."""
    ranges = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    return F.shiftright(F.shiftright(F.col("mix_key"), 20) * ranges, 32)


def plan(sizes: DataFrame, weights=(3, 1, 2), budget: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """One row for each source: its target, whole repetitions, and where the seeded order stops."""
    per_source = sizes.groupBy("source").agg(F.sum("mix_size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    goal = materialize(
        targets(per_source, weights, budget, max_epochs)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", F.greatest(F.lit(0), F.floor(F.col("target")) - F.col("whole") * F.col("source_size")).cast("long")),
        "mix-goal",
    )
    keyed = sizes.join(small(goal.select(F.col("source").alias("g_source"), "n_docs")), F.col("source").eqNullSafe(F.col("g_source")))
    sums = keyed.groupBy("source", _bucket(F.col("n_docs")).alias("bucket")).agg(F.sum("mix_size").alias("words"))
    running = sums.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("bucket")))
    rest = goal.select(F.col("source").alias("g_source"), "rest")
    stop = (
        running.join(small(rest), F.col("source").eqNullSafe(F.col("g_source")))
        .filter(F.col("upto") > F.col("rest"))
        .groupBy("source")
        .agg(F.min(F.struct("bucket", (F.col("rest") - F.col("upto") + F.col("words")).alias("left"))).alias("stop"))
        .select(F.col("source").alias("s_source"), "stop.bucket", "stop.left")
    )
    out = goal.join(stop, F.col("source").eqNullSafe(F.col("s_source")), "left").select(
        F.col("source").alias("p_source"), "source_size", "n_docs", "target", "whole",
        F.coalesce("bucket", F.lit(-1)).alias("stop_bucket"), F.coalesce("left", F.lit(0)).alias("left"),
    )
    return materialize(out, "mix-plan")


def _assign(docs: DataFrame, per_source: DataFrame) -> DataFrame:
    """Add ``whole`` and ``extra``, the words of the repetition after the whole ones."""
    joined = docs.join(small(per_source), F.col("source").eqNullSafe(F.col("p_source")))
    joined = joined.withColumn("mix_at", _bucket(F.col("n_docs")) - F.col("stop_bucket"))
    sure = joined.filter("mix_at <> 0").withColumn("extra", F.when(F.col("mix_at") < 0, F.col("mix_size")).otherwise(F.lit(0)).cast("long"))
    order = Window.partitionBy("source").orderBy("mix_key", "doc_id", "mix_size")
    done = F.sum("mix_size").over(order.rowsBetween(Window.unboundedPreceding, -1))
    edge = joined.filter("mix_at = 0").withColumn(
        "extra", F.greatest(F.lit(0), F.least(F.col("mix_size"), F.col("left") - F.coalesce(done, F.lit(0)))).cast("long")
    )
    return sure.unionByName(edge)


def mix(docs: DataFrame, weights=(3, 1, 2), budget: float = 1.5, max_epochs: int = 2, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target, whole (repetitions), taken (words, repetitions counted)."""
    sizes = materialize(_keyed(docs.select("doc_id", "source", "text"), seed).drop("text"), "mix-sizes")
    return _assign(sizes, plan(sizes, weights, budget, max_epochs)).select(
        "doc_id", F.col("mix_size").alias("size"), "source_size", "target", "whole",
        (F.col("whole") * F.col("mix_size") + F.col("extra")).alias("taken"),
    )


def repeat(docs: DataFrame, weights=(3, 1, 2), budget: float = 1.5, max_epochs: int = 2, seed: int = 17) -> DataFrame:
    """The mixed documents themselves: a row for each repetition, columns as in ``docs``.

    Documents stay whole: the one that a target cuts is repeated once more if at least half of it is taken.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("mix_row")  # names of its own can clash with nothing
    keyed = _keyed(docs.select(row, "doc_id", "source", "text"), seed).drop("text")
    sizes = materialize(keyed.drop("mix_row"), "mix-sizes")
    more = ((F.col("extra") > 0) & (2 * F.col("extra") >= F.col("mix_size"))).cast("int")
    times = (F.col("whole") + more).cast("int")
    mixed = _assign(keyed, plan(sizes, weights, budget, max_epochs))
    return mixed.select("mix_row", F.explode(F.array_repeat(F.lit(1), times))).select("mix_row.*")


#: The same mix in DuckDB's SQL: plain windows over whole sources.
ORACLE_SQL = r"""
WITH s AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) AS k
  FROM documents),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
r AS (SELECT *, (ARRAY[3, 1, 2])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w,
             (2 * source_size)::DOUBLE AS cap FROM p),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5
               - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lev,
             row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS place FROM r),
f AS (SELECT arg_min(lev, place) AS lev FROM l WHERE NOT (cap <= lev * w)),
t AS (SELECT source, source_size, CASE WHEN cap <= l.lev * w THEN cap ELSE (SELECT lev FROM f) * w END AS target FROM l),
g AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
h AS (SELECT *, greatest(0, CAST(floor(target) AS BIGINT) - whole * source_size) AS rest FROM g),
c AS (SELECT s.*, h.source_size, h.target, h.whole, h.rest,
             coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY k, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done
      FROM s JOIN h ON s.source IS NOT DISTINCT FROM h.source)
SELECT doc_id, size, source_size, target, whole,
       CAST(whole * size + greatest(0, least(size, rest - done)) AS BIGINT) AS taken
FROM c
"""
