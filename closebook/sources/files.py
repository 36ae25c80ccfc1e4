"""Raw files of a feed, damaged ones among them: every line gets its place, and no bad line stops or vanishes.

Lines are read in splits, as many tasks to a file as it has splits. A line's number in its split, and the counts of the
splits before it in its file, give its number in the file: ``file, record #i``, from 0. Only the few rows of split counts
are ordered, file by file; lines are not. The lines are written once with their split, so that numbers can't change if a
task is run again or the cluster grows between two scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import materialize, small
from .feeds import CONNECTORS, RAW

#: Columns that connectors carry along: where a row stood, and the text of a line that can't be read.
PLACE, DAMAGED = "_place", "_damaged"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, value): every line of the files under ``path`` with its number in its file, blank ones included."""
    read = spark.read.text(path).select(
        F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), "value"
    )
    held = materialize(read, "raw-lines")
    counts = held.groupBy("file_path", "split").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("file_path").orderBy("split")) - F.col("n")  # a row for each split
    starts = materialize(counts.select("file_path", "split", (before - F.col("first")).alias("shift")), "raw-splits")
    return held.join(small(starts), ["file_path", "split"]).select("file", (F.col("at") + F.col("shift")).alias("record"), "value")


def _placed(of: DataFrame) -> DataFrame:
    return of.withColumn(PLACE, F.concat("file", F.lit(", record #"), F.col("record").cast("string")))


def read_json(spark: SparkSession, source: str, path: str) -> DataFrame:
    """Raw rows of JSON lines. What is no JSON object of the declared types has its text in ``_damaged``; blank lines are no records."""
    kind = f"{RAW[source]}, {DAMAGED} string"
    parsed = F.from_json("value", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": DAMAGED})
    read = _placed(lines(spark, path)).filter(F.trim("value") != "").withColumn("r", parsed)
    return read.select("r.*", PLACE).withColumn(DAMAGED, F.col(DAMAGED))


def read_csv(spark: SparkSession, source: str, path: str) -> DataFrame:
    """Raw rows of CSV files with a header line each; rows with too few or too many fields, or of wrong types, are ``_damaged``."""
    kind = f"{RAW[source]}, {DAMAGED} string"
    parsed = F.from_csv("value", F.lit(kind), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": DAMAGED})
    read = _placed(lines(spark, path)).filter((F.col("record") > 0) & (F.trim("value") != "")).withColumn("r", parsed)
    return read.select("r.*", PLACE)


def scan(spark: SparkSession, source: str, path: str, fmt: str = "json") -> DataFrame:
    """A feed's files through its connector: canonical rows with outcome, reason, locator.

    The locator is the row's reference, or ``file, record #i`` where it has none or can't be read; such lines are rejected as
    ``malformed_record`` before anything else is judged.
    """
    return CONNECTORS[source]({"json": read_json, "csv": read_csv}[fmt](spark, source, path))
