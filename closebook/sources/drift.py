"""Drift of a feed's raw JSON: which keys come that are not declared, which are missing, and whose type has changed.

Every line is opened as a variant, and its keys and types are counted in one aggregation that combines before the shuffle;
a key that all lines share costs a row for each task. Only keys and types leave it, never values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .feeds import RAW

#: Declared type -> the types that a JSON value of it has.
TYPES = {"long": ("BIGINT",), "string": ("STRING",), "boolean": ("BOOLEAN",)}


def keys(lines: DataFrame) -> DataFrame:
    """(key, type, n) over the JSON objects of ``lines`` (value); nulls have the type VOID, and lines that are no objects have no keys."""
    opened = lines.select(F.try_parse_json("value").alias("v")).filter(F.schema_of_variant("v").startswith("OBJECT"))
    each = opened.lateralJoin(opened.sparkSession.tvf.variant_explode(F.col("v").outer()))
    return each.groupBy("key", F.schema_of_variant("value").alias("type")).agg(F.count(F.lit(1)).alias("n"))


def report(source: str, lines: DataFrame) -> DataFrame:
    """(source, key, drift, type, n): ``unexpected`` keys, ``missing`` ones (n is 0), and ``type_changed`` with the type that came."""
    declared = []
    for part in RAW[source].split(", "):
        name, _, kind = part.rpartition(" ")
        declared += [(name.strip("`"), t) for t in TYPES[kind]]
    known = F.broadcast(lines.sparkSession.createDataFrame(declared, "key string, declared string"))  # the feed's columns
    both = keys(lines).join(known, "key", "full")
    there = both.groupBy("key").agg(F.sum("n").alias("n"))
    missing = there.filter("n IS NULL").select("key", F.lit("missing").alias("drift"), F.lit(None).cast("string").alias("type"), F.lit(0).cast("long").alias("n"))
    # Numbers of any width are one type here.
    plain = F.when(F.col("type").rlike("^(BIGINT|DECIMAL.*,0.*)$"), "BIGINT").otherwise(F.col("type"))
    came = both.filter("n IS NOT NULL").withColumn("type", plain)
    drift = F.when(F.col("declared").isNull(), "unexpected").when((F.col("type") != "VOID") & (F.col("type") != F.col("declared")), "type_changed")
    odd = came.withColumn("drift", drift).filter("drift IS NOT NULL").groupBy("key", "drift", "type").agg(F.sum("n").alias("n"))
    return missing.unionByName(odd).select(F.lit(source).alias("source"), "key", "drift", "type", "n")
