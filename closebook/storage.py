"""Tables of a run, and cut lineage in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A side of at most this many bytes may be broadcast; they are counted first.
BROADCAST_BYTES = 32 << 20

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_dir: list[str] = []
_open: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only in a local session without one (as in tests) a folder of our own."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="closebook-"))
    return _own_dir[0]


def materialize(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there.

    With ``by``, a column of few values, readers of one value read its files only.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    for made in _open[-1:]:
        made.append(path)
    with _cleaned(spark):
        (df.write if by is None else df.write.partitionBy(by)).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*(f"`{c}`" for c in df.columns))


@contextlib.contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """What is shuffled for a write inside goes from the disks when the write is done, and not when the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, None)
    try:
        spark.conf.set(CLEANUP, "true")
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def kept(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """``materialize``, the bytes of its rows counted by the write itself; beyond the bound the table is never broadcast.

    The planner knows the compressed bytes of files only, of which rows with few different values take a hundred times as many.
    """
    seen = Observation()
    out = materialize(df.observe(seen, F.sum(_width(df)).alias("bytes")), label, by)
    return out if (seen.get.get("bytes") or 0) <= BROADCAST_BYTES else out.hint("merge")


def unfolded(df: DataFrame) -> DataFrame:
    """Rows that an explosion made, for a join: never broadcast, as the planner takes an explosion to have the size of its input."""
    return df.hint("merge")


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What ``materialize`` writes inside is removed at the end; results must be written outside or read before."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _width(df: DataFrame) -> Column:
    """Bytes of a row of ``df``, texts and lists in full."""
    kind = lambda t: F.octet_length if t in ("string", "binary") else lambda c: F.coalesce(F.octet_length(c.cast("string")), F.lit(0)) if t.startswith(("array", "struct", "map")) else F.lit(8)
    width = F.lit(16)
    for name, t in df.dtypes:
        width = width + F.coalesce(kind(t)(F.col(f"`{name}`")), F.lit(0))
    return width.cast("long")


def size_of(df: DataFrame) -> int:
    """Bytes of the rows of ``df``, texts and lists in full."""
    return df.agg(F.sum(_width(df))).first()[0] or 0


def small(df: DataFrame) -> DataFrame:
    """``df``, a table, marked for broadcast if its counted bytes stay within the bound, else left to the planner."""
    return F.broadcast(df) if size_of(df) <= BROADCAST_BYTES else df


def bounded(df: DataFrame) -> DataFrame:
    """``df``, a table, never broadcast if its counted bytes are beyond the bound, else left to the planner."""
    return df if size_of(df) <= BROADCAST_BYTES else unfolded(df)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
