"""The append-only audit log: JSON lines, null fields left out."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOGGED = "phase int, decision string, actor string, subjects array<string>, reason string, confidence double, tier string, amount_minor long, currency string, candidate int, idempotency_key string"


class AuditSink(Protocol):
    def write(self, entries: DataFrame) -> None: ...

    def read(self) -> DataFrame | None: ...


def as_lines(entries: DataFrame) -> DataFrame:
    return entries.select(F.to_json(F.struct(*entries.columns)).alias("value"))


class JsonLog:
    """One batch is one append; nothing is ever rewritten."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, entries: DataFrame) -> None:
        as_lines(entries).write.mode("append").text(self.path)

    def read(self) -> DataFrame:
        """All entries; none yet is an empty table."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], LOGGED)
        return self.spark.read.schema(LOGGED).json(self.path)

    def __len__(self) -> int:
        return self.read().count()


class MemoryLog:
    """Entries of this session, for tests and small runs."""

    def __init__(self):
        self.entries: DataFrame | None = None

    def write(self, entries: DataFrame) -> None:
        self.entries = entries if self.entries is None else self.entries.unionByName(entries, allowMissingColumns=True)

    def read(self) -> DataFrame | None:
        return self.entries
