"""First-wins deduplication of an unbounded feed, bounded or exact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.ingest import KEY, dedupe


def within_watermark(stream: DataFrame, delay: str = "3 days") -> DataFrame:
    """State is bounded: a key is forgotten ``delay`` after its event time."""
    return stream.withWatermark("posted_at", delay).dropDuplicatesWithinWatermark(list(KEY))


class AcceptedTable:
    """Exact memory across batches: accepted rows are a Parquet table that each micro-batch is held against.

    A micro-batch writes under its own batch id and overwrites it if it is run again, so a restart after a
    failure accepts nothing twice.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _before(self, batch_id: int, like: DataFrame) -> DataFrame:
        keyed = self.spark.read.schema(f"{', '.join(f'{c} string' for c in KEY)}, batch long")
        try:
            return keyed.option("basePath", self.path).parquet(self.path).filter(f"batch < {batch_id}")
        except Exception as error:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return like.select(*KEY).limit(0)

    def accept(self, batch: DataFrame, batch_id: int) -> None:
        fresh = dedupe(batch, self._before(batch_id, batch))
        fresh.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(self.accept).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    def read(self) -> DataFrame:
        return self.spark.read.option("basePath", self.path).parquet(self.path)
