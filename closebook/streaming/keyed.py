"""Decisions with idempotency keys from any number of sessions, each key applied once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..sources.sinks import LOGGED

ASKED = f"{LOGGED}, asked string"


class KeyedLog:
    """An audit sink in which the first entry of a key is the only one, whoever wrote it and however often it is replayed.

    Sessions append what they ask for; nobody looks a key up before writing, so there is no moment between the two. One
    stream applies what was asked, batch by batch: of the entries of one key in a batch the smallest by the name it was
    asked under wins, and none does if an earlier batch has the key. A batch overwrites its own folder if it is run again. Entries without a
    key are all applied. What is read are the applied entries, so every session sees the winner. One stream at a time may
    apply: its checkpoint sees to that.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, entries: DataFrame, writer: str | None = None) -> None:
        """Ask for entries; a name of the writer's own tells its entries from others'.

        They are written in a folder of their own and its files then moved, as of two writes to one folder the first to end clears away what the other has not committed.
        """
        name = writer or uuid.uuid4().hex
        asked = entries.withColumn("asked", F.concat(F.lit(f"{name}:"), F.monotonically_increasing_id().cast("string")))
        own = f"{self.path}/asking/{uuid.uuid4().hex}"
        asked.select(F.to_json(F.struct(*asked.columns)).alias("value")).write.text(own)
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        files, to = path(own).getFileSystem(self.spark._jsc.hadoopConfiguration()), f"{self.path}/asked"
        files.mkdirs(path(to))
        for at in [x.getPath() for x in files.listStatus(path(own)) if x.getPath().getName().startswith("part-")]:
            if not files.rename(at, path(f"{to}/{at.getName()}")):
                raise OSError(f"{at.toString()} cannot be moved to {to}")
        files.delete(path(own), True)

    def _applied(self) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/applied")
        kind = f"{ASKED}, key string, batch long"
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).option("basePath", f"{self.path}/applied").parquet(f"{self.path}/applied")

    def apply_batch(self, batch: DataFrame, batch_id: int) -> None:
        """Insert the keys of a batch that are absent. The winner of a key is a minimum, so a hot key is combined before it is shuffled."""
        keyed = batch.withColumn("key", F.coalesce("idempotency_key", F.concat(F.lit("\x00"), "asked")))
        first = keyed.groupBy("key").agg(F.min_by(F.struct(*batch.columns), "asked").alias("won")).select("key", "won.*")
        known = self._applied().filter(F.col("batch") < batch_id).select("key")
        first.join(known, "key", "left_anti").write.mode("overwrite").parquet(f"{self.path}/applied/batch={batch_id}")

    def start(self, checkpoint: str, **trigger) -> StreamingQuery:
        """The stream that applies what is asked; by default all that there is now."""
        asked = self.spark.readStream.schema(ASKED).json(f"{self.path}/asked")
        writer = asked.writeStream.foreachBatch(self.apply_batch).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    def read(self) -> DataFrame:
        return self._applied().drop("asked", "key", "batch")
