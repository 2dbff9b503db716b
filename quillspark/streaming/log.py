"""Streams into the message log and the note index, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import message_log, note_index


class Versions:
    """A table as numbered Parquet versions: readers see the last that is whole.

    One writer adds version n + 1 from version n; a batch that runs again
    writes its version again, so a lost driver leaves the table as it was.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), root, jvm

    def last(self) -> int:
        fs, root, jvm = self._fs()
        if not fs.exists(root):
            return -1
        done = [s.getPath().getName() for s in fs.listStatus(root) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return max((int(n.removeprefix("v")) for n in done if n.startswith("v")), default=-1)

    def read(self, before: int | None = None) -> DataFrame:
        version = self.last() if before is None else before - 1
        if version < 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{version}")

    def write(self, df: DataFrame, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v{version}")


LOG_SCHEMA = "id string, content string, type string, ts timestamp, source string, ord long"


def merge_batches(table: Versions, then: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that upserts messages (with ``ord``) by key."""

    def merge(batch: DataFrame, number: int) -> None:
        merged = message_log.upsert_merge(table.read(number), batch)
        table.write(merged.select("id", "content", "type", "ts", "source", F.col("first_ord").alias("ord")), number)
        if then is not None:
            then(table.read(), number)

    return merge


INDEX_SCHEMA = "note_id string, content_hash string"


def index_sync(table: Versions) -> Callable[[DataFrame, int], None]:
    """Keeps an index of note hashes in step with the log."""

    def sync(log: DataFrame, number: int) -> None:
        notes, old = note_index.project_notes(log), table.read(number)
        kept = note_index.delete(old, note_index.orphans(old, notes), "note_id")
        table.write(note_index.upsert(kept, note_index.to_index(notes, old).select("note_id", "content_hash"), "note_id"), number)

    return sync


def run(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Process all that is there and stop."""
    return stream.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
