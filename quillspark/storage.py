"""Cutting lineage in the shared folder, and running sums over any number of rows."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the session names none, as in local tests, a temporary folder is
    set and removed at exit.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if held:
        return held.rstrip("/")
    folder = tempfile.mkdtemp(prefix="quillspark-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/quillspark-{label}-{uuid.uuid4().hex}"
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    for scope in Scratch.open[-1:]:
        scope.paths.append(hadoop_path)
    return path


class Scratch:
    """Notes the paths that are made while it is open (``with``); ``clear`` deletes them, once nothing reads them any more."""

    open: list[Scratch] = []

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        Scratch.open.append(self)
        return self

    def __exit__(self, *error) -> None:
        Scratch.open.remove(self)

    def clear(self) -> None:
        while self.paths:
            path = self.paths.pop()
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result no longer depends on earlier shuffles, so a lost executor costs
    a re-read only, and nothing upstream is computed twice.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_sum(df: DataFrame, order: Sequence[str], value: str, out: str, label: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all rows up to and with this one in ``order``.

    ``order`` should be unique, else rows that tie share no defined order.  The
    rows are range-partitioned; each partition's total (one number for each)
    goes through the driver and comes back as an offset.  No task sees more than
    its own range.
    """
    spark = df.sparkSession
    ranged = cut(df.repartitionByRange(shuffle_width(spark), *order).withColumn("_part", F.spark_partition_id()), f"{label}-ranged")
    totals = {r["_part"]: r["t"] or 0 for r in ranged.groupBy("_part").agg(F.sum(value).alias("t")).collect()}
    before, so_far = [], 0
    for p in range(max(totals, default=0) + 1):
        before.append(so_far)
        so_far += totals.get(p, 0)
    local = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    offsets = F.split(F.lit(",".join(map(str, before))), ",").cast("array<bigint>")
    return ranged.withColumn(out, F.sum(value).over(local) + F.element_at(offsets, F.col("_part") + 1)).drop("_part")
