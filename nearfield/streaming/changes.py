"""Vector tables that follow a stream of changes, by versioned snapshots.

Each micro-batch gives a new version directory named by its epoch; a version is there once its _SUCCESS file is, and an
epoch that is replayed finds its version and does nothing more. Within a batch the last change of a tag wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.mutations import upsert_latest

SCHEMA = "tag long, vec array<float>"


def versions(spark: SparkSession, path: str, last: str = "") -> list[int]:
    """Numbers of the complete versions under ``path``, through the file system Spark reads it with; ``last`` is what is written last."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/{last}/_SUCCESS" if last else f"{path}/{n}/_SUCCESS")))


def current(spark: SparkSession, path: str) -> DataFrame:
    """(tag, vec) of the newest version; empty without one."""
    known = versions(spark, path)
    return spark.read.parquet(f"{path}/v{known[-1]}") if known else spark.createDataFrame([], SCHEMA)


def apply_changes(table: DataFrame, changes: DataFrame) -> DataFrame:
    """``table`` (tag, vec) after ``changes`` (seq, op, tag, vec): "insert" puts a vector in the tag's place, "delete" takes it away."""
    last = upsert_latest(changes.select("tag", "seq", "op", "vec"), "tag", [F.col("seq")])
    kept = table.join(last.select("tag"), "tag", "left_anti")
    return kept.select("tag", "vec").unionByName(last.filter("op = 'insert' AND vec IS NOT NULL").select("tag", F.col("vec").cast("array<float>").alias("vec")))


def follow(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Start a query that keeps the table at ``path`` up to date with a stream of changes."""

    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        if epoch in versions(spark, path):
            return
        apply_changes(current(spark, path), batch).write.mode("overwrite").parquet(f"{path}/v{epoch}")

    return changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
