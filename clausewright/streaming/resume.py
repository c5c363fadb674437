"""Resumable batch state as a stream: replayed batches change nothing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.session import shared_dir


def run_available(spark: SparkSession, path: str, schema, out: str, state: str, max_files: int = 4) -> int:
    """Process what is new under path into out, one directory per micro-batch; returns the batches done.

    The checkpoint keeps what was read; a batch that runs again overwrites its
    own directory, so a crash between write and commit costs nothing.
    """
    done: list[int] = []

    def one(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/part={batch}")
        done.append(batch)

    # a pattern, since a stream may not be started on a single file
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(f"{path}*")
    q = stream.writeStream.foreachBatch(one).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return len(done)


def counted_by_type(spark: SparkSession, path: str) -> DataFrame:
    """Events per type, read through a stream that is run twice: the second run finds nothing new."""
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    run_available(spark, path, schema, f"{root}/out", f"{root}/state")
    run_available(spark, path, schema, f"{root}/out", f"{root}/state")
    out = spark.read.schema(schema).parquet(f"{root}/out/part=*")
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 2).alias("total"))
