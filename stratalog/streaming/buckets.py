"""Time buckets over streams: the streaming form of GROUP BY time_bucket.

Rows later than the watermark are dropped, where a sorted in-memory aggregate would fail.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import shared_folder
from ..sources import logs


def read_logs(spark: SparkSession, fmt: str, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """New files of a log format in a folder, as a stream of typed rows."""
    return logs.parse(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder), fmt)


def bucketed(stream: DataFrame, time_col: str, width: str, key: str, value: str, late: str = "10 minutes") -> DataFrame:
    """Count and sum per bucket and key; state lives until the watermark passes a bucket."""
    return (
        stream.withWatermark(time_col, late)
        .groupBy(F.window(time_col, width).alias("w"), key)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
        .select(F.col("w.start").alias("bucket"), key, "n", F.round("total", 3).alias("total"))
    )


def start(buckets: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append finished buckets to Parquet, exactly once by way of the checkpoint."""
    writer = buckets.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def replayed(rows: DataFrame, time_col: str, width: str, key: str, value: str) -> DataFrame:
    """rows, streamed from a table of their own, as finished buckets; a null key is a key like
    others. A last row far beyond the others closes every bucket; its own, told by its time, is
    left out. Rows without a time are in no bucket."""
    spark = rows.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    kept = rows.select(F.col(time_col).cast("timestamp").alias(time_col), key, value)
    kept.write.parquet(f"{folder}/in")
    last = spark.read.parquet(f"{folder}/in").agg(F.max(time_col).alias("last"))
    far = last.where("last is not null").select((F.col("last") + F.expr("interval 400 days")).alias(time_col))
    end = far.select(time_col, *(F.lit(None).cast(kept.schema[c].dataType).alias(c) for c in (key, value)))
    schema = kept.schema
    for source in (None, end):
        if source is not None:
            source.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        query = start(bucketed(stream, time_col, width, key, value, late="366 days"), f"{folder}/out", f"{folder}/state")
        query.awaitTermination()
    moment = last.first()["last"]
    out = spark.read.schema(bucketed(kept, time_col, width, key, value).schema).parquet(f"{folder}/out")
    return out if moment is None else out.where(F.col("bucket") <= F.lit(moment))
