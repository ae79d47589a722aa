"""A stream of index mutations, appended to a stored log batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def append_to_log(stream: DataFrame, log_path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Writes each micro-batch into a folder named after its number and overwrites it when a batch is run again, so that every row is in the log once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log_path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_log(spark, log_path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("basePath", log_path).parquet(log_path)


def tumbling_counts(stream: DataFrame, time: str, size: str, late: str) -> DataFrame:
    """Rows of each time bucket, as they come; buckets close after ``late``."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "n")
