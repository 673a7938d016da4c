"""Landed records as a stream: duplicates dropped whatever their age, batches appended once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def landed(spark: SparkSession, path: str, schema: str, files: int = 50) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


def deduplicated(rows: DataFrame, key: str = "id", time: str = "created_utc") -> DataFrame:
    """One record of each key, with ``event_time``. No watermark: listings run from new to old, so an old record is not a late one.

    Over a stream every key is kept as state; ``append_new`` needs no such state.
    """
    return rows.withColumn("event_time", F.timestamp_seconds(F.col(time))).dropDuplicates([key])


def append_new(rows: DataFrame, to: str, checkpoint: str, key: str = "id") -> StreamingQuery:
    """Append to Parquet one record of each key that its folder does not hold yet; a repeated batch writes nothing twice.

    Records without key cannot be told apart and are all kept.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.filter(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(batch.filter(F.col(key).isNull()))
        try:
            batch = batch.join(spark.read.parquet(to).select(key), key, "left_anti")
        except Exception as e:  # the first batch has nothing to compare with
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        batch.write.mode("append").parquet(to)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
