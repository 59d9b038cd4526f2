"""Event streams: the same operators as in batch, on Structured Streaming with state that ends."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from sedge.session import shared_folder


def source(spark: SparkSession, path: str) -> DataFrame:
    """Parquet events as a stream. A file source needs a folder: a single file is read through its own pattern."""
    schema = spark.read.parquet(path).schema
    folder, name = path.rsplit("/", 1)
    s = spark.readStream.schema(schema)
    return s.option("pathGlobFilter", name).parquet(folder).withColumn("at", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """What the stream gives once all present input is read, as a batch table in the shared folder."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
        q.outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{base}/out")

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{base}/out/{batch:08d}")

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/state")
    q.outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{base}/out")


def tumbling(spark: SparkSession, path: str, width: str) -> DataFrame:
    """event_type, opened (epoch seconds), n, total of each window."""
    w = source(spark, path).groupBy("event_type", F.window("at", width)).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return drained(w.select("event_type", F.unix_seconds("window.start").alias("opened"), "n", "total"), "complete")


def once_by_key(spark: SparkSession, path: str, key: list[str], late: str = "3650 days") -> DataFrame:
    """The first event of each key; keys are forgotten once the watermark has passed them."""
    s = source(spark, path).withWatermark("at", late).dropDuplicatesWithinWatermark(key)
    return drained(s.select(*key), "append")


def trailing_counts(events: DataFrame, key: str, width: str, slide: str, late: str) -> DataFrame:
    """Sliding counts of a stream with a column at; closed windows leave the state."""
    return events.withWatermark("at", late).groupBy(key, F.window("at", width, slide)).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, key: str, gap: str, late: str) -> DataFrame:
    """Sessions of a stream: events of one key with no gap between them."""
    return events.withWatermark("at", late).groupBy(key, F.session_window("at", gap)).agg(F.count("*").alias("n"))
