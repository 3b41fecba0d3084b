"""Request metrics rolled up by minute and hour, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LATE = "25 hours"


def measures(value: str) -> list[Column]:
    return [F.count("*").alias("requests"), F.sum(value).alias("total"), F.max(value).alias("most")]


def rollup(events: DataFrame, ts: str = "ts", keys: tuple[str, ...] = ("event_type",), value: str = "value", every: str = "1 hour") -> DataFrame:
    """(bucket, keys, requests, total, most)."""
    return events.groupBy(F.window(ts, every).alias("w"), *keys).agg(*measures(value)).select(F.col("w.start").alias("bucket"), *keys, "requests", "total", "most")


def merged(old: DataFrame, late: DataFrame, keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Add late buckets to a rolled-up table."""
    both = old.unionByName(late)
    return both.groupBy("bucket", *keys).agg(F.sum("requests").alias("requests"), F.sum("total").alias("total"), F.max("most").alias("most"))


def hours_of(minutes: DataFrame, keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Minute buckets to hour buckets."""
    return minutes.groupBy(F.date_trunc("hour", "bucket").alias("bucket"), *keys).agg(F.sum("requests").alias("requests"), F.sum("total").alias("total"), F.max("most").alias("most"))


def streamed(events: DataFrame, ts: str = "ts", keys: tuple[str, ...] = ("event_type",), value: str = "value", every: str = "1 hour") -> DataFrame:
    """The same over a stream, with a watermark for late rows."""
    return rollup(events.withWatermark(ts, LATE), ts, keys, value, every)


def stream_to_table(spark, folder: str, schema, name: str, checkpoint: str, ts: str = "ts", keys: tuple[str, ...] = ("event_type",), value: str = "value", every: str = "1 hour"):
    """Run the rollup over the files of a folder until all are read; results are in the view ``name``.

    Each micro-batch writes its own buckets, in a folder named by its number, so a batch that is run again
    replaces what it wrote, and no state is held however late a row is. The view adds the batches up.
    """
    target = f"{checkpoint.rstrip('/')}-{name}"

    def put(batch: DataFrame, number: int) -> None:
        rollup(batch, ts, keys, value, every).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(folder)
    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    parts = spark.read.parquet(target)
    both = parts.groupBy("bucket", *keys).agg(F.sum("requests").alias("requests"), F.sum("total").alias("total"), F.max("most").alias("most"))
    both.createOrReplaceTempView(name)
    return spark.table(name)


def slowest(events: DataFrame, value: str = "value", n: int = 20, key: str = "event_id") -> DataFrame:
    """The slow log: the n largest values."""
    return events.orderBy(F.desc(value), key).limit(n)
