"""op10: pages written as WARC archives and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .warc import chunked, planned, read, write


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write(chunked(planned(table(spark, sf_dir, "pages"))))
    return read(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op10_warc": op10_warc}
