"""op4: documents stored as media in tar shards and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .media import media_columns


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = media_columns(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "depth")


QUERIES = {"op4_media": op4_media}
