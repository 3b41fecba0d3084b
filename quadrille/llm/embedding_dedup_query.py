"""op6: near-duplicate embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .embedding_dedup import near_duplicates


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op6_embedding_dedup": op6_embedding_dedup}
