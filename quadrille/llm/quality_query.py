"""op9: quality of every document by co-training, learned from part of the labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, table
from .quality import learn, score


def held_out(rows: DataFrame):
    return crc_mod(rows["doc_id"], 5) == 3


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    done = score(docs, learn(docs, labels, ~held_out(labels)))
    return done.select("doc_id", held_out(done).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op9_quality": op9_quality}
