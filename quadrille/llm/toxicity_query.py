"""op1: toxicity of every document, learned from part of the labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, table
from .toxicity import THRESHOLD, learn, score_texts


def held_out(rows: DataFrame):
    return crc_mod(rows["doc_id"], 3) == 1


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learned = learn(docs, labels, ~held_out(labels))
    done = score_texts(docs, learned)
    return done.select("doc_id", held_out(done).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op1_toxicity": op1_toxicity}
