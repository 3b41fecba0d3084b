"""op3: language of every document, learned from part of the labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, table
from .language_id import identify, learn


def held_out(docs: DataFrame):
    return crc_mod(docs["doc_id"], 4) == 2


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    content = learn(docs, ~held_out(docs))
    done = identify(docs, content)
    return done.select("doc_id", held_out(done).alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op3_language_id": op3_language_id}
