"""The corpus pipeline: five training-data operators applied to documents in order.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a table with
the columns of documents, the last one the encoded documents. ``run`` applies them one after another.
Every stage works on all rows its predecessor kept.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import byte_bpe, language_id, minhash, mixing, toxicity
from quadrille.llm.common import checked_broadcast, crc_mod, small_batches, stored, table

#: The pipeline has no SQL form: compression, learned lexicons and hashes drive its stages. The tests
#: hold it against a brute-force version instead.
ORACLE_SQL = None

VOCABULARY = "byte_bpe_multi_50k.tiktoken"

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_small_batches(stage: Stage) -> Stage:
    """The stage with small batches of texts: all stages share the executors, whose memory adds up."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


@in_small_batches
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised clearly."""
    content = language_id.learn(docs, crc_mod(docs["doc_id"], 4) != 2)
    return language_id.filter_identified(docs, content)


@in_small_batches
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar scores below its threshold."""
    labels = table(spark, sf_dir, "labels")
    return toxicity.filter_toxic(docs, toxicity.learn(docs, labels, crc_mod(labels["doc_id"], 3) != 1))


@in_small_batches
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8).

    The one with the smallest id stays. Where ids are null or repeat, every text of an id is a document
    of its own and the one whose hash of id and text is smallest stays; of rows that repeat both, one.
    Null and wordless texts all stay. An empty table gives no rows.
    """
    unique = docs.groupBy(docs["doc_id"]).agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").isEmpty()
    own = docs["doc_id"] if unique else F.xxhash64(docs["doc_id"], docs["text"])
    gone = minhash.near_duplicates(docs.select(own.alias("doc_id"), docs["text"])).where("not kept").select(F.col("doc_id").alias("gone_id")).distinct()
    gone = checked_broadcast(stored(gone, "gone"))
    rows = docs.select(own.alias("own"), (mixing.word_count(docs["text"]) > 0).alias("worded"), F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    rows = rows.join(gone, rows["own"] == gone["gone_id"], "left_anti")
    if not unique:
        one = rows.where("worded").groupBy("own").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
        rows = one.select("row").unionByName(rows.where("not worded").select("row"))
    return rows.select("row.*")


@in_small_batches
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it: not at all, once or twice.

    Null sources are one source; a text without words is taken no times; repeated rows each as often as
    the one of them that is taken most. An empty table gives no rows.
    """
    taken = mixing.mix(docs).where("copies > 0").groupBy("doc_id", "source", "size").agg(F.max("copies").alias("copies"))
    taken = checked_broadcast(stored(taken, "copies"))
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), mixing.word_count(docs["text"]).alias("words"))
    same = rows["row.doc_id"].eqNullSafe(taken["doc_id"]) & rows["row.source"].eqNullSafe(taken["source"]) & (rows["words"] == taken["size"])
    repeated = rows.join(taken, same).select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return repeated.select("row.*")


@in_small_batches
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit) of every document, with the digests of both directions."""
    return byte_bpe.tokenize(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("language", identify_language),
    ("toxicity", reject_toxic),
    ("near duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
