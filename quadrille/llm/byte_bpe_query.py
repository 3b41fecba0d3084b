"""op7: byte-level BPE over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .byte_bpe import tokenize
from .common import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokenize(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


QUERIES = {"op7_byte_bpe": op7_byte_bpe}
