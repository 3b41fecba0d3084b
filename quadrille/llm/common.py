"""Helpers shared by the training-data operators.

Conventions that hold for every operator here:

* inputs are narrowed to the columns an operator names before anything else, so extra columns,
  whatever they are called, never clash with internal ones;
* a null text counts as an empty one unless an operator's docstring says otherwise;
* intermediate tables go to the folder in ``spark.checkpoint.dir`` as Parquet, which every executor
  can read again after another one is lost.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import ExitStack, contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the near-duplicate contracts: runs of anything but ASCII white space.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
#: Spark's setting that deletes a query's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Settings of Spark's runtime filters: of 4 MB, whatever the input. A filter that has too many keys for that
#: lets more rows pass, which the join drops.
PRUNE = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1t",
    "spark.sql.optimizer.runtime.bloomFilter.expectedNumItems": "4000000",
    "spark.sql.optimizer.runtime.bloomFilter.maxNumItems": "4000000",
    "spark.sql.optimizer.runtime.bloomFilter.numBits": "33554432",
}
#: Rows of text handed to a Python worker at once; texts may be long, so few.
TEXT_ROWS = 512

#: Rows of a batch read from Parquet or handed to a Python worker. Spark's own 4 096 and 10 000 rows of text are
#: buffers of tens of MB, twice that while they grow, in each task and outside the heap too.
BATCHES = {
    "spark.sql.parquet.columnarReaderBatchSize": str(TEXT_ROWS),
    "spark.sql.execution.arrow.maxRecordsPerBatch": str(TEXT_ROWS),
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(UPPER, LOWER)
_spaced = re.compile(SPACED_WORD)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only a local session may go without the setting."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        full = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
        return re.sub(r"^file:/(?!/)", "file:///", full).rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="quadrille-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/quadrille-{tag}-{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting that holds around eager steps only."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def small_batches(spark: SparkSession) -> None:
    """Have texts travel in batches of TEXT_ROWS rows, where the session has no setting of its own.

    This lasts, as a result that is returned is computed later. It changes no result.
    """
    for name, value in BATCHES.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)


def stored(df: DataFrame, tag: str, prune: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at the files.

    Shuffle files of the step are deleted when it ends; should an executor be lost before that, Spark
    computes what is missing again. With ``prune`` Spark may thin the larger side of a shuffled join by a
    Bloom filter of the other one's keys (see PRUNE), if that one is filtered, as ``keys_of`` does.
    """
    path = fresh_path(df.sparkSession, tag)
    with ExitStack() as held:
        for name, value in {CLEANUP: "true", **(PRUNE if prune else {})}.items():
            held.enter_context(setting(df.sparkSession, name, value))
        df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._quadrille_path = path
    return back


def keys_of(df: DataFrame, key: str) -> DataFrame:
    """The rows of a stored table that have a key, said in a form that Spark counts as a selective filter."""
    return df.where(F.col(key) <= F.lit((1 << 63) - 1))


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`stored` that nothing reads any more."""
    path = getattr(df, "_quadrille_path", None)
    if path:
        discard_path(df.sparkSession, path)


def discard_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: A key that more than one in HOT_VALUES of all rows have, and HOT_LEAST rows besides, is joined by
#: broadcast: there are HOT_VALUES of them at most, whatever the input.
HOT_VALUES, HOT_LEAST = 8192, 16


def spread_join(rows: DataFrame, values: DataFrame, keys: list[str], spread: list[str], total: int, trimmed: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` left joined with ``values`` (keys, n, other columns; one row a key), of which n rows have a key.

    The few keys that very many rows have are matched by a broadcast of bounded size before the shuffle,
    and their rows are then dealt by ``spread``, columns that tell rows apart, instead of by the key.
    ``total`` is the number of rows; ``values`` should be stored, as it is read twice. ``trimmed`` replaces
    columns before the shuffle and may use ``_hot``, the values of such a key, null for other rows.
    """
    others = [c for c in values.columns if c not in (*keys, "n")]
    often = total // HOT_VALUES + HOT_LEAST
    named = [F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]
    hot = values.where(F.col("n") > often).select(*named, F.struct(*others, F.lit(1).alias("_met")).alias("_hot"))
    marked = rows.join(F.broadcast(hot), [F.col(k) == F.col(f"_key{i}") for i, k in enumerate(keys)], "left").drop(*(f"_key{i}" for i in range(len(keys))))
    marked = marked.withColumns(trimmed or {})
    marked = marked.withColumn("_deal", F.when(F.col("_hot").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(*spread)))
    zero = F.shiftright(F.col("n"), 62).cast("long").alias("_zero")  # 0, but not to the optimizer, which would take it out of the join's key
    cold = values.where(F.col("n") <= often).select(*named, zero, F.struct(*others, F.lit(1).alias("_met")).alias("_cold"))
    on = [F.col("_deal") == F.col("_zero"), *(F.col(k) == F.col(f"_key{i}") for i, k in enumerate(keys))]
    joined = marked.join(cold, on, "left").withColumn("_found", F.when(F.col("_hot").isNotNull(), F.col("_hot")).otherwise(F.col("_cold")))
    return joined.select(*(F.col(c) for c in rows.columns), *(F.col(f"_found.{c}").alias(c) for c in others), F.col("_found").isNotNull().alias("met"))


#: Rows up to which a stored table of a few narrow columns is broadcast; about the size to which Spark itself does.
BROADCAST_ROWS = 1_000_000


def checked_broadcast(df: DataFrame) -> DataFrame:
    """A stored table of a few narrow columns, marked for broadcast if it is counted to be small; beyond that
    Spark joins it by a shuffle."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def spaced_words(text: str | None) -> list[str]:
    return _spaced.findall((text or "").translate(ASCII_LOWER))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def map_texts(df: DataFrame, make: Callable[[], Callable[[dict], dict]], schema: str, rows: int = TEXT_ROWS) -> DataFrame:
    """Run ``make()`` once a task and the function it returns over column batches of ``rows`` rows.

    The function gets ``{column: list}`` and returns the same shape. Slices keep the Python objects
    of only ``rows`` texts alive, whatever the size of Spark's Arrow batches.
    """
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    parsed = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(parsed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = work(batch.slice(at, rows).to_pydict())
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, parsed)
