"""Session helpers: the shared folder, written intermediate tables and size estimates."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_dir


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/revstrand/{tag}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Parquet's writer looks at its memory after 100 rows at first, so rows of many megabytes would pile up in it. With these options
#: every such row is a row group of its own, and neither writer nor reader holds more than one.
LARGE_ROWS = {"parquet.block.size": str(1 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.enable.dictionary": "false"}


def cut(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """df written to the shared folder (options: the writer's) and read again: lineage ends there and nothing is computed twice."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.options(**options).parquet(path)
    done = spark.read.schema(df.schema).parquet(path)
    done._written = path
    return done


def drop(*written: DataFrame) -> None:
    """Deletes tables that `cut` wrote and nothing reads any more."""
    for df in written:
        drop_path(df.sparkSession, df._written)


#: Bits of a filter over ids: 8 MB whatever the input. Once it is full it passes every id, and what reads its rows decides.
SIEVE_BITS = 1 << 26


def sieve_slot(column: str) -> Column:
    """The bit that stands for an id."""
    return F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(SIEVE_BITS))


class Sieve:
    def __init__(self, words: np.ndarray):
        self.words = words.view(np.uint64)

    def has(self, slots) -> np.ndarray:
        """Which slots (an Arrow column, null: none) are set."""
        at = np.asarray(slots.fill_null(-1), np.int64)
        bit = (at & 63).astype(np.uint64)
        return (at >= 0) & ((self.words[np.maximum(at, 0) >> 6] >> bit) & np.uint64(1) == 1)


def sieve(ids: DataFrame):
    """A broadcast filter that all ids in ids(doc_id) pass, and others with the chance of a shared bit."""
    at = sieve_slot("doc_id")
    words = ids.select(at.alias("at")).select(F.floor(F.col("at") / 64).cast("long").alias("w"), F.expr("shiftleft(1L, int(at % 64))").alias("b"))
    got, bits = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow(), np.zeros(SIEVE_BITS // 64, np.int64)
    bits[np.asarray(got.column("w"))] = np.asarray(got.column("b"))
    return ids.sparkSession.sparkContext.broadcast(Sieve(bits))


def input_bytes(df: DataFrame) -> int:
    """Catalyst's sizes of the plan's leaves, in bytes (0 where unknown); used to size buckets, never to change results."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 60)


def buckets_for(df: DataFrame, bytes_each: int, least: int = 16, most: int = 1 << 20) -> int:
    """A power of two of buckets, so that each gets about bytes_each of the input."""
    n, size = least, input_bytes(df)
    while n < most and n * bytes_each < size:
        n *= 2
    return n


#: Allocator settings of Python workers: large arrays and Arrow buffers go back to the system when they are freed, so that workers
#: that wait between stages stay small. What a user has set stays.
WORKER_ENV = {"MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}
#: Rows and bytes of the Arrow batches that tasks exchange with Python; texts can be long, so both are bounded.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of sf_dir. Sessions that still have Spark's default Arrow batches get bounded ones, and workers their allocator settings."""
    for k, v in WORKER_ENV.items():
        spark.sparkContext.environment.setdefault(k, v)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, m: int):
    """crc32(id as text) mod m; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % m
