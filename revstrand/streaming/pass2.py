"""Pass 2 as a stream: reads that arrive in a folder are called and decided against a fixed support table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..config import ReadConfig
from ..operators import readmode as R


def decided_stream(spark: SparkSession, path: str, support: DataFrame, cfg: ReadConfig) -> DataFrame:
    """Decisions of reads(read_id, seq) in Parquet files that arrive at `path`. The join with the static support keeps no state."""
    reads = spark.readStream.schema("read_id string, seq string").parquet(path)
    return R.decide(R.calls(reads, cfg), support, cfg)


def write_decisions(decided: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends the report of each micro-batch to `out`, exactly once, until the files there are used up."""
    return R.report(decided).drop("delta", "p2_span", "cross_frac").writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
