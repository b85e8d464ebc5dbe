"""Token counts of documents in flat token files that have no index, by a separator scan.

A token file is nothing but token ids of fixed width, each document followed by the end-of-document id. Files are read in
blocks of bytes wherever documents begin; the separators of a block are found by one vectorised comparison, and a document
that crosses blocks is stitched by a prefix scan over the blocks' totals: the tokens before its first separator in a block
are added to those since the last separator of the blocks before. The scan runs on two levels, so that one huge file is
scanned in many tasks.
"""

from __future__ import annotations

import base64
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _text as X
from ._spark import cut, scratch_path, table

#: The split pattern and the number of ranks of the public 50k byte-level vocabulary; the id after them is free.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
EOD = 50256
BLOCK = 1 << 20
#: Blocks of one file that the upper level of the prefix scan takes as one.
SUPER = 1024


def _filesystem(path: str):
    from pyarrow import fs

    path = re.sub("^s3[an]://", "s3://", path)  # Hadoop's names of the same store
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write_token_files(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, eod: int = EOD) -> DataFrame:
    """Tokenises docs(doc_id, text) into flat files of 16-bit ids in `path`, one per task; returns file, n_bytes, ordinal, doc_id.

    A document's text never yields `eod`. Null text is empty. Each attempt of a task writes a file of its own name, and only
    the files named in the result count, so a task that is run again or twice does no harm.
    """
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        shared = spark.sparkContext.broadcast({base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())})
    if eod in shared.value.values() or eod >= 1 << 16:
        raise ValueError("the separator must be a free 16-bit id")
    kind = pa.schema([("file", pa.string()), ("ordinal", pa.int64()), ("doc_id", pa.int64())])

    def go(batches):
        import tiktoken

        coder = tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=shared.value, special_tokens={})
        store, at = _filesystem(path)
        store.create_dir(at, recursive=True)
        name, n, out = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.tok", 0, None
        try:
            for b in X.pieces(batches):
                out = out or store.open_output_stream(f"{at}/{name}")
                for t in b.column("text").to_pylist():
                    ids = coder.encode_to_numpy(t, allowed_special=set(), disallowed_special=()) if t else np.zeros(0, np.uint32)
                    out.write(np.append(ids, eod).astype(np.uint16).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([name] * b.num_rows), pa.array(np.arange(n, n + b.num_rows)), b.column("doc_id").cast(pa.int64())], schema=kind)
                n += b.num_rows
        finally:
            if out is not None:
                out.close()

    return docs.select("doc_id", "text").mapInArrow(go, "file string, ordinal long, doc_id long")


def block_totals(ids: np.ndarray, eod: int) -> tuple[np.ndarray, int]:
    """Tokens before each separator of a block since the one before it (the first since the block's start), and after the last."""
    at = np.flatnonzero(ids == eod)
    if not len(at):
        return np.zeros(0, np.int64), len(ids)
    return np.diff(np.concatenate([[-1], at])) - 1, len(ids) - int(at[-1]) - 1


def scan_blocks(spark: SparkSession, path: str, files: DataFrame | None = None, eod: int = EOD, width: int = 2, block: int = BLOCK) -> DataFrame:
    """file, block, lengths (of the documents that end in the block, the first counted from its start), tail (tokens after the last).

    files: file (names inside `path`) and n_bytes; by default all files there. An incomplete last token is ignored.
    """
    if files is None:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        listed = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)
        files = spark.createDataFrame([(s.getPath().getName(), s.getLen()) for s in listed if s.isFile() and s.getPath().getName()[0] not in "._"], "file string, n_bytes long")
    step = max(block // width, 1) * width
    blocks = files.where(F.col("n_bytes") >= width).select("file", "n_bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_bytes") - 1) / step).cast("long"))).alias("block"))
    kind = pa.schema([("file", pa.string()), ("block", pa.int64()), ("lengths", pa.list_(pa.int64())), ("tail", pa.int64())])

    def go(batches):
        store, at = _filesystem(path)
        for b in batches:
            for name, size, k in zip(*(b.column(c).to_pylist() for c in ("file", "n_bytes", "block"))):
                with store.open_input_file(f"{at}/{name}") as f:
                    f.seek(k * step)
                    raw = f.read(min(step, size - k * step))
                lengths, tail = block_totals(np.frombuffer(raw[: len(raw) // width * width], f"<u{width}"), eod)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k]), pa.array([lengths], kind.field(2).type), pa.array([tail])], schema=kind)

    return blocks.repartition(F.col("file"), F.col("block")).mapInArrow(go, "file string, block long, lengths array<long>, tail long")


def stitched(blocks: DataFrame) -> DataFrame:
    """file, ordinal, n_tokens of every document, from the blocks' totals by a two-level prefix scan.

    A pair (separators, tokens since the last one) per block; pairs combine associatively: what follows a separator starts anew.
    Tokens after a file's last separator are a document too if there are any.
    """
    b = cut(blocks.withColumn("n", F.size("lengths").cast("long")).withColumn("sup", F.floor(F.col("block") / SUPER)), "tokens-blocks")
    upper = b.groupBy("file", "sup").agg(F.sum("n").alias("n"), F.max(F.when(F.col("n") > 0, F.col("block"))).alias("last"), F.sum("tail").alias("_"))
    since = b.join(upper.select("file", "sup", "last"), ["file", "sup"]).where(F.coalesce(F.col("block") >= F.col("last"), F.lit(True))).groupBy("file", "sup").agg(F.sum("tail").alias("tail"))
    upper = upper.drop("_").join(since, ["file", "sup"])

    def carried(rows: DataFrame, key: list[str], order: str) -> DataFrame:
        """ordinal and carry into each row: separators before it, and tokens since the last of them."""
        w = Window.partitionBy(*key).orderBy(order)
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("ordinal", F.coalesce(F.sum("n").over(before), F.lit(0)))
        rows = rows.withColumn("_run", F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        run = Window.partitionBy(*key, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumn("_sum", F.sum("tail").over(run)).withColumn("carry", F.coalesce(F.lag("_sum").over(w), F.lit(0))).drop("_run", "_sum")

    upper = carried(upper, ["file"], "sup").select("file", "sup", F.col("ordinal").alias("o_up"), F.col("carry").alias("c_up"))
    low = carried(b, ["file", "sup"], "block").join(upper, ["file", "sup"])
    # carry over the superblock's start holds only while it has had no separator
    low = low.withColumn("carry", F.col("carry") + F.when(F.col("ordinal") == 0, F.col("c_up")).otherwise(0)).withColumn("ordinal", F.col("ordinal") + F.col("o_up"))
    docs = low.select("file", "ordinal", "carry", F.posexplode("lengths").alias("i", "len")).select("file", (F.col("ordinal") + F.col("i")).alias("ordinal"), (F.col("len") + F.when(F.col("i") == 0, F.col("carry")).otherwise(0)).alias("n_tokens"))
    end = low.groupBy("file").agg(F.max_by(F.struct(F.col("ordinal"), F.col("n"), F.col("tail"), F.col("carry")), "block").alias("e"))
    rest = end.select("file", (F.col("e.ordinal") + F.col("e.n")).alias("ordinal"), (F.col("e.tail") + F.when(F.col("e.n") == 0, F.col("e.carry")).otherwise(0)).alias("n_tokens"))
    return docs.unionByName(rest.where("n_tokens > 0"))


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, block: int = BLOCK) -> DataFrame:
    """doc_id, n_tokens of every row of docs(doc_id, text): written as flat token files, scanned and stitched.

    Null or empty text: 0. Repeated rows stay rows; there are no ties to settle. Long texts are tokenised whole. Null doc_id:
    counted under null. Columns but doc_id and text are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    order = cut(write_token_files(docs, path, vocabulary), "tokens-order")
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = p.getFileSystem(spark._jsc.hadoopConfiguration())
    sizes = {s.getPath().getName(): s.getLen() for s in store.listStatus(p)} if store.exists(p) else {}
    names = [r["file"] for r in order.select("file").distinct().collect()]  # one per task that wrote
    files = spark.createDataFrame([(x, sizes[x]) for x in names], "file string, n_bytes long")
    found = order.join(stitched(scan_blocks(spark, path, files, EOD, 2, block)), ["file", "ordinal"], "left")
    return found.select("doc_id", F.coalesce("n_tokens", F.raise_error(F.lit("a document of a token file was not found by the scan")).cast("long")).alias("n_tokens"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
