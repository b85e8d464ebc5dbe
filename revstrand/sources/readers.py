"""Sources: FASTA, FASTQ (plain or gzip), header-named TSV, PAF, id lists and subsets."""

from __future__ import annotations

import itertools
import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import seq as S
from .ranges import RANGE, Range, planned


#: Columns that put records in the order of their files: file, block of the file, and a number that rises inside a block.
PLACE = ("file", "block", "at")


def read_fasta(spark: SparkSession, path, partitions: int | None = None, place: bool = False) -> DataFrame:
    """read_id (whole header), seq (upper case, IUPAC or N) of FASTA files, plain (split anywhere) or gzip; with `place` PLACE too.

    A gzip file is one task's work to unpack; `partitions` deals its records out afterwards.
    """
    raw = spark.read.option("lineSep", "\n>").text(path)
    where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")] if place else []
    raw = raw.select("value", *where)
    rec = F.regexp_replace("value", "^>", "")
    head = F.regexp_replace(F.substring_index(rec, "\n", 1), "\r$", "")
    body = F.regexp_replace(F.expr("substring(_r, length(substring_index(_r, '\n', 1)) + 1)"), r"\s", "")
    rows = raw.withColumn("_r", rec).where(F.length(F.trim("_r")) > 0).select(head.alias("read_id"), S.clean(body).alias("seq"), *(PLACE if place else ()))
    rows = rows.withColumn("len", F.length("seq").cast("long"))
    return rows.repartition(partitions) if partitions else rows


def _open(path: str):
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store.open_input_stream(at, compression="gzip" if path.endswith(".gz") else None)


def _records(lines):
    """(offset, header, sequence) of (offset, line) of a FASTQ, four by four; qualities may begin with @ and are dropped."""
    it = iter(lines)
    for at, head in it:
        head = head.rstrip(b"\r\n")
        if not head:
            continue
        if not head.startswith(b"@"):
            raise ValueError(f"not a FASTQ header: {head[:50]!r}")
        seq, plus, qual = (next(it, (0, b""))[1].rstrip(b"\r\n") for _ in range(3))
        if not plus.startswith(b"+") or len(qual) != len(seq):
            raise ValueError(f"broken FASTQ record: {head[:50]!r}")
        yield at, head[1:].decode("utf-8", "replace"), seq.decode("utf-8", "replace")


def records_of(r: Range):
    """(header, sequence) of the FASTQ records whose header begins in a range, whole.

    In the middle of a file the first line that begins with @ and has a + two lines on is a header: where @ begins a quality, the line
    two on is a sequence, which never begins with +.
    """
    lines = r.lines()
    ahead: list[tuple[int, bytes]] = []
    before = r.before()
    if before:
        if before != b"\n":
            next(lines, None)  # the rest of a line of the range before
        for line in lines:
            ahead.append(line)
            if len(ahead) == 3:
                if ahead[0][1].startswith(b"@") and ahead[2][1].startswith(b"+"):
                    break
                if ahead.pop(0)[0] >= r.pulled:  # past the range
                    return
        else:
            if not (len(ahead) == 3 and ahead[0][1].startswith(b"@")):
                return
    for at, head, seq in _records(itertools.chain(ahead, lines)):
        if at >= r.pulled:
            return
        yield head, seq


class FastqSource(DataSource):
    """FASTQ files in byte ranges, a task each. Option `plan`: the ranges, as JSON."""

    @classmethod
    def name(cls) -> str:
        return "revstrand_fastq"

    def schema(self) -> str:
        return "read_id string, seq string, file string, block long, at long"

    def reader(self, schema) -> DataSourceReader:
        return FastqReader(json.loads(self.options["plan"]), int(self.options["batch"]))


class FastqReader(DataSourceReader):
    def __init__(self, plan: list, batch: int):
        self.plan, self.batch = plan, batch

    def partitions(self):
        return [InputPartition(tuple(x)) for x in self.plan]

    def read(self, partition):
        path, begin, end, kind = partition.value
        names = ("read_id", "seq", *PLACE)
        with Range(path, begin, end, kind) as r:
            rows, held = [], 0
            for n, (h, s) in enumerate(records_of(r)):
                rows.append((h, s, path, begin, n))
                held += len(s)
                if len(rows) == self.batch or held >= 8 << 20:
                    yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)))))
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)))))


def list_sizes(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Path and bytes of the files that a path, folder or pattern names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or []
    out = []
    for f in found:
        inner = f.getPath().getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(f.getPath()) if f.isDirectory() else [f]
        out += [(x.getPath().toString(), x.getLen()) for x in inner if x.isFile() and x.getPath().getName()[0] not in "._"]
    return sorted(out)


def list_files(spark: SparkSession, path: str) -> list[str]:
    return [f for f, _ in list_sizes(spark, path)]


def read_fastq(spark: SparkSession, path: str, partitions: int | None = None, batch: int = 256, place: bool = False, size: int = RANGE) -> DataFrame:
    """read_id, seq, len of FASTQ files, with `place` PLACE too.

    Plain files and BGZF files are read in ranges of `size` bytes, each by its own task; another gzip file is streamed by one.
    """
    plan = planned(list_sizes(spark, path), size)
    if not plan:
        return spark.createDataFrame([], "read_id string, seq string, len long" + (", file string, block long, at long" if place else ""))
    spark.dataSource.register(FastqSource)
    rows = spark.read.format(FastqSource.name()).option("plan", json.dumps(plan)).option("batch", batch).load()
    rows = rows.select("read_id", S.clean("seq").alias("seq"), *(PLACE if place else ())).withColumn("len", F.length("seq").cast("long"))
    return rows.repartition(partitions) if partitions else rows


def is_fastq(spark: SparkSession, path: str) -> bool:
    """Whether the first file that the path names begins as a FASTQ does."""
    files = list_files(spark, path)
    if not files:
        raise FileNotFoundError(path)
    with _open(files[0]) as f:
        return f.read(1) == b"@"


def read_sequences(spark: SparkSession, path: str, partitions: int | None = None, place: bool = False) -> DataFrame:
    """FASTA or FASTQ by the first character of the first file."""
    return read_fastq(spark, path, partitions, place=place) if is_fastq(spark, path) else read_fasta(spark, path, partitions, place)


def read_tsv(spark: SparkSession, path, schema: str) -> DataFrame:
    """A tab-separated table by header name (order and extra columns don't matter); empty, `None` and `NaN` cells are null."""
    raw = spark.read.option("sep", "\t").option("header", True).option("nullValue", "").csv(path)
    known = {c.lstrip("#"): c for c in raw.columns}
    from pyspark.sql import types as T

    out = []
    for f in T._parse_datatype_string(schema).fields:
        if f.name in known:
            c = F.col(f"`{known[f.name]}`")
            out.append(F.when(c.isin("None", "NaN", ""), None).otherwise(c).try_cast(f.dataType).alias(f.name))
        else:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
    return raw.select(*out)


PAF = ("qname", "qlen", "qstart", "qend", "strand", "tname", "tlen", "tstart", "tend", "matches", "block", "mapq")


def read_paf(spark: SparkSession, path) -> DataFrame:
    """The twelve PAF columns, the tags as a map, and line_no, which rises in file order inside a file."""
    raw = spark.read.text(path).where(F.length(F.trim("value")) > 0).withColumn("line_no", F.monotonically_increasing_id())
    p = F.split("value", r"[\t ]+")
    cols = [(p.getItem(i) if n in ("qname", "strand", "tname") else p.getItem(i).try_cast("long")).alias(n) for i, n in enumerate(PAF)]
    tags = F.map_from_entries(F.transform(F.filter(F.slice(p, 13, 1000), lambda x: F.rlike(x, F.lit("^..:.:"))), lambda x: F.struct(F.substring(x, 1, 2), F.substring_index(x, ":", -1))))
    return raw.select("line_no", *cols, tags.alias("tags"))


def read_ids(spark: SparkSession, path) -> DataFrame:
    """Distinct canonical ids, one per line."""
    return spark.read.text(path).where(F.length(F.trim("value")) > 0).select(S.canonical_id(F.trim("value")).alias("id")).distinct()


def first_n(reads: DataFrame, n: int, order: str | None = None) -> DataFrame:
    """The first n reads: in file order where reads were read with their place, else by `order` (read_id); 0 keeps all."""
    if n <= 0:
        return reads
    by = [order] if order else list(PLACE) if set(PLACE) <= set(reads.columns) else ["read_id"]
    return reads.orderBy(*by).limit(n)


def extract(reads: DataFrame, ids: DataFrame) -> DataFrame:
    """Reads whose canonical id is listed; the planner broadcasts the list if it is small."""
    return reads.withColumn("id", S.canonical_id("read_id")).join(ids.select("id"), "id", "left_semi").drop("id")


def first_per_read(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")
