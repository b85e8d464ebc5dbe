"""WARC archives by a deterministic sharded writer, and their reader.

Records are ordered by page and payload and cut into ranges of about equal bytes, at bounds that follow from the rows alone. Each
range is sorted and streamed by one task, which rolls its file once the compressed bytes reach a limit, so names and bytes of the
files are the same in every run. Files are written under temporary names of their attempt; the names that successful tasks report
become a manifest, only these are moved to their places, and publishing the manifest is the commit.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import cut, drop, scratch_path, table
from .token_counts import _filesystem

#: Compressed bytes after which a file is rolled, payload bytes of a shard, and the most shards (they grow beyond that).
FILE_BYTES, SHARD_BYTES, MOST_SHARDS = 64 << 20, 32 << 20, 16384
#: Shards of a task, about.
SHARDS_EACH = 2
#: Rows per shard in the sample that bounds shards, by payload bytes.
SAMPLE = 24
#: Payloads below this many bytes are written whole even where they repeat.
LEAST = 100
DATE = "2000-01-01T00:00:00Z"
#: Names of the profile for revisits and of the HTTP header lines, as the format has them.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
LINE = "\r\n"


def _record_id(page, digest: str, ordinal: int) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page}|{digest}|{ordinal}'.encode()).digest()[:16], version=5)}>"


def _uri(url: str) -> str:
    """A url as one header value: blanks, control characters and what isn't ASCII are percent-encoded."""
    return "".join(c if 0x20 < ord(c) < 0x7F else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url)


def _member(head: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    """One record as a gzip member of its own; there is no time in its header, so equal records give equal bytes."""
    head = [*head, ("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest()), ("Content-Length", str(len(block)))]
    raw = ("WARC/1.1" + LINE + LINE.join(f"{k}: {v}" for k, v in head) + 2 * LINE).encode() + block + (2 * LINE).encode()
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def page_record(page, url, payload: bytes, digest: str, ordinal: int, refers, revisit: bool, date: str, level: int) -> bytes:
    """The response or revisit of a page. A revisit's block is the HTTP header alone, whose Content-Length is the full payload's."""
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(page, digest, ordinal)), ("WARC-Date", date)]
    head += [("WARC-Target-URI", _uri(url) if url else f"urn:page:{page}"), ("WARC-Payload-Digest", f"sha256:{digest}")]
    head += [("Content-Type", "application/http;msgtype=response")] + ([("X-Page-ID", str(page))] if page is not None else [])
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(refers, digest, 0))] + ([("X-Refers-To-Page-ID", str(refers))] if refers is not None else [])
    return _member(head, HTTP.format(len(payload)).encode() + (b"" if revisit else payload), level)


def _prepared(pages: DataFrame) -> DataFrame:
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload"), F.sha2(body, 256).alias("digest"), F.octet_length(body).cast("long").alias("size"))


def verdicts(thin: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, digest, refers_to of the pages whose payload a smaller page_id (nulls last) has, from thin(page_id, digest, size)."""
    some = thin.where(F.col("size") >= least).groupBy("digest", "page_id").agg(F.count("*").alias("n"))
    first = some.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("ids")).where("ids > 1").drop("ids")
    return some.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to")


def _key(page, digest) -> tuple:
    return (page is None, page or 0, digest)


def bounds(thin: DataFrame, shard_bytes: int) -> list[tuple]:
    """Keys that begin shards after the first: quantiles of a sample in proportion to bytes, chosen by a hash of the row.

    The sample is the rows of the least exponential clocks, which is the same whatever the partitions; its size is bounded.
    """
    total = thin.agg(F.sum("size")).first()[0] or 0
    n = min(max(-(-total // shard_bytes), 1), MOST_SHARDS)
    if n == 1:
        return []
    u = (F.pmod(F.xxhash64("page_id", "digest"), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    some = thin.select("page_id", "digest", (-F.log(u) / F.greatest("size", F.lit(1))).alias("at")).orderBy("at", F.col("page_id").asc_nulls_last(), "digest").limit(SAMPLE * n)
    keys = sorted(_key(r["page_id"], r["digest"]) for r in some.collect())
    return sorted({keys[len(keys) * i // n] for i in range(1, n)})


_MOVED = "shard long, page_id long, digest string, kind int, url string, refers_to long, copies long, payload binary"


def _dealt(rows: DataFrame, edges: list[tuple]) -> DataFrame:
    """Rows with their shard. Equal rows of a batch travel as one with a count, so a row repeated very often moves little."""
    shared = rows.sparkSession.sparkContext.broadcast(edges)
    names = [x.split()[0] for x in _MOVED.split(", ")]

    def go(batches):
        for b in batches:
            pages, digests, urls, kinds = (b.column(c).to_pylist() for c in ("page_id", "digest", "url", "kind"))
            count: dict[tuple, int] = {}
            first: list[int] = []
            for i, k in enumerate(zip(pages, digests, urls, kinds)):
                if k not in count:
                    first.append(i)
                count[k] = count.get(k, 0) + 1
            some = b.take(pa.array(first, pa.int64()))
            shard = [bisect_right(shared.value, _key(pages[i], digests[i])) for i in first]
            more = {"shard": pa.array(shard, pa.int64()), "copies": pa.array(list(count.values()), pa.int64())}
            yield pa.RecordBatch.from_arrays([more[c] if c in more else some.column(c) for c in names], names=names)

    return rows.mapInArrow(go, _MOVED)


_MANIFEST = "shard long, no long, file string, attempt string, records long, n_bytes long, sha256 string"


def _write(rows: DataFrame, path: str, attempts: str, file_bytes: int, date: str, level: int) -> DataFrame:
    """Streams sorted rows into files of their shard; returns a row per file. Every attempt has names of its own."""

    def go(batches):
        store, at = _filesystem(path)
        folder = f"{at}/{attempts}"
        store.create_dir(folder, recursive=True)
        out, shard, no, last, ordinal, refers, done = None, None, 0, None, 0, None, []
        n = size = 0
        mark = hashlib.sha256()

        def close():
            nonlocal out
            if out is not None:
                out.close()
                done.append((shard, no, f"pages-{shard:06d}-{no:05d}.warc.gz", attempt, n, size, mark.hexdigest()))
                out = None

        def put(body: bytes):
            nonlocal size
            out.write(body)
            mark.update(body)
            size += len(body)

        def flushed():
            got, done[:] = list(done), []
            if got:
                yield pa.RecordBatch.from_pydict({c: [g[i] for g in got] for i, c in enumerate(_COLS)})

        try:
            for b in batches:
                cols = [b.column(c) for c in ("shard", "page_id", "digest", "kind", "url", "refers_to", "copies")]
                payload = b.column("payload")
                for i, (s, page, digest, kind, url, refer, copies) in enumerate(zip(*(c.to_pylist() for c in cols))):
                    if (page, digest) != last:
                        last, ordinal, refers = (page, digest), 0, None
                    if kind == 0:  # the verdict comes before the rows that it is on
                        refers = (refer,)
                        continue
                    body = payload[i].as_py()
                    for _ in range(copies):
                        if out is not None and (s != shard or size >= file_bytes):
                            close()
                        if out is None:
                            no, shard = (no + 1 if s == shard else 0), s
                            attempt, n, size, mark = f"{uuid.uuid4().hex}.tmp", 0, 0, hashlib.sha256()
                            out = store.open_output_stream(f"{folder}/{attempt}")
                            name = f"pages-{shard:06d}-{no:05d}.warc.gz"
                            info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id("file", name, 0)), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
                            put(_member(info, b"format: WARC File Format 1.1\r\n", level))
                        again = refers is not None or (ordinal > 0 and len(body) >= LEAST)
                        put(page_record(page, url, body, digest, ordinal, refers[0] if refers else page, again, date, level))
                        ordinal, n = ordinal + 1, n + 1
                yield from flushed()
            close()
            yield from flushed()
        finally:
            if out is not None:
                out.close()

    return rows.mapInArrow(go, _MANIFEST)


_COLS = [x.split()[0] for x in _MANIFEST.split(", ")]


def write_archives(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES, shard_bytes: int = SHARD_BYTES, date: str = DATE, level: int = 6) -> DataFrame:
    """Writes pages(page_id, url, html) as WARC files into the folder `path` and returns its manifest: a row per file.

    Of pages with equal payloads of at least LEAST bytes, that with the smallest page_id is a response and the others are revisits
    of it; null page_ids come last; of repeated rows one is the response and the rest are revisits of their own page_id. Null html
    is an empty payload, a null url leaves `urn:page:...` as target. Payloads are never cut. Other columns are ignored. An empty
    table gives no files and an empty manifest. A folder that has a manifest is refused, and one without it counts as empty: what
    a broken run left there is never read. A record is one gzip member; all of a shard is streamed by one task.
    """
    spark = pages.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    sub = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    if store.exists(sub("_manifest")):
        raise FileExistsError(f"{path} has a manifest already")
    rows = _prepared(pages)
    thin = cut(rows.select("page_id", "digest", "size"), "warc-thin")
    edges = bounds(thin, shard_bytes)
    some = rows.select("page_id", "digest", F.lit(1).alias("kind"), "url", F.lit(None).cast("long").alias("refers_to"), "payload")
    said = verdicts(thin).select("page_id", "digest", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), "refers_to", F.lit(None).cast("binary").alias("payload"))
    # a task has a few shards, however many there are, and streams one after the other
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (len(edges) + 1) // SHARDS_EACH)
    dealt = _dealt(some.unionByName(said), edges).repartition(n, "shard")
    order = dealt.sortWithinPartitions("shard", F.col("page_id").asc_nulls_last(), "digest", "kind", "url")
    attempts = f"_temporary-{uuid.uuid4().hex}"
    _write(order, path, attempts, file_bytes, date, level).write.parquet(f"{path}/{attempts}/manifest")  # the attempts that count
    drop(thin)
    named = spark.read.schema(_MANIFEST).parquet(f"{path}/{attempts}/manifest")

    def move(batches):
        from pyarrow import fs

        files, folder = _filesystem(path)
        for b in batches:
            for name, attempt in zip(b.column("file").to_pylist(), b.column("attempt").to_pylist()):
                if files.get_file_info(f"{folder}/{attempts}/{attempt}").type != fs.FileType.NotFound:  # else an earlier attempt moved it
                    files.move(f"{folder}/{attempts}/{attempt}", f"{folder}/{name}")
                elif files.get_file_info(f"{folder}/{name}").type == fs.FileType.NotFound:
                    raise FileNotFoundError(name)
            yield b

    named.mapInArrow(move, _MANIFEST).drop("attempt").write.parquet(f"{path}/{attempts}/committed")
    if not store.rename(sub(f"{attempts}/committed"), sub("_manifest")):
        raise OSError(f"the manifest of {path} could not be published")
    store.delete(sub(attempts), True)
    return manifest(spark, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """shard, no, file, records, n_bytes, sha256 of the files that a committed write left in `path`."""
    return spark.read.schema("shard long, no long, file string, records long, n_bytes long, sha256 string").parquet(f"{path}/_manifest")


def members(stream, step: int = 1 << 20):
    """The uncompressed gzip members of a stream, one at a time."""
    rest = stream.read(step)
    while rest:
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if not rest and not (rest := stream.read(step)):
                raise EOFError("a gzip member is incomplete")
            parts.append(z.decompress(rest))
            rest = z.unused_data
        yield b"".join(parts)
        rest = rest or stream.read(step)


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block of a record; digests and lengths are checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split(LINE)
    if not first.startswith("WARC/1."):
        raise ValueError("this is no WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(fields["content-length"])]
    if len(block) != int(fields["content-length"]) or fields.get("warc-block-digest") != "sha256:" + hashlib.sha256(block).hexdigest():
        raise ValueError(f"the block of {fields.get('warc-record-id')} doesn't match its header")
    return fields, block


def _page(fields: dict[str, str], block: bytes) -> tuple:
    http, _, body = block.partition(b"\r\n\r\n")
    named = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode().split(LINE)[1:])}
    digest, kind, size = fields["warc-payload-digest"].removeprefix("sha256:"), fields["warc-type"], int(named["content-length"])
    if kind == "response" and (len(body) != size or hashlib.sha256(body).hexdigest() != digest):
        raise ValueError(f"the payload of {fields.get('warc-record-id')} doesn't match its digest")
    whole = lambda k: int(fields[k]) if k in fields else None
    return whole("x-page-id"), fields["warc-target-uri"], size, digest, kind, whole("x-refers-to-page-id") if kind == "revisit" else None, body if kind == "response" else None


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload, null in revisits) of a committed folder.

    Files are dealt to tasks and streamed a record at a time. Every block and payload is held against its digest.
    """
    kind = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payload
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: 6 + payload]
    names = [x.split()[0] for x in kind.split(", ")]

    def go(batches):
        store, at = _filesystem(path)
        for b in batches:
            for name in b.column("file").to_pylist():
                with store.open_input_stream(f"{at}/{name}", compression=None) as f:
                    rows, held = [], 0
                    for raw in members(f):
                        fields, block = parsed(raw)
                        if fields["warc-type"] not in ("response", "revisit"):
                            continue
                        rows.append(_page(fields, block)[: len(names)])
                        held += len(block) if payload else 0
                        if len(rows) >= 1000 or held >= 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return manifest(spark, path).select("file").repartition(F.col("file")).mapInArrow(go, kind)


def op12_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all `pages` as archives and returns what reading them back gives."""
    path = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
WITH d AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), o AS (
  SELECT *, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST) AS n, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to
FROM (SELECT *, payload_bytes >= {LEAST} AND n > 1 AS again FROM o)
"""
