"""A substring index that outlives its batches: runs of anchors and digests, and the texts behind them, in a named folder.

Each batch adds one run of anchors (the first document of each), one of 128-bit digests (the first document of each) and its texts,
compressed. Anchors that a new batch shares with history lead back to the texts of the documents that were alone with them until
now; those windows are digested together with the batch's. Windows over anchors that were shared before have been digested then, so
the runs of digests hold them. Together that is every window that could equal one of the batch.

A manifest names the runs that count. Each batch publishes a new one by a rename, so a batch that breaks off leaves the index as it
was; files that no manifest names are never read. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from . import _text as X
from . import substring_dedup as S
from ._spark import cut, drop, drop_path, sieve, sieve_slot

TEXTS = "grp int, doc_id long, z binary"


def _packed(docs: DataFrame, groups: int) -> DataFrame:
    """grp, doc_id and compressed text of all documents."""

    def go(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        for b in X.pieces(batches):
            ids = np.asarray(b.column("doc_id"), np.int64)
            z = [None if t is None else squeeze.compress(t.encode()) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(S._group_of(ids, groups)), pa.array(ids), pa.array(z, pa.binary())], names=["grp", "doc_id", "z"])

    return docs.select("doc_id", "text").mapInArrow(go, TEXTS)


def _some(texts: DataFrame, bits) -> DataFrame:
    """Texts whose ids pass a filter."""

    def go(batches):
        for b in batches:
            yield b.filter(pa.array(bits.value.has(b.column("_at")))).select(["grp", "doc_id", "z"])

    return texts.withColumn("_at", sieve_slot("doc_id")).mapInArrow(go, TEXTS)


class History(S.FingerprintIndex):
    """An index in `folder`, opened if it is there. Buckets and groups are fixed when it is made; `close` ends this session's use."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64, groups: int = 256, most_runs: int = 4):
        super().__init__(spark, buckets, groups, most_runs)
        self.folder, self.version = folder.rstrip("/"), 0
        self.anchors, self.digests, self.texts = self.runs, [], []
        self._old: list[str] = []
        at = self._path(self.folder)
        self._store = at.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in self._store.listStatus(at)] if self._store.exists(at) else []
        if found := max((n for n in names if n.startswith("manifest-")), default=None):
            said = json.loads(spark.read.text(f"{self.folder}/{found}", wholetext=True).first()[0])
            self.buckets, self.groups, self.version, self.texts = said["buckets"], said["groups"], said["version"], said["texts"]
            self.anchors += [self._opened(x) for x in said["anchors"]]
            self.digests += [self._opened(x) for x in said["digests"]]

    def _path(self, at: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(at)

    def _write(self, rows: DataFrame) -> str:
        name = f"revstrand_run_{uuid.uuid4().hex}"
        self._paths[name] = f"{self.folder}/{name}"
        rows.write.format("parquet").option("path", self._paths[name]).partitionBy("kind").bucketBy(self.buckets, "bucket").saveAsTable(name)
        return name

    def _opened(self, run: str) -> str:
        """A run of an earlier session under a name of this one, bucketed as it lies."""
        name = f"revstrand_run_{uuid.uuid4().hex}"
        self._paths[name] = f"{self.folder}/{run}"
        columns = S.MERGED.replace("kind int, ", "") + ", kind int"
        self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet PARTITIONED BY (kind) CLUSTERED BY (bucket) INTO {self.buckets} BUCKETS LOCATION '{self._paths[name]}'")
        self.spark.sql(f"MSCK REPAIR TABLE {name}")
        return name

    def _gone(self, name: str) -> None:
        """A run that compaction replaced goes once the manifest that doesn't name it is out."""
        self._old.append(name)

    def _publish(self) -> None:
        base = lambda names: [self._paths[n].rsplit("/", 1)[1] for n in names]
        said = {"version": self.version + 1, "buckets": self.buckets, "groups": self.groups, "anchors": base(self.anchors), "digests": base(self.digests), "texts": self.texts}
        from ..storage import write_text

        tmp = f"{self.folder}/_tmp-{uuid.uuid4().hex}"
        write_text(self.spark, tmp, json.dumps(said))
        if not self._store.rename(self._path(tmp), self._path(f"{self.folder}/manifest-{self.version + 1:09d}.json")):
            raise OSError("another writer has published this version of the index")
        self.version += 1
        while self._old:
            name = self._old.pop()
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            drop_path(self.spark, self._paths.pop(name))

    def _earlier(self, fresh: str, old: str) -> DataFrame:
        """Hits of the digests of a fresh run whose first document comes after that of an older run."""
        groups = self.groups

        def go(one: pa.Table, two: pa.Table) -> pa.Table:
            if not one.num_rows or not two.num_rows:
                return S._HITS.empty_table()
            (d1, k1, _), (d2, k2, _) = S._unpack(one), S._unpack(two)
            keys, docs, new, order = S._sorted_first([np.concatenate(x) for x in zip(k1, k2)], np.concatenate([d1, d2]))
            least = np.repeat(docs[new], np.diff(np.append(np.flatnonzero(new), len(docs))))
            hit = (order < len(d1)) & (docs != least)
            b = S._pack_by(S._group_of(docs[hit], groups), docs[hit], [k[hit] for k in keys], S._HITS)
            return S._HITS.empty_table() if b is None else pa.Table.from_batches([b])

        return self._read(fresh, 1).groupBy("bucket").cogroup(self._read(old, 1).groupBy("bucket")).applyInArrow(S._tidy_two(go), S.HITS)

    def take(self, docs: DataFrame) -> tuple[DataFrame, int]:
        """Takes docs(doc_id, text) in. Per group, the digests of their windows that a document with a smaller doc_id, of the batch or
        of history, has too, as packed rows (written); and the number of groups. Documents taken earlier are not judged again."""
        shared = self.add(docs)
        name = f"texts-{uuid.uuid4().hex}"
        _packed(docs, self.groups).write.parquet(f"{self.folder}/{name}")
        bits, read = sieve(S._ids(shared)), self.spark.read.schema(TEXTS)
        some = reduce(DataFrame.unionByName, [_some(read.parquet(f"{self.folder}/{x}"), bits) for x in [*self.texts, name]])
        block = S._Block(self.buckets, self.groups, False)
        rows = some.groupBy("grp").cogroup(shared.groupBy("grp")).applyInArrow(S._tidy_two(S._candidates(block)), S.PACKED)
        fresh = self._write(rows.groupBy("bucket").applyInArrow(S._tidy(S._merge(self.groups, False, True)), S.MERGED))
        hits = cut(reduce(DataFrame.unionByName, [self._read(fresh, 0).select(*S._HITS.names), *(self._earlier(fresh, old) for old in self.digests)]), "digest-hits")
        drop(shared)
        self.texts = [*self.texts, name]
        self.digests.append(fresh)
        self.anchors = self.runs
        while len(self.digests) > self.most_runs:
            self.runs = self.digests
            self.compact()
            self.digests, self.runs = self.runs, self.anchors
        self._publish()
        return hits, self.groups

    def close(self) -> None:
        """Forgets this session's names of the runs; the folder stays."""
        for name in [*self.anchors, *self.digests]:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.runs = self.anchors = []
        self.digests = []
