"""Substring deduplication over a log-structured fingerprint index.

A window is 13 consecutive words of one document. A word goes if a window over it also starts in a document with a smaller
doc_id. Two steps find those windows exactly:

1. Anchors. Of the eight-word hashes inside a window the smallest is its anchor, so equal windows have equal anchors and the
   index needs about a third of the windows. The index is a set of immutable runs, tables bucketed by fingerprint and sorted
   inside a bucket. Each batch of documents is dealt to the buckets once and becomes a run; it is then merge-joined with every
   older run bucket by bucket, where both lie, so history is never shuffled. Anchors that two documents hold are returned to
   those documents. When there are too many runs the two smallest neighbours become one (`compact`), again without a shuffle.
2. Verification. Only windows over a shared anchor can repeat. Their full word sequence is compared by a 128-bit digest of
   two independent hashes, and the smallest doc_id of each is found in the same bucketed way.

Texts move only where they must: a filter of fixed size over the ids that have hits keeps the others out of the shuffle.
Rows between tasks are packed: one row per block of documents and bucket, with sorted keys. A key that many documents hold is
reduced to one entry per block before it is shuffled, and repeats inside a block are settled there, so no key gathers all its
documents in one task. What a bucket holds is bounded by the number of buckets, which follows the input's size.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as X
from ._spark import buckets_for, cut, drop, drop_path, scratch_path, sieve, sieve_slot, table

WINDOW = 13
ANCHOR = 8
#: Bytes of parquet that one bucket of keys, or one group of documents, stands for.
BUCKET_BYTES, GROUP_BYTES = 8 << 20, 2 << 20
#: Batches that the query takes the documents in, and runs that the index keeps.
BATCHES, MOST_RUNS = 3, 2

PACKED = "bucket int, run int, width int, docs binary, at binary, keys binary"
HITS = "grp int, width int, docs binary, at binary, keys binary"
_PACKED = pa.schema([("bucket", pa.int32()), ("run", pa.int32()), ("width", pa.int32()), ("docs", pa.binary()), ("at", pa.binary()), ("keys", pa.binary())])
_HITS = pa.schema([("grp", pa.int32()), ("width", pa.int32()), ("docs", pa.binary()), ("at", pa.binary()), ("keys", pa.binary())])
_U = np.uint64


def _words(batch: pa.RecordBatch, which=(0,)):
    data, off = X.raw(batch.column("text"))
    starts, ends, to = X.word_spans(data, off)
    return data, starts, ends, to, [X.span_hashes(data, starts, ends, k) for k in which]


def _anchors(h: np.ndarray, to: np.ndarray):
    """Eight-word hashes and, for each window of 13 words, the position of the smallest one inside it."""
    small, _, s_to = X.ngrams(h, to, ANCHOR)
    span = WINDOW - ANCHOR + 1
    count = np.maximum(np.diff(s_to) - span + 1, 0)
    w_to = np.concatenate([[0], np.cumsum(count)])
    first = np.arange(w_to[-1]) + np.repeat(s_to[:-1] - w_to[:-1], count)
    if not len(first):
        return small, first, w_to
    best = first.copy()
    for k in range(1, span):
        best = np.where(small[first + k] < small[best], first + k, best)
    return small, best, w_to


def _sorted_first(keys: list[np.ndarray], docs: np.ndarray):
    """Order by key and then document; marks of each key's first row."""
    order = np.lexsort([docs, *keys[::-1]])
    keys, docs = [k[order] for k in keys], docs[order]
    new = np.ones(len(docs), bool)
    if len(docs):
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return keys, docs, new, order


def _pack_by(part: np.ndarray, docs: np.ndarray, keys: list[np.ndarray], schema: pa.Schema, **fixed) -> pa.RecordBatch | None:
    """Rows grouped by `part`: per group its distinct documents, and per key an index into them."""
    if not len(part):
        return None
    order = np.argsort(part, kind="stable")
    part, docs, keys = part[order], docs[order], [k[order] for k in keys]
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    cols: dict[str, list] = {n: [] for n in schema.names}
    for lo, hi in zip(cuts, np.append(cuts[1:], len(part))):
        own, at = np.unique(docs[lo:hi], return_inverse=True)
        cols[schema.names[0]].append(int(part[lo]))
        cols["docs"].append(own.tobytes())
        cols["at"].append(at.astype(np.uint16 if len(own) < 65536 else np.uint32).tobytes())
        cols["keys"].append(b"".join(k[lo:hi].tobytes() for k in keys))
    for name, value in fixed.items():
        cols[name] = [value] * len(cuts)
    cols["width"] = [len(keys)] * len(cuts)
    return pa.RecordBatch.from_pydict(cols, schema=schema)


def _unpack(t: pa.Table) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """doc, keys and row number of every entry of packed rows."""
    docs, keys, rows = [], [], []
    for i, (d, a, k, w) in enumerate(zip(*(t.column(c).to_pylist() for c in ("docs", "at", "keys", "width")))):
        own = np.frombuffer(d, np.int64)
        n = len(k) // (8 * w)
        at = np.frombuffer(a, np.uint16 if len(a) == 2 * n else np.uint32)
        docs.append(own[at])
        keys.append(np.frombuffer(k, np.uint64).reshape(w, n))
        rows.append(np.full(n, i, np.int32))
    if not docs:
        return np.zeros(0, np.int64), [np.zeros(0, np.uint64)], np.zeros(0, np.int32)
    return np.concatenate(docs), list(np.concatenate(keys, axis=1)), np.concatenate(rows)


def _group_of(docs: np.ndarray, groups: int) -> np.ndarray:
    return (X.mix(docs.view(np.uint64)) % _U(groups)).astype(np.int32)


class _Block:
    """Collects one block's keys per document and packs them: keys for other blocks by bucket, settled repeats by group."""

    def __init__(self, buckets: int, groups: int, all_docs: bool):
        self.shift, self.groups, self.all_docs = _U(64 - buckets.bit_length() + 1), groups, all_docs

    def pack(self, docs: np.ndarray, keys: list[np.ndarray]):
        keys, docs, new, _ = _sorted_first(keys, docs)
        if not len(docs):
            return
        first = np.flatnonzero(new)
        least = np.repeat(docs[first], np.diff(np.append(first, len(docs))))
        repeat = docs != least
        if self.all_docs:  # the anchor's first document holds a shared anchor as well
            many = np.repeat(np.maximum.reduceat(docs, first) != docs[first], np.diff(np.append(first, len(docs))))
            settled = many & (repeat | new)
        else:
            settled = repeat
        again = np.zeros(len(docs), bool)
        again[1:] = (docs[1:] == docs[:-1]) & ~new[1:]
        settled &= ~again
        yield _pack_by((keys[0][new] >> self.shift).astype(np.int32), docs[new], [k[new] for k in keys], _PACKED, run=-1)
        # settled entries travel with the buckets under a bucket of their own group, marked by run -2
        yield _pack_by(_group_of(docs[settled], self.groups), docs[settled], [k[settled] for k in keys], _PACKED, run=-2)


def _tidy(go):
    """A function of one group that gives the memory of its arrays back before the next group, so that workers stay small."""

    def one(t: pa.Table) -> pa.Table:
        done = go(t)
        X.release()
        return done

    return one


def _tidy_two(go):
    """The same for a function of two groups that meet."""

    def both(one: pa.Table, two: pa.Table) -> pa.Table:
        done = go(one, two)
        X.release()
        return done

    return both


def _merge(groups: int, all_docs: bool, run: bool):
    """Settles one bucket of a batch: the hits of keys that several of its documents hold, and with `run` the bucket of its run."""
    as_run = run

    def go(t: pa.Table) -> pa.Table:
        run = np.asarray(t.column("run"))
        bucket, out = 0, []

        def put(kind: int, b: pa.RecordBatch) -> None:
            fixed = [pa.array(np.full(b.num_rows, x, np.int32)) for x in (kind, bucket)]
            out.append(pa.RecordBatch.from_arrays([*fixed, *b.columns], schema=_MERGED))

        bucket = int(t.column("bucket")[0].as_py())
        for r in t.filter(pa.array(run == -2)).to_batches():
            put(0, pa.RecordBatch.from_arrays([r.column("bucket"), *(r.column(c) for c in ("width", "docs", "at", "keys"))], schema=_HITS))
        rest = t.filter(pa.array(run != -2))
        if rest.num_rows:
            docs, keys, _ = _unpack(rest)
            keys, docs, new, _ = _sorted_first(keys, docs)
            first = np.flatnonzero(new)
            width = np.diff(np.append(first, len(docs)))
            hit = docs != np.repeat(docs[first], width)
            if all_docs:  # the first document of a shared key holds it as well
                hit = np.repeat(np.maximum.reduceat(docs, first) != docs[first], width)
            if (b := _pack_by(_group_of(docs[hit], groups), docs[hit], [k[hit] for k in keys], _HITS)) is not None:
                put(0, b)
            if as_run:  # one entry per fingerprint: its first document
                put(1, _pack_by(np.full(len(first), bucket, np.int32), docs[first], [k[first] for k in keys], _HITS))
        return pa.Table.from_batches(out, schema=_MERGED)

    return go


_MERGED = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("grp", pa.int32()), ("width", pa.int32()), ("docs", pa.binary()), ("at", pa.binary()), ("keys", pa.binary())])
MERGED = "kind int, bucket int, " + HITS


def _run_of(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Keys and documents of one bucket of a run, by key."""
    docs, keys, _ = _unpack(t)
    keys, docs, new, _ = _sorted_first(keys, docs)
    return keys[0][new], docs[new]


class FingerprintIndex:
    """Immutable runs of anchors with their first documents: tables bucketed by fingerprint, in a folder that all executors reach.

    Every batch becomes a run. A fingerprint may be in several runs; compaction keeps its first document. `close` ends the index.
    """

    def __init__(self, spark: SparkSession, buckets: int = 64, groups: int = 256, most_runs: int = MOST_RUNS):
        self.spark, self.buckets, self.groups, self.most_runs = spark, buckets, groups, most_runs
        self.runs: list[str] = []
        self.compactions = 0
        self._paths: dict[str, str] = {}

    def _write(self, rows: DataFrame) -> str:
        name, path = f"revstrand_run_{uuid.uuid4().hex}", scratch_path(self.spark, "run")
        rows.write.format("parquet").option("path", path).partitionBy("kind").bucketBy(self.buckets, "bucket").saveAsTable(name)
        self._paths[name] = path
        return name

    def _read(self, name: str, kind: int) -> DataFrame:
        return self.spark.table(name).where(F.col("kind") == kind)

    def _gone(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        drop_path(self.spark, self._paths.pop(name))

    def add(self, docs: DataFrame) -> DataFrame:
        """Anchors of docs(doc_id, text) that this batch shows to be in two documents, as packed rows by group (written)."""
        block, groups = _Block(self.buckets, self.groups, True), self.groups

        def sketch(batches):
            for b in X.pieces(batches):
                _, _, _, to, (h,) = _words(b)
                small, best, w_to = _anchors(h, to)
                ids = np.asarray(b.column("doc_id"), np.int64)[X.owners(w_to)]
                new = np.ones(len(best), bool)
                new[1:] = best[1:] != best[:-1]
                yield from filter(None, block.pack(ids[new], [small[best[new]]]))

        rows = docs.select("doc_id", "text").mapInArrow(sketch, PACKED).groupBy("bucket").applyInArrow(_tidy(_merge(groups, True, True)), MERGED)
        fresh = self._write(rows)
        parts = [self._read(fresh, 0).select(*_HITS.names), *(self._shared(fresh, old) for old in self.runs)]
        hits = cut(reduce(DataFrame.unionByName, parts), "index-hits")
        self.runs.append(fresh)
        while len(self.runs) > self.most_runs:
            self.compact()
        return hits

    def _shared(self, fresh: str, old: str) -> DataFrame:
        """A merge join of two runs: anchors of both, with the first document of each."""
        groups = self.groups

        def go(one: pa.Table, two: pa.Table) -> pa.Table:
            if not one.num_rows or not two.num_rows:
                return _HITS.empty_table()
            (k1, d1), (k2, d2) = _run_of(one), _run_of(two)
            at = np.minimum(np.searchsorted(k2, k1), len(k2) - 1)
            on = (k2[at] == k1) & (d2[at] != d1)
            docs, keys = np.concatenate([d1[on], d2[at[on]]]), np.concatenate([k1[on], k1[on]])
            b = _pack_by(_group_of(docs, groups), docs, [keys], _HITS)
            return _HITS.empty_table() if b is None else pa.Table.from_batches([b])

        return self._read(fresh, 1).groupBy("bucket").cogroup(self._read(old, 1).groupBy("bucket")).applyInArrow(_tidy_two(go), HITS)

    def compact(self) -> None:
        """Merges the two oldest runs into one, bucket by bucket; they go after the new one is complete."""
        if len(self.runs) < 2:
            return

        def go(one: pa.Table, two: pa.Table) -> pa.Table:
            docs, keys, _ = _unpack(pa.concat_tables([one, two]))
            keys, docs, new, _ = _sorted_first(keys, docs)
            bucket = (one if one.num_rows else two).column("bucket")[0].as_py()
            b = _pack_by(np.full(int(new.sum()), bucket, np.int32), docs[new], [k[new] for k in keys], _HITS)
            fixed = [pa.array(np.full(b.num_rows, x, np.int32)) for x in (1, bucket)]
            return pa.Table.from_batches([pa.RecordBatch.from_arrays([*fixed, *b.columns], schema=_MERGED)])

        a, b = self.runs[:2]
        both = self._read(a, 1).groupBy("bucket").cogroup(self._read(b, 1).groupBy("bucket")).applyInArrow(_tidy_two(go), MERGED)
        self.runs[:2] = [self._write(both)]
        self.compactions += 1
        for name in (a, b):
            self._gone(name)

    def close(self) -> None:
        while self.runs:
            self._gone(self.runs.pop())


def _ids(hits: DataFrame) -> DataFrame:
    """doc_id of every document of packed rows, once. A document's rows, one per bucket, meet in its group."""

    def go(t: pa.Table) -> pa.Table:
        return pa.table({"doc_id": np.unique(np.concatenate([np.frombuffer(x, np.int64) for x in t.column("docs").to_pylist()]))})

    return hits.select("grp", "docs").groupBy("grp").applyInArrow(go, "doc_id long")


def _packed_texts(docs: DataFrame, groups: int, bits, keep: tuple[str, ...] = ()) -> DataFrame:
    """grp, doc_id, z and the columns in `keep` of documents whose ids pass the filter: texts compressed for the shuffle."""

    def go(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        for b in batches:
            for x in X.pieces([b.filter(pa.array(bits.value.has(b.column("_at"))))]):
                ids = np.asarray(x.column("doc_id"), np.int64)
                z = [None if t is None else squeeze.compress(t.encode()) for t in x.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(_group_of(ids, groups)), pa.array(ids), pa.array(z, pa.binary()), *(x.column(c) for c in keep)], names=["grp", "doc_id", "z", *keep])

    kinds = dict(docs.dtypes)
    return docs.select("doc_id", "text", *keep, sieve_slot("doc_id").alias("_at")).mapInArrow(go, ", ".join(["grp int, doc_id long, z binary", *(f"`{c}` {kinds[c]}" for c in keep)]))


def _texts(t: pa.Table, keep: tuple[str, ...] = ()) -> pa.RecordBatch:
    loose = zstandard.ZstdDecompressor()
    body = [None if z is None else loose.decompress(z).decode() for z in t.column("z").to_pylist()]
    return pa.RecordBatch.from_arrays([t.column("doc_id").combine_chunks(), pa.array(body, pa.large_string()), *(t.column(c).combine_chunks() for c in keep)], names=["doc_id", "text", *keep])


def _hit_mask(docs: np.ndarray, keys: list[np.ndarray], h_docs: np.ndarray, h_keys: list[np.ndarray]) -> np.ndarray:
    """Which (doc, keys) are among the hits, by a merge of sorted rows."""
    if not len(h_docs) or not len(docs):
        return np.zeros(len(docs), bool)
    n = len(docs)
    all_docs, all_keys = np.concatenate([docs, h_docs]), [np.concatenate([a, b]) for a, b in zip(keys, h_keys)]
    order = np.lexsort([*all_keys, all_docs])
    d, ks = all_docs[order], [k[order] for k in all_keys]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | np.any([k[1:] != k[:-1] for k in ks], axis=0)
    first = np.flatnonzero(new)
    hit = np.repeat(np.logical_or.reduceat(order >= n, first), np.diff(np.append(first, len(d))))
    out = np.zeros(n + len(h_docs), bool)
    out[order] = hit
    return out[:n]


def _candidates(block: _Block):
    """Digests of the windows over a shared anchor, of one group's texts."""

    def go(texts: pa.Table, hits: pa.Table) -> pa.Table:
        out = []
        if texts.num_rows and hits.num_rows:
            h_docs, h_keys, _ = _unpack(hits)
            for b in X.pieces([_texts(texts)]):
                _, _, _, to, (h, h2) = _words(b, (0, 1))
                small, best, w_to = _anchors(h, to)
                ids = np.asarray(b.column("doc_id"), np.int64)[X.owners(w_to)]
                on = _hit_mask(ids, [small[best]], h_docs, h_keys)
                one, two = X.ngrams(h, to, WINDOW)[0], X.ngrams(h2, to, WINDOW, 1)[0]
                out += filter(None, block.pack(ids[on], [one[on], two[on]]))
        return pa.Table.from_batches(out, schema=_PACKED)

    return go


def repeats(docs: DataFrame, batches: int = BATCHES) -> tuple[DataFrame, int]:
    """Per group, the 128-bit digests of windows that a document with a smaller doc_id has too, as packed rows (written).

    An index of this call takes the documents in `batches` ranges of doc_id, oldest first. `history.History` is one that stays.
    """
    spark = docs.sparkSession
    groups = buckets_for(docs, GROUP_BYTES, 64)
    buckets = buckets_for(docs, BUCKET_BYTES, 16)
    own = FingerprintIndex(spark, buckets=buckets, groups=groups)
    cuts = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)]).alias("c")).first()["c"] or [] if batches > 1 else []
    cuts = sorted(set(cuts))
    found = []
    try:
        for lo, hi in zip([None, *cuts], [*cuts, None]):
            part = docs if lo is None else docs.where(F.col("doc_id") > lo)
            found.append(own.add(part if hi is None else part.where(F.col("doc_id") <= hi)))
    finally:
        own.close()
    shared = reduce(DataFrame.unionByName, found)
    packed = _packed_texts(docs, own.groups, sieve(_ids(shared)))
    buckets, groups = own.buckets, own.groups
    block = _Block(buckets, groups, False)

    rows = packed.groupBy("grp").cogroup(shared.groupBy("grp")).applyInArrow(_tidy_two(_candidates(block)), PACKED)
    hits = cut(rows.groupBy("bucket").applyInArrow(_tidy(_merge(groups, False, False)), MERGED).select(*_HITS.names), "digest-hits")
    drop(*found)
    return hits, groups


def dedup(docs: DataFrame, batches: int = BATCHES, keep: tuple[str, ...] = (), history=None) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the kept words joined by one space), text and the columns in `keep` of every row of docs.

    `text` is the row's own text where nothing was removed, else `kept`. Null or empty text: no words, kept ''. Documents of
    under 13 words keep everything. Rows with the same doc_id (repeats) are one document to each other: their windows don't
    count against themselves. Equal windows of one document are no ties. Null doc_id: kept whole, and counts against none. Long
    texts are judged whole. An empty table gives an empty result. `keep` takes no name of the result's own columns. With a `history`
    (`history.History`) documents that it took before count too, and docs are taken into it.
    """
    if clash := {"doc_id", "n_words", "n_removed", "kept", "text"} & set(keep):
        raise ValueError(f"columns of the result can't be kept besides: {sorted(clash)}")
    kinds = dict(docs.dtypes)
    known = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keep)
    hits, groups = history.take(known.select("doc_id", "text")) if history else repeats(known.select("doc_id", "text"), batches)

    def final(texts: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        if texts.num_rows:
            h_docs, h_keys, _ = _unpack(found)
            for b in X.pieces([_texts(texts, keep)]):
                data, starts, ends, to, (h, h2) = _words(b, (0, 1))
                ids = np.asarray(b.column("doc_id"), np.int64)
                one, at, w_to = X.ngrams(h, to, WINDOW)
                gone = np.zeros(len(starts) + 1, np.int32)
                if len(h_docs) and len(at):
                    two = X.ngrams(h2, to, WINDOW, 1)[0]
                    on = at[_hit_mask(ids[X.owners(w_to)], [one, two], h_docs, h_keys)]
                    gone += np.bincount(on, minlength=len(gone)).astype(np.int32)
                    gone -= np.bincount(on + WINDOW, minlength=len(gone)).astype(np.int32)
                gone = np.cumsum(gone[:-1]) > 0
                lost = np.concatenate([[0], np.cumsum(gone)])
                removed = lost[to[1:]] - lost[to[:-1]]
                body, kept, text = data.tobytes(), [], b.column("text").to_pylist()
                byte_to = X.raw(b.column("text"))[1]
                for i in range(len(ids)):
                    if removed[i]:
                        stay = np.flatnonzero(~gone[to[i] : to[i + 1]]) + to[i]
                        kept.append(b" ".join([body[s:e] for s, e in zip(starts[stay].tolist(), ends[stay].tolist())]).decode())
                        text[i] = kept[-1]
                    else:
                        kept.append(b" ".join(body[byte_to[i] : byte_to[i + 1]].split()).decode())
                out.append(pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.diff(to)), pa.array(removed), pa.array(kept, pa.string()), pa.array(text, pa.string()), *(b.column(c) for c in keep)], names=names))
        return pa.Table.from_batches(out)

    names = ["doc_id", "n_words", "n_removed", "kept", "text", *keep]
    schema = ", ".join(["doc_id long, n_words long, n_removed long, kept string, text string", *(f"`{c}` {kinds[c]}" for c in keep)])

    def settled(texts: pa.Table, found: pa.Table) -> pa.Table:
        if texts.num_rows:
            return final(texts, found)
        cols = [pa.array([], k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())]
        return pa.Table.from_arrays([*cols, *(texts.column(c) for c in keep)], names=names)

    bits = sieve(_ids(hits))
    done = _packed_texts(known, groups, bits, keep).groupBy("grp").cogroup(hits.groupBy("grp")).applyInArrow(_tidy_two(settled), schema)

    def whole(batches):
        for batch in batches:
            for b in X.pieces([batch.filter(pa.array(~bits.value.has(batch.column("_at"))))]):
                t = [b" ".join((x or "").encode().split()) for x in b.column("text").to_pylist()]
                n = [x.count(b" ") + 1 if x else 0 for x in t]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(np.zeros(len(t), np.int64)), pa.array([x.decode() for x in t], pa.string()), b.column("text"), *(b.column(c) for c in keep)], names=names)

    # documents without a hit, and rows without an id, are kept whole where they are
    rest = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keep, F.when(F.col("doc_id").isNotNull(), sieve_slot("doc_id")).alias("_at"))
    return done.unionByName(rest.mapInArrow(whole, schema))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dedup(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
