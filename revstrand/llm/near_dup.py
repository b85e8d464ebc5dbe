"""Near duplicates by DartMinHash and banded joining.

A document is a weighted set of five-word shingles. The region of a shingle of weight c is [0, c), cut into unit cells; each cell
throws hashed darts whose ranks are a Poisson process of rate 1, so darts of rank below r fall in proportion to the weight. A
document looks only at darts below a rank that leaves about K (ln K + 3) of them over all its cells, keeps the earliest dart of
each of the K coordinates, and looks twice as far while a coordinate has none. Two documents have the same dart at a coordinate
with the probability of their weighted Jaccard similarity, and the work is linear in the text plus K ln K. Signatures and
verification read the same cells, so both speak of one similarity: by default every distinct shingle weighs 1, and with
`weighted` as much as it occurs.

Documents of the same words are one node from the start. Nodes that share a band of coordinates are compared:

1. Bands of up to FEW nodes: all their pairs.
2. Larger ones: every node with two leaders, the node that has most company over all its bands and the first one.
3. Nodes of larger bands that still hold different classes: pairs that share a rare shingle, which are few by its rarity, unless
   their counts rule the similarity out.
4. Where nothing rules it out, all other pairs of different classes of a band, in blocks of bounded size, by counts of shared
   shingles. A class is never compared with itself.

So no pair that shares a band is missed, however many nodes the band has. What is compared grows with the nodes, but for bands of
many nodes in different classes with few rare shingles, where it grows with their square. Of pairs at a similarity of exactly 0.8,
0.04 % share no band.

A pair is compared where its leader is: members' compressed texts go there, at most CROWD to a group, and a leader with more of
them is in several groups. The comparison is exact; classes are the connected components of the pairs that pass.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as X
from ._spark import cut, drop, sieve, sieve_slot, table

SHINGLE = 5
SIMILARITY = 0.8
ROWS, BANDS = 5, 20
#: Bands of up to so many nodes are compared pair by pair.
FEW = 6
#: Members that one group compares with their leader.
CROWD = 256
#: Texts and elements, about, of a block whose members are compared with those of another, and shingles counted at once.
BLOCK, ELEMENTS, COLUMNS = 1024, 1 << 18, 4096
#: A shingle is rare among the documents still to be compared if at most this many have it.
RARE = 16
#: Links whose components one task finds (two longs each, 16 MB in all).
FEW_EDGES = 1 << 20
_U = np.uint64


def _nth(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How often each shingle occurrence's shingle came before it inside the document."""
    doc = X.owners(off)
    key = h ^ X.mix(doc.astype(np.uint64) + _U(1))
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    start = np.flatnonzero(new)
    nth = np.empty(len(k), np.int64)
    nth[order] = np.arange(len(k)) - np.repeat(start, np.diff(np.append(start, len(k))))
    return nth


def _cells(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Each shingle occurrence's own unit cell: its hash with the number of the occurrence inside the document."""
    nth = _nth(h, off)
    return np.where(nth == 0, h, X.mix(h + nth.astype(np.uint64) * _U(0x9E3779B97F4A7C15)))


def _distinct(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first occurrence of each shingle of a document, and their offsets."""
    first = _nth(h, off) == 0
    return h[first], np.concatenate([[0], np.cumsum(first)])[off]


def _unit(h: np.ndarray) -> np.ndarray:
    return ((h >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def dart_signatures(cells: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """(documents, k) dart ids, 0 for documents without shingles."""
    n = len(off) - 1
    sig, best = np.zeros((n, k), np.uint64), np.full((n, k), np.inf)
    size = np.diff(off)
    todo = np.flatnonzero(size)
    reach = k * (np.log(k) + 3.0) / np.maximum(size, 1)
    while len(todo):
        at = np.arange(size[todo].sum()) + np.repeat(off[todo] - np.concatenate([[0], np.cumsum(size[todo])[:-1]]), size[todo])
        doc = np.repeat(todo, size[todo])
        cell, rank, limit, d = cells[at], np.zeros(len(at)), reach[doc], 0
        parts = []
        while len(cell):
            d += 1
            h = X.mix(cell + _U(d * 0xA24BAED4963EE407 & (1 << 64) - 1))
            rank = rank - np.log(_unit(h))
            on = rank < limit
            cell, rank, limit, doc, h = cell[on], rank[on], limit[on], doc[on], h[on]
            if len(h):
                parts.append((doc, rank, X.mix(h + _U(0x632BE59BD9B4E019))))
        doc, rank, dart = (np.concatenate(p) for p in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.uint64))
        slot = doc * k + ((dart >> _U(33)) % _U(k)).astype(np.int64)
        low = best.reshape(-1)
        np.minimum.at(low, slot, rank)
        won = low[slot] == rank
        sig.reshape(-1)[slot[won]] = dart[won] | _U(1)
        todo = todo[np.isinf(best[todo]).any(axis=1)]
        reach[todo] *= 2
        best[todo], sig[todo] = np.inf, 0
    return sig


def _shingles(b: pa.RecordBatch):
    """Shingle hashes and offsets; a document of one to four words is one shingle."""
    data, off = X.raw(b.column("text"))
    starts, ends, to = X.word_spans(data, off)
    words = X.span_hashes(data, starts, ends)
    h, _, s_to = X.ngrams(words, to, SHINGLE)
    few = np.flatnonzero((np.diff(to) > 0) & (np.diff(to) < SHINGLE))
    if len(few):
        one = np.array([int(X.ngrams(words[to[i] : to[i + 1]], np.array([0, to[i + 1] - to[i]]), int(to[i + 1] - to[i]), 7)[0][0]) for i in few], np.uint64)
        h = np.insert(h, s_to[few], one)
        s_to = s_to + np.concatenate([[0], np.cumsum(np.isin(np.arange(len(to) - 1), few))])
    whole = [X.span_hashes(data, starts, ends, 1), words]
    return h, s_to, to, whole


def _elements(h: np.ndarray, off: np.ndarray, weighted: bool) -> tuple[np.ndarray, np.ndarray]:
    """Cells of each document's shingles: one of each, or with `weighted` one of each occurrence. Similarity is that of these sets."""
    return (_cells(h, off), off) if weighted else _distinct(h, off)


def sketches(docs: DataFrame, rows: int = ROWS, bands: int = BANDS, weighted: bool = False) -> DataFrame:
    """doc_id, k1, k2 (128-bit key of the word sequence, null without words) and bands of every row of docs(doc_id, text)."""

    def go(batches):
        for b in X.pieces(batches):
            h, s_to, to, whole = _shingles(b)
            sig = dart_signatures(*_elements(h, s_to, weighted), rows * bands)
            key = np.zeros((sig.shape[0], bands), np.uint64)
            for r in range(rows):
                key = key * _U(0xC2B2AE3D27D4EB4F) + sig[:, r::rows]
            key = X.mix(key + np.arange(bands, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)).view(np.int64)
            has = np.diff(to) > 0
            keys = [np.zeros(len(has), np.int64)] * 2
            if len(whole[0]):
                first = to[:-1][has]
                pos = np.arange(to[-1]) - np.repeat(to[:-1], np.diff(to))
                keys = [np.zeros(len(has), np.uint64), np.zeros(len(has), np.uint64)]
                for i in range(2):
                    keys[i][has] = np.add.reduceat(X.mix(whole[i] + pos.astype(np.uint64) * _U(0xA24BAED4963EE407 + 2 * i)), first)
                keys = [X.mix(x).view(np.int64) for x in keys]
            null = lambda x: pa.array(np.asarray(x), mask=~has)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1) * bands, pa.int32()), pa.array(key.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), null(keys[0]), null(keys[1]), lists], names=["doc_id", "k1", "k2", "bands"])

    return docs.select("doc_id", "text").mapInArrow(go, "doc_id long, k1 long, k2 long, bands array<long>")


def _loose(batches, keep: tuple[str, ...]):
    """Batches of compressed texts in pieces of bounded text: the columns in `keep`, and `text`."""
    d = zstandard.ZstdDecompressor()

    def parts():
        for b in batches:
            z = b.column("z").to_pylist()
            to = np.concatenate([[0], np.cumsum([zstandard.frame_content_size(x) for x in z])])
            i = 0
            while i < len(z):
                j = max(i + 1, int(np.searchsorted(to, to[i] + X.PIECE, "right")) - 1)
                text = pa.array([d.decompress(x).decode() for x in z[i:j]], pa.large_string())
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in keep), text], names=[*keep, "text"])
                i = j

    return X.pieces(parts())


def _sets(texts: DataFrame, weighted: bool) -> DataFrame:
    """rep, t (a hash that tells rows apart, also those of equal sets) and each element s of the set of every row of texts(doc_id, z)."""

    def go(batches):
        for b in _loose(batches, ("doc_id", "t")):
            h, s_to, _, _ = _shingles(b)
            e, off = _elements(h, s_to, weighted)
            own = X.owners(off)
            yield pa.RecordBatch.from_arrays([*(pa.array(np.asarray(b.column(c))[own]) for c in ("doc_id", "t")), pa.array(e.view(np.int64))], names=["rep", "t", "s"])

    return texts.select("doc_id", "z", F.xxhash64("doc_id", "z").alias("t")).mapInArrow(go, "rep long, t long, s long")


def _small_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and the compressed text of documents that may be in ids, so that a shuffle moves less."""
    bits = sieve(ids)

    def go(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        for b in batches:
            b = b.filter(pa.array(bits.value.has(b.column("at"))))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array([squeeze.compress((x or "").encode()) for x in b.column("text").to_pylist()], pa.binary())], names=["doc_id", "z"])

    return docs.select("doc_id", "text", sieve_slot("doc_id").alias("at")).mapInArrow(go, "doc_id long, z binary")


def verified(pairs: DataFrame, texts: DataFrame, least: float, weighted: bool = False) -> DataFrame:
    """The pairs (a, b) with a Jaccard similarity of `least` or more. texts: doc_id and z, its compressed text, for both sides.

    A doc_id with several texts is as near to another as any of its texts is.
    """
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / CROWD).alias("groups"))
    jobs = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("groups")).alias("g"))
    leads = jobs.select("a", "g").distinct().join(texts.withColumnRenamed("doc_id", "a"), "a").select("a", "g", F.lit(None).cast("long").alias("b"), "z")
    mates = jobs.join(texts.withColumnRenamed("doc_id", "b"), "b").select("a", "g", "b", "z")
    rows = leads.unionByName(mates).repartition("a", "g").sortWithinPartitions("a", "g", F.col("b").asc_nulls_first())

    def go(batches):
        lead, own = None, []  # the leader whose group goes on, and the sets of its texts
        for b in _loose(batches, ("a", "g", "b")):
            h, s_to, _, _ = _shingles(b)
            e, off = _elements(h, s_to, weighted)
            e = e[np.lexsort([e, X.owners(off)])]
            good = []
            for i, (a, g, m) in enumerate(zip(*(b.column(c).to_pylist() for c in ("a", "g", "b")))):
                mine = e[off[i] : off[i + 1]]
                if m is None:
                    own = [*own, mine] if lead == (a, g) else [mine]
                    lead = (a, g)
                    continue
                for other in own if lead == (a, g) else []:
                    n, k = len(mine), len(other)
                    if min(n, k) < least * max(n, k) - 1e-9 or not k:
                        continue
                    at = np.searchsorted(other, mine)
                    both = int((other[np.minimum(at, k - 1)] == mine).sum())
                    if both >= least * (n + k - both) - 1e-9:
                        good.append((a, m))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in good], pa.int64()), pa.array([x for _, x in good], pa.int64())], names=["a", "b"])

    return rows.mapInArrow(go, "a long, b long")


def _roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and the smallest id of each one's component, by hooking roots to smaller ones and halving paths, all edges at once."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    up = np.arange(len(ids))
    while True:
        x, y = up[a], up[b]
        if (x == y).all():
            return ids, ids[up]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while (far := up[up]).tobytes() != up.tobytes():
            up = far


def components(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """id, root (the smallest id of its component) of every id in edges(a, b) that isn't its own root, by alternating large-star and small-star steps.

    Neighbours are handled by aggregation and a join, so a hub is never gathered in one row; each round's edges are written. Edges
    that number `few` at most are the work of one task, which gives the same.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "near-cc")
    if e.count() <= few:

        def go(batches):
            got = [(np.asarray(b.column("u")), np.asarray(b.column("v"))) for b in batches if b.num_rows]
            if got:
                ids, root = _roots(*(np.concatenate(x) for x in zip(*got)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[ids != root]), pa.array(root[ids != root])], names=["id", "root"])

        return e.coalesce(1).mapInArrow(go, "id long, root long")
    last, e_before = None, e
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        e = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u != v").distinct()
        e = cut(e, "near-cc")
        drop(e_before)
        e_before = e
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            return e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("root"))
        last = now


def _small_bands(member: DataFrame) -> DataFrame:
    """All pairs (a, b), a < b, of the nodes of each band of member(rep, band), a few to each."""
    x = member.groupBy("band").agg(F.array_sort(F.collect_set("rep")).alias("x"))
    rows = x.select("x", F.posexplode("x").alias("i", "a")).select("a", F.explode(F.slice("x", F.col("i") + 2, F.size("x"))).alias("b"))
    return rows.distinct()


def _led(member: DataFrame, lead: DataFrame, *who: str) -> DataFrame:
    """Pairs (a, b) of a band's leaders and each other member of it."""
    return member.join(lead, "band").select(F.explode(F.array(*who)).alias("a"), F.col("rep").alias("b")).where("a != b").distinct()


def _compared(member: DataFrame, keep) -> tuple[DataFrame, DataFrame]:
    """Pairs to compare of member(rep, band, ...), and its rows of bands with more than FEW nodes, with their number c."""
    full = member.groupBy("band").agg(F.count("*").alias("c")).where("c > 1")
    member = keep(member.join(full, "band"), "near-bands")
    big = member.where(F.col("c") > FEW)
    company = member.groupBy("rep").agg(F.sum("c").alias("company"))
    lead = big.join(company, "rep").groupBy("band").agg(F.max_by("rep", F.struct("company", -F.col("rep"))).alias("hub"), F.min("rep").alias("low"))
    return _small_bands(member.where(F.col("c") <= FEW)).unionByName(_led(big, lead, "hub", "low")), big


def _still_open(member: DataFrame, links: DataFrame, keep) -> DataFrame:
    """rep, band, root of the members of bands that hold different classes."""
    root = components(links)
    named = member.join(root.withColumnRenamed("id", "rep"), "rep", "left").select("rep", "band", F.coalesce("root", "rep").alias("root"))
    bands = named.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("band")
    return keep(named.join(bands, "band"), "near-open")


def _rare(named: DataFrame, texts: DataFrame, similarity: float, weighted: bool, keep) -> tuple[DataFrame, DataFrame]:
    """rep, d, d_low, common of the open nodes, and pairs (a, b) of different classes that share a rare element and can be near.

    d, d_low: elements of a node's largest and smallest text; common: the most elements of a text that aren't rare. Rare ones are
    those that at most RARE open texts have, so pairs over one of them are few, and what two nodes share is what they share of
    rare elements and at most their common ones.
    """
    roots = named.select("rep", "root").distinct()
    each = keep(_sets(texts.join(roots.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"), weighted), "near-elements")
    few = each.groupBy("s").agg(F.count("*").alias("c")).where(F.col("c") <= RARE)
    rare = keep(each.select("t", "s").join(few, "s"), "near-rare")
    own = rare.groupBy("t").agg(F.count("*").alias("own"))
    size = each.groupBy("rep", "t").agg(F.count("*").alias("d")).join(own, "t", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    size = keep(size.select("rep", "t", "d", (F.col("d") - F.col("own")).alias("common")), "near-sizes")
    node = size.groupBy("rep").agg(F.max("d").alias("d"), F.min("d").alias("d_low"), F.max("common").alias("common"))
    x = F.struct("rep", "root", "d", "d_low", "common")
    met = rare.where("c > 1").select("t", "s").join(size.select("t", "rep").join(roots, "rep").join(node, "rep").select("t", x.alias("x")), "t")
    met = met.groupBy("s").agg(F.collect_set("x").alias("x")).select(F.explode("x").alias("p"), "x").select("p", F.explode("x").alias("q"))
    met = met.where((F.col("p.rep") < F.col("q.rep")) & (F.col("p.root") != F.col("q.root")) & (F.least("p.d", "q.d") >= similarity * F.greatest("p.d_low", "q.d_low") - 1e-9))
    met = met.groupBy(F.col("p.rep").alias("a"), F.col("q.rep").alias("b")).agg(F.count("*").alias("n"), F.first(F.least("p.common", "q.common")).alias("c"), F.first(F.col("p.d_low") + F.col("q.d_low")).alias("both"))
    shared = F.col("n") + F.col("c")
    return node, met.where(shared >= similarity * (F.col("both") - shared) - 1e-9).select("a", "b")


def _joined(t: pa.Table, least: float, weighted: bool) -> pa.Table:
    """One near pair (a, b) for each two classes that become one by near pairs of two blocks, or of one. t: rep, root, side, z."""
    es, size, rep, root, side = [], [], [], [], []
    for b in _loose(t.to_batches(), ("rep", "root", "side")):
        h, s_to, _, _ = _shingles(b)
        e, off = _elements(h, s_to, weighted)
        es.append(e)
        size.append(np.diff(off))
        for got, c in ((rep, "rep"), (root, "root"), (side, "side")):
            got.append(np.asarray(b.column(c)))
    e, size, rep, root, side = (np.concatenate(x) for x in (es, size, rep, root, side))
    own = np.repeat(np.arange(len(size)), size)
    _, col, df = np.unique(e, return_inverse=True, return_counts=True)
    on = df[col] > 1  # an element of one text is shared by none
    own, col = own[on], (np.cumsum(df > 1) - 1)[col[on]]
    order = np.argsort(col, kind="stable")
    own, col = own[order], col[order]
    one = np.flatnonzero(side == 0)
    two = np.flatnonzero(side == 1) if (side == 1).any() else one
    both = np.zeros((len(one), len(two)))
    for lo in range(0, int((df > 1).sum()), COLUMNS):
        i, j = np.searchsorted(col, [lo, lo + COLUMNS])
        has = np.zeros((len(size), COLUMNS), np.float32)
        has[own[i:j], col[i:j] - lo] = 1
        both += has[one] @ has[two].T
    near = (both > 0) & (both >= least * (size[one][:, None] + size[two] - both) - 1e-9) & (root[one][:, None] != root[two])
    x, y = np.nonzero(near)
    x, y = one[x], two[y]
    up, found = {}, []

    def top(r):
        while up.get(r, r) != r:
            r = up[r]
        return r

    for i in np.unique(np.stack([root[x], root[y]]), axis=1, return_index=True)[1] if len(x) else ():
        r, q = top(int(root[x[i]])), top(int(root[y[i]]))
        if r != q:
            up[r] = q
            found.append((int(rep[x[i]]), int(rep[y[i]])))
    return pa.table({"a": pa.array([p for p, _ in found], pa.int64()), "b": pa.array([q for _, q in found], pa.int64())})


def _rest(x: DataFrame, texts: DataFrame, least: float, weighted: bool) -> DataFrame:
    """Pairs (a, b) that join all classes with a near pair in a band of x(rep, band, root, d), from all pairs of its classes.

    A large class of a band has blocks of its own, small ones share blocks; blocks of one class are not compared.
    """
    parts = F.greatest(F.ceil(F.sum("n") / BLOCK), F.ceil(F.sum("e") / ELEMENTS))
    of = x.groupBy("band", "root").agg(F.count("*").alias("n"), F.sum("d").alias("e"))
    of = of.withColumn("own", F.when((2 * F.col("n") > BLOCK) | (2 * F.col("e") > ELEMENTS), F.col("root")))
    many = of.groupBy("band", "own").agg(parts.alias("parts"))
    x = x.join(of.select("band", "root", "own"), ["band", "root"]).join(many.withColumnsRenamed({"band": "b2", "own": "o2"}), F.expr("band = b2 AND own <=> o2"))
    x = x.select("rep", "band", "root", F.struct("own", F.pmod(F.xxhash64("rep"), "parts").alias("nth")).alias("block"))
    lists = x.groupBy("band").agg(F.array_sort(F.collect_set("block")).alias("x"))
    jobs = lists.select("band", "x", F.posexplode("x").alias("i", "p")).select("band", "p", F.explode(F.slice("x", F.col("i") + 1, F.size("x"))).alias("q"))
    jobs = jobs.where("p.own IS NULL OR q.own IS NULL OR p.own != q.own").withColumn("job", F.xxhash64("band", "p", "q"))
    sides = F.when(F.expr("p = q"), F.array(F.struct(F.col("p").alias("block"), F.lit(0).alias("side"))))
    sides = sides.otherwise(F.array(*(F.struct(F.col(c).alias("block"), F.lit(i).alias("side")) for i, c in enumerate("pq"))))
    jobs = jobs.select("band", "job", F.explode(sides).alias("y")).select("band", "job", "y.side", F.col("y.block.own").alias("o2"), F.col("y.block.nth").alias("n2"))
    x = x.withColumnsRenamed({"band": "b2"}).join(jobs, F.expr("b2 = band AND block.own <=> o2 AND block.nth = n2")).select("job", "rep", "root", "side")
    rows = x.join(texts.withColumnRenamed("doc_id", "rep"), "rep").select("job", "rep", "root", "side", "z")
    return rows.groupBy("job").applyInArrow(lambda t: _joined(t, least, weighted), "a long, b long")


def classes(docs: DataFrame, similarity: float = SIMILARITY, rows: int = ROWS, bands: int = BANDS, weighted: bool = False) -> DataFrame:
    """doc_id, class_id of every row of docs(doc_id, text): the smallest doc_id of the row's class of near duplicates.

    Null, empty or blank text: a class of its own. Documents of under five words are one shingle, so only equal ones meet.
    Repeated rows and copies share a class. A doc_id that stands for several texts joins their classes. Long texts are compared
    whole. Null doc_id: null class. An empty table gives an empty result. Columns but doc_id and text are ignored.
    """
    known = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = cut(sketches(known, rows, bands, weighted), "near-sketch")
    reps = cut(seen.where("k1 IS NOT NULL").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "near-reps")
    member = reps.select("rep", F.explode("bands").alias("band")).distinct()
    done: list[DataFrame] = []  # tables that nothing reads once classes are known

    def keep(rows: DataFrame, tag: str) -> DataFrame:
        done.append(cut(rows, tag))
        return done[-1]

    pairs, big = _compared(member, keep)
    pairs = keep(pairs, "near-pairs")
    # only nodes with company are compared
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = keep(_small_texts(known, ids).join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id", "z"]), "near-texts")
    # a doc_id with several texts is one node of several keys
    keyed = seen.where("k1 IS NOT NULL").select("doc_id", "k1", "k2").join(reps.select("k1", "k2", "rep"), ["k1", "k2"])
    split = keyed.groupBy("doc_id").agg(F.min("rep").alias("a"), F.collect_set("rep").alias("x")).where("size(x) > 1").select("a", F.explode("x").alias("b")).where("a != b")
    found = [keep(verified(pairs, texts, similarity, weighted), "near-links"), split]
    both = lambda: reduce(DataFrame.unionByName, found)
    named = _still_open(big, both(), keep)
    if not named.isEmpty():
        sizes, met = _rare(named, texts, similarity, weighted, keep)
        # a node that shares no rare element shares as much as it has in common with others, at most
        can = lambda shared, one, two: shared >= similarity * (one + two - shared) - 1e-9
        named = named.join(sizes, "rep")
        low = named.groupBy("band").agg(F.min("d_low").alias("d_min"))
        named = named.join(low, "band").where(can(F.col("common"), F.col("d_low"), F.greatest("d_min", "common"))).select("rep", "band", "root", "d")
        found.append(keep(verified(keep(met, "near-pairs"), texts, similarity, weighted), "near-links"))
        found.append(keep(_rest(keep(named, "near-open"), texts, similarity, weighted), "near-links"))
    root = components(both())
    drop(*done)
    named = reps.select("k1", "k2", "rep").join(root.withColumnRenamed("id", "rep"), "rep", "left").select("k1", "k2", F.coalesce("root", "rep").alias("root"))
    result = seen.select("doc_id", "k1", "k2").join(named, ["k1", "k2"], "left").select("doc_id", F.coalesce("root", "doc_id").alias("class_id"))
    return result.unionByName(docs.where("doc_id IS NULL").select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id")))


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
