"""Toxicity by maximum-scoring segments.

Every token has a log-odds score between toxic and clean documents under a Dirichlet prior, shrunk towards zero by its own
uncertainty, minus a drift. All maximal scoring segments of a document are found in one pass (Ruzzo and Tompa); a segment
counts as a toxic passage if its score beats what the best segment of a clean document of that length reaches by chance,
by the extreme-value law of such scores. The passages' excesses over that law add up to the document's evidence.
"""

from __future__ import annotations

import copy

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as X
from ._spark import crc_mod, cut, drop, table
from ._train import labelled_sample, logistic, sigmoid

BITS = 20
#: Labelled documents of each class that the model is fitted on.
PER_CLASS = 8000
PRIOR, SHRINK, DRIFT, SIGNIFICANT = 0.5, 1.96, 0.25, 0.05
EULER = 0.5772156649015329


def _tokens(texts: pa.Array):
    """Buckets of lower-cased tokens (runs of letters, digits and bytes from 0x80), token spans and n+1 offsets."""
    data, off = X.raw(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    starts, ends, to = X.word_spans(data, off, X.PUNCT)
    return (X.span_hashes(data, starts, ends) >> np.uint64(64 - BITS)).astype(np.int64), to


def log_odds(y1, y0, n1, n0):
    """Score of tokens found in y1 of n1 toxic and y0 of n0 clean documents: log-odds with a Dirichlet prior, shrunk."""
    a1, b1, a0, b0 = y1 + PRIOR, np.maximum(n1 - y1, 0) + PRIOR, y0 + PRIOR, np.maximum(n0 - y0, 0) + PRIOR
    delta = np.log(a1 / b1) - np.log(a0 / b0)
    z2 = delta**2 / (1 / a1 + 1 / b1 + 1 / a0 + 1 / b0)
    return delta * np.maximum(0.0, 1.0 - SHRINK**2 / np.maximum(z2, 1e-12))


def maximal_segments(x: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments [start, end) of a sequence, each with its score, in linear time."""
    sums = np.concatenate([[0.0], np.cumsum(x)])
    up = x > 0
    if not up.any():
        return []
    edge = np.flatnonzero(np.diff(np.concatenate([[0], up.view(np.int8), [0]])))
    found: list[list] = []  # start, end, sum before, sum after, index of the nearest earlier one with a smaller sum before
    for a, z in zip(edge[::2], edge[1::2]):
        cur = [int(a), int(z), sums[a], sums[z]]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= cur[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= cur[3]:
                found.append([*cur, j])
                break
            cur = [found[j][0], cur[1], found[j][2], cur[3]]
            del found[j:]
    return [(a, z, hi - lo) for a, z, lo, hi, _ in found]


class Model:
    def __init__(self, y1: np.ndarray, y0: np.ndarray, n1: int, n0: int):
        self.y1, self.y0, self.n1, self.n0 = y1, y0, n1, n0
        self.score = log_odds(y1, y0, n1, n0).astype(np.float32)
        self.rate, self.log_k, self.w = 1.0, 0.0, np.zeros(3)

    def steps(self, g: np.ndarray, own: int | None = None) -> np.ndarray:
        """Token scores less the drift; with `own`, as if the document (of that label) had not been learned from."""
        if own is None:
            return self.score[g] - DRIFT
        return log_odds(self.y1[g] - own, self.y0[g] - (1 - own), self.n1 - own, self.n0 - (1 - own)) - DRIFT

    def passages(self, x: np.ndarray) -> list[tuple[int, int, float, float]]:
        """start, end, score and excess (minus log of the expected number of such segments by chance) of significant segments."""
        chance = self.log_k + np.log(max(len(x), 1))
        out = ((a, z, s, self.rate * s - chance) for a, z, s in maximal_segments(x))
        return [p for p in out if p[3] > -np.log(SIGNIFICANT)]

    def evidence(self, found) -> tuple[float, float]:
        e = [p[3] for p in found]
        return float(np.log1p(sum(e))), float(np.log1p(max(e, default=0.0)))

    def fit_chance(self, hist: np.ndarray, centres: np.ndarray, tops: np.ndarray, sizes: np.ndarray) -> None:
        """Rate and size of the extreme-value law from clean documents: their token scores, best segments and lengths."""
        p = hist / max(hist.sum(), 1)
        lo, hi = 1e-3, 50.0
        for _ in range(60):  # the positive root of E[exp(rate * x)] = 1
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if (p * np.exp(np.minimum(mid * centres, 700))).sum() < 1 else (lo, mid)
        self.rate = lo
        if len(tops):
            self.log_k = float(np.mean(self.rate * tops - np.log(np.maximum(sizes, 1)))) - EULER


def train(sample: DataFrame) -> Model:
    """Fits on a bounded sample(doc_id, text, y)."""
    sample = cut(sample, "toxic-sample")

    def count(batches):
        c, n = np.zeros((2, 1 << BITS), np.int64), [0, 0]
        for b in X.pieces(batches):
            g, to = _tokens(b.column("text"))
            y = np.asarray(b.column("y"))
            own = X.owners(to)
            once = np.unique(own * (1 << BITS) + g)
            for k in (0, 1):
                c[k] += np.bincount(once[y[once >> BITS] == k] & ((1 << BITS) - 1), minlength=1 << BITS)
                n[k] += int((y == k).sum())
        at = np.flatnonzero(c.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(c[1][at], n[1])), pa.array(np.append(c[0][at], n[0]))], names=["g", "y1", "y0"])

    got = sample.mapInArrow(count, "g long, y1 long, y0 long").groupBy("g").agg(F.sum("y1").alias("y1"), F.sum("y0").alias("y0")).toPandas()
    y1, y0 = np.zeros(1 << BITS), np.zeros(1 << BITS)
    tok, n = got[got.g >= 0], got[got.g < 0]
    y1[tok.g.to_numpy()], y0[tok.g.to_numpy()] = tok.y1.to_numpy(), tok.y0.to_numpy()
    m = Model(y1, y0, int(n.y1.sum()), int(n.y0.sum()))
    edges = np.linspace(-12, 12, 481)
    spark = sample.sparkSession
    shared = spark.sparkContext.broadcast(m)

    def walk(batches):
        m = shared.value
        for b in X.pieces(batches):
            g, to = _tokens(b.column("text"))
            rows = []
            for i, own in enumerate(b.column("y").to_pylist()):
                if not own:  # chance is what clean documents reach
                    x = m.steps(g[to[i] : to[i + 1]], own)
                    rows.append((len(x), max((s for _, _, s in maximal_segments(x)), default=0.0), np.histogram(np.clip(x, -12, 12), edges)[0].tolist()))
            yield pa.RecordBatch.from_pydict({k: [r[j] for r in rows] for j, k in enumerate(["n", "top", "h"])}, schema=pa.schema([("n", pa.int64()), ("top", pa.float64()), ("h", pa.list_(pa.int64()))]))

    clean = cut(sample.mapInArrow(walk, "n long, top double, h array<long>"), "toxic-walk")
    hist = np.zeros(480)
    for r in clean.select(F.posexplode("h").alias("i", "c")).groupBy("i").agg(F.sum("c").alias("c")).collect():
        hist[r["i"]] = r["c"]
    tops = clean.select("top", "n").toPandas()
    m.fit_chance(hist, (edges[1:] + edges[:-1]) / 2, tops.top.to_numpy(), tops.n.to_numpy())
    shared.destroy()
    fitted = spark.sparkContext.broadcast(m)

    def weigh(batches):
        m = fitted.value
        for b in X.pieces(batches):
            g, to = _tokens(b.column("text"))
            y = b.column("y").to_pylist()
            e = np.array([m.evidence(m.passages(m.steps(g[to[i] : to[i + 1]], own))) for i, own in enumerate(y)]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(y, pa.int32()), pa.array(e[:, 0]), pa.array(e[:, 1])], names=["doc_id", "y", "all", "most"])

    rows = sample.mapInArrow(weigh, "doc_id long, y int, all double, most double").toPandas().sort_values(["doc_id", "y"])
    m.w = logistic(rows[["all", "most"]].to_numpy(float).reshape(-1, 2), rows.y.to_numpy(float), l2=0.01)
    fitted.destroy()
    drop(sample, clean)
    return m


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, passages (array of token start, end, segment score and excess) of every row of docs(doc_id, text).

    Null or empty text has no passage and the lowest score. Without labelled rows every score is 0.5. Long texts are scored whole;
    repeated rows and equal texts score alike, and there are no ties to settle. Null doc_id is scored as any. An empty table gives
    an empty result. Columns but doc_id and text are ignored.
    """
    light = copy.copy(model)
    light.y1 = light.y0 = None  # scoring needs the score table alone
    shared = docs.sparkSession.sparkContext.broadcast(light)
    schema = "doc_id long, score double, passages array<struct<start:long,end:long,score:double,excess:double>>"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("excess", pa.float64())]))

    def go(batches):
        m = shared.value
        for b in X.pieces(batches):
            g, to = _tokens(b.column("text"))
            x = m.steps(g)
            any_up = np.concatenate([[0], np.cumsum(x > 0)])
            some = any_up[to[1:]] > any_up[to[:-1]]
            found = [m.passages(x[to[i] : to[i + 1]]) if some[i] else [] for i in range(b.num_rows)]
            e = np.array([m.evidence(f) for f in found]).reshape(-1, 2)
            s = sigmoid(m.w[0] + e @ m.w[1:])
            told = [[dict(zip(("start", "end", "score", "excess"), p)) for p in f] for f in found]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(s, pa.float64()), pa.array(told, kind)], names=["doc_id", "score", "passages"])

    return docs.select("doc_id", "text").mapInArrow(go, schema)


def op7_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic", 5, 0, PER_CLASS))
    return score(docs, model).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
