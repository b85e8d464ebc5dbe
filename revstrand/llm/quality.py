"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. A line's potential comes from its own features and those of its neighbours, and neighbouring
labels are tied by transition weights. Forward and backward messages give each line's marginal probability of being good;
weighted by line length they add up to the document's share of good text, which a two-weight calibration maps to a score.
Lines inherit their document's label for fitting.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as X
from ._spark import crc_mod, cut, table
from ._train import labelled_sample, logistic, sigmoid

#: Labelled documents of each class that the model is fitted on, and lines of one that it is fitted on at most: a chain of
#: consecutive lines that begins anywhere in the document, by a hash of its id. Scores always read all lines.
PER_CLASS, CHAIN = 3000, 200
ROUNDS, RATE, L2 = 200, 0.1, 1e-3
_NEWLINE = np.zeros(256, bool)
_NEWLINE[0x0A] = True


def _kind(test) -> np.ndarray:
    return np.array([c < 0x80 and test(chr(c)) for c in range(256)])


_KINDS = [
    _kind(str.isalpha) | (np.arange(256) >= 0x80), _kind(str.isdigit), X.PUNCT & ~X.SPACE, X.SPACE, _kind(str.isupper),
    _kind(lambda c: c in "|<>{}[]=\\/_~^"), _kind(lambda c: c in "#$%&*@+!"), _kind(lambda c: c in ".,;:'\"?()-"), np.arange(256) >= 0x80,
]
FEATURES = len(_KINDS) + 10


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each line that isn't blank (rows), its length in bytes, and n+1 offsets of the documents' lines."""
    data, off = X.raw(texts)
    starts, ends, to = X.word_spans(data, off, _NEWLINE)
    size = (ends - starts).astype(np.float64)
    if not len(starts):
        return np.zeros((0, FEATURES)), size, to
    count = lambda mask: (c := np.concatenate([[0], np.cumsum(mask, dtype=np.int64)]))[ends] - c[starts]
    kinds = [count(k[data]) / size for k in _KINDS]
    space = X.SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    begins[starts] = ~space[starts]
    words = np.maximum(count(begins), 1)
    twice = np.zeros(len(data), bool)
    twice[1:] = (data[1:] == data[:-1]) & X.PUNCT[data[1:]]
    marked = np.zeros(len(data), bool)  # words that end in a symbol
    marked[:-1] = _KINDS[6][data[:-1]] & space[1:]
    w_start, w_end, _ = X.word_spans(data, off)
    w = X.span_hashes(data, w_start, w_end)
    same = np.zeros(len(data), bool)  # words that repeat the one before
    same[w_start[1:][w[1:] == w[:-1]]] = True
    h = X.span_hashes(data, starts, ends)
    key = h ^ X.mix(X.owners(to).astype(np.uint64) + np.uint64(1))
    _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
    last, first = data[ends - 1], data[starts]
    more = [
        np.log1p(size) / 5, np.log1p(words) / 4, np.minimum((size - count(space)) / words, 40) / 10, count(twice) / size, count(marked) / words,
        _KINDS[7][last], _KINDS[4][first], np.log1p(times[inverse] - 1), words == 1, count(same) / words,
    ]
    return np.column_stack([*kinds, *more]).astype(np.float64), size, to


def neighbours(f: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Bias, own features, and those of the line before and after (zeros at a document's ends)."""
    before, after = np.zeros_like(f), np.zeros_like(f)
    before[1:], after[:-1] = f[:-1], f[1:]
    has = np.diff(to) > 0
    before[to[:-1][has]] = 0
    after[to[1:][has] - 1] = 0
    return np.column_stack([np.ones(len(f)), f, before, after])


def _rows_by_step(to: np.ndarray):
    """Documents by falling number of lines, and how many have a line t."""
    n = np.diff(to)
    order = np.argsort(-n, kind="stable")
    n = n[order]
    return order, n, [int(np.searchsorted(-n, -t, "left")) for t in range(int(n[0]) if len(n) else 0)]


def messages(u: np.ndarray, to: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward log-odds (with the line's own potential) and backward log-odds (without it) of good over bad.

    u: log-odds potentials; w[i, j]: weight of label j after label i.
    """
    e = np.exp(w)
    f, b = np.empty_like(u), np.zeros_like(u)
    order, n, live = _rows_by_step(to)
    base = to[:-1][order]
    for t, m in enumerate(live):
        at = base[:m] + t
        if t:
            x = sigmoid(f[at - 1])
            f[at] = u[at] + np.log(x * e[1, 1] + (1 - x) * e[0, 1]) - np.log(x * e[1, 0] + (1 - x) * e[0, 0])
        else:
            f[at] = u[at]
    for t in range(len(live) - 2, -1, -1):
        m = live[t + 1]
        at = base[:m] + t
        x = sigmoid(u[at + 1] + b[at + 1])
        b[at] = np.log(e[1, 1] * x + e[1, 0] * (1 - x)) - np.log(e[0, 1] * x + e[0, 0] * (1 - x))
    return f, b


class Model:
    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        self.mean, self.scale = mean, scale
        self.theta, self.w, self.cal = np.zeros(1 + 3 * FEATURES), np.zeros((2, 2)), np.zeros(2)

    def good(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Marginal probability of good of each line, line lengths and offsets."""
        f, size, to = line_features(texts)
        if not len(f):
            return np.zeros(0), size, to
        u = neighbours((f - self.mean) / self.scale, to) @ self.theta
        a, b = messages(u, to, self.w)
        return sigmoid(a + b), size, to

    def score(self, texts: pa.Array) -> np.ndarray:
        p, size, to = self.good(texts)
        total = np.concatenate([[0], np.cumsum(size)])
        part = np.concatenate([[0], np.cumsum(p * size)])
        length = total[to[1:]] - total[to[:-1]]
        share = np.where(length > 0, (part[to[1:]] - part[to[:-1]]) / np.maximum(length, 1), 0.0)
        return sigmoid(self.cal[0] + self.cal[1] * (share - 0.5))


def fit(f: np.ndarray, to: np.ndarray, y: np.ndarray) -> Model:
    """Conditional likelihood of the chains by gradient steps (Adam). y: label of each chain's lines; classes weigh the same."""
    m = Model(f.mean(axis=0), f.std(axis=0) + 1e-3)
    x = neighbours((f - m.mean) / m.scale, to)
    own = X.owners(to)
    label = y[own].astype(float)
    share = np.array([(label == k).mean() for k in (0.0, 1.0)])
    weight = np.where(label == 1, 0.5 / max(share[1], 1e-9), 0.5 / max(share[0], 1e-9)) / max(len(label), 1)
    linked = np.flatnonzero(own[1:] == own[:-1]) if len(own) else np.zeros(0, int)
    g1, g2 = np.zeros(x.shape[1] + 4), np.zeros(x.shape[1] + 4)
    for r in range(1, ROUNDS + 1):
        u = x @ m.theta
        a, b = messages(u, to, m.w)
        grad = x.T @ ((sigmoid(a + b) - label) * weight) + L2 * m.theta
        i, j = linked, linked + 1
        la, lb = np.stack([np.zeros(len(i)), a[i]], 1), np.stack([np.zeros(len(i)), (u + b)[j]], 1)
        pair = la[:, :, None] + lb[:, None, :] + m.w
        pair = np.exp(pair - pair.max(axis=(1, 2), keepdims=True))
        pair /= pair.sum(axis=(1, 2), keepdims=True)
        seen = np.zeros_like(pair)
        seen[np.arange(len(i)), label[i].astype(int), label[j].astype(int)] = 1
        gw = ((pair - seen) * weight[i][:, None, None]).sum(axis=0) + 0.05 * m.w
        g = np.concatenate([grad, gw.reshape(-1)])
        g1, g2 = 0.9 * g1 + 0.1 * g, 0.99 * g2 + 0.01 * g * g
        step = RATE * (g1 / (1 - 0.9**r)) / (np.sqrt(g2 / (1 - 0.99**r)) + 1e-8) / np.sqrt(1 + r / 20)
        m.theta -= step[:-4]
        m.w = np.clip(m.w - step[-4:].reshape(2, 2), -2, 2)
    return m


def chain_start(doc_id: int, lines: int) -> int:
    """The first line of the chain that a document of so many lines is learned from."""
    spare = max(lines - CHAIN, 0)
    return int(X.mix(np.array([doc_id], np.int64).view(np.uint64))[0] % np.uint64(spare + 1))


def train(sample: DataFrame) -> Model:
    """Fits on a bounded sample(doc_id, text, y) of at most CHAIN lines of each document.

    Features are found on the executors; these and nothing else of the texts come to the driver, which fits the field.
    """
    kind = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("n", pa.int32()), ("f", pa.binary())])

    def go(batches):
        for b in X.pieces(batches):
            f, _, to = line_features(b.column("text"))
            f, rows = f.astype(np.float32), []
            for i, (d, y) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("y").to_pylist())):
                n = int(to[i + 1] - to[i])
                lo = int(to[i]) + chain_start(d, n)
                part = f[lo : lo + min(n, CHAIN)]
                rows.append((d, y, len(part), part.tobytes()))
            yield pa.RecordBatch.from_pydict({k: [r[j] for r in rows] for j, k in enumerate(kind.names)}, schema=kind)

    sample = cut(sample, "quality-sample")
    got = sample.mapInArrow(go, "doc_id long, y int, n int, f binary").orderBy("doc_id", "y").toPandas()
    if not len(got):
        return Model(np.zeros(FEATURES), np.ones(FEATURES))
    f = np.frombuffer(b"".join(got.f), np.float32).reshape(-1, FEATURES).astype(np.float64)
    m = fit(f, np.concatenate([[0], np.cumsum(got.n)]), got.y.to_numpy())
    shared = sample.sparkSession.sparkContext.broadcast(m)

    def rate(batches):
        m = shared.value
        for b in X.pieces(batches):
            p, size, to = m.good(b.column("text"))
            total, part = np.concatenate([[0], np.cumsum(size)]), np.concatenate([[0], np.cumsum(p * size)])
            n = total[to[1:]] - total[to[:-1]]
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(np.where(n > 0, (part[to[1:]] - part[to[:-1]]) / np.maximum(n, 1), 0.0))], names=["y", "s"])

    rated = sample.mapInArrow(rate, "y int, s double").toPandas()
    m.cal = logistic(rated.s.to_numpy()[:, None] - 0.5, rated.y.to_numpy().astype(float), l2=0.1)
    return m


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every row of docs(doc_id, text).

    Blank lines don't count. Null, empty or blank text has no good line and the lowest score. Without labelled rows every score is 0.5.
    Long texts are scored whole; repeated rows and equal texts score alike, and there are no ties to settle. Null doc_id is scored
    as any. An empty table gives an empty result. Columns but doc_id and text are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def go(batches):
        m = shared.value
        for b in X.pieces(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(m.score(b.column("text")))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(go, "doc_id long, score double")


def op9_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", 3, 1, PER_CLASS))
    return score(docs, model).select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
