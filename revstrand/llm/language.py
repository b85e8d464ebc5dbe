"""Language identification as multilingual mixture inference.

Languages are distributions over byte four-grams of letters. A document is a mixture of them: expectation-maximisation finds
its proportions, and the set of languages is the one with the best penalised likelihood along backward elimination from all
languages to one. The label is the language with the largest proportion.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as X
from ._spark import crc_mod, table

ORDER = 4
BUCKETS = 1 << 16
#: Documents per language that the model is fitted on (a bounded sample by hash order of the ids; see `train`).
PER_LANGUAGE = 3000
#: Expectation-maximisation ends when no share moves by more than this, or after so many rounds.
SETTLED, MOST_ROUNDS = 2e-3, 60
#: Languages that a model may have: each takes a column of the table that goes to the executors.
MOST_LANGUAGES = 512
#: Bytes of text whose four-grams are held at once.
PIECE = 1 << 20
UNKNOWN = "und"
_LETTER = np.array([chr(c).isalpha() or c >= 0x80 for c in range(256)])


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the four-grams of lower-cased letters and blanks, blank runs excluded, and n+1 offsets."""
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    data, off = X.raw(pc.binary_join_element_wise(pa.scalar("  ", pa.large_string()), low, pa.scalar("  ", pa.large_string()), pa.scalar("", pa.large_string())))
    flat = np.where(_LETTER[data], data, np.uint8(0x20))
    if len(flat) < ORDER:
        return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
    code = np.ascontiguousarray(np.lib.stride_tricks.as_strided(flat, (len(flat) - ORDER + 1, ORDER), (1, 1))).view(np.uint32).reshape(-1)
    ok = (code & np.uint32(0x00FFFFFF)) != np.uint32(0x00202020)
    for back in range(1, ORDER):  # no gram over the end of a document
        ends = off[1:] - back
        ok[ends[(ends >= 0) & (ends < len(ok))]] = False
    at = np.flatnonzero(ok)
    return ((code[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.uint32), np.searchsorted(at, off)


class Model:
    """Gram probabilities of each language, one row per bucket, with an even background as the last column."""

    def __init__(self, langs: list[str], counts: np.ndarray, alpha: float = 0.5):
        self.langs = langs
        every = counts.sum(axis=1, keepdims=True) + 0.5
        every = every / every.sum()
        p = (counts + alpha * BUCKETS * every * 0.02 + 0.002) / (counts.sum(axis=0, keepdims=True) + alpha * BUCKETS * 0.02 + 0.002 * BUCKETS)
        self.p = np.column_stack([p, np.full(BUCKETS, 1.0 / BUCKETS)]).astype(np.float32)


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Fits on rows of docs(doc_id, text, lang) with a language, about `per_language` of each, chosen by a hash of doc_id."""
    known = docs.where("lang IS NOT NULL")
    sizes = {r["lang"]: r["c"] for r in known.groupBy("lang").agg(F.count("*").alias("c")).collect()}
    langs = sorted(sizes)
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"{len(langs)} distinct values of lang; more than {MOST_LANGUAGES} aren't languages")
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)))
    rate = F.create_map(*[F.lit(v) for k in langs for v in (k, min(1.0, per_language / sizes[k]))])
    some = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.element_at(rate, F.col("lang")) * (1 << 30))
    index = {k: i for i, k in enumerate(langs)}

    def count(batches):
        total: dict[int, np.ndarray] = {}
        for b in X.pieces(batches):
            g, off = _grams(b.column("text"))
            own = np.repeat([index[x] for x in b.column("lang").to_pylist()], np.diff(off))
            for i in np.unique(own):
                c = np.bincount(g[own == i], minlength=BUCKETS)
                total[i] = total.get(i, 0) + c
        for i, c in total.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int32)), pa.array(at.astype(np.int32)), pa.array(c[at])], names=["l", "g", "n"])

    found = some.select("text", "lang").mapInArrow(count, "l int, g int, n long").groupBy("l", "g").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((BUCKETS, len(langs)))
    counts[found["g"].to_numpy(), found["l"].to_numpy()] = found["n"].to_numpy()
    return Model(langs, counts)


def _step(p, c, start, size, share):
    """One round: the shares of each document after it, and its log-likelihood before."""
    r = p * np.repeat(share, size, axis=0)
    s = r.sum(axis=1)
    like = np.add.reduceat(c * np.log(s), start)
    r *= (c / s)[:, None]
    return np.add.reduceat(r, start, axis=0) / np.add.reduceat(c, start)[:, None], like


def _em(p, c, start, size, share):
    """Shares of each document once they have settled, and their log-likelihood. Settled documents take no further rounds."""
    share, like, live = share.copy(), np.zeros(len(share)), np.arange(len(share))
    for _ in range(MOST_ROUNDS):
        now, value = _step(p, c, start, size, share[live])
        moved = np.abs(now - share[live]).max(axis=1) > SETTLED
        share[live], like[live] = now, value
        if not moved.any():
            break
        if moved.mean() < 0.7:
            at, to, num = _take(start, size, np.flatnonzero(moved))
            p, c, start, size, live = p[at], c[at], to, num, live[moved]
    return share, like


def _worthless(share, total, cost):
    """Languages that go at once: the smallest shares that together explain less than one language costs.

    Without shares of sum s every gram keeps at least 1 - s of its probability, so their loss is at most -total log(1 - s).
    """
    order = np.argsort(share, axis=1)
    s = np.minimum(np.cumsum(np.take_along_axis(share.astype(np.float64), order, axis=1), axis=1), 1 - 1e-12)
    gone = np.zeros(share.shape, bool)
    np.put_along_axis(gone, order, -total[:, None] * np.log1p(-s) / ORDER <= cost[:, None], axis=1)
    gone[np.arange(len(gone)), share[:, :-1].argmax(axis=1)] = False  # the background alone is no answer
    return gone


def _take(start, size, some):
    n = size[some]
    to = np.concatenate([[0], np.cumsum(n)[:-1]])
    return np.arange(n.sum()) + np.repeat(start[some] - to, n), to, n


def infer(texts: pa.Array, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each language (and of the background, last) in the selected set, and the confidence in the largest."""
    n, k = len(texts), m.p.shape[1]
    shares, sure = np.zeros((n, k)), np.zeros(n)
    g, off = _grams(texts)
    has = np.flatnonzero(np.diff(off))
    if not len(has) or k < 2:
        return shares, sure
    key = np.sort((X.owners(off).astype(np.uint64) << np.uint64(16)) | g)
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    c = np.diff(np.append(first, len(key))).astype(np.float32)
    key = key[first]
    size = np.bincount((key >> np.uint64(16)).astype(np.int64), minlength=n)[has]
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    p = m.p[(key & np.uint64(0xFFFF)).astype(np.int64)]
    total = np.add.reduceat(c, start)
    alone = np.add.reduceat(c[:, None] * np.log(p[:, :-1]), start, axis=0)
    best = alone.argmax(axis=1)
    rel = (alone - alone[np.arange(len(has)), best][:, None]) / ORDER
    sure[has] = 1.0 / np.exp(np.maximum(rel, -50)).sum(axis=1)
    cost = 0.5 * np.log(total + 2.0)
    won = np.zeros((len(has), k))
    won[np.arange(len(has)), best] = 1.0
    score = alone.max(axis=1) / ORDER - cost
    share, _ = _em(p, c, start, size, np.full((len(has), k), 1.0 / k, np.float32))
    live = np.arange(len(has))
    while True:  # backward elimination: drop what can't pay, settle the rest, compare, drop the smallest
        gone = _worthless(share, total[live], cost[live])
        share = np.where(gone, 0, share).astype(np.float32)
        share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-9)
        more = (share > 0).sum(axis=1) > 1
        live, share = live[more], share[more]
        if not len(live):
            break
        at, to, num = _take(start, size, live)
        share, like = _em(p[at], c[at], to, num, share)
        value = like / ORDER - cost[live] * (share > 0).sum(axis=1)
        better = value > score[live]
        won[live[better]], score[live[better]] = share[better], value[better]
        share[np.arange(len(live)), np.where(share > 0, share, 2).argmin(axis=1)] = 0
        share /= share.sum(axis=1, keepdims=True)
    shares[has] = won
    return shares, sure


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs' rows with lang_pred, score, shares (map of the selected languages), other (share of no language).

    Null or letterless text: lang_pred 'und', score 0, no shares. Without any learned language every text is 'und'. Languages that
    explain a text equally well are taken in code-point order. Long texts are read whole. Repeated rows and equal texts are judged
    alike. An empty table gives an empty result. Other columns pass through unchanged; the four new ones replace columns of those names.
    """
    out = ["lang_pred", "score", "shares", "other"]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("shares", pa.map_(pa.string(), pa.float64())), ("other", pa.float64())])

    @F.arrow_udf("lang_pred string, score double, shares map<string, double>, other double")
    def told(texts: pa.Array) -> pa.Array:  # only texts go to Python, and no text comes back
        parts = [_told(t, shared.value, kind) for t in X.spread(texts, PIECE)]
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    rows = docs.drop(*out)
    return rows.withColumn("_t", told(F.col("text"))).select(*[rows[c] for c in rows.columns], *[F.col(f"_t.{c}").alias(c) for c in out])


def _told(text: pa.Array, m: Model, kind: pa.DataType) -> pa.Array:
    names = np.array([*m.langs, UNKNOWN], object)
    letter = np.array(pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False))
    shares, sure = infer(text, m)
    if not m.langs:
        letter[:] = False
        top, largest = np.zeros(len(letter), int), np.zeros(len(letter))
    else:
        known = shares[:, :-1].sum(axis=1)
        top = shares[:, :-1].argmax(axis=1)  # of a text that is background alone: the first language, with score 0
        largest = shares[np.arange(len(top)), top] / np.where(known > 0, known, 1)
    score = np.where(letter, np.clip(largest * np.where(sure > 0, sure, 1), 0, 1), 0.0)
    sets = [[(names[j], float(s[j])) for j in np.flatnonzero(s[:-1])] if ok else [] for s, ok in zip(shares, letter)]
    columns = [pa.array(np.where(letter, names[top], UNKNOWN), pa.string()), pa.array(score), pa.array(sets, kind.field(2).type), pa.array(np.where(letter, shares[:, -1], 1.0))]
    return pa.StructArray.from_arrays(columns, fields=list(kind))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_mod("doc_id", 5) == 0
    model = train(docs.where(~held).select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "shares", "other")
