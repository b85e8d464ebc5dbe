import itertools
import math

import numpy as np
import pyarrow as pa
from revstrand.llm import language as L
from revstrand.llm import quality as Q
from revstrand.llm import toxicity as T
from revstrand.llm._spark import crc_mod
from revstrand.llm._train import labelled_sample

SF = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = L.op1_language_id(spark, SF).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got.held_out & got.lang.notna()]
    assert len(got) == docs.count() and len(held) > 100 and (held.lang == held.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_language_mixture_and_edges(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = L.train(docs.select("doc_id", "text", "lang"))
    longest = {x: docs.where(f"lang = '{x}'").orderBy("n_chars", ascending=False).first()["text"] for x in ("en", "de")}
    rows = [(1, longest["en"][:3000] + "\n" + longest["de"][:1500], "q"), (2, None, "q"), (3, "", "q"), (4, "123 !!", "q"), (5, "é", "q"), (6, longest["de"] * 20, None)]
    got = {r["doc_id"]: r for r in L.identify(spark.createDataFrame(rows, "doc_id long, text string, score string"), model).collect()}
    assert got[1]["lang_pred"] == "en" and set(got[1]["shares"]) == {"en", "de"} and abs(got[1]["shares"]["de"] - 1 / 3) < 0.1
    assert [got[i]["lang_pred"] for i in (2, 3, 4)] == ["und"] * 3 and got[5]["lang_pred"] != "und" and got[6]["lang_pred"] == "de"
    nothing = L.train(docs.where("false"))
    assert {r["lang_pred"] for r in L.identify(docs.limit(5), nothing).collect()} == {"und"}
    assert L.identify(docs.where("false"), model).count() == 0


def brute_mixture(counts, p):
    """Backward elimination one language at a time, each set's mixture fitted by many rounds in plain Python."""
    def fit(on):
        share = {j: 1 / len(on) for j in on}
        for _ in range(200):
            new = dict.fromkeys(on, 0.0)
            for g, c in counts.items():
                s = sum(share[j] * p[g][j] for j in on)
                for j in on:
                    new[j] += c * share[j] * p[g][j] / s
            share = {j: v / sum(counts.values()) for j, v in new.items()}
        return share, sum(c * math.log(sum(share[j] * p[g][j] for j in on)) for g, c in counts.items())

    k, cost = len(next(iter(p.values()))), 0.5 * math.log(sum(counts.values()) + 2.0)
    on, best = list(range(k)), (-math.inf, None)
    for j in range(k - 1):  # one language alone, never the background
        _, like = fit([j])
        best = max(best, (like / L.ORDER - cost, {j: 1.0}), key=lambda x: x[0])
    while len(on) > 1:
        share, like = fit(on)
        best = max(best, (like / L.ORDER - cost * len(on), share), key=lambda x: x[0])
        on = [j for j in on if j != min(on, key=share.get)]
    return best[1]


def test_mixtures_against_plain_elimination():
    r = np.random.default_rng(3)
    words = [["".join(r.choice(list(a), r.integers(3, 7))) for _ in range(40)] for a in ("abcde", "cdefgh", "mnopq", "uvwxyz")]
    counts = np.stack([np.bincount(L._grams(pa.array([" ".join(r.choice(w, 3000))]))[0], minlength=L.BUCKETS) for w in words], 1)
    m = L.Model(["a", "b", "c", "d"], counts)
    say = lambda j, n: " ".join(r.choice(words[j], n))
    texts = [say(0, 200), say(0, 60) + " " + say(1, 60), say(0, 40) + " " + say(2, 20) + " " + say(3, 30), say(3, 300) + " " + say(1, 8), "7 " * 9 + say(2, 3), "zzzzzzzz qqqq"]
    shares, _ = L.infer(pa.array(texts), m)
    for t, s in zip(texts, shares):
        g, n = np.unique(L._grams(pa.array([t]))[0], return_counts=True)
        want = brute_mixture(dict(zip(g.tolist(), n.tolist())), {int(x): m.p[x].astype(float).tolist() for x in g})
        assert set(np.flatnonzero(s)) == set(want) and all(abs(s[j] - v) < 0.02 for j, v in want.items()), t


def brute_segments(x):
    """All maximal scoring segments by their definition: repeatedly the best segment, then left and right of it."""
    if not len(x):
        return []
    best = max(((sum(x[i:j]), -(j - i), i, j) for i in range(len(x)) for j in range(i + 1, len(x) + 1)))
    s, _, i, j = best
    if s <= 0:
        return []
    return brute_segments(x[:i]) + [(i, j, s)] + [(a + j, b + j, v) for a, b, v in brute_segments(x[j:])]


def test_maximal_segments_against_definition():
    r = np.random.default_rng(5)
    for n in range(1, 40):
        x = r.normal(-0.1, 1, n)
        got, want = T.maximal_segments(x), brute_segments(list(x))
        assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want])


def test_toxicity_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    got = T.op7_toxic_segments(spark, SF).toPandas()
    m = got.merge(labels, on="doc_id")
    m = m[m.held_out]
    assert (m.predicted == m.toxic).mean() > 0.92
    rows = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert T.train(rows.selectExpr("doc_id", "text", "0 y").where("false")).w.tolist() == [0, 0, 0]


def test_toxicity_of_hostile_documents(spark, docs):
    sample = spark.createDataFrame([(i, ("vile hateful scum " if i % 2 else "kind gentle friend ") * 5 + f"w{i % 7} and so on", i % 2) for i in range(60)], "doc_id long, text string, y int")
    model = T.train(sample)
    again = T.train(sample.repartition(5))
    assert np.allclose(model.w, again.w) and np.allclose(model.rate, again.rate)
    extra = spark.createDataFrame([(None, "vile hateful scum"), (900, "so " * 30_000 + "vile hateful scum " * 4 + "so " * 30_000), (901, "kind gentle friend " * 9), (901, "kind gentle friend " * 9)], "doc_id long, text string")
    rows = docs.unionByName(extra, allowMissingColumns=True).withColumn("score", docs.bin)
    got = T.score(rows, model).collect()
    assert len(got) == rows.count() and all(0 <= r["score"] <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add(r["score"])
    least = min(r["score"] for r in got)
    assert by[75] == by[76] == {least} and max(by[900]) > least and by[901] == {least} and len(by[80]) == 1
    where = [p for r in got if r["doc_id"] == 900 for p in r["passages"]]
    assert where and all(30_000 <= p["start"] < p["end"] <= 30_012 for p in where)
    assert T.score(rows.where("false"), model).count() == 0


def brute_marginals(u, w):
    n, p = len(u), np.zeros(len(u))
    z = 0.0
    for y in itertools.product((0, 1), repeat=n):
        v = math.exp(sum(a for a, b in zip(u, y) if b) + sum(w[a, b] for a, b in zip(y, y[1:])))
        z += v
        p += v * np.array(y)
    return p / z


def test_chain_marginals_against_enumeration():
    r = np.random.default_rng(1)
    u, to, w = r.normal(0, 2, 12), np.array([0, 5, 5, 6, 12]), r.normal(0, 1, (2, 2))
    a, b = Q.messages(u, to, w)
    want = np.concatenate([brute_marginals(u[i:j], w) for i, j in zip(to, to[1:]) if j > i])
    assert np.allclose(Q.sigmoid(a + b), want)


def test_chains_begin_anywhere():
    starts = [Q.chain_start(i, 1000) for i in range(400)]
    assert min(starts) < 20 and max(starts) > 780 and max(starts) <= 800 and {Q.chain_start(i, 200) for i in range(50)} == {0}


def test_fit_follows_its_gradient():
    """The fitted field has no direction in which the penalised likelihood rises, by enumeration over labellings."""
    r = np.random.default_rng(2)
    to, y = np.array([0, 4, 7, 11, 14]), np.array([1, 0, 1, 0])
    f = r.normal(0, 1, (14, Q.FEATURES)) + np.repeat(y, np.diff(to))[:, None] * 0.8
    m = Q.fit(f, to, y)
    x = Q.neighbours((f - m.mean) / m.scale, to)

    def loss(theta, w):
        u, total = x @ theta, 0.0
        for i, (a, z) in enumerate(zip(to, to[1:])):
            energy = lambda lab: sum(v for v, b in zip(u[a:z], lab) if b) + sum(w[p, q] for p, q in zip(lab, lab[1:]))
            logz = math.log(sum(math.exp(energy(lab)) for lab in itertools.product((0, 1), repeat=int(z - a))))
            share = sum(n for n, k in zip(np.diff(to), y) if k == y[i]) / 14
            total += (logz - energy([int(y[i])] * int(z - a))) * 0.5 / share / 14
        return total + Q.L2 / 2 * (theta**2).sum() + 0.05 / 2 * (w**2).sum()

    here = loss(m.theta, m.w)
    for _ in range(20):
        step = r.normal(0, 1, len(m.theta))
        assert loss(m.theta + 0.05 * step / np.linalg.norm(step), m.w) > here - 2e-3


def test_quality_held_out(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    got = Q.op9_line_crf_quality(spark, SF).toPandas()
    m = got.merge(labels, on="doc_id")
    m = m[m.held_out]
    assert (m.predicted == m.quality).mean() > 0.95
    model = Q.Model(np.zeros(Q.FEATURES), np.ones(Q.FEATURES))
    assert len(model.score(pa.array([None, "", "a\n\nb"]))) == 3
    scored = Q.score(docs.withColumn("score", docs.bin), model).collect()
    assert len(scored) == docs.count() and all(0 <= r["score"] <= 1 for r in scored) and len({r["score"] for r in scored if r["doc_id"] == 80}) == 1
    assert Q.score(docs, model).count() == docs.count() and Q.score(docs.where("false"), model).count() == 0


def test_sample_is_bounded_and_never_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = labelled_sample(docs, labels, "quality", 3, 1, 20)
    assert got.count() <= 40 and got.where(crc_mod("doc_id", 3) == 1).count() == 0


def test_null_labels_and_no_labels(spark):
    """Null labels teach nothing; without labelled rows, and without any, every score is 0.5."""
    docs = spark.createDataFrame([(i, f"a line of text {i}\nand another one\n", None) for i in range(40)] + [(None, None, 3)], "doc_id long, text string, label int")
    none = spark.createDataFrame([(i, None) for i in range(40)] + [(None, 1)], "doc_id long, label int")
    for labels in (none, none.where("false")):
        sample = labelled_sample(docs, labels, "label", 5, 0, 10)
        assert sample.count() == 0
        for part in (T, Q):
            got = part.score(docs, part.train(sample)).collect()
            assert len(got) == 41 and {r["score"] for r in got} == {0.5}
    some = none.unionByName(spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, label int"))
    assert labelled_sample(docs, some, "label", 5, 0, 10).count() > 10
