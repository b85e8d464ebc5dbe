import numpy as np
import pytest

from revstrand.llm import whitening

VECTORS = "vec_id long, embedding array<float>, label int, x array<int>, component int"


def frame(spark, rows):
    return spark.createDataFrame([(*x, 0, [1], 9) for x in rows], VECTORS).repartition(3)


def brute(vectors, components):
    x = np.floor(np.array(vectors, np.float32).astype(float) * 64).astype(np.int64) + 1_000_000
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(axis=0)
    z = (n * u - s) / n
    v = z.T @ z / n
    e, w = np.linalg.eigh(v)
    e, w = e[::-1][:components], w[:, ::-1][:, :components]
    return n, ((n * x - s) ** 2).sum(axis=1), ((n * x - s) / n) @ w / np.sqrt(e), e / np.trace(v)


@pytest.fixture()
def rows():
    r = np.random.default_rng(9)
    mix = r.normal(0, 1, (70, 70)) * np.linspace(3, 0.2, 70)
    v = (r.normal(0, 1, (300, 70)) @ mix.T + 5).astype(np.float32)
    out = [(i, x.tolist()) for i, x in enumerate(v)] + [(1000 + i, v[3].tolist()) for i in range(150)] + [(4, v[5].tolist()), (None, v[6].tolist())]
    return out, [(2000, None), (2001, [None] * 70), (2002, [float("nan")] * 70), (2003, [float("inf")] + [0.0] * 69)]


def test_equals_brute_force(spark, rows):
    good, bad = rows
    got = sorted(whitening.whiten(frame(spark, good + bad)).collect(), key=lambda r: (r["vec_id"] is None, r["vec_id"] or 0, r["deviation"], r["component"]))
    n, deviation, white, share = brute([x for _, x in good], 16)
    order = sorted(range(len(good)), key=lambda i: (good[i][0] is None, good[i][0] or 0, deviation[i]))
    assert len(got) == 16 * len(good) and {r["n"] for r in got} == {n} and n == 300
    assert [r["vec_id"] for r in got[::16]] == [good[i][0] for i in order]
    assert [r["deviation"] for r in got[::16]] == deviation[order].tolist()
    w = np.array([r["whitened"] for r in got]).reshape(-1, 16)
    sign = np.sign((w * white[order]).sum(axis=0))
    assert np.abs(w * sign - white[order]).max() < 1e-9
    assert np.allclose([r["explained"] for r in got[:16]], share, rtol=1e-9)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


def test_deviation_is_exact_or_null():
    x = np.array([[10**6 + 3, 10**6 - 4], [10**6, 10**6]])
    n, sums = 10**8, [10**14 + 5, 10**14 - 7]
    w = whitening.Whitening(n, sums, 1.0, np.ones(1), np.ones((2, 1)))
    assert w.deviation(x) == [sum((n * int(v) - s) ** 2 for v, s in zip(r, sums)) for r in x]
    n, sums = 10**10, [10**16 + 5, 10**16 - 7]
    assert whitening.Whitening(n, sums, 1.0, np.ones(1), np.ones((2, 1))).deviation(x) == [None, 74]


def test_defined_cases(spark):
    columns = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for rows in ([], [(1, None)], [(1, [0.5, 0.25])] * 3, [(1, [])]):
        got = whitening.whiten(frame(spark, rows))
        assert got.collect() == [] and got.columns == columns
    two = whitening.whiten(frame(spark, [(1, [0.0, 1.0]), (2, [2.0, 1.0]), (3, [2.0, 1.0])])).collect()  # one dimension is constant
    assert sorted((r["vec_id"], r["component"], r["n"], abs(r["whitened"]), r["explained"]) for r in two) == [(1, 1, 2, 1.0, 1.0), (2, 1, 2, 1.0, 1.0), (3, 1, 2, 1.0, 1.0)]
    with pytest.raises(ValueError, match="1 to 2 components"):
        whitening.whiten(frame(spark, [(1, [0.5]), (2, [0.5, 1.0])]))
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(frame(spark, [(1, [1e30])])).collect()
