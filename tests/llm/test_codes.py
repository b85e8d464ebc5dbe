import duckdb
import numpy as np
import pytest

from revstrand.llm import codes

VECTORS = "vec_id long, embedding array<float>, label int, code string, at int"


def brute(rows, scale, parts, entries, rounds):
    """Every distance of every round, with Python's integers."""
    some = [r for r in rows if r[1] is not None and all(c is not None and np.isfinite(c) for c in r[1])]
    some.sort(key=lambda r: (r[0] is None, r[0] or 0, [float(np.float32(c)) for c in r[1]]))
    x = [[int(np.floor(float(np.float32(c)) * scale)) for c in r[1]] for r in some]
    w = len(x[0]) // parts
    cut = [[v[p * w : (p + 1) * w] for v in x] for p in range(parts)]
    books = [c[:entries] for c in cut]
    gap = lambda a, b: sum((i - j) ** 2 for i, j in zip(a, b))
    near = lambda p: [min(range(len(books[p])), key=lambda e: (gap(v, books[p][e]), e)) for v in cut[p]]
    for _ in range(rounds):
        for p in range(parts):
            at = near(p)
            mean = lambda e: [sum(c) // len(c) for c in zip(*(v for v, a in zip(cut[p], at) if a == e))] or books[p][e]
            books[p] = [mean(e) for e in range(len(books[p]))]
    at = [near(p) for p in range(parts)]
    out = [(r[0], "".join(f"{at[p][i]:02x}" for p in range(parts)), sum(gap(cut[p][i], books[p][at[p][i]]) for p in range(parts)), r[2]) for i, r in enumerate(some)]
    return sorted(out, key=str), books


@pytest.fixture()
def vectors():
    r = np.random.default_rng(3)
    centre = r.normal(0, 0.4, (6, 8))
    rows = [(i, (centre[i % 6] + r.normal(0, 0.05, 8)).astype(np.float32).tolist(), i % 3 if i % 5 else None) for i in range(150)]
    rows += [(200 + i, rows[7][1], 1) for i in range(60)] + [(7, rows[7][1], 2), (7, rows[8][1], 2), (None, rows[9][1], None)]  # copies, repeated and null ids
    rows += [(300 + i, (np.round(r.normal(0, 2, 8)) / 1024).tolist(), 0) for i in range(40)]  # few different integers: many ties
    rows += [(400, None, 1), (401, [None] + [0.0] * 7, 1), (402, [float("nan")] + [0.0] * 7, 1), (403, [float("-inf")] + [0.0] * 7, None)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*x, "extra", 9) for x in rows], VECTORS).repartition(3)


@pytest.mark.parametrize("entries, rounds", [(16, 4), (5, 1), (256, 4), (3, 0)])
def test_equals_full_search(spark, vectors, entries, rounds):
    got, books = codes.compress(frame(spark, vectors), entries=entries, rounds=rounds)
    want, theirs = brute(vectors, codes.SCALE, codes.PARTS, entries, rounds)
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label"]) for r in got.collect()), key=str) == want
    assert books.tolist() == theirs


def test_query_equals_sql(spark, vectors, tmp_path):
    rows = [r for r in vectors if r[0] is not None]
    frame(spark, rows).select("vec_id", "embedding", "label").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = codes.op11_vector_codes(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(codes.oracle()).fetchall()
    assert got.columns == [d[0] for d in con.description]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_bounds_prune_and_stay_bounds():
    r = np.random.default_rng(5)
    centre = r.integers(-500, 500, (20, 6))
    x = (centre[r.integers(0, 20, 800)] + r.integers(-30, 30, (800, 6))).astype(np.int64)
    book = x[:20].copy()
    at, upper, lower = np.zeros(800, np.int64), np.full(800, np.inf), np.zeros((800, 20))
    before = None
    for turn in range(5):
        b = codes.Books(book[None], None if before is None else before[None])
        upper, lower = upper + b.moved[0][at], np.maximum(lower - b.moved[0], 0)
        own = b.half[0].copy()
        np.fill_diagonal(own, np.inf)
        if turn:
            assert (own.min(axis=1)[at] > upper).mean() > 0.2  # rows that no entry is compared with
        codes.nearest(x, book, b.half[0], at, upper, lower)
        full = ((x[:, None] - book[None]) ** 2).sum(2)
        assert (at == full.argmin(axis=1)).all()
        assert (upper >= np.sqrt(full[np.arange(800), at])).all() and (lower <= np.sqrt(full)).all()
        before = book.copy()
        for e in range(20):
            if (at == e).any():
                book[e] = x[at == e].sum(axis=0) // (at == e).sum()


def test_defined_cases(spark, vectors):
    empty, books = codes.compress(frame(spark, []))
    assert empty.collect() == [] and empty.columns == ["vec_id", "label", "code", "error"] and books.size == 0
    one, _ = codes.compress(frame(spark, [(None, [0.5] * 8, None)]))
    assert [tuple(r) for r in one.collect()] == [(None, None, "00000000", 0)]
    with pytest.raises(ValueError, match="equal parts"):
        codes.compress(frame(spark, [(1, [0.5] * 7, 1)]))
    with pytest.raises(Exception, match="must have 8 components"):
        codes.compress(frame(spark, [(1, [0.5] * 8, 1), (2, [0.5] * 4, 1)]))
    with pytest.raises(ValueError, match="too large"):
        codes.compress(frame(spark, [(1, [1e30] * 8, 1)]))
