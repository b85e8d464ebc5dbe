import random
import re

import numpy as np
import pyarrow as pa
from revstrand.llm import _text as X
from revstrand.llm import near_dup as N

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(text or "")
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def occurrences(text):
    """Shingles numbered by occurrence: the Jaccard similarity of these sets is the weighted one of the counts."""
    w, seen, out = WORD.findall(text or ""), {}, set()
    for i in range(max(len(w) - 4, 1)) if w else []:
        k = tuple(w[i : i + 5])
        seen[k] = seen.get(k, 0) + 1
        out.add((k, seen[k]))
    return out


def brute(rows, weighted=False):
    """Classes by all pairs of doc_ids; a doc_id with several texts is as near as any of them is."""
    ids = sorted({r[0] for r in rows})
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(occurrences(t) if weighted else shingles(t))
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if any(x & y and len(x & y) / len(x | y) >= 0.8 for x in sets[a] for y in sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_classes_against_all_pairs(spark, corpus, docs):
    r = random.Random(3)
    rows = [x[:2] for x in corpus]
    for g in range(6):  # a base and copies that are near it, but less near to each other
        base = ["w%d" % r.randrange(500) for _ in range(200)]
        for j in range(25):
            w = list(base)
            for _ in range(r.choice([0, 1, 3, 3, 6])):
                w[r.randrange(200)] = "z%d" % r.randrange(1000)
            rows.append((1000 + g * 100 + j, " ".join(w)))
    want = brute(rows)
    got = N.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == len(rows)
    assert {x.doc_id: x.class_id for x in got} == want


def test_empty_and_null(spark, docs):
    assert N.classes(docs.where("false")).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f"), (2, None), (3, None), (4, "a"), (5, "a")], "doc_id long, text string")
    assert sorted(map(tuple, N.classes(rows).collect()), key=str) == [(2, 2), (3, 3), (4, 4), (5, 4), (None, None)]


def test_signatures_estimate_weighted_similarity():
    one, two = ["a b c d e"] * 3 + ["f g h i j"] * 2, ["a b c d e"] * 2 + ["f g h i j"] * 4
    cells = lambda t: (h := np.array([hash_of(x) for x in t], np.uint64), N._cells(h, np.array([0, len(h)])))[1]
    hash_of = lambda s: int(X.mix(np.array([sum(map(ord, s))], np.uint64))[0])
    c = [cells(one), cells(two)]
    sig = N.dart_signatures(np.concatenate(c), np.array([0, len(c[0]), len(c[0]) + len(c[1])]), 4000)
    assert abs((sig[0] == sig[1]).mean() - 4 / 7) < 0.04 and (sig != 0).all()
    assert pa.array([1]).type == pa.int64()


def test_repeated_paragraphs_do_not_part_copies(spark):
    r, rows = random.Random(5), []
    for g in range(12):  # a text once, twice, thrice and five times, and one line 10 and 100 times after another text
        base = " ".join("w%d" % r.randrange(5000) for _ in range(300))
        rows += [(g * 10 + j, "\n".join([base] * n)) for j, n in enumerate((1, 2, 3, 5))]
        other, junk = " ".join("v%d" % r.randrange(5000) for _ in range(150)), " ".join("j%d" % r.randrange(5000) for _ in range(8))
        rows += [(1000 + g * 10 + j, "\n".join([other] + [junk] * n)) for j, n in enumerate((10, 100))]
    want = brute(rows)
    got = {x.doc_id: x.class_id for x in N.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == want and len(set(want.values())) == 24


def test_weighted_classes_count_repeats(spark):
    r, rows = random.Random(8), []
    for g in range(12):  # nine of ten repeats shared is near, once against twice is not
        base = " ".join("w%d" % r.randrange(5000) for _ in range(60))
        rows += [(g * 10 + j, "\n".join([base] * n)) for j, n in enumerate((1, 2, 9, 10))]
    want = brute(rows, weighted=True)
    got = {x.doc_id: x.class_id for x in N.classes(spark.createDataFrame(rows, "doc_id long, text string"), weighted=True).collect()}
    assert got == want and len(set(want.values())) == 36


def test_one_doc_id_with_several_texts(spark):
    r = random.Random(6)
    say = lambda n: " ".join("u%d" % r.randrange(900) for _ in range(n))
    a, b, c = say(120), say(150), say(90)
    rows = [(7, a), (7, b), (7, a), (9, a + " more"), (11, b + " more"), (3, c), (3, None), (4, "  "), (12, c + " too")]
    got = N.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x.doc_id, x.class_id) for x in got) == [(3, 3), (3, 3), (4, 4), (7, 7), (7, 7), (7, 7), (9, 7), (11, 7), (12, 3)]


def test_large_bands_lose_no_link(spark):
    r, rows = random.Random(12), []
    for g in range(3):  # chains: each text is near to the one before, but not to those long before
        w = ["c%d" % r.randrange(3000) for _ in range(160)]
        for j in range(60):
            w = list(w)
            w[r.randrange(160)] = "e%d" % r.randrange(10**6)
            rows.append((g * 1000 + j, " ".join(w)))
    rows += [(5000 + j, rows[0][1] + " " + " ".join("f%d" % r.randrange(10**6) for _ in range(25 + j))) for j in range(30)]
    want = brute(rows)
    got = {x.doc_id: x.class_id for x in N.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == want


def test_crowded_bands_without_rare_shingles_lose_no_link(spark, monkeypatch):
    for name, value in (("FEW", 1), ("BLOCK", 32)):  # every band counts as large
        monkeypatch.setattr(N, name, value)
    r, gap = random.Random(21), " - - - - "
    say = lambda i: " ".join("p%dw%d" % (i, j) for j in range(8))
    rows = []
    for j in range(250):  # 30 passages that all have and 8 of 80: four of these in common make two texts near
        rows.append((j, gap.join(map(say, [*range(30), *(30 + x for x in sorted(r.sample(range(80), 8)))]))))
    want = brute(rows)
    got = {x.doc_id: x.class_id for x in N.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert len(set(want.values())) > 50 and got == want


def test_equal_shingles_in_another_order_stay_linked_in_a_crowded_band(spark):
    r, gap, rows = random.Random(31), " - - - - ", []
    say = lambda i: " ".join("p%dw%d" % (i, j) for j in range(8))
    for g in range(25):  # 30 passages that all have and 5 of its own, and the same passages in another order
        middle = [*range(1, 29), *(100 + g * 5 + x for x in range(5))]
        for j in range(2):
            rows.append((g * 2 + j, gap.join(map(say, [0, *middle, 29]))))
            r.shuffle(middle)
    want = brute(rows)
    got = {x.doc_id: x.class_id for x in N.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows=1, bands=1).collect()}
    assert len(set(want.values())) == 25 and got == want


def test_sizes_of_a_doc_id_whose_texts_have_one_set(spark):
    import zstandard

    line = " ".join("w%d" % i for i in range(40))
    texts = [(1, line), (1, line.replace(" ", "  ")), (2, line), (2, line + " " + " ".join("x%d" % i for i in range(20)))]
    z = [(i, bytearray(zstandard.ZstdCompressor(level=1).compress(t.encode()))) for i, t in texts]
    named = spark.createDataFrame([(1, 5, 1), (2, 5, 2)], "rep long, band long, root long")
    node, met = N._rare(named, spark.createDataFrame(z, "doc_id long, z binary"), 0.8, False, lambda rows, tag: rows)
    assert sorted(map(tuple, node.collect())) == [(1, 36, 36, 0), (2, 56, 36, 0)] and [tuple(x) for x in met.collect()] == [(1, 2)]


def test_components_of_few_and_many_edges(spark):
    r = random.Random(11)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(1, 40)] + [(5, 5)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    near, want = {}, {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for start in sorted(near):
        todo = [start] if start not in want else []
        while todo:
            if (x := todo.pop()) not in want:
                want[x] = start
                todo += near[x]
    want = {k: v for k, v in want.items() if k != v}
    for few in (0, 1 << 20):
        assert {r["id"]: r["root"] for r in N.components(df, few).collect()} == want
    assert N.components(df.where("a < 0")).collect() == []
