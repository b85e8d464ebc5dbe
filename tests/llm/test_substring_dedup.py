import random
import re

import pytest
from revstrand.llm import substring_dedup as S
from revstrand.llm.history import History

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    first, words = {}, [(r[0], WORD.findall(r[1] or "")) for r in rows]
    for d, w in words:
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < d:
                gone.update(range(i, i + 13))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out)


def test_against_brute_force(spark, corpus, docs):
    want = brute(corpus)
    assert sum(x[2] for x in want) > 500
    for batches in (1, 2, 5):
        assert sorted(map(tuple, S.dedup(docs, batches).drop('text').collect())) == want


def test_empty_table_and_null_id(spark, docs):
    assert S.dedup(docs.where("false")).count() == 0
    rows = spark.createDataFrame([(None, "a  b c"), (1, "d")], "doc_id long, text string")
    assert sorted(map(tuple, S.dedup(rows).drop('text').collect()), key=str) == [(1, 1, 0, "d"), (None, 3, 0, "a b c")]


def test_runs_are_merged(spark, docs):
    index = S.FingerprintIndex(spark, buckets=16, groups=64)
    for k in range(5):
        index.add(docs.where(f"doc_id % 5 = {k}"))
    assert len(index.runs) == S.MOST_RUNS and index.compactions == 5 - S.MOST_RUNS
    index.compact()
    assert len(index.runs) == 1
    copy = docs.where("doc_id = 3").withColumn("doc_id", docs.doc_id + 9000)
    found = {r["doc_id"] for r in S._ids(index.add(copy)).distinct().collect()}
    assert found == {3, 9003}  # history meets the batch; the first document of each anchor is returned with it
    index.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("revstrand_run_")]


def test_history_is_not_shuffled(spark, docs):
    index = S.FingerprintIndex(spark, buckets=16, groups=64)
    index.add(docs.where("doc_id < 30"))
    index.add(docs.where("doc_id >= 30"))
    plan = index._shared(index.runs[1], index.runs[0])._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroups" in plan and "Exchange" not in plan
    index.close()


def test_columns_pass_and_untouched_texts_stay(spark, corpus, docs):
    got = {r["doc_id"]: r for r in S.dedup(docs, keep=("lang", "source", "bin")).collect()}
    for r in corpus:
        g = got[r[0]]
        assert (g["lang"], g["source"], g["bin"]) == (r[2], r[3], r[6])
        assert g["text"] == (g["kept"] if g["n_removed"] else r[1])


def test_names_of_the_result_are_not_kept(spark, docs):
    with pytest.raises(ValueError):
        S.dedup(docs.withColumn("kept", docs.bin), keep=("kept",))


def test_groups_give_their_memory_back(monkeypatch):
    calls = []
    monkeypatch.setattr(S.X, "release", lambda: calls.append(1))
    assert S._tidy(lambda t: t + 1)(1) == 2 and S._tidy_two(lambda a, b: a + b)(1, 2) == 3 and len(calls) == 2


def result(df):
    return sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in df.collect())


@pytest.mark.parametrize("most_runs", [1, 5])
def test_batches_against_history_equal_one_shot(spark, tmp_path, most_runs):
    """Each batch alone, against an index of the ones before in its folder: closed and opened again, with and without compaction."""
    r = random.Random(21)
    vocab = [f"w{i}" for i in range(60)]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    shared, rows = [say(40), say(25), say(14)], []
    for i in range(90):
        parts = [say(r.randint(0, 30)) for _ in range(3)]
        for _ in range(r.randint(0, 2)):
            p = r.choice(shared).split()
            a = r.randint(0, 10)
            parts.insert(r.randint(0, 3), " ".join(p[a:]))
        rows.append((i, " ".join(parts)))
    rows[40] = (40, rows[3][1])  # a copy of a document of the first batch
    rows[70] = (70, rows[3][1] + " " + rows[50][1])
    rows += [(200, None), (201, "")]
    order = [x for x in rows if x[0] % 3 == 0], [x for x in rows if x[0] % 3 == 1], [x for x in rows if x[0] % 3 == 2]  # ids of batches interleave
    kind = "doc_id long, text string"
    everything = {x[0]: x for x in result(S.dedup(spark.createDataFrame(rows, kind)))}
    seen: list = []
    for n, batch in enumerate(order):
        history = History(spark, f"file://{tmp_path}/index", buckets=4, groups=8, most_runs=most_runs)
        got = result(S.dedup(spark.createDataFrame(batch, kind).repartition(3), history=history))
        seen += batch
        known = {x[0]: x for x in result(S.dedup(spark.createDataFrame(seen, kind)))}
        assert got == sorted(known[i] for i in sorted(x[0] for x in batch)), n
        assert history.version == n + 1 and len(history.anchors) <= most_runs and len(history.digests) <= most_runs
        history.close()
    assert got == sorted(everything[x[0]] for x in order[2]) and sum(x[2] for x in got) > 100
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("revstrand_run_")]


def test_a_copy_of_history_is_found(spark, tmp_path):
    words = [f"x{i}" for i in range(40)]
    old = spark.createDataFrame([(i, " ".join(f"{i}a{j}" for j in range(30)) + " " + (" ".join(words) if i == 7 else "")) for i in range(10)], "doc_id long, text string")
    new = spark.createDataFrame([(100, "here " + " ".join(words) + " there")], "doc_id long, text string")
    history = History(spark, f"file://{tmp_path}/index")
    S.dedup(old, history=history).count()
    history.close()
    history = History(spark, f"file://{tmp_path}/index")
    assert result(S.dedup(new, history=history)) == [(100, 42, 40, "here there")]
    history.close()


def test_a_batch_that_breaks_off_leaves_the_index(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(1, " ".join(f"y{j}" for j in range(20)))], "doc_id long, text string")
    history = History(spark, f"file://{tmp_path}/index")
    S.dedup(docs, history=history).count()
    with monkeypatch.context() as m:
        m.setattr(History, "_publish", lambda self: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            S.dedup(docs.selectExpr("2L doc_id", "text"), history=history)
    history.close()
    history = History(spark, f"file://{tmp_path}/index")
    assert history.version == 1 and len(history.texts) == 1
    assert result(S.dedup(docs.selectExpr("3L doc_id", "text"), history=history))[0][2] == 20
    history.close()
