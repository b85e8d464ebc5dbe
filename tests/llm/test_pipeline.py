import corpus_pipeline as C
from revstrand.llm import decontaminate as D

from .conftest import DOCS
from .test_near_dup import brute as near_brute
from .test_substring_dedup import brute as passages_brute


def test_stages_on_hostile_rows(spark, docs, tmp_path):
    bench = spark.createDataFrame([(1, "one benchmark passage that nobody else would ever write down in this order")], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    leak = spark.createDataFrame([(500, "so ONE benchmark passage, that nobody else would ever write down in this order ok", "xx", "a", 1, "e", 1)], DOCS + ", rank string, bin int")
    several = spark.createDataFrame([(None, "nobody knows this one here", "xx", "a", 1, "e", 1), (None, "nobody knows this one here", "xx", "a", 1, "e", 1)] + [(501, f"text of {x} which shares its number with another one", "xx", "b", 1, "e", 1) for x in ("apples", "pears", "pears")], DOCS + ", rank string, bin int")
    docs.unionByName(leak).unionByName(several).write.parquet(f"{tmp_path}/documents.parquet")
    rows, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in C.STAGES:
        rows = C.cut(stage(spark, rows, str(tmp_path)), f"t-{name}")
        if name != "mixing":
            assert rows.where("doc_id IS NULL").count() == 2 and rows.where("doc_id = 501").count() == (3 if name == "language_id" else 2), name
        seen.append({r["doc_id"] for r in rows.select("doc_id").collect()})
        assert rows.columns[:5] == C.COLUMNS or name == "mixing"
    assert {75, 76, 77, 82} & seen[0] == set() and 500 in seen[0]
    assert 79 not in seen[1] and 80 not in seen[1] and 3 in seen[1] and len(seen[1] & set(range(60, 75))) == 1
    assert 500 in seen[2] and 500 not in seen[3]
    assert rows.where("copies < 1 OR copies > 3 OR taken != copies * size").count() == 0
    assert D.find(rows.select("doc_id", "text"), bench).where("size(leaks) > 0").count() == 0


def test_stages_against_brute_force(spark, corpus, docs, tmp_path):
    """What near_dedup keeps and what substring_dedup leaves, by all pairs of documents and all windows of what the stage was given."""
    spark.createDataFrame([(1, "one benchmark passage that nobody else would ever write down in this order")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    given = C.cut(C.identify_language(spark, docs, str(tmp_path)), "t-given")
    rows = [(r["doc_id"], r["text"]) for r in given.collect()]
    kept = C.cut(C.drop_near_duplicates(spark, given, str(tmp_path)), "t-kept")
    root = near_brute(rows)
    want = sorted({(i, t) for i, t in rows if root[i] == i})
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == want and len(want) < len(rows)
    left = C.drop_repeated_passages(spark, kept, str(tmp_path)).collect()
    plain = {d: (n, gone, text) for d, n, gone, text in passages_brute(want)}
    assert {r["doc_id"] for r in left} == {d for d, (n, gone, _) in plain.items() if n == 0 or gone < n}
    assert all(r["text"] == (plain[r["doc_id"]][2] if plain[r["doc_id"]][1] else dict(want)[r["doc_id"]]) for r in left)


def test_empty_table(spark, docs, tmp_path):
    docs.where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0
