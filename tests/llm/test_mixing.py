import re

import duckdb
import pytest
from pyspark.sql import functions as F
from revstrand.llm import mixing as M
from revstrand.llm import sql

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def water_fill(sizes, weights, most):
    total, left, target = sum(sizes), set(range(len(sizes))), {}
    while left:
        level = (total - sum(target.values())) / sum(weights[i] for i in left)
        over = [i for i in left if level * weights[i] > most * sizes[i] + 1e-9]
        if not over:
            return {**target, **{i: level * weights[i] for i in left}}
        target |= {i: most * sizes[i] for i in over}
        left -= set(over)
    return target


def test_targets_against_repeated_resharing(spark):
    for sizes in ([100, 5, 7, 3000, 1, 40, 0], [10], [1, 1, 1, 1000], [500, 400, 300]):
        rows = spark.createDataFrame([(f"s{i:02d}", n) for i, n in enumerate(sizes)], "source string, source_size long")
        want = water_fill(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))], 3)
        got = {int(r["source"][1:]): r["target"] for r in M.targets(rows).collect()}
        assert all(abs(got[i] - want[i]) < 1e-6 for i in want) and abs(sum(got.values()) - sum(sizes)) < 1e-6


def test_sources_meet_targets_and_reruns_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = M.mix(docs, keep_source=True).collect()
    by = {}
    for r in rows:
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        by.setdefault(r["source"], [0, r["target"]])[0] += r["taken"]
    assert all(abs(t - g) <= 0.03 * g for t, g in by.values())
    again = M.mix(docs.repartition(7), bins=16, few=5).collect()  # neither partitions nor the grid change the choice
    assert sorted((r["doc_id"], r["taken"]) for r in rows) == sorted((r["doc_id"], r["taken"]) for r in again)


def test_hostile_rows_against_sql(spark, corpus, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/d/*.parquet')")
    want = con.execute(f"SELECT doc_id, size, source_size, round(target, 6), taken FROM ({sql.MIX})").fetchall()
    got = [(r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in M.mix(docs).collect()]
    assert len(got) == len(corpus) and sorted(set(got)) == sorted(set(want))
    assert {r[0]: r[1] for r in got} == {r[0]: len(WORD.findall(r[1] or "")) for r in corpus}
    assert M.mix(docs.where("false")).count() == 0


def test_inclusion_odds_change_the_order(spark):
    """Documents of one source, of the same random numbers: those of unequal sizes are ranked otherwise than by the random numbers."""
    rows = spark.createDataFrame([(i, " ".join(["w"] * (1 if i % 2 else 50)), s) for s in ("a", "b") for i in range(400)], "doc_id long, text string, source string")
    got = M.mix(rows, keep_source=True).where("source = 'a'").collect()
    u = {r["doc_id"]: r["u"] for r in rows.select("doc_id", M.random_unit(F.concat_ws(":", F.lit(""), F.col("doc_id").cast("string"))).alias("u")).distinct().collect()}
    mean, size = got[0]["target"] / got[0]["source_size"], {r["doc_id"]: r["size"] for r in got}
    part, extra = mean - int(mean), {r["doc_id"]: r["copies"] > int(mean) for r in got}
    q = {i: (u[i] / (1 - u[i])) / (part / (1 - part) * (size[i] / 25.5) ** 0.5) for i in u}
    by_rank = sorted(q, key=q.get)
    n = sum(extra.values())
    assert all(extra[i] for i in by_rank[: n - 52])  # a prefix of the ranking; one-word documents fill what is left
    assert not all(extra[i] for i in sorted(u, key=u.get)[: n - 1])
    share = [sum(extra[i] for i in u if size[i] == z) / 200 for z in (1, 50)]
    assert share[1] > share[0] + 0.15  # large documents have larger odds


def test_repeats_and_null_ids_go_together(spark, tmp_path):
    rows = [(1, "a b c", "x")] * 3 + [(None, "d e", "x")] * 2 + [(2, "f " * 40, "x"), (3, "g " * 7, "x"), (3, "h i", "x"), (4, None, None)] + [(i, "k " * (i % 9), "y") for i in range(10, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/d/*.parquet')")
    want = con.execute(f"SELECT doc_id, size, source_size, round(target, 6), taken FROM ({sql.MIX})").fetchall()
    for few in (1, 1000):
        got = [(r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in M.mix(docs, few=few, bins=8).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    alike = {}
    for r in got:
        alike.setdefault(r[:2], set()).add(r[4])
    assert all(len(x) == 1 for x in alike.values())


def test_names_of_the_result_are_not_kept(spark, docs):
    with pytest.raises(ValueError):
        M.mix(docs, keep=("size",))
