import importlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from revstrand.functions import synth as Y
from revstrand.operators import irmode
from revstrand.operators import readmode as R
from revstrand.plans import assembly, coarse
from revstrand.sources.contigs import CHUNK, parts, pieces


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """Reads of all kinds, a few of each."""
    d = str(tmp_path_factory.mktemp("sf"))
    spark.range(96, 120).withColumnRenamed("id", "doc_id").repartition(4).write.parquet(f"{d}/documents.parquet")
    return d


def query(name):
    return importlib.import_module("__spark_entry__").queries()[name]


def test_profile_takes_every_read(spark, sf):
    calls = R.calls(Y.reads(spark, sf), coarse.CFG).where("refined_split IS NOT NULL").collect()
    reach = [min(c["refined_split"] - c["gap_est"] // 2, c["len"] - c["refined_split"] - c["gap_est"] // 2, 500) for c in calls]
    got = {r["i"]: r["n"] for r in query("position_profile")(spark, sf).collect()}
    assert {c["read_id"] for c in calls} > {"r96", "r97", "r99", "r100", "r107"}
    assert got == {i: sum(n > i for n in reach) for i in range(max(reach))} and max(got) == 499


def test_ont_takes_every_read(spark, sf):
    cfg = coarse.replace(coarse.CFG, refine=coarse.Refine(window=100, arm=1200, mode="ont"))
    want = {}
    for r in Y.reads(spark, sf).collect():
        c = R.call_read(r["read_id"], r["seq"], cfg)
        if c and c["refined_split"] is not None:
            want[r["read_id"]] = (c["refined_split"], c["gap_est"], round(c["identity_est"], 6))
    got = query("refine_ont")(spark, sf).collect()
    assert {r["read_id"]: (r["refined_split"], r["gap_est"], r["identity_est"]) for r in got} == want and len(want) >= 16


def test_contigs_of_every_read(spark, sf):
    got = Counter(r["contig"] for r in assembly.contigs(spark, sf).select("contig").collect())
    assert got == {f"c{i}": 1 for i in range(96, 120)}
    called = {r["contig"] for r in query("tir_ident")(spark, sf).select("contig").collect()}
    bounds = {r["read_id"] for r in query("arm_bounds_minmax")(spark, sf).select("read_id").collect()}
    windows = {r["contig"] for r in query("ir_windows")(spark, sf).select("contig").collect()}
    assert {r["contig"] for r in query("ir_calls")(spark, sf).select("contig").collect()} == called
    for kind in (0, 1, 3, 4):
        assert any(int(c[1:]) % 6 == kind for c in called) and any(int(c[1:]) % 6 == kind for c in bounds), kind
    assert any(int(c[1:]) % 2 for c in called) and windows == set(got)


def test_one_detection_and_time_linear_in_the_contig(spark):
    """Windows are scanned once for the calls, and what is dealt to tasks is 1.25 times the contig, and a piece more, whatever its length."""
    rows = spark.createDataFrame([("c", "ACGT" * 50_000), ("d", "ACGT" * 200_000)], "contig string, seq string")
    cfg = coarse.replace(assembly.SMALL, window_len=20_000, step=4000)
    p = pieces(rows)
    dealt = irmode.blocks(p, irmode.windows(p, cfg), cfg)
    size = {r["contig"]: r["n"] for r in dealt.groupBy("contig").agg(F.sum(F.octet_length("piece")).alias("n")).collect()}
    assert size["c"] <= 200_000 * 1.25 + 4 * CHUNK and size["d"] <= 800_000 * 1.25 + 11 * CHUNK
    plan = irmode.call_irs(rows, cfg)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") <= 4  # pieces and arms; hits are read, not found again


def test_sequences_are_not_broadcast(spark):
    """Contigs made from a few ids look small to the planner, whatever their length."""
    ids = spark.range(0, 2)
    made = ids.mapInArrow(lambda batches: batches, "id long").selectExpr("concat('c', id) AS contig", "repeat('ACGT', 20000) AS seq")
    need = ids.selectExpr("concat('c', id) AS contig", "60000L AS lo", "70000L AS hi")
    got = parts(need, made)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["contig"], r["start"], len(r["part"])) for r in got.collect()) == [(c, at, n) for c in ("c0", "c1") for at, n in ((0, CHUNK - 60000), (CHUNK, 70000 - CHUNK))]
