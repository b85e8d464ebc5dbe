import gzip
import hashlib
import math
import random
import re
from dataclasses import replace

from pyspark.sql import functions as F
from revstrand.config import AssemblyConfig, ReadConfig, Refine, Sketch
from revstrand.operators import evaluate as E
from revstrand.operators import irmode as I
from revstrand.operators import kernels as K
from revstrand.operators import readmode as R
from revstrand.operators.lookup import signature_set
from revstrand.sources import readers, sinks
from revstrand.streaming import pass2

from .test_kernels import dna, rc

CFG = ReadConfig(end_guard=500)


def reads(spark):
    same = dna(1500, 1)
    rows = [(f"real{i} extra text", same + rc(same)) for i in range(4)]
    for i in range(3):
        a = dna(1500, 50 + i)
        rows.append((f"art{i} d", a + rc(a)))
    rows += [("random", dna(3000, 90)), ("short", "ACGT"), ("empty", ""), ("none", None), ("n", "N" * 3000)]
    return spark.createDataFrame(rows, "read_id string, seq string")


def test_read_mode_decides_and_cuts(spark):
    fixed, report = R.correct(reads(spark), CFG)
    got = {r["read_id"]: r["decision"] for r in report.collect()}
    assert {v for k, v in got.items() if k.startswith("real")} == {"real"} and {v for k, v in got.items() if k.startswith("art")} == {"artefact"}
    assert len(got) == 7 and report.columns == list(sinks.REPORT)
    out = {r["read_id"]: r["seq_out"] for r in fixed.collect()}
    assert len(out) == 12 and len(out["art0 d_chopped_at_1500"]) == 1500 and len(out["real0 extra text"]) == 3000 and out["none"] == ""


def test_low_identity_and_cut_low(spark):
    a = dna(1500, 7)
    r = random.Random(1)
    b = "".join(c if i % 21 else r.choice("ACGT") for i, c in enumerate(a))
    one = spark.createDataFrame([("x", a + rc(b))], "read_id string, seq string")
    strict = replace(CFG, min_identity=0.999)
    assert [x["decision"] for x in R.correct(one, strict)[1].collect()] == ["low_ident"]
    fixed, report = R.correct(one, replace(strict, cut_low_ident=True))
    assert report.first()["decision"] == "artefact" and fixed.first()["keep_end"] == report.first()["refined_split"]


def test_cuts_look_signatures_up_in_files(spark):
    """The cuts of a plain set, from sorted files of one signature a block, and no sequence is moved."""
    rows = reads(spark)
    inner = dna(2000, 3)
    inner = inner + rc(inner)
    rows = rows.unionByName(spark.createDataFrame([("deep", inner + rc(inner))], rows.schema))
    sup = R.support(R.calls(rows, CFG))
    real = {r["sig"] for r in sup.where(R.is_real(CFG)).collect()}
    fixed = R.corrected(rows, sup, CFG)
    want = {(r["read_id"], r["seq"]): R.cut_read(r["read_id"], r["seq"], CFG, real) for r in rows.collect()}
    assert sorted(map(tuple, fixed.collect())) == sorted(want.values())
    assert [r["keep_end"] for r in fixed.where("read_id = 'deep_chopped_at_4000'").collect()][0] < 2100
    files = signature_set(sup.where(R.is_real(CFG)), block=1)
    assert real and all(s in files for s in real) and not any(f"{i:032x}" in files for i in range(50))
    by_read = R.decide(R.calls(rows, CFG), sup, CFG).where("decision = 'artefact'").select("read_id").collect()
    assert {r["read_id"] for r in by_read} == {k.rsplit("_chopped_at_", 1)[0] for k, *_ in want.values() if "_chopped_at_" in k}
    for plan in (fixed, R.position_profile(rows, CFG)):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in text and not re.search(r"Exchange[^\n]*seq", text)


def test_signature_files_of_many_blocks(spark):
    sigs = spark.range(20_000).selectExpr("md5(cast(id as string)) sig").unionByName(spark.createDataFrame([("zz",), (None,), ("0" * 32,)], "sig string"))
    s = signature_set(sigs.repartition(4), block=100)
    s.kept = 3
    assert len(s.blocks) >= 200 and all(hashlib.md5(str(i).encode()).hexdigest() in s for i in range(0, 20_000, 37))
    assert not any(hashlib.md5(str(i).encode()).hexdigest() in s for i in range(20_000, 20_500)) and "0" * 32 in s and "f" * 32 not in s
    assert len(s._cache) == 3 and "0" * 32 not in signature_set(sigs.where("false"))


def test_rank_is_percent_rank(spark):
    sup = spark.createDataFrame([("a", 5), ("b", 5), ("c", 9), ("d", 1)], "sig string, n long").selectExpr("*", "0L min_split", "0L max_split", "1.0D mean_ident")
    assert {r["sig"]: round(r["rank_frac"], 6) for r in R.support_rank(sup).collect()} == {"c": 1.0, "a": round(2 / 3, 6), "b": round(1 / 3, 6), "d": 0.0}
    assert R.support_rank(sup.limit(1)).first()["rank_frac"] == 1.0


def test_assembly_mode_finds_planted_repeats(spark):
    rows = []
    for i, (arm, spacer) in enumerate([(2500, 0), (3000, 1500), (2200, 6000)]):
        a = dna(arm, 200 + i)
        rows.append((f"c{i}", dna(8000, 300 + i) + a + dna(spacer, 400 + i) + rc(a) + dna(7000, 500 + i)))
    rows += [("neg", dna(30000, 600)), ("tiny", "ACGT"), ("gapped", dna(5000, 700) + "N" * 500 + dna(5000, 701))]
    cfg = AssemblyConfig(window_len=20000, step=5000)
    contigs = spark.createDataFrame(rows, "contig string, seq string")
    calls = I.call_irs(contigs, cfg)
    got = {r["contig"]: r for r in calls.collect()}
    assert set(got) == {"c0", "c1", "c2"} and all(r["tir_ident"] >= 0.95 for r in got.values())
    assert calls.columns == list(sinks.IR) and I.call_irs(contigs.where("contig = 'neg'"), cfg).count() == 0


def plain_calls(name, seq, cfg):
    """The whole scan of one contig in loops: windows, hits, arms, cap, both de-duplications, arm identity of the contig's own bases."""
    seq, found = seq.upper(), []
    for m in re.finditer("[ACGT]+", seq):
        n = m.end() - m.start()
        if n < 2 * cfg.min_arm:
            continue
        size, at = min(cfg.window_len, n) if cfg.window_len > 0 else n, m.start()
        while True:
            end = min(at + size, m.end())
            for h in I.window_hits(seq[at:end], cfg):
                found.append(h | {k: h[k] + at for k in ("break_pos", "la0", "la1", "ra0", "ra1")} | {"win_start": at, "win_end": end})
            if at + size >= m.end():
                break
            at += cfg.step
    for h in found:
        left, right = sorted([(h["la0"], h["la1"]), (h["ra0"], h["ra1"])], key=lambda x: x[0]) if h["la0"] > h["ra0"] else [(h["la0"], h["la1"]), (h["ra0"], h["ra1"])]
        h["arm_len"] = min(max(left[1] - left[0], 0), max(right[1] - right[0], 0))
        h["spacer"], h["start"] = right[0] - left[1], left[0]
        h["end"] = max(min(right[0] + h["arm_len"], len(seq)), left[0])
        h["grp"] = 1
        if h["end"] - h["start"] > cfg.max_interval:
            h["grp"], h["start"] = 0, max(h["break_pos"] - cfg.max_interval // 2, 0)
            h["end"] = min(h["start"] + cfg.max_interval, len(seq))
        h["score"] = min(max(math.floor(h["identity_est"] * 1000 + 0.5), 0), 1000)
    found.sort(key=lambda h: (-h["grp"], -h["score"], -h["matches"], h["break_pos"], h["win_start"], h["bin"]))
    cells, taken, out = set(), [], []
    for h in found:
        cell = (h["break_pos"] // cfg.dedup, 2 * h["break_pos"] // cfg.diag_tol)
        if cell in cells:
            continue
        cells.add(cell)
        a, z = h["start"] // cfg.dedup * cfg.dedup, h["end"] // cfg.dedup * cfg.dedup
        if any(a < y and x < z for x, y in taken):
            continue
        taken.append((a, z))
        ident = K.arm_identity(K.as_array(seq[h["la0"] : h["la1"]]), K.as_array(seq[h["ra0"] : h["ra1"]]), cfg.proxy_gate)
        out.append((name, h["start"], h["end"], h["score"], h["break_pos"], h["matches"], h["la0"], h["la1"], h["ra0"], h["ra1"], h["win_start"], h["bin"], h["arm_len"], h["spacer"], ident and round(ident, 3)))
    return out


def test_calls_against_loops(spark, monkeypatch):
    monkeypatch.setattr(I, "CHUNK", 700)  # arms over many chunks
    cfg = AssemblyConfig(min_matches=8, min_arm=150, window_len=1500, step=400, refine=Refine(window=80), dedup=60, max_interval=1800)
    rows = []
    for i in range(6):
        a, b = dna(500 + 90 * i, 900 + i), dna(300, 920 + i)
        rows.append((f"c{i}", dna(400, i) + a + dna(40 * i, 930 + i) + rc(a) + ("N" * 3 if i % 2 else "") + dna(700, 940 + i).lower() + b + rc(b) + b + dna(300, 950 + i)))
    rows += [("none", dna(3000, 960)), ("short", "ACGT" * 9)]
    want = sorted(x for n, s in rows for x in plain_calls(n, s, cfg))
    got = I.call_irs(spark.createDataFrame(rows, "contig string, seq string").repartition(3), cfg)
    got = sorted(map(tuple, got.select("contig", "start", "end", "score", "break_pos", "matches", "la0", "la1", "ra0", "ra1", "win_start", "bin", "arm_len", "spacer", "tir_ident").collect()))
    assert len(want) >= 8 and got == want


def test_windows_cover_spans_and_stop(spark):
    rows = spark.createDataFrame([("a", "A" * 1000 + "N" + "C" * 450 + "NN" + "G" * 100)], "contig string, seq string")
    cfg = AssemblyConfig(min_arm=100, window_len=400, step=150)
    w = sorted((r["win_start"], r["win_end"]) for r in I.windows(rows, cfg).collect())
    assert w == [(0, 400), (150, 550), (300, 700), (450, 850), (600, 1000), (1001, 1401), (1151, 1451)]
    whole = I.windows(rows, replace(cfg, window_len=0)).collect()
    assert len(whole) == 2


def test_greedy_dedup_against_a_loop(spark):
    r = random.Random(4)
    rows = [(f"c{r.randrange(3)}", r.randrange(4) * 1000, i, r.randrange(20000), r.randrange(20, 90), r.random(), r.randrange(50, 3000)) for i in range(300)]
    c = spark.createDataFrame(rows, "contig string, win_start long, bin long, break_pos long, matches long, identity_est double, half long")
    c = I.ranked(c.selectExpr("*", "1 grp", "greatest(break_pos - half, 0) start", "break_pos + half `end`"))
    cfg = AssemblyConfig()
    got = {(x["contig"], x["bin"]) for x in I.dedup_b(I.dedup_a(c, cfg), cfg).collect()}
    want, cells, taken = set(), set(), []
    for x in sorted(c.collect(), key=lambda x: (-x["score"], -x["matches"], x["break_pos"], x["win_start"], x["bin"])):
        cell = (x["contig"], x["break_pos"] // 200, 2 * x["break_pos"] // 120)
        if cell in cells:
            continue
        cells.add(cell)
        s, e = x["start"] // 200 * 200, x["end"] // 200 * 200
        if any(k == x["contig"] and s < b and a < e for k, a, b in taken):
            continue
        taken.append((x["contig"], s, e))
        want.add((x["contig"], x["bin"]))
    assert got == want


def test_fasta_fastq_round_trip(spark, tmp_path):
    want = {f"r{i} d@x": dna(50 + 37 * i, i) for i in range(20)}
    fa = "".join(f">{k}\r\n" + "\n".join(v[i : i + 60].lower() for i in range(0, len(v), 60)) + "\n" for k, v in want.items())
    fq = "".join(f"@{k}\n{v}\n+\n{'@' * len(v)}\n" for k, v in want.items())
    (tmp_path / "a.fa").write_text(fa)
    (tmp_path / "b.fq").write_text(fq)
    for name, text in (("c.fa.gz", fa), ("d.fq.gz", fq)):
        with gzip.open(tmp_path / name, "wt") as f:
            f.write(text)
    for name in ("a.fa", "b.fq", "c.fa.gz", "d.fq.gz"):
        got = readers.read_sequences(spark, str(tmp_path / name), 3)
        assert {r["read_id"]: r["seq"] for r in got.collect()} == want, name
    ids = spark.createDataFrame([("r3",), ("r7",)], "id string")
    assert {r["read_id"] for r in readers.extract(readers.read_fasta(spark, str(tmp_path / "a.fa")), ids).collect()} == {"r3 d@x", "r7 d@x"}
    for name in ("a.fa", "b.fq", "c.fa.gz", "d.fq.gz"):  # in file order, not by name
        first = readers.first_n(readers.read_sequences(spark, str(tmp_path / name), 3, place=True), 11).collect()
        assert [r["read_id"] for r in first] == list(want)[:11], name


def test_tables_round_trip(spark, tmp_path):
    fixed, report = R.correct(reads(spark), CFG)
    sinks.write_report_tsv(report, str(tmp_path / "r"))
    back = readers.read_tsv(spark, str(tmp_path / "r"), "read_id string, refined_split long, identity_est double, decision string, nothing string")
    assert sorted(map(tuple, back.collect())) == sorted((r["read_id"], r["refined_split"], r["identity_est"], r["decision"], None) for r in report.collect())
    sinks.write_corrected_fasta(fixed.where("seq_out != ''"), str(tmp_path / "f"))
    assert readers.read_fasta(spark, str(tmp_path / "f")).count() == 10
    (tmp_path / "p.paf").write_text("q 10 0 9 - q 10 1 8 5 9 60 tp:A:P\n\nz\t1\t0\t1\t+\tz\t1\t0\t1\t1\t1\t0\n")
    p = readers.read_paf(spark, str(tmp_path / "p.paf")).orderBy("line_no").collect()
    assert len(p) == 2 and p[0]["tags"] == {"tp": "P"} and p[0]["tend"] == 8


def test_ir_sinks(spark, tmp_path):
    row = ("c", 2, 10, "IR", 900, ".", 6, 0.9, None, 30, 8, 2, 5, 6, 10, 20, 0, 20, 40, 1, 3, 1, "immediate")
    calls = spark.createDataFrame([row], ", ".join(f"`{n}` {'string' if isinstance(v, str) else 'double' if n.endswith(('est', 'ident')) else 'long'}" for n, v in zip(sinks.IR, row)))
    sinks.write_ir_tsv(calls, str(tmp_path / "t"))
    lines = spark.read.text(str(tmp_path / "t")).collect()
    assert lines[0][0].startswith("#contig\tstart") and lines[0][0].count("\t") == 22 and "\tNaN\t" in lines[1][0]
    assert len(sinks.ir_tsv(calls, False).columns) == 20
    contigs = spark.createDataFrame([("c", "ACGTACGTACGTACGTACGT")], "contig string, seq string")
    text = sinks.ir_fasta(calls, contigs, 5).first()[0]
    assert text == ">c:2-10|break=6|ident=0.900|tir_ident=NaN|matches=30|span=8|bin=1|class=spaced|spacer=1\nGTACG\nTAC"
    page = sinks.html_report(calls, "a <b>")
    assert "a &lt;b&gt;" in page and '"contig":"c"' in page and '"tir_ident":null' in page and page.count('class="cls"') == 4
    many = spark.range(60_000).selectExpr("concat('c', id % 7, '</script>') contig", "id score", "1 matches", "id start", "id + 9 end", "0.9D tir_ident")
    sinks.write_html_report(many, str(tmp_path / "h"), "all")
    rows = spark.read.text(str(tmp_path / "h" / "rows"))
    assert rows.count() == 60_000 and rows.where("value LIKE '%</script%'").count() == 0


def test_stream_decides_like_the_batch(spark, tmp_path):
    rows = reads(spark)
    rows.write.parquet(str(tmp_path / "in"))
    sup = R.support(R.calls(rows, CFG))
    sup.write.parquet(str(tmp_path / "sup"))
    sup = spark.read.parquet(str(tmp_path / "sup"))
    pass2.write_decisions(pass2.decided_stream(spark, str(tmp_path / "in"), sup, CFG), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r["read_id"]: r["decision"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r["read_id"]: r["decision"] for r in R.correct(rows, CFG)[1].select("read_id", "decision").collect()}


def test_position_profile(spark):
    a = dna(1500, 8)
    rows = spark.createDataFrame([("x", a + dna(400, 9) + rc(a))], "read_id string, seq string")
    p = R.position_profile(rows, CFG, 100).agg(F.avg("mean_match")).first()[0]
    assert p > 0.6


def test_sweep(spark):
    got = {r["tag"]: r for r in R.sweep(reads(spark), {"base": CFG, "s5": replace(CFG, min_support=5), "long": replace(CFG, min_arm=2800)}).collect()}
    assert (got["base"]["real"], got["base"]["artefact"]) == (4, 3) and (got["s5"]["real"], got["s5"]["artefact"]) == (0, 7)
    assert got["long"]["detected"] == 7


def test_one_pass_for_many_configurations(spark, monkeypatch):
    """Twelve configurations, also of other sketches and modes, equal twelve runs; a read is sketched once per sketch."""
    rows = reads(spark)
    configs = {f"{s}-{i}-{a}": replace(CFG, min_support=s, min_identity=i, min_arm=a) for s in (1, 5) for i in (0.5, 0.999) for a in (200, 2800)}
    configs |= {"ont": replace(CFG, refine=replace(CFG.refine, mode="ont")), "tol": replace(CFG, diag_tol=300), "low": replace(CFG, min_identity=1.0, cut_low_ident=True), "sketch": replace(CFG, sketch=Sketch(15, 11), min_matches=40)}
    got = {r["tag"]: r.asDict() for r in R.sweep(rows, configs).collect()}
    for tag, cfg in configs.items():
        called = R.calls(rows, cfg)
        by = {r["decision"]: r["count"] for r in R.decide(called, R.support(called), cfg).groupBy("decision").count().collect()}
        assert got[tag] == {"tag": tag, "detected": sum(by.values()), **{d: by.get(d, 0) for d in ("artefact", "low_ident", "real", "unknown")}}, tag
    seen, a = [], K.as_array(rows.where("read_id LIKE 'art0%'").first()["seq"])
    monkeypatch.setattr(K, "_points", lambda *x, f=K._points: seen.append(x[1]) or f(*x))
    shared: dict = {}
    for cfg in configs.values():
        K.detect(a, cfg, shared)
    assert sorted(seen, key=str) == sorted({c.sketch for c in configs.values()}, key=str)


def test_traps_of_ont_mode():
    """T2, T3: support and the identity gate are hifi's, the reported split and identity are ont's, and hifi's where ont finds nothing."""
    a = dna(1500, 60)
    r = a + rc(a)
    broken = r[:1700] + r[1701:1900] + "ACG" + r[1900:]  # indels: fine for ont, not for hifi
    ont = replace(CFG, refine=replace(CFG.refine, mode="ont"))
    x, y = R.call_read("x", broken, CFG), R.call_read("x", broken, ont)
    assert y["hifi_identity"] == x["identity_est"] and y["sig"] == x["sig"] and y["identity_est"] != x["identity_est"]
    none = replace(ont, refine=replace(ont.refine, max_ed_rate=0.0))
    far = dna(1500, 61)[:400] + rc(dna(1500, 61))[-400:]
    noisy = far[:150] + "A" * 40 + far[190:]
    loose = replace(none, min_matches=5, min_arm=50, end_guard=50)
    got, want = R.call_read("x", noisy, loose), R.call_read("x", noisy, replace(loose, refine=replace(loose.refine, mode="hifi")))
    assert got == want and (got is None or got["refined_split"] is not None)


def test_traps_of_cutting(spark):
    """T4: an artefact keeps its suffix even where the cutter leaves it whole. T5: the first recursion sees the same signature."""
    rows = reads(spark)
    called = R.calls(rows, CFG)
    sup, uncut = R.support(called), replace(CFG, max_depth=0)
    decided = R.decide(called, sup, uncut)
    artefacts = {r["read_id"] for r in decided.where("decision = 'artefact'").collect()}
    got = {r["read_id"]: r for r in R.corrected(rows, sup, uncut).collect()}
    named = {k for k in got if "_chopped_at_" in k}
    assert artefacts and {k.rsplit("_chopped_at_", 1)[0] for k in named} == artefacts
    assert all(got[k]["keep_end"] == len(got[k]["seq_out"]) for k in named)
    kept = R.first_cut(decided).withColumn("keep_end", F.col("len"))
    assert R.run_counters(rows, decided, kept).first()["num_cut"] == 0
    seqs = {r["read_id"]: r["seq"] for r in rows.collect()}
    for r in called.where("sig IS NOT NULL").collect():
        x = K.as_array(seqs[r["read_id"]])
        f = K.detect(x, CFG)
        assert K.signature(x, f, K.refine(x, f, CFG, "hifi").split, CFG) == r["sig"]


def test_traps_of_candidates(spark):
    """T6: equal group, score and matches are ordered by break position, not by bin rank. T11: raw arms, but normalised lengths."""
    row = "contig string, win_start long, bin long, bin_rank long, break_pos long, matches long, identity_est double, grp int, start long, end long"
    c = spark.createDataFrame([("c", 0, 1, 0, 900, 30, 0.9, 1, 800, 1000), ("c", 0, 2, 3, 850, 30, 0.9, 1, 790, 1010)], row)
    assert [r["break_pos"] for r in I.dedup_b(I.ranked(c), AssemblyConfig()).collect()] == [850]
    h = spark.createDataFrame([(500, 700, 100, 350, 5000)], "la0 long, la1 long, ra0 long, ra1 long, contig_len long")
    x = I.arms(h).first()
    assert (x["la0"], x["la1"], x["ra0"], x["ra1"]) == (500, 700, 100, 350) and (x["arm_len"], x["spacer"], x["start"]) == (200, 150, 100)


def test_intervals_meet_in_bins(spark):
    r = random.Random(2)
    t = [(i, f"c{r.randrange(2)}", a := r.randrange(200_000), a + r.choice([0, 50, 400, 30_000, 70_000])) for i in range(60)]
    c = [(i, f"c{r.randrange(2)}", a := r.randrange(200_000), a + r.choice([0, 80, 500, 20_000, 60_000]), r.random()) for i in range(80)]
    truth, calls = spark.createDataFrame(t, "truth_id long, contig string, t0 long, t1 long"), spark.createDataFrame(c, "call_id long, contig string, start long, `end` long, tir_ident double")
    got = {x["truth_id"]: x["call_id"] for x in E.match_truth(truth, calls).collect()}
    for i, k, a, z in t:
        best = max(((min(z, e) - max(a, s), q, s - e, -j) for j, kk, s, e, q in c if kk == k and (ov := min(z, e) - max(a, s)) > 0 and (ov >= 100 or (ov >= 0.25 * (z - a) and ov >= 0.25 * (e - s)))), default=None)
        assert got[i] == (best and -best[3]), i


def test_support_rank_of_one_support(spark):
    sigs = sorted(f"{i * 2654435761 % 2**32:08x}" for i in range(700))
    sup = spark.createDataFrame([(s, 1 + (s < "2"), 0, 0, 0.9) for s in sigs], "sig string, n long, min_split long, max_split long, mean_ident double")
    want = sorted(sigs, key=lambda s: (s >= "2", s))
    got = {r["sig"]: r["rank_frac"] for r in R.support_rank(sup).collect()}
    assert all(abs(got[s] - (1 - i / 699)) < 1e-12 for i, s in enumerate(want))


def test_a_cut_read_is_detected_once_for_its_call(monkeypatch):
    import numpy as np
    from revstrand.operators import generate as G

    cfg = ReadConfig(end_guard=300, max_depth=1)
    seq = G.foldback(np.random.default_rng(4), 900).tobytes().decode()
    want, seen, detect = R.call_read("a", seq, cfg), [], K.detect
    monkeypatch.setattr(K, "detect", lambda *a: seen.append(1) or detect(*a))
    assert want["sig"] and R.cut_read("a", seq, cfg, {want["sig"]}) == ("a", 0, len(seq), seq)
    seen.clear()
    name, start, end, kept = R.cut_read("a", seq, cfg, set())
    assert (name, start, end) == (f"a_chopped_at_{want['refined_split']}", 0, want["refined_split"] + want["gap_est"] // 2) and kept == seq[:end] and len(seen) == 1


def test_windows_of_many_blocks_are_sketched_once(monkeypatch):
    r = random.Random(11)
    small = AssemblyConfig(min_matches=10, min_arm=200, window_len=1000, step=300, refine=Refine(window=100), dedup=50)
    shared = dna(400, 900)
    seqs = []
    for i in range(40):
        arm = r.choice([shared, dna(r.randrange(100, 700), i)])
        back = list(rc(arm))
        for at in range(r.randrange(1, 25), len(back), r.choice([20, 60, 10_000])):
            back[at] = "A"
        unit = dna(30, i)
        seqs.append(dna(r.randrange(0, 300), i + 50) + arm + r.choice(["", "N" * 60, dna(150, i + 100), unit * 40 + rc(unit) * 40]) + "".join(back) + dna(r.randrange(0, 300), i + 150))
    body = "".join(seqs)
    todo = sorted((a, min(a + r.choice([30, 47, 48, 300, 1000, 2500]), len(body))) for a in range(0, len(body), 150))
    for cfg in (small, replace(small, bucket_cap=3, hits_per_window=2), replace(small, sketch=Sketch(11, 5, False), min_matches=4, min_arm=60)):
        want = [(i, h) for i, (a, z) in enumerate(todo) if (h := I.window_hits(body[a:z], cfg))]
        for most in (1, 500, K.AT_ONCE):
            monkeypatch.setattr(K, "AT_ONCE", most)
            assert [x for x in I.block_hits(body.encode(), todo, cfg) if x[1]] == want
        assert len(want) > 20
        assert not list(I.block_hits(b"", [(0, 0)], cfg)) and not list(I.block_hits(b"ACGT" * 3, [(0, 12)], cfg))


def test_clusters_are_many_tasks_work_and_no_group_each(spark):
    rows = [(f"c{i}", 1000, 50, 900, 0, i, 1, 500, 1500) for i in range(400)] + [(f"c{i}", 1010, 60, 800, 0, -1, 1, 400, 1600) for i in range(400)]
    c = spark.createDataFrame(rows, "contig string, break_pos long, matches long, score long, win_start long, bin long, grp int, start long, `end` long")
    got = I.dedup_b(c, AssemblyConfig()).select("bin", F.spark_partition_id().alias("task")).collect()
    assert sorted(x["bin"] for x in got) == list(range(400))
    assert len({x["task"] for x in got}) > 4  # small rows had all been put into one task
