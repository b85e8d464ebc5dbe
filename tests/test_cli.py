import pytest
from revstrand.__main__ import assembly_settings, main, parser, read_settings
from revstrand.config import AssemblyConfig
from revstrand.operators import evaluate as E
from revstrand.operators import generate as G
from revstrand.operators import irmode as I
from revstrand.sources import readers, sinks

from .test_kernels import dna, rc


def test_settings():
    a = parser().parse_args(["correct", "x", "-m", "permissive", "--mode", "ont", "--min-support", "4", "-w", "9"])
    c = read_settings(a)
    assert (c.sketch.k, c.sketch.w, c.min_support, c.min_arm) == (11, 9, 4, 1200)
    assert assembly_settings(parser().parse_args(["scan", "x"])) == AssemblyConfig()


def test_correct_and_scan(spark, tmp_path):
    a = dna(3000, 1)
    (tmp_path / "r.fa").write_text(f">one x\n{a + rc(a)}\n>two\n{dna(4000, 2)}\n")
    out, rep = str(tmp_path / "o"), str(tmp_path / "t")
    assert main(["correct", str(tmp_path / "r.fa"), "-o", out, "-r", rep], spark) == 0
    got = {r["read_id"]: r["len"] for r in readers.read_fasta(spark, out).collect()}
    assert got == {"one x_chopped_at_3000": 3000, "two": 4000}
    assert readers.read_tsv(spark, rep, "decision string").collect()[0][0] == "artefact"
    (tmp_path / "c.fa").write_text(f">c1 desc\n{dna(6000, 3) + a + rc(a) + dna(6000, 4)}\n")
    page = tmp_path / "page"
    assert main(["scan", str(tmp_path / "c.fa"), "-b", str(tmp_path / "b"), "-f", str(tmp_path / "f"), "--html", str(page)], spark) == 0
    assert readers.read_tsv(spark, str(tmp_path / "b"), "contig string, break_pos long").first()["contig"] == "c1" and "rows/part-" in (page / "index.html").read_text()
    assert "c1" in "".join(f.read_text() for f in (page / "rows").glob("part-*"))


def test_generated_truth_is_recovered(spark):
    contigs, truth = G.contigs(spark, 1)
    contigs = contigs.persist()
    calls = I.call_irs(contigs, AssemblyConfig()).selectExpr("row_number() over (order by contig, start) call_id", "*")
    t = truth.where("planted").selectExpr("contig truth_id", "contig", "scenario_group", "la0 t0", "ra1 t1", "1.0D true_identity")
    got = {r["scenario_group"]: r["detected"] for r in E.match_truth(t, calls).collect()}
    assert all(got[g] for g in ("clean_high_identity", "class_spacing", "gc_bias", "asymmetric", "reused_family")) and not got["micro_ir"]
    assert calls.where("contig LIKE 'negative%'").count() == 0
    assert E.false_positives(calls, E.match_truth(t, calls)).count() == 0


def test_one_file_each(spark, tmp_path):
    a = dna(3000, 1)
    (tmp_path / "r.fa").write_text(f">one x\n{a + rc(a)}\n>two\n{dna(4000, 2)}\n")
    assert main(["correct", str(tmp_path / "r.fa"), "-o", str(tmp_path / "o.fa"), "-r", str(tmp_path / "r.tsv"), "--one-file"], spark) == 0
    assert {r["read_id"]: r["len"] for r in readers.read_fasta(spark, str(tmp_path / "o.fa")).collect()} == {"one x_chopped_at_3000": 3000, "two": 4000}
    lines = (tmp_path / "r.tsv").read_text().split("\n")
    assert lines[0] == "\t".join(sinks.REPORT) and lines[1].startswith("one x\t6000\tfoldback") and lines[2:] == [""]
    (tmp_path / "c.fa").write_text(f">c1 desc\n{dna(6000, 3) + a + rc(a) + dna(6000, 4)}\n")
    assert main(["scan", str(tmp_path / "c.fa"), "-b", str(tmp_path / "b.tsv"), "-f", str(tmp_path / "f.fa"), "--one-file"], spark) == 0
    assert (tmp_path / "b.tsv").read_text().startswith("#contig\tstart") and readers.read_tsv(spark, str(tmp_path / "b.tsv"), "contig string, break_pos long").first()["contig"] == "c1"
    assert (tmp_path / "f.fa").read_text().startswith(">c1:") and sorted(p.name for p in tmp_path.iterdir()) == ["b.tsv", "c.fa", "f.fa", "o.fa", "r.fa", "r.tsv"]


def test_single_file_in_order_from_many_tasks(spark, tmp_path):
    rows = spark.range(0, 5000, 1, 7).selectExpr("concat('line ', id, ' ', repeat('é', id % 5)) value", "(id * 7919) % 5000 AS k").unionByName(spark.createDataFrame([(None, 9000)], "value string, k long"))
    sinks.write_single_file(rows, str(tmp_path / "x.txt"), ("k",), "head")
    want = [r["value"] or "" for r in sorted(rows.collect(), key=lambda r: r["k"])]
    assert (tmp_path / "x.txt").read_text() == "\n".join(["head", *want, ""])
    with pytest.raises(FileExistsError):
        sinks.write_single_file(rows, str(tmp_path / "x.txt"))
    with pytest.raises(ValueError, match="middle of a file"):
        sinks.write_single_file(rows, "s3://bucket/x.txt")
    sinks.write_single_file(rows.where("false"), f"file://{tmp_path}/none.txt", (), "head")
    assert (tmp_path / "none.txt").read_text() == "head\n" and sorted(p.name for p in tmp_path.iterdir()) == ["none.txt", "x.txt"]
