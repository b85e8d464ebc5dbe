"""Command line: `python -m revstrand correct READS ...` (read mode) and `python -m revstrand scan CONTIGS ...` (assembly mode)."""

from __future__ import annotations

import argparse
import os
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="revstrand", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    r = sub.add_parser("correct", help="detect foldbacks in reads, decide and cut")
    r.add_argument("input")
    r.add_argument("-o", "--output", default="corrected", help="folder of the corrected FASTA")
    r.add_argument("-r", "--report", help="folder of the report TSV")
    r.add_argument("-k", type=int)
    r.add_argument("-w", type=int)
    for name, kind in (
        ("min-span", int), ("min-identity", float), ("min-support", int), ("max-depth", int), ("end-guard", int), ("refine-window", int), ("refine-arm", int),
        ("max-jump-clip", int), ("max-ed-rate", float), ("min-matches", int), ("fold-diag-tol", int), ("sig-flank-bp", int), ("sig-take", int),
    ):
        r.add_argument(f"--{name}", type=kind)
    r.add_argument("--forward-only", action=argparse.BooleanOptionalAction, default=None)
    r.add_argument("-m", "--preset", choices=("strict", "balanced", "permissive"), default="balanced")
    r.add_argument("--mode", choices=("hifi", "ont"), default="hifi")
    r.add_argument("--cut-low-ident", action="store_true")
    r.add_argument("--fairness-baseline", action="store_true", help=argparse.SUPPRESS)
    s = sub.add_parser("scan", help="find inverted repeats in contigs")
    s.add_argument("input")
    s.add_argument("-b", "--tsv", help="folder of the BED-like TSV")
    s.add_argument("-f", "--fasta", help="folder of the repeats' FASTA")
    s.add_argument("--fasta-wrap", type=int, default=60)
    s.add_argument("--html", help="file of the HTML report")
    for name, kind, default in (
        ("max-interval-bp", int, 250_000), ("window-len", int, 250_000), ("step", int, 50_000), ("hits-per-window", int, 4), ("dedup-bp", int, 200), ("diag-widen", int, 4),
        ("trim-lo", float, 0.10), ("trim-hi", float, 0.90), ("immediate-bp", int, 2000), ("wide-bp", int, 100_000),
    ):
        s.add_argument(f"--{name}", type=kind, default=default)
    s.add_argument("--no-classify-ir", dest="classify", action="store_false")
    s.add_argument("--cap-policy", choices=("penalize", "clamp", "drop"), default="penalize")
    for x in (r, s):
        x.add_argument("--one-file", action="store_true", help="write each table or FASTA as one file, on a folder that all executors share")
        x.add_argument("-t", "--partitions", type=int, help="partitions that records are dealt to after the scan")
    return p


def read_settings(a: argparse.Namespace):
    from .config import read_config

    flags = {
        "k": a.k, "w": a.w, "forward_only": a.forward_only, "min_arm": a.min_span, "min_identity": a.min_identity, "min_support": a.min_support, "max_depth": a.max_depth,
        "end_guard": a.end_guard, "window": a.refine_window, "arm": a.refine_arm, "max_jump_clip": a.max_jump_clip, "max_ed_rate": a.max_ed_rate, "min_matches": a.min_matches,
        "diag_tol": a.fold_diag_tol, "flank": a.sig_flank_bp, "take": a.sig_take, "cut_low_ident": a.cut_low_ident,
    }
    return read_config(a.preset, a.mode, a.fairness_baseline or os.environ.get("REVSTRAND_FAIRNESS") == "1", **flags)


def assembly_settings(a: argparse.Namespace):
    from .config import AssemblyConfig

    return AssemblyConfig(
        max_interval=a.max_interval_bp, window_len=a.window_len, step=a.step, hits_per_window=a.hits_per_window, dedup=a.dedup_bp, diag_widen=a.diag_widen, trim_lo=a.trim_lo,
        trim_hi=a.trim_hi, immediate=a.immediate_bp, wide=a.wide_bp, cap_policy=a.cap_policy,
    )


def main(argv: list[str] | None = None, spark=None) -> int:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .operators import irmode, readmode
    from .sources import readers, sinks
    from .sources.contigs import read_pieces
    from .storage import written

    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("revstrand").getOrCreate()
    if a.command == "correct":
        rows = readers.read_sequences(spark, a.input, a.partitions)
        fixed, report = readmode.correct(rows, read_settings(a))
        if a.one_file:
            sinks.write_single_file(sinks.corrected_fasta(fixed), a.output)
            if a.report:
                sinks.write_single_file(sinks.tsv_lines(sinks.report_tsv(report), "read_id"), a.report, ("read_id",), "\t".join(sinks.REPORT))
            return 0
        sinks.write_corrected_fasta(fixed, a.output)
        if a.report:
            sinks.write_report_tsv(report, a.report)
        return 0
    from .functions.seq import first_token

    if readers.is_fastq(spark, a.input):
        contigs = readers.read_fastq(spark, a.input, a.partitions).select(first_token("read_id").alias("contig"), "seq")
    else:  # a contig is never one row; its pieces are written once and read for windows, hits and arms
        contigs = written(read_pieces(spark, a.input).withColumn("contig", first_token("contig")), "pieces")
    calls = written(irmode.call_irs(contigs, assembly_settings(a)), "calls")
    if a.tsv and a.one_file:
        t = sinks.ir_tsv(calls, a.classify)
        lines = sinks.tsv_lines(t, "contig", "start")
        sinks.write_single_file(lines.withColumn("_at", F.col("start").cast("long")), a.tsv, ("contig", "_at", "value"), "#" + "\t".join(t.columns))
    elif a.tsv:
        sinks.write_ir_tsv(calls, a.tsv, a.classify)
    if a.fasta and a.one_file:
        sinks.write_single_file(sinks.ir_fasta(calls, contigs, a.fasta_wrap), a.fasta, ("value",))
    elif a.fasta:
        sinks.write_ir_fasta(calls, contigs, a.fasta, a.fasta_wrap)
    if a.html:
        sinks.write_html_report(calls, a.html, os.path.splitext(os.path.basename(a.html.rstrip("/")))[0])
    return 0


if __name__ == "__main__":
    sys.exit(main())
