"""Queries over support, decisions, cuts and reports."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..config import ReadConfig
from ..functions import synth as Y
from ..operators import readmode as R
from ..storage import written
from . import coarse as C
from .scalar import _with

CFG = ReadConfig(min_support=3, min_identity=0.6)


def _rows(s, d):
    """Refined calls as read mode's across-read operators take them."""
    t = Y.table(s, d, "calls")
    return t.withColumn("hifi_identity", F.col("identity_est")).withColumn("sig", F.when(F.col("identity_est") >= CFG.min_identity, F.col("sig")))


def _map(s, d):
    x = R.support(_rows(s, d))
    return x.select("sig", "n", "min_split", "max_split", F.round("mean_ident", 6).alias("mean_ident"))


def _hist(s, d):
    return R.support_histogram(R.support(_rows(s, d)))


def _summary(s, d):
    return R.support_summary(R.support(_rows(s, d)), CFG)


def _rank(s, d):
    return R.support_rank(R.support(_rows(s, d))).select("sig", "n", F.round("rank_frac", 6).alias("rank_frac"))


def _decided(s, d, cfg=CFG):
    c = _rows(s, d)
    return R.decide(c, R.support(c), cfg)


def _decision(s, d):
    return _decided(s, d).select("read_id", "decision", F.coalesce("n", F.lit(0)).alias("support_n"), F.round(F.coalesce("rank_frac", F.lit(0.0)), 6).alias("rank_frac"))


def _first_cut(s, d):
    return R.first_cut(_decided(s, d)).select("read_id", "decision", "keep_end")


def _cut_low(s, d):
    return R.first_cut(_decided(s, d, replace(CFG, cut_low_ident=True))).select("read_id", "decision", "keep_end")


def _counters(s, d):
    x = _decided(s, d)
    return R.run_counters(Y.table(s, d, "samples"), x, R.first_cut(x))


def _whole(s, d):
    reads = Y.reads(s, d)
    called = written(R.calls(reads, C.CFG), "calls")
    sup = R.support(called)
    return reads, sup, R.decide(called, sup, C.CFG)


def _report(s, d):
    r = R.report(_whole(s, d)[2])
    return r.select("read_id", "len", "event", "called", "coarse_split", "refined_split", "matches", "span_p1", "coarse_score", "refined_score", "identity_est", "gap_est", "support_n", "support_rank_frac", "support_span", "decision")


def _corrected(s, d):
    reads, sup, _ = _whole(s, d)
    one = replace(C.CFG, max_depth=1)
    return R.corrected(reads, sup, one).select("read_id", "keep_end", F.md5(F.col("seq_out").cast("binary")).alias("seq_md5"))


def _recursive(s, d):
    reads, sup, _ = _whole(s, d)
    return R.corrected(reads, sup, C.CFG).select("read_id", "keep_end")


#: Configurations of the sweep: others across reads, and another identity that decides on signatures too.
SWEEP = {"base": C.CFG, "support5": replace(C.CFG, min_support=5), "support1": replace(C.CFG, min_support=1), "ident95": replace(C.CFG, min_identity=0.95)}


def _sweep(s, d):
    return R.sweep(Y.reads(s, d), SWEEP)


QUERIES = {
    "support_map": _map, "support_hist": _hist, "support_summary": _summary, "support_rank": _rank, "decision": _decision, "first_cut": _first_cut, "cut_low_ident": _cut_low,
    "run_counters": _counters, "read_report": _report, "corrected_reads": _corrected, "recursive_cut": _recursive, "sweep_reads": _sweep,
}

SUP = [
    Y.table_sql("calls"), "cl AS (SELECT * REPLACE (CASE WHEN identity_est >= 0.6 THEN sig END AS sig) FROM calls_t)",
    "sup AS (SELECT sig, count(*) AS n, min(refined_split) AS min_split, max(refined_split) AS max_split, avg(identity_est) AS mean_ident FROM cl WHERE sig IS NOT NULL GROUP BY 1)",
    "rk AS (SELECT *, CASE WHEN count(*) OVER () <= 1 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - (row_number() OVER (ORDER BY n DESC, sig) - 1)::DOUBLE / (count(*) OVER () - 1) END AS rank_frac FROM sup)",
    "dec AS (SELECT c.*, n, rank_frac, CASE WHEN identity_est < 0.6 THEN 'low_ident' WHEN c.sig IS NULL THEN 'unknown' WHEN n >= 3 THEN 'real' ELSE 'artefact' END AS decision FROM cl c LEFT JOIN rk USING (sig))",
]
FULL = [
    *C.POINTS, *C.BINS, *C.CHAIN, *C.REFINE, *C.SIG,
    "sup AS (SELECT sig, count(*) AS n, min(refined_split) AS min_split, max(refined_split) AS max_split FROM sigs JOIN refined USING (read_id) GROUP BY 1)",
    "rk AS (SELECT *, CASE WHEN count(*) OVER () <= 1 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - (row_number() OVER (ORDER BY n DESC, sig) - 1)::DOUBLE / (count(*) OVER () - 1) END AS rank_frac FROM sup)",
    """dec AS (SELECT r.*, c.split AS coarse_split, c.m, c.span, k.n AS support_n, rank_frac, max_split - min_split AS support_span,
      CASE WHEN identity_est < 0.6 THEN 'low_ident' WHEN s.sig IS NULL THEN 'unknown' WHEN k.n >= 3 THEN 'real' ELSE 'artefact' END AS decision
      FROM refined r JOIN coarse c USING (read_id) LEFT JOIN sigs s USING (read_id) LEFT JOIN rk k ON k.sig = s.sig)""",
]
ORACLE = {
    "support_map": _with(*SUP, body=" SELECT sig, n, min_split, max_split, round(mean_ident, 6) AS mean_ident FROM sup"),
    "support_hist": _with(*SUP, body=", h AS (SELECT n // 10 * 10 AS lo, count(*) AS clusters FROM sup GROUP BY 1) SELECT lo, lo + 9 AS hi, clusters, floor(clusters * 30::DOUBLE / max(clusters) OVER ())::BIGINT AS bar FROM h"),
    "support_summary": _with(*SUP, body=" SELECT count(*) AS clusters, coalesce(sum(n), 0)::BIGINT AS total_n, round(avg(n), 6) AS avg_n, max(n) AS max_n, count(*) FILTER (n >= 3) AS passing, count(*) FILTER (n >= 3 AND mean_ident >= 0.6) AS passing_ident FROM sup"),
    "support_rank": _with(*SUP, body=" SELECT sig, n, round(rank_frac, 6) AS rank_frac FROM rk"),
    "decision": _with(*SUP, body=" SELECT read_id, decision, coalesce(n, 0)::BIGINT AS support_n, round(coalesce(rank_frac, 0), 6) AS rank_frac FROM dec"),
    "first_cut": _with(*SUP, body=" SELECT read_id, decision, CASE WHEN decision = 'artefact' THEN least(refined_split + gap_est // 2, len) ELSE len END AS keep_end FROM dec"),
    "cut_low_ident": _with(*SUP, body=" SELECT read_id, CASE decision WHEN 'low_ident' THEN 'artefact' ELSE decision END AS decision, CASE decision WHEN 'low_ident' THEN refined_split WHEN 'artefact' THEN least(refined_split + gap_est // 2, len) ELSE len END AS keep_end FROM dec"),
    "run_counters": _with(*SUP, body=""" SELECT (SELECT count(*) FROM documents) AS jobs, count(*) AS detected, count(refined_split) AS refined, count(*) FILTER (identity_est >= 0) AS with_identity, count(sig) AS sig_ok,
      count(*) FILTER (decision = 'real') AS num_real, count(*) FILTER (decision = 'artefact' AND refined_split + gap_est // 2 < len) AS num_cut FROM dec"""),
    "read_report": _with(*FULL, body=""" SELECT read_id, n AS len, 'foldback' AS event, 1 AS called, coarse_split, refined_split::BIGINT AS refined_split, m AS matches, span AS span_p1, span + 10 * m AS coarse_score, refined_score::BIGINT AS refined_score,
      round(identity_est, 3) AS identity_est, gap_est::BIGINT AS gap_est, coalesce(support_n, 0)::BIGINT AS support_n, round(coalesce(rank_frac, 0), 6) AS support_rank_frac, coalesce(support_span, 0)::BIGINT AS support_span, decision FROM dec"""),
    "corrected_reads": _with(*FULL, body=""", cut AS (SELECT reads.read_id, seq, decision, refined_split, CASE WHEN decision = 'artefact' THEN least(refined_split + gap_est // 2, length(seq)) ELSE length(seq) END AS keep_end FROM reads LEFT JOIN dec USING (read_id))
      SELECT CASE WHEN decision = 'artefact' THEN read_id || '_chopped_at_' || refined_split ELSE read_id END AS read_id, keep_end::BIGINT AS keep_end, md5(substr(seq, 1, keep_end::INT)) AS seq_md5 FROM cut"""),
    "sweep_reads": _with(*C.POINTS, *C.BINS, *C.CHAIN, *C.REFINE, C.SIG[0].replace("AND r.identity_est >= 0.6", ""), C.SIG[1], body=""",
      cf AS (SELECT * FROM (VALUES ('base', 3, 0.6::DOUBLE), ('support5', 5, 0.6::DOUBLE), ('support1', 1, 0.6::DOUBLE), ('ident95', 3, 0.95::DOUBLE)) t(tag, ms, mi)),
      x AS (SELECT tag, ms, mi, r.identity_est, CASE WHEN r.identity_est >= mi THEN s.sig END AS sig FROM cf, refined r LEFT JOIN sigs s USING (read_id)),
      y AS (SELECT *, count(*) OVER (PARTITION BY tag, sig) AS n FROM x),
      z AS (SELECT tag, CASE WHEN identity_est < mi THEN 'low_ident' WHEN sig IS NULL THEN 'unknown' WHEN n >= ms THEN 'real' ELSE 'artefact' END AS decision FROM y)
      SELECT tag, (SELECT count(*) FROM coarse) AS detected, count(*) FILTER (decision = 'artefact') AS artefact, count(*) FILTER (decision = 'low_ident') AS low_ident,
        count(*) FILTER (decision = 'real') AS "real", count(*) FILTER (decision = 'unknown') AS "unknown" FROM z GROUP BY tag"""),
}
