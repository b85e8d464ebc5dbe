"""Queries over evaluation, the alignment baseline and exploration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import synth as Y
from ..operators import baseline as B
from ..operators import evaluate as E
from ..sources import readers
from .scalar import _with

T = Y.table


def _matched(s, d):
    return E.match_truth(T(s, d, "truth"), T(s, d, "ir_calls"))


def _truth_match(s, d):
    return _matched(s, d).select("truth_id", "detected", "call_id", "ov", F.round("recip_truth", 6).alias("recip_truth"), F.round("recip_call", 6).alias("recip_call"))


def _summary(s, d):
    m = E.truth_summary(_matched(s, d))
    return m.select("scenario_group", "n", "found", *[F.round(c, 6).alias(c) for c in ("recovery", "median_len_error", "median_ident_error")])


def _fp(s, d):
    return E.false_positives(T(s, d, "ir_calls"), _matched(s, d)).select("call_id", "contig")


def _confusion(s, d):
    n = 2 * T(s, d, "samples").count()
    a, b = T(s, d, "ours"), T(s, d, "base")
    return E.confusion(a, b, n).withColumn("rule", F.lit("strict")).unionByName(E.confusion(a, b, n, ("artefact", "low_ident")).withColumn("rule", F.lit("generous")))


def _deltas(s, d):
    return E.breakpoint_deltas(T(s, d, "ours"), T(s, d, "base"))


def _vs(s, d):
    r = T(s, d, "report").withColumnRenamed("read_id", "label")
    return E.report_vs_truth(T(s, d, "expect"), r)


def _cross(s, d):
    return T(s, d, "clips").join(T(s, d, "report"), "read_id").groupBy("artifact_class", "decision").agg(F.count("*").alias("n"), F.sum("clip_len").alias("clip_bases"))


def _primary(s, d):
    return E.primary_class(T(s, d, "clips"))


def _crosstab(s, d):
    return E.class_crosstab(T(s, d, "clips"), T(s, d, "report"))


def _sanity(s, d):
    return E.sanity_checks(_crosstab(s, d))


def _outermost(s, d):
    r = T(s, d, "report").withColumn("label", F.concat(F.lit("g"), (F.col("len") % 50).cast("string")))
    return E.outermost(r).select("label", "refined_split", "len", "decision")


def _min_distance(s, d):
    return E.min_distance(T(s, d, "events"))


def _pearson(s, d):
    return E.gap_correlation(E.min_distance(T(s, d, "events")).join(T(s, d, "report"), "read_id").select(F.col("min_distance").cast("double").alias("x"), (F.col("gap_est") + F.col("len") / 10).alias("y")))


def _counts(s, d):
    return E.decision_counts(T(s, d, "report"), "sample")


def _sample(s, d):
    return E.sample_summary(T(s, d, "samples"), T(s, d, "report"))


def _n50(s, d):
    return E.n50(T(s, d, "samples"), ["sample"])


def _nearest(s, d):
    return E.nearest_rank(T(s, d, "report"), ["sample"], "identity_est", 0.9)


def _inverted(s, d):
    return E.inverted_hits(T(s, d, "hits"), T(s, d, "samples"))


def _classify(s, d):
    return B.classify(T(s, d, "paf")).drop("tlen", "tstart", "tend")


def _chop(s, d):
    return B.chop(T(s, d, "paf_reads"), B.classify(T(s, d, "paf")))


def _two(s, d):
    return B.two_iterations(T(s, d, "paf_reads"), T(s, d, "paf"), T(s, d, "paf2"))


def _union(s, d):
    c = _chop(s, d)
    both = c.where("kind = 'chopped'").select("id").unionByName(c.where("kind = 'include'").select("id")).unionByName(T(s, d, "paf_reads").select(F.col("read_id").alias("id")))
    return both.groupBy("id").agg(F.count("*").alias("n"))


def _difference(s, d):
    return T(s, d, "ours").select("id").subtract(T(s, d, "base").select("id"))


def _intersect(s, d):
    return T(s, d, "ours").select("id").intersect(T(s, d, "base").select("id"))


def _relation(s, d):
    return E.set_relation(T(s, d, "ours"), T(s, d, "base"))


def _with_class(s, d):
    from ..functions import seq as S

    return T(s, d, "ir_calls").withColumn("ir_class", S.ir_class("spacer"))


def _dashboard(s, d):
    return E.dashboard_filter(_with_class(s, d)).select("call_id", "ir_class")


def _rollup(s, d):
    return E.contig_rollup(T(s, d, "ir_calls"))


def _histogram(s, d):
    x = _with_class(s, d)
    a = E.histogram(x, "tir_ident", "ir_class", 0.0, 1.0).withColumn("what", F.lit("tir_ident"))
    return a.unionByName(E.histogram(x, "interval_len", "ir_class", 0.0, 250000.0).withColumn("what", F.lit("interval_len")))


def _ident_bins(s, d):
    return T(s, d, "report").groupBy(E.identity_bin(F.col("identity_est")).alias("ident_bin")).agg(F.count("*").alias("n"))


def _stratified(s, d):
    return E.stratified(T(s, d, "report"), 5).select("read_id", "ident_bin")


def _semi(s, d):
    want = T(s, d, "report").where("decision = 'real'").select(F.col("read_id").alias("id"))
    return readers.extract(Y.reads(s, d), want).select("read_id", F.length("seq").cast("long").alias("len"))


def _first_n(s, d):
    return readers.first_n(Y.reads(s, d), 100, "doc_id").select("read_id")


def _sweep(s, d):
    return E.sweep(T(s, d, "sweeps"), 10)


QUERIES = {
    "truth_match": _truth_match, "truth_summary": _summary, "false_positives": _fp, "confusion": _confusion, "bp_deltas": _deltas, "report_vs_truth": _vs, "cross_tool": _cross, "primary_class": _primary,
    "class_crosstab": _crosstab, "sanity_checks": _sanity, "outermost_row": _outermost, "min_distance": _min_distance, "gap_pearson": _pearson, "decision_counts": _counts, "sample_summary": _sample, "n50": _n50,
    "nearest_rank": _nearest, "inverted_hits": _inverted, "paf_classify": _classify, "paf_chop": _chop, "two_iterations": _two, "treated_union": _union, "set_difference": _difference, "set_intersect": _intersect,
    "set_relation": _relation, "dashboard_filter": _dashboard, "contig_rollup": _rollup, "histogram30": _histogram, "ident_bins": _ident_bins, "stratified_sample": _stratified, "semi_extract": _semi, "first_n": _first_n, "sweep": _sweep,
}

MATCH = [
    Y.table_sql("truth"), Y.table_sql("ir_calls"),
    'pr AS (SELECT t.*, c.call_id, c."start", c."end", c.tir_ident, greatest(least(t1, c."end") - greatest(t0, c."start"), 0) AS ov FROM truth_t t JOIN ir_calls_t c USING (contig))',
    'pq AS (SELECT *, ov::DOUBLE / greatest(t1 - t0, 1) AS recip_truth, ov::DOUBLE / greatest("end" - "start", 1) AS recip_call FROM pr WHERE ov > 0)',
    'pb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY truth_id ORDER BY ov DESC, recip_truth DESC, coalesce(tir_ident, -1) DESC, "end" - "start", call_id) AS rn FROM pq WHERE ov >= 100 OR (recip_truth >= 0.25 AND recip_call >= 0.25)) WHERE rn = 1)',
    'mt AS (SELECT t.*, b.call_id, b.ov, b.recip_truth, b.recip_call, b.tir_ident, b."start" AS cs, b."end" AS ce, b.call_id IS NOT NULL AS detected FROM truth_t t LEFT JOIN pb b USING (truth_id))',
]
REPORT, SAMPLES = Y.table_sql("report"), Y.table_sql("samples")
PRIMARY = [Y.table_sql("clips"), "pc AS (SELECT read_id, artifact_class FROM (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY clip_len DESC, clip_no) AS rn FROM clips_t) WHERE rn = 1)"]
_D = ("artefact", "low_ident", "real", "unknown")
XTAB = [REPORT, *PRIMARY, "xt AS (SELECT artifact_class, count(*) AS n, " + ", ".join(f"count(*) FILTER (decision = '{x}') AS n_{x}" for x in _D) + ", round(avg(gap_est), 6) AS mean_gap, round(quantile_cont(identity_est, 0.5), 6) AS median_identity FROM pc JOIN report_t USING (read_id) GROUP BY 1)"]
CONF = [Y.table_sql("ours"), Y.table_sql("base")]


def _conf(rule: str, accept: str) -> str:
    return f"""SELECT '{rule}' AS rule, tp, fp, fn, tn, round(tp::DOUBLE / nullif(tp + fp, 0), 6) AS prec, round(tp::DOUBLE / nullif(tp + fn, 0), 6) AS rec, round(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1,
      round(tp::DOUBLE / nullif(tp + fp + fn, 0), 6) AS jaccard, round(tn::DOUBLE / nullif(tn + fp, 0), 6) AS specificity FROM (SELECT *, 2 * (SELECT count(*) FROM documents) - tp - fp - fn AS tn FROM (
      SELECT count(*) FILTER (a.id IS NOT NULL AND b.id IS NOT NULL) AS tp, count(*) FILTER (b.id IS NULL) AS fp, count(*) FILTER (a.id IS NULL) AS fn
      FROM (SELECT DISTINCT id FROM ours_t WHERE decision IN ({accept})) a FULL JOIN (SELECT DISTINCT id FROM base_t) b ON a.id = b.id))"""


CLASS = "CASE WHEN spacer <= 0 THEN 'overlap' WHEN spacer <= 2000 THEN 'immediate' WHEN spacer >= 100000 THEN 'wide' ELSE 'spaced' END"
NEAREST = lambda q, name: f"{name} AS (SELECT sample, v[(floor({q}::DOUBLE * (len(v) - 1)) + 1)::INT] AS {name} FROM (SELECT sample, list_sort(list(identity_est)) AS v FROM report_t GROUP BY 1))"
BIN = "CASE WHEN identity_est < 0.5 THEN '<0.5' WHEN identity_est < 0.7 THEN '0.5-0.7' WHEN identity_est < 0.9 THEN '0.7-0.9' WHEN identity_est < 0.95 THEN '0.9-0.95' ELSE '>=0.95' END"


def _paf(name: str, src: str) -> list[str]:
    return [
        f"{name}_h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qname ORDER BY line_no) AS rn FROM {src} WHERE qname = tname AND strand = '-') WHERE rn = 1)",
        f"""{name}_e AS (SELECT *, CASE WHEN tstart <= 0.1::DOUBLE * tlen AND tend >= 0.9::DOUBLE * tlen THEN 3 WHEN tstart <= 0.1::DOUBLE * tlen THEN 1 WHEN tend >= 0.9::DOUBLE * tlen THEN 2 ELSE 0 END AS isend, (tstart + tend) // 2 AS mid FROM {name}_h)""",
        f"""{name} AS (SELECT qname, isend, round(tstart::DOUBLE / tlen, 6) AS start_pos, round(tend::DOUBLE / tlen, 6) AS end_pos, CASE WHEN isend = 1 THEN 0 ELSE mid END AS cut_from, CASE WHEN isend = 1 THEN mid ELSE tlen END AS cut_to, round((tend - tstart)::DOUBLE / tlen, 6) AS overlap_prop FROM {name}_e)""",
    ]


def _chopped(name: str, reads: str, cls: str) -> list[str]:
    return [
        f"{name}_j AS (SELECT r.read_id AS parent, r.len, isend, coalesce(isend <> 0 OR start_pos > 0.3, FALSE) AS hit, CASE WHEN isend = 1 THEN cut_to ELSE cut_from END AS mid, CASE WHEN isend = 0 THEN '-dup023' ELSE '-dup1' END AS tag FROM {reads} r LEFT JOIN {cls} c ON c.qname = r.read_id)",
        f"""{name} AS (SELECT * FROM (SELECT parent, parent || tag || '.1' AS id, 0::BIGINT AS "start", mid AS "end", 'chopped' AS kind FROM {name}_j WHERE hit UNION ALL SELECT parent, parent || tag || '.2', mid, len, 'chopped' FROM {name}_j WHERE hit) WHERE "end" - "start" >= 500
          UNION ALL SELECT parent, parent, 0, len, 'include' FROM {name}_j WHERE NOT hit)""",
    ]


PAF = [Y.table_sql("paf"), Y.table_sql("paf_reads"), *_paf("pa", "paf_t")]
CHOP = [*PAF, *_chopped("ch", "paf_reads_t", "pa")]
TWO = [*CHOP, Y.table_sql("paf2"), *_paf("pb", "paf2_t"), "again AS (SELECT id AS read_id, \"end\" - \"start\" AS len FROM ch WHERE kind = 'chopped')", *_chopped("ch2", "again", "pb")]
ORACLE = {
    "truth_match": _with(*MATCH, body=" SELECT truth_id, detected, call_id, ov, round(recip_truth, 6) AS recip_truth, round(recip_call, 6) AS recip_call FROM mt"),
    "truth_summary": _with(*MATCH, body=""" SELECT scenario_group, count(*) AS n, count(*) FILTER (detected) AS found, round(count(*) FILTER (detected)::DOUBLE / count(*), 6) AS recovery,
      round(quantile_cont((ce - cs - (t1 - t0))::DOUBLE, 0.5) FILTER (detected), 6) AS median_len_error, round(quantile_cont(tir_ident - true_identity, 0.5) FILTER (detected), 6) AS median_ident_error FROM mt GROUP BY 1"""),
    "false_positives": _with(*MATCH, body=" SELECT call_id, contig FROM ir_calls_t WHERE call_id NOT IN (SELECT call_id FROM mt WHERE call_id IS NOT NULL)"),
    "confusion": _with(*CONF, body=" " + _conf("strict", "'artefact'") + " UNION ALL " + _conf("generous", "'artefact', 'low_ident'")),
    "bp_deltas": _with(*CONF, body=""", d AS (SELECT abs(refined_split - bp) AS d FROM ours_t JOIN base_t USING (id) WHERE bp IS NOT NULL)
      SELECT CASE WHEN d = 0 THEN '0' WHEN d <= 50 THEN '1-50' WHEN d <= 100 THEN '51-100' WHEN d <= 250 THEN '101-250' WHEN d <= 500 THEN '251-500' WHEN d <= 1000 THEN '501-1000' ELSE '>1000' END AS bucket,
      count(*) AS n, min(d) AS min_d, quantile_cont(d::DOUBLE, 0.5) AS median_d, round(avg(d), 6) AS mean_d, max(d) AS max_d FROM d GROUP BY 1"""),
    "report_vs_truth": _with(Y.table_sql("expect"), REPORT, body=""", j AS (SELECT label, split, want, refined_split, decision IS NOT NULL AS detected, coalesce(decision, '-') AS decision, abs(refined_split - split) AS delta FROM expect_t LEFT JOIN report_t ON read_id = label),
      k AS (SELECT *, split = 0 OR decision = 'low_ident' OR coalesce(delta <= 100, FALSE) AS split_ok FROM j)
      SELECT label, detected, decision, coalesce(delta, -1) AS abs_delta, split_ok, CASE WHEN detected AND decision = want AND split_ok THEN 'PASS' ELSE 'FAIL' END AS pass_fail FROM k"""),
    "cross_tool": _with(Y.table_sql("clips"), REPORT, body=" SELECT artifact_class, decision, count(*) AS n, sum(clip_len)::BIGINT AS clip_bases FROM clips_t JOIN report_t USING (read_id) GROUP BY 1, 2"),
    "primary_class": _with(*PRIMARY, body=" SELECT * FROM pc"),
    "class_crosstab": _with(*XTAB, body=" SELECT * FROM xt"),
    "sanity_checks": _with(*XTAB, body=" SELECT artifact_class, round(n_artefact::DOUBLE / n, 6) AS artefact_share, n_artefact::DOUBLE / n >= 0.5 AS ok FROM xt"),
    "outermost_row": _with(REPORT, body=", l AS (SELECT *, 'g' || (len % 50) AS label FROM report_t) SELECT label, refined_split, len, decision FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY refined_split DESC, read_id DESC) AS rn FROM l) WHERE rn = 1"),
    "min_distance": _with(Y.table_sql("events"), body=" SELECT read_id, min(distance::BIGINT) AS min_distance FROM events_t WHERE distance <> 'inter' GROUP BY 1"),
    "gap_pearson": _with(Y.table_sql("events"), REPORT, body=""", p AS (SELECT m::DOUBLE AS x, gap_est + len::DOUBLE / 10 AS y FROM (SELECT read_id, min(distance::BIGINT) AS m FROM events_t WHERE distance <> 'inter' GROUP BY 1) JOIN report_t USING (read_id))
      SELECT count(*) AS n, round(corr(x, y), 6) AS r, round(avg(CASE WHEN x <= 2 * y AND y <= 2 * x THEN 1.0::DOUBLE ELSE 0 END), 6) AS within_2x, round(stddev_samp(x - y), 6) AS sd_diff FROM p"""),
    "decision_counts": _with(REPORT, body=" SELECT sample, count(*) AS n, " + ", ".join(f"count(*) FILTER (decision = '{x}') AS {x}, round(count(*) FILTER (decision = '{x}')::DOUBLE / count(*), 6) AS {x}_frac" for x in _D) + " FROM report_t GROUP BY 1"),
    "sample_summary": _with(REPORT, SAMPLES, NEAREST("0.1", "identity_q10"), NEAREST("0.9", "identity_q90"), body=""", t AS (SELECT sample, count(*) AS total FROM samples_t GROUP BY 1),
      r AS (SELECT sample, count(*) AS detected, count(*) FILTER (decision = 'artefact') AS artefact, count(*) FILTER (decision = 'real') AS "real", count(*) FILTER (decision = 'low_ident') AS low_ident,
        coalesce(sum(len) FILTER (decision = 'artefact'), 0)::BIGINT AS bases_before, coalesce(sum(refined_split) FILTER (decision = 'artefact'), 0)::BIGINT AS bases_after,
        round(avg(identity_est), 6) AS identity_mean, round(quantile_cont(identity_est, 0.5), 6) AS identity_median FROM report_t GROUP BY 1)
      SELECT t.sample, total, detected, artefact, "real", low_ident, bases_before, bases_after, identity_mean, identity_median, identity_q10, identity_q90, bases_before - bases_after AS bases_removed,
        round(bases_after::DOUBLE / nullif(bases_before, 0), 6) AS frac_retained, round(detected::DOUBLE / total, 6) AS detected_frac FROM t LEFT JOIN r USING (sample) LEFT JOIN identity_q10 USING (sample) LEFT JOIN identity_q90 USING (sample)"""),
    "n50": _with(SAMPLES, body=", c AS (SELECT sample, len, sum(len) OVER (PARTITION BY sample ORDER BY len DESC) AS cum, sum(len) OVER (PARTITION BY sample) AS total FROM samples_t) SELECT sample, max(len) AS n50 FROM c WHERE 2 * cum >= total GROUP BY 1"),
    "nearest_rank": _with(REPORT, NEAREST("0.9", "q"), body=" SELECT sample, q AS identity_est FROM q"),
    "inverted_hits": _with(Y.table_sql("hits"), SAMPLES, body=""", b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY length DESC, hit_no) AS rn FROM hits_t WHERE length >= 200) WHERE rn = 1)
      SELECT s.read_id, CASE WHEN b.read_id IS NULL THEN s.len // 2 ELSE (qend + send - 1) // 2 END AS split_pos, coalesce(b.length, 0)::BIGINT AS arm_len, CASE WHEN b.read_id IS NULL THEN 0 ELSE greatest(send - 1 - qend, 0) END::BIGINT AS gap_est FROM samples_t s LEFT JOIN b USING (read_id)"""),
    "paf_classify": _with(*PAF, body=" SELECT qname, isend, start_pos, end_pos, cut_from, cut_to, overlap_prop FROM pa"),
    "paf_chop": _with(*CHOP, body=' SELECT parent, id, "start", "end", kind FROM ch'),
    "two_iterations": _with(*TWO, body=""" SELECT id, "end" - "start" AS len, 1 AS round FROM ch WHERE kind = 'include' UNION ALL SELECT id, "end" - "start", 2 FROM ch2"""),
    "treated_union": _with(*CHOP, body=", u AS (SELECT id FROM ch UNION ALL SELECT read_id FROM paf_reads_t) SELECT id, count(*) AS n FROM u GROUP BY 1"),
    "set_difference": _with(*CONF, body=" SELECT id FROM ours_t EXCEPT SELECT id FROM base_t"),
    "set_intersect": _with(*CONF, body=" SELECT id FROM ours_t INTERSECT SELECT id FROM base_t"),
    "set_relation": _with(*CONF, body=" SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'b_only' WHEN b.id IS NULL THEN 'a_only' ELSE 'both' END AS side FROM (SELECT DISTINCT id FROM ours_t) a FULL JOIN (SELECT DISTINCT id FROM base_t) b ON a.id = b.id"),
    "dashboard_filter": _with(Y.table_sql("ir_calls"), body=f" SELECT call_id, {CLASS} AS ir_class FROM ir_calls_t WHERE tir_ident >= 0.5 AND kept_pts >= 50 AND matches >= 50 AND arm_len >= 500 AND spacer >= 0"),
    "contig_rollup": _with(Y.table_sql("ir_calls"), body=" SELECT contig, count(*) AS n, max(contig_len) AS contig_len FROM ir_calls_t GROUP BY 1"),
    "histogram30": _with(Y.table_sql("ir_calls"), body=f""", c AS (SELECT *, {CLASS} AS ir_class FROM ir_calls_t)
      SELECT ir_class, least(floor(tir_ident / 1.0::DOUBLE * 30), 29)::BIGINT AS bin, count(*) AS n, 'tir_ident' AS what FROM c WHERE tir_ident BETWEEN 0 AND 1 GROUP BY 1, 2
      UNION ALL SELECT ir_class, least(floor(interval_len / 250000.0::DOUBLE * 30), 29)::BIGINT, count(*), 'interval_len' FROM c WHERE interval_len BETWEEN 0 AND 250000 GROUP BY 1, 2"""),
    "ident_bins": _with(REPORT, body=f" SELECT {BIN} AS ident_bin, count(*) AS n FROM report_t GROUP BY 1"),
    "stratified_sample": _with(REPORT, body=f" SELECT read_id, ident_bin FROM (SELECT read_id, {BIN} AS ident_bin, row_number() OVER (PARTITION BY {BIN} ORDER BY md5('7:' || read_id), read_id) AS rn FROM report_t) WHERE rn <= 5"),
    "semi_extract": _with(Y.READS_SQL, REPORT, body=" SELECT read_id, length(seq)::BIGINT AS len FROM reads WHERE read_id IN (SELECT read_id FROM report_t WHERE decision = 'real')"),
    "first_n": " SELECT 'r' || doc_id AS read_id FROM documents ORDER BY doc_id LIMIT 100",
    "sweep": _with(Y.table_sql("sweeps"), body=" SELECT tag, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM sweeps_t ORDER BY f1 DESC, tag LIMIT 10"),
}
