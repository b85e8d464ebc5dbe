"""Queries over coarse detection and refinement."""

from __future__ import annotations

from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import AssemblyConfig, ReadConfig, Refine
from ..functions import synth as Y
from ..operators import kernels as K
from ..operators import readmode as R
from .scalar import _with, minimizers_sql

#: Gates scaled to the synthetic reads (arms of 600); sketch, tolerance and chain rules are the defaults.
CFG = ReadConfig(end_guard=300, refine=Refine(window=100, arm=1200))
TOP = AssemblyConfig(min_matches=10, min_arm=200, end_guard=300, hits_per_window=3)


def _points(reads: DataFrame) -> DataFrame:
    """Matches of each read with its reverse complement: read_id, n, p1, p2, val (the self-join, in the kernel)."""

    def go(batches):
        for b in batches:
            cols = ([], [], [], [], [])
            for i, x in zip(b.column("read_id").to_pylist(), b.column("seq").to_pylist()):
                a = K.as_array(x)
                j = K.self_join(a, CFG)
                if j is not None:
                    m = len(j[0])
                    for c, v in zip(cols, ([i] * m, [len(a)] * m, *(y.tolist() for y in j))):
                        c += v
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["read_id", "n", "p1", "p2", "val"])

    return reads.select("read_id", "seq").mapInArrow(go, "read_id string, n long, p1 long, p2 long, val long")


def _self_join(s, d):
    return _points(Y.reads(s, d))


def bins(points: DataFrame, tol: int = 120) -> DataFrame:
    """Anti-diagonal bins: count, least and largest p1."""
    return points.groupBy("read_id", "n", F.floor((F.col("p1") + F.col("p2")) / tol).cast("long").alias("bin")).agg(F.count("*").alias("cnt"), F.min("p1").alias("min_p1"), F.max("p1").alias("max_p1"))


def _gated(points: DataFrame) -> DataFrame:
    return bins(points).withColumn("span", F.col("max_p1") - F.col("min_p1")).where((F.col("cnt") >= CFG.min_matches) & (F.col("span") >= CFG.min_arm))


def _antidiag(s, d):
    return bins(_points(Y.reads(s, d))).drop("n")


def best_bin(points: DataFrame) -> DataFrame:
    score = F.col("span") + 10 * F.col("cnt")
    return _gated(points).groupBy("read_id").agg(F.max_by(F.struct("bin", "cnt", "span"), F.struct(score, -F.col("bin"))).alias("b")).select("read_id", "b.*")


def _best(s, d):
    return best_bin(_points(Y.reads(s, d)))


def _topk(s, d):
    w = Window.partitionBy("read_id").orderBy(F.desc("cnt"), F.desc("span"), "bin")
    return _gated(_points(Y.reads(s, d))).withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("read_id", F.col("rank").cast("long").alias("rank"), "bin", "cnt", "span")


def chain(points: DataFrame) -> DataFrame:
    """Points of the best bin that form the monotone chain: strict prefix minima of p2 in p1 order."""
    on = points.withColumn("bin", F.floor((F.col("p1") + F.col("p2")) / 120).cast("long")).join(best_bin(points).select("read_id", "bin"), ["read_id", "bin"])
    before = Window.partitionBy("read_id").orderBy("p1", F.desc("p2")).rowsBetween(Window.unboundedPreceding, -1)
    return on.withColumn("_low", F.min("p2").over(before)).where(F.col("_low").isNull() | (F.col("p2") < F.col("_low"))).drop("_low")


def _chain(s, d):
    c = chain(_points(Y.reads(s, d))).groupBy("read_id").agg(F.count("*").alias("chain_len"), (F.max("p1") - F.min("p1")).alias("span"))
    return c.where((F.col("chain_len") >= CFG.min_matches) & (F.col("span") >= CFG.min_arm))


def _split(s, d):
    w = 1.0 / F.greatest(F.abs(F.col("p1") - F.col("p2")), F.lit(CFG.sketch.k))
    c = chain(_points(Y.reads(s, d))).groupBy("read_id", "n").agg(F.count("*").alias("m"), (F.max("p1") - F.min("p1")).alias("span"), (F.sum((F.col("p1") + F.col("p2")) * w) / F.sum(w)).alias("d"))
    c = c.where((F.col("m") >= CFG.min_matches) & (F.col("span") >= CFG.min_arm)).withColumn("split", F.floor(F.round("d", 6) / 2 + 0.5).cast("long"))
    return c.select("read_id", "split", ((F.col("split") >= CFG.end_guard) & (F.col("split") + CFG.end_guard <= F.col("n"))).alias("inside"))


def _calls(s, d):
    return R.calls(Y.reads(s, d), CFG)


def _arm_bounds(s, d):
    return _calls(s, d).select("read_id", "arm_end", "arm_start_right")


def _coarse(s, d):
    return _calls(s, d).select("read_id", "len", F.col("coarse_split").alias("split"), "matches", F.col("span_p1").alias("span"), F.col("coarse_score").alias("score"), "bin")


def _multi(s, d):
    def go(batches):
        for b in batches:
            rows = []
            for i, x in zip(b.column("read_id").to_pylist(), b.column("seq").to_pylist()):
                rows += [(i, f.bin, f.bin_count, f.split, f.matches, f.span) for f in K.detect_topk(K.as_array(x), TOP, TOP.hits_per_window)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(1, 6))], names=["read_id", "bin", "bin_count", "split", "matches", "span"])

    return Y.reads(s, d).select("read_id", "seq").mapInArrow(go, "read_id string, bin long, bin_count long, split long, matches long, span long")


def _refine(s, d):
    return _calls(s, d).where("refined_split IS NOT NULL").select("read_id", "refined_split", "refined_score", "gap_est", F.round("identity_est", 6).alias("identity_est"))


def _refine_ont(s, d):
    cfg = replace(CFG, refine=replace(CFG.refine, mode="ont"))
    return R.calls(Y.reads(s, d), cfg).where("refined_split IS NOT NULL").select("read_id", "refined_split", "gap_est", F.round("identity_est", 6).alias("identity_est"))


def _gap_scan(s, d):
    return _calls(s, d).where("refined_split IS NOT NULL").select("read_id", "gap_est")


def _identity_final(s, d):
    return _calls(s, d).where("refined_split IS NOT NULL").select("read_id", F.round("identity_est", 6).alias("identity_est"))


def _sig_local(s, d):
    return _calls(s, d).where("sig IS NOT NULL").select("read_id", "sig")


def _sig_flank(s, d):
    def go(batches):
        sig = replace(CFG.sig, flank=300, take=8)
        for b in batches:
            rows = [(i, K.signature_flank(K.as_array(x), 600 // 150 * 150, 17, 21, sig)) for i, x in zip(b.column("read_id").to_pylist(), b.column("seq").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], names=["read_id", "sig"])

    return Y.reads(s, d).select("read_id", "seq").mapInArrow(go, "read_id string, sig string").where("sig IS NOT NULL")


def _profile(s, d):
    return R.position_profile(Y.reads(s, d), CFG).select("i", F.round("mean_match", 6).alias("mean_match"), "n")


def _rolling(s, d):
    c = Y.table(s, d, "calls").select("sample", "doc_id", F.col("doc_id").alias("i"))
    p = c.groupBy("sample", F.floor(F.col("i") / 3).cast("long").alias("i")).agg(F.avg(F.when(F.col("i") < 600, 1.0).otherwise(F.col("i") % 2)).alias("mean_match"))
    return R.arm_length(p, ["sample"])


QUERIES = {
    "minimizer_selfjoin": _self_join, "antidiag_bins": _antidiag, "best_bin": _best, "topk_bins": _topk, "monotone_chain": _chain, "weighted_split": _split,
    "arm_bounds_t1": _arm_bounds, "coarse_detect": _coarse, "multi_hit": _multi, "refine_hifi": _refine, "refine_ont": _refine_ont, "sig_local": _sig_local, "sig_flank": _sig_flank,
    "position_profile": _profile, "gap_scan": _gap_scan, "identity_final": _identity_final, "arm_len_rolling": _rolling,
}

RC = f"rcs AS (SELECT read_id, doc_id, {Y.rc_sql('seq')} AS seq FROM reads)"
POINTS = [
    Y.READS_SQL, RC, minimizers_sql("f", "reads"), minimizers_sql("r", "rcs"),
    """ok AS (SELECT read_id, length(seq) AS n FROM reads JOIN (SELECT read_id, count(*) AS c FROM f GROUP BY 1) USING (read_id) JOIN (SELECT read_id, count(*) AS c2 FROM r GROUP BY 1) USING (read_id) WHERE length(seq) >= 48 AND c >= 10 AND c2 >= 10)""",
    """fc AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY read_id, val) AS c FROM f) WHERE c <= 64)""",
    """pts AS (SELECT ok.read_id, ok.n::BIGINT AS n, fc.pos::BIGINT AS p1, (ok.n - 17 - r.pos)::BIGINT AS p2, r.val, floor((fc.pos + ok.n - 17 - r.pos)::DOUBLE / 120)::BIGINT AS bin FROM ok JOIN r USING (read_id) JOIN fc ON fc.read_id = r.read_id AND fc.val = r.val)""",
]
BINS = [
    "bins AS (SELECT read_id, n, bin, count(*) AS cnt, min(p1) AS min_p1, max(p1) AS max_p1 FROM pts GROUP BY 1, 2, 3)",
    "gated AS (SELECT *, max_p1 - min_p1 AS span FROM bins WHERE cnt >= 10 AND max_p1 - min_p1 >= 200)",
    "best AS (SELECT read_id, bin, cnt, span FROM (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY span + 10 * cnt DESC, bin) AS rn FROM gated) WHERE rn = 1)",
]
CHAIN = [
    "chain AS (SELECT * FROM (SELECT p.*, min(p2) OVER (PARTITION BY p.read_id ORDER BY p1, p2 DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM pts p JOIN best b ON b.read_id = p.read_id AND b.bin = p.bin) WHERE low IS NULL OR p2 < low)",
    "agg AS (SELECT read_id, n, bin, count(*) AS m, max(p1) - min(p1) AS span, sum((p1 + p2) * (1.0::DOUBLE / greatest(abs(p1 - p2), 17))) / sum(1.0::DOUBLE / greatest(abs(p1 - p2), 17)) AS d FROM chain GROUP BY 1, 2, 3)",
    "spl AS (SELECT *, floor(round(d, 6) / 2 + 0.5::DOUBLE)::BIGINT AS split FROM agg WHERE m >= 10 AND span >= 200)",
    "coarse AS (SELECT read_id, n, bin, m, span, split FROM spl WHERE split >= 300 AND split + 300 <= n)",
    "t1 AS (SELECT c.read_id, coalesce(max(p1) + 17, 0) AS arm_end, coalesce(min(p2), 0) AS arm_start_right FROM coarse c LEFT JOIN chain h ON h.read_id = c.read_id AND h.p1 < c.split AND h.p2 > c.split GROUP BY 1)",
]
REFINE = [
    f"base AS (SELECT c.read_id, c.n, c.span, c.split AS s0, t1.arm_end, t1.arm_start_right, x.seq, {Y.rc_sql('x.seq')} AS rc, least(1200, greatest(least(c.split, c.n - c.split) - 100, 0))::BIGINT AS arm FROM coarse c JOIN t1 USING (read_id) JOIN reads x USING (read_id))",
    # the left arm's reverse complement ending at s is rc[n - s, n - s + arm)
    "cand AS (SELECT *, arm - 2 * hamming(substr(rc, (n - s + 1)::INT, arm::INT), substr(seq, (s + 1)::INT, arm::INT)) AS sc FROM (SELECT *, unnest(range(s0 - 100, s0 + 101)) AS s FROM base WHERE arm >= 10))",
    "pick AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY sc DESC, s) AS pick_n FROM cand) WHERE pick_n = 1)",
    "lim AS (SELECT *, least(500, greatest(arm - 100, 0)) AS md, greatest(least(500, greatest(arm - 100, 0)) // 200, 1) AS stride, greatest(arm_start_right - arm_end, 0) AS hint FROM pick)",
    "way AS (SELECT *, arm_end > 0 AND arm_start_right > arm_end AND hint > 2 * md AND arm_end <= n AND arm_start_right < n AS use_hint FROM lim)",
    "scan AS (SELECT *, (least(arm - de, 500) - hamming(substr(rc, (n - s + de + 1)::INT, least(arm - de, 500)::INT), substr(seq, (s + de + 1)::INT, least(arm - de, 500)::INT)))::DOUBLE / least(arm - de, 500) AS v FROM (SELECT *, unnest(range(0, md + 1)) AS de FROM way WHERE NOT use_hint))",
    "rough AS (SELECT read_id, de AS d1, v AS v1 FROM (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY v DESC, de) AS rn FROM scan WHERE de = 0 OR (de - 1) % stride = 0) WHERE rn = 1)",
    "fine AS (SELECT s.read_id, s.de, s.v, row_number() OVER (PARTITION BY s.read_id ORDER BY s.v DESC, s.de) AS rn FROM scan s JOIN rough USING (read_id) WHERE stride > 1 AND d1 > 0 AND s.de BETWEEN greatest(d1 - stride, 1) AND least(d1 + stride, md) AND s.v > v1)",
    "shift AS (SELECT w.*, coalesce(fine.de, d1, 0) AS de FROM way w LEFT JOIN rough USING (read_id) LEFT JOIN fine ON fine.read_id = w.read_id AND fine.rn = 1)",
    """ends AS (SELECT *, CASE WHEN use_hint THEN greatest(least(arm_end, n - arm_start_right, least(arm, span, 500)), 1) ELSE greatest(least(arm - de, span, 500), 1) END AS win,
      CASE WHEN use_hint THEN arm_end ELSE s - de END AS le, CASE WHEN use_hint THEN arm_start_right ELSE s + de END AS rs FROM shift)""",
    "arms AS (SELECT *, substr(seq, (le - win + 1)::INT, win::INT) AS la, substr(rc, (n - rs - win + 1)::INT, win::INT) AS ra FROM ends)",
    """refined AS (SELECT read_id, n, s AS refined_split, sc AS refined_score, CASE WHEN use_hint THEN hint ELSE 2 * de END AS gap_est,
      CASE WHEN levenshtein(la, ra) <= greatest(ceil(0.25::DOUBLE * win), 1) THEN 1 - levenshtein(la, ra)::DOUBLE / win ELSE (win - hamming(la, ra))::DOUBLE / win END AS identity_est FROM arms)""",
]
SIG = [
    """near AS (SELECT p.read_id, p.val, row_number() OVER (PARTITION BY p.read_id ORDER BY p.val) AS rn, count(*) OVER (PARTITION BY p.read_id) AS c FROM pts p JOIN coarse c ON c.read_id = p.read_id AND c.bin = p.bin
      JOIN refined r ON r.read_id = p.read_id WHERE abs(p.p1 - r.refined_split) <= 1000 AND r.identity_est >= 0.6)""",
    "sigs AS (SELECT read_id, md5(string_agg(val::VARCHAR, ',' ORDER BY val)) AS sig FROM near WHERE c >= 12 AND rn <= 12 GROUP BY 1)",
]

_FLANK = [
    Y.READS_SQL,
    "fl AS (SELECT read_id || 'L' AS read_id, substr(seq, 301, 300) AS seq FROM reads WHERE length(seq) >= 900)",
    f"fr AS (SELECT read_id || 'R' AS read_id, {Y.rc_sql('substr(seq, 601, 300)')} AS seq FROM reads WHERE length(seq) >= 900)",
    "both_f AS (SELECT * FROM fl UNION ALL SELECT * FROM fr)",
    minimizers_sql("m", "both_f", True),
    "low AS (SELECT substr(read_id, 1, (length(read_id) - 1)::INT) AS read_id, val, row_number() OVER (PARTITION BY read_id ORDER BY val) AS rn FROM m)",
]

ORACLE = {
    "minimizer_selfjoin": _with(*POINTS, body=" SELECT read_id, n, p1, p2, val FROM pts"),
    "antidiag_bins": _with(*POINTS, *BINS, body=" SELECT read_id, bin, cnt, min_p1, max_p1 FROM bins"),
    "best_bin": _with(*POINTS, *BINS, body=" SELECT * FROM best"),
    "topk_bins": _with(*POINTS, *BINS, body=" SELECT read_id, rn AS rank, bin, cnt, span FROM (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY cnt DESC, span DESC, bin) AS rn FROM gated) WHERE rn <= 3"),
    "monotone_chain": _with(*POINTS, *BINS, *CHAIN, body=" SELECT read_id, m AS chain_len, span FROM spl"),
    "weighted_split": _with(*POINTS, *BINS, *CHAIN, body=" SELECT read_id, split, split >= 300 AND split + 300 <= n AS inside FROM spl"),
    "arm_bounds_t1": _with(*POINTS, *BINS, *CHAIN, body=" SELECT read_id, arm_end::BIGINT AS arm_end, arm_start_right::BIGINT AS arm_start_right FROM t1"),
    "coarse_detect": _with(*POINTS, *BINS, *CHAIN, body=" SELECT read_id, n AS len, split, m AS matches, span, span + 10 * m AS score, bin FROM coarse"),
    "multi_hit": _with(*POINTS, *BINS, body=""",
      top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY cnt DESC, span DESC, bin) AS rn FROM gated) WHERE rn <= 3),
      ch AS (SELECT * FROM (SELECT p.*, t.cnt, min(p2) OVER (PARTITION BY p.read_id, p.bin ORDER BY p1, p2 DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM pts p JOIN top t ON t.read_id = p.read_id AND t.bin = p.bin) WHERE low IS NULL OR p2 < low),
      g AS (SELECT read_id, n, bin, cnt, count(*) AS m, max(p1) - min(p1) AS span, sum((p1 + p2) * (1.0::DOUBLE / greatest(abs(p1 - p2), 17))) / sum(1.0::DOUBLE / greatest(abs(p1 - p2), 17)) AS d FROM ch GROUP BY 1, 2, 3, 4)
      SELECT read_id, bin, cnt AS bin_count, split, m AS matches, span FROM (SELECT *, floor(round(d, 6) / 2 + 0.5::DOUBLE)::BIGINT AS split FROM g WHERE m >= 10 AND span >= 200) WHERE split >= 300 AND split + 300 <= n"""),
    "refine_hifi": _with(*POINTS, *BINS, *CHAIN, *REFINE, body=" SELECT read_id, refined_split::BIGINT AS refined_split, refined_score::BIGINT AS refined_score, gap_est::BIGINT AS gap_est, round(identity_est, 6) AS identity_est FROM refined"),
    "gap_scan": _with(*POINTS, *BINS, *CHAIN, *REFINE, body=" SELECT read_id, gap_est::BIGINT AS gap_est FROM refined"),
    "identity_final": _with(*POINTS, *BINS, *CHAIN, *REFINE, body=" SELECT read_id, round(identity_est, 6) AS identity_est FROM refined"),
    "position_profile": _with(*POINTS, *BINS, *CHAIN, *REFINE, body=f""", h AS (SELECT seq, refined_split - gap_est // 2 AS l, refined_split + gap_est // 2 AS r FROM refined JOIN reads USING (read_id)),
      p AS (SELECT seq, l, r, unnest(range(0, greatest(least(l, length(seq) - r, 500), 0)::BIGINT)) AS i FROM h)
      SELECT i::INT AS i, round(avg(CASE WHEN translate(substr(seq, (l - i)::INT, 1), '{Y.S.IUPAC}', '{Y.S.COMPLEMENT}') = substr(seq, (r + i + 1)::INT, 1) THEN 1.0::DOUBLE ELSE 0 END), 6) AS mean_match, count(*) AS n FROM p GROUP BY 1"""),
    "sig_local": _with(*POINTS, *BINS, *CHAIN, *REFINE, *SIG, body=" SELECT * FROM sigs"),
    "sig_flank": _with(*_FLANK, body=", t AS (SELECT * FROM low WHERE rn <= 8) SELECT read_id, md5(string_agg(val::VARCHAR, ',' ORDER BY val)) AS sig FROM t GROUP BY 1 HAVING count(*) = 16"),
    "arm_len_rolling": _with(Y.table_sql("calls"), body=""",
      p AS (SELECT sample, doc_id // 3 AS i, avg(CASE WHEN doc_id < 600 THEN 1.0::DOUBLE ELSE doc_id % 2 END) AS m FROM calls_t GROUP BY 1, 2),
      r AS (SELECT *, CASE WHEN i >= 50 THEN avg(m) OVER (PARTITION BY sample ORDER BY i ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) END AS roll FROM p)
      SELECT sample, coalesce(min(i) FILTER (roll < 0.7) - 25, max(i) + 1)::BIGINT AS arm_len FROM r GROUP BY 1"""),
}
