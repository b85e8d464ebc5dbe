"""Evaluation queries: truth matching, confusion, summaries and cross-tool comparisons. Aggregations and joins only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written
from .quantiles import _joined, quantiles, values_at

#: Bases of a bin in which intervals are paired.
BIN = 16384


def overlap(a0, a1, b0, b1) -> Column:
    return F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0))


def match_truth(truth: DataFrame, calls: DataFrame, least: int = 100, share: float = 0.25) -> DataFrame:
    """Each truth interval with its best overlapping call (null if none): truth(truth_id, contig, t0, t1), calls(call_id, contig, start, end, tir_ident).

    A pair matches at `least` overlapping bases or `share` of both. Best: overlap, its share of the truth, identity, shorter, first.
    Intervals meet in bins of positions, so that only near ones of a contig are paired; a pair counts in the bin where it begins.
    """
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / BIN), F.floor((F.col(hi) - 1) / BIN)))
    c = calls.where(F.col("end") > F.col("start")).select("contig", "call_id", "start", "end", "tir_ident").withColumn("_bin", bins("start", "end"))
    t = truth.where(F.col("t1") > F.col("t0")).select("truth_id", "contig", "t0", "t1").withColumn("_bin", bins("t0", "t1"))
    j = t.join(c, ["contig", "_bin"]).where(F.col("_bin") == F.floor(F.greatest("t0", "start") / BIN)).withColumn("ov", overlap(F.col("t0"), F.col("t1"), F.col("start"), F.col("end"))).where("ov > 0")
    t_len, c_len = F.greatest(F.col("t1") - F.col("t0"), F.lit(1)), F.greatest(F.col("end") - F.col("start"), F.lit(1))
    j = j.withColumn("recip_truth", F.col("ov") / t_len).withColumn("recip_call", F.col("ov") / c_len)
    j = j.where((F.col("ov") >= least) | ((F.col("recip_truth") >= share) & (F.col("recip_call") >= share)))
    best = F.max(F.struct("ov", "recip_truth", F.coalesce("tir_ident", F.lit(-1.0)).alias("i"), (F.col("start") - F.col("end")).alias("neg"), (-F.col("call_id")).alias("first"), "tir_ident", "start", "end", "recip_call"))
    b = j.groupBy("truth_id").agg(best.alias("b")).select("truth_id", (-F.col("b.first")).alias("call_id"), "b.ov", "b.recip_truth", "b.recip_call", F.col("b.tir_ident").alias("call_ident"), F.col("b.start").alias("call_start"), F.col("b.end").alias("call_end"))
    return truth.join(b, "truth_id", "left").withColumn("detected", F.col("call_id").isNotNull())


def false_positives(calls: DataFrame, matched: DataFrame) -> DataFrame:
    """Calls that are the best match of no planted truth."""
    return calls.join(matched.where("call_id IS NOT NULL").select("call_id"), "call_id", "left_anti")


def truth_summary(matched: DataFrame) -> DataFrame:
    """Per scenario group: planted, detected, recovery, and true medians of errors over the detected."""
    key = ["scenario_group"]
    found = matched.where("detected")
    length, ident = F.col("call_end") - F.col("call_start") - (F.col("t1") - F.col("t0")), F.col("call_ident") - F.col("true_identity")
    out = matched.groupBy(*key).agg(F.count("*").alias("n"), F.count_if("detected").alias("found"), (F.count_if("detected") / F.count("*")).alias("recovery"))
    for name, x in (("median_len_error", length), ("median_ident_error", ident)):
        out = _joined(out, quantiles(found, key, x, {name: ("linear", 0.5)}), key, "left")
    return out


def acceptance(truth: DataFrame, calls: DataFrame) -> DataFrame:
    """Per scenario group: planted, found, calls that are no planted repeat's best match, and median errors of arm, spacer and identity.

    truth: contig, scenario_group, planted, true_identity, la0, la1, ra0, ra1; calls: the table of `irmode.call_irs`. An error is the
    call's value less the true one; the true arm is the shorter one.
    """
    key = ["scenario_group"]
    own = F.xxhash64("contig", "win_start", "bin", "break_pos")
    c = calls.select("contig", "start", "end", "tir_ident", "arm_len", "spacer", own.alias("call_id"))
    t = truth.select("*", F.col("contig").alias("truth_id"), F.col("la0").alias("t0"), F.col("ra1").alias("t1"))
    met = match_truth(t.where("planted"), c).where("detected").join(c.select("call_id", "arm_len", "spacer"), "call_id")
    met = written(met.select(*key, "call_id", (F.col("arm_len") - F.least(F.col("la1") - F.col("la0"), F.col("ra1") - F.col("ra0"))).alias("arm"), (F.col("spacer") - (F.col("ra0") - F.col("la1"))).alias("gap"), (F.col("call_ident") - F.col("true_identity")).alias("ident")), "acceptance")
    out = truth.groupBy(*key).agg(F.count_if("planted").alias("planted"))
    wrong = false_positives(c, met).join(truth.select("contig", *key), "contig").groupBy(*key).agg(F.count("*").alias("false_calls"))
    for more in (met.groupBy(*key).agg(F.count("*").alias("found")), wrong):
        out = _joined(out, more, key, "left")
    for name, x in (("median_arm_error", "arm"), ("median_spacer_error", "gap"), ("median_ident_error", "ident")):
        out = _joined(out, quantiles(met, key, F.col(x), {name: ("linear", 0.5)}), key, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.select(*key, "planted", zero("found"), zero("false_calls"), "median_arm_error", "median_spacer_error", F.round("median_ident_error", 3).alias("median_ident_error"))


def confusion(ours: DataFrame, base: DataFrame, total: int, accept=("artefact",)) -> DataFrame:
    """Counts and scores of ours(id, decision) against base(id): full outer join of the flagged, the rest by the total."""
    a = ours.where(F.col("decision").isin(*accept)).select("id").distinct().withColumn("a", F.lit(1))
    b = base.select("id").distinct().withColumn("b", F.lit(1))
    t = a.join(b, "id", "full_outer").agg(F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("tp"), F.count_if(F.col("b").isNull()).alias("fp"), F.count_if(F.col("a").isNull()).alias("fn"))
    t = t.withColumn("tn", F.lit(total) - F.col("tp") - F.col("fp") - F.col("fn"))
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    six = lambda c: F.round(c, 6)
    return t.select(
        "tp", "fp", "fn", "tn", six(p).alias("prec"), six(r).alias("rec"), six(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("f1"),
        six(F.try_divide("tp", F.col("tp") + F.col("fp") + F.col("fn"))).alias("jaccard"), six(F.try_divide("tn", F.col("tn") + F.col("fp"))).alias("specificity"),
    )


def delta_bucket(d: Column) -> Column:
    return F.when(d == 0, "0").when(d <= 50, "1-50").when(d <= 100, "51-100").when(d <= 250, "101-250").when(d <= 500, "251-500").when(d <= 1000, "501-1000").otherwise(">1000")


def breakpoint_deltas(ours: DataFrame, base: DataFrame) -> DataFrame:
    """Buckets of |our split - theirs| over reads that both have a breakpoint for."""
    d = ours.where("refined_split IS NOT NULL").join(base.where("bp IS NOT NULL"), "id").select(F.abs(F.col("refined_split") - F.col("bp")).alias("d"))
    d = d.withColumn("bucket", delta_bucket(F.col("d")))
    rest = d.groupBy("bucket").agg(F.count("*").alias("n"), F.min("d").alias("min_d"), F.round(F.avg("d"), 6).alias("mean_d"), F.max("d").alias("max_d"))
    return rest.join(quantiles(d, ["bucket"], F.col("d"), {"median_d": ("linear", 0.5)}), "bucket").select("bucket", "n", "min_d", "median_d", "mean_d", "max_d")


def nearest_rank(df: DataFrame, key: list[str], x: str, q: float) -> DataFrame:
    """sorted[floor(q * (n - 1))] per key, by refined counts: no key's values are ordered in one task."""
    return quantiles(df, key, F.col(x), {x: ("nearest", q)})


def report_vs_truth(truth: DataFrame, report: DataFrame, tol: int = 100) -> DataFrame:
    """PASS or FAIL per truth(label, split, want): detected, decision as wanted, and split within `tol` (skipped for 0 and low_ident)."""
    r = outermost(report).select("label", "refined_split", "decision")
    j = truth.join(r, "label", "left").withColumn("detected", F.col("decision").isNotNull()).withColumn("decision", F.coalesce("decision", F.lit("-")))
    delta = F.abs(F.col("refined_split") - F.col("split"))
    split_ok = (F.col("split") == 0) | (F.col("decision") == "low_ident") | F.coalesce(delta <= tol, F.lit(False))
    ok = F.col("detected") & (F.col("decision") == F.col("want"))
    return j.select("label", "detected", "decision", F.coalesce(delta, F.lit(-1)).alias("abs_delta"), split_ok.alias("split_ok"), F.when(ok & split_ok, "PASS").otherwise("FAIL").alias("pass_fail"))


def outermost(report: DataFrame, key: str = "label") -> DataFrame:
    """The row with the largest refined_split of each read."""
    rest = [c for c in report.columns if c != key]
    return report.groupBy(key).agg(F.max(F.struct("refined_split", *[c for c in rest if c != "refined_split"])).alias("x")).select(key, *[F.col(f"x.{c}").alias(c) for c in rest])


def primary_class(clips: DataFrame) -> DataFrame:
    """Class of the longest clip of each read, first clip on a tie."""
    return clips.groupBy("read_id").agg(F.max_by("artifact_class", F.struct("clip_len", -F.col("clip_no"))).alias("artifact_class"))


def class_crosstab(clips: DataFrame, report: DataFrame, decisions=("artefact", "low_ident", "real", "unknown")) -> DataFrame:
    """Decisions per primary class with mean gap and median identity."""
    j = primary_class(clips).join(report, "read_id")
    counts = [F.count_if(F.col("decision") == d).alias(f"n_{d}") for d in decisions]
    return j.groupBy("artifact_class").agg(F.count("*").alias("n"), *counts, F.round(F.avg("gap_est"), 6).alias("mean_gap"), F.round(F.percentile("identity_est", 0.5), 6).alias("median_identity"))


def sanity_checks(crosstab: DataFrame, least: float = 0.5) -> DataFrame:
    """Share of artefacts per class and whether it reaches `least`."""
    share = F.try_divide("n_artefact", "n")
    return crosstab.select("artifact_class", F.round(share, 6).alias("artefact_share"), (share >= least).alias("ok"))


def min_distance(events: DataFrame) -> DataFrame:
    """Least distance of each read's events, 'inter' left out."""
    return events.where("distance != 'inter'").groupBy("read_id").agg(F.min(F.col("distance").cast("long")).alias("min_distance"))


def gap_correlation(pairs: DataFrame) -> DataFrame:
    """Pearson r, share within a factor of two, and sample deviation of differences of pairs(x, y)."""
    twice = (F.col("x") <= 2 * F.col("y")) & (F.col("y") <= 2 * F.col("x"))
    return pairs.agg(F.count("*").alias("n"), F.round(F.corr("x", "y"), 6).alias("r"), F.round(F.avg(twice.cast("double")), 6).alias("within_2x"), F.round(F.stddev_samp(F.col("x") - F.col("y")), 6).alias("sd_diff"))


def decision_counts(report: DataFrame, key: str, decisions=("artefact", "low_ident", "real", "unknown")) -> DataFrame:
    total = F.count("*")
    out = [f for d in decisions for f in (F.count_if(F.col("decision") == d).alias(d), F.round(F.count_if(F.col("decision") == d) / total, 6).alias(f"{d}_frac"))]
    return report.groupBy(key).agg(total.alias("n"), *out)


def sample_summary(reads: DataFrame, report: DataFrame) -> DataFrame:
    """Per sample: totals, decisions, artefact bases before and after the refined split, identity mean and quantiles."""
    total = reads.groupBy("sample").agg(F.count("*").alias("total"))
    art = lambda c: F.sum(F.when(F.col("decision") == "artefact", F.col(c)).otherwise(0))
    r = report.groupBy("sample").agg(
        F.count("*").alias("detected"), F.count_if(F.col("decision") == "artefact").alias("artefact"), F.count_if(F.col("decision") == "real").alias("real"),
        F.count_if(F.col("decision") == "low_ident").alias("low_ident"), art("len").alias("bases_before"), art("refined_split").alias("bases_after"),
        F.round(F.avg("identity_est"), 6).alias("identity_mean"),
    )
    wanted = {"identity_median": ("linear", 0.5), "identity_q10": ("nearest", 0.10), "identity_q90": ("nearest", 0.90)}
    r = _joined(r, quantiles(report, ["sample"], F.col("identity_est"), wanted), ["sample"], "left").withColumn("identity_median", F.round("identity_median", 6))
    j = total.join(r, "sample", "left")
    six = lambda c: F.round(c, 6)
    return j.withColumn("bases_removed", F.col("bases_before") - F.col("bases_after")).withColumn("frac_retained", six(F.try_divide("bases_after", "bases_before"))).withColumn("detected_frac", six(F.try_divide("detected", "total")))


def n50(df: DataFrame, key: list[str], x: str = "len") -> DataFrame:
    """Largest length at which the lengths not below it hold half of all, by refined sums of lengths from the longest on."""
    half = df.groupBy(*key).agg(F.sum(x).alias("_all")).where("_all > 0").select(*key, F.lit("n50").alias("name"), F.ceil(F.col("_all") / 2).alias("t"))
    return values_at(df, key, -F.col(x), half, weight=F.col(x)).select(*key, (-F.col("value")).alias("n50"))


def set_relation(a: DataFrame, b: DataFrame) -> DataFrame:
    """id and whether it is in both sets, in a only or in b only."""
    j = a.select("id").distinct().withColumn("_a", F.lit(1)).join(b.select("id").distinct().withColumn("_b", F.lit(1)), "id", "full_outer")
    return j.select("id", F.when(F.col("_a").isNull(), "b_only").when(F.col("_b").isNull(), "a_only").otherwise("both").alias("side"))


def dashboard_filter(calls: DataFrame, tir: float = 0.5, kept: int = 50, matches: int = 50, arm: int = 500, spacer: int = 0, classes=("overlap", "immediate", "spaced", "wide")) -> DataFrame:
    """Calls that the report's sliders keep; a null tir_ident fails."""
    return calls.where((F.col("tir_ident") >= tir) & (F.col("kept_pts") >= kept) & (F.col("matches") >= matches) & (F.col("arm_len") >= arm) & (F.col("spacer") >= spacer) & F.col("ir_class").isin(*classes))


def contig_rollup(calls: DataFrame) -> DataFrame:
    return calls.groupBy("contig").agg(F.count("*").alias("n"), F.max("contig_len").alias("contig_len"))


def histogram(df: DataFrame, x: str, key: str, lo: float, hi: float, bins: int = 30) -> DataFrame:
    """Counts of x in even bins of [lo, hi] per key; the last bin is closed."""
    b = F.least(F.floor((F.col(x) - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("long")
    return df.where(F.col(x).between(lo, hi)).groupBy(key, b.alias("bin")).agg(F.count("*").alias("n"))


def identity_bin(x: Column) -> Column:
    return F.when(x < 0.5, "<0.5").when(x < 0.7, "0.5-0.7").when(x < 0.9, "0.7-0.9").when(x < 0.95, "0.9-0.95").otherwise(">=0.95")


def stratified(df: DataFrame, n: int, key: str = "read_id", x: str = "identity_est", salt: str = "7") -> DataFrame:
    """n rows of each identity bin, chosen by a hash of the key."""
    d = df.withColumn("ident_bin", identity_bin(F.col(x))).withColumn("_h", F.md5(F.concat_ws(":", F.lit(salt), F.col(key)).cast("binary")))
    return d.withColumn("_n", F.row_number().over(Window.partitionBy("ident_bin").orderBy("_h", key))).where(F.col("_n") <= n).drop("_n", "_h")


def inverted_hits(hits: DataFrame, reads: DataFrame, least: int = 200) -> DataFrame:
    """Split, arm and gap of each read from its longest inverted aligner hit; without one the middle of the read."""
    h = hits.where(F.col("length") >= least).groupBy("read_id").agg(F.max_by(F.struct("qstart", "qend", "send", "length"), F.struct("length", -F.col("hit_no"))).alias("h"))
    j = reads.select("read_id", "len").join(h, "read_id", "left")
    none = F.col("h").isNull()
    split = F.when(none, F.floor(F.col("len") / 2)).otherwise(F.floor((F.col("h.qend") + F.col("h.send") - 1) / 2)).cast("long")
    return j.select("read_id", split.alias("split_pos"), F.when(none, 0).otherwise(F.col("h.length")).alias("arm_len"), F.when(none, 0).otherwise(F.greatest(F.col("h.send") - 1 - F.col("h.qend"), F.lit(0))).cast("long").alias("gap_est"))


def sweep(results: DataFrame, n: int) -> DataFrame:
    """Best n configurations by F1, then tag; results(tag, tp, fp, fn)."""
    f1 = F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return results.withColumn("f1", F.round(f1, 6)).orderBy(F.desc("f1"), "tag").limit(n)
