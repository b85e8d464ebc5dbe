"""Read mode: detect foldbacks, gather junction support over all reads, decide, cut.

One pass over the sequences finds a compact row per read (`calls`); everything across reads is ordinary aggregation and joins on
those rows. To be cut, reads are visited again where they are; no sequence is ever shuffled.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import ReadConfig
from ..storage import written
from . import kernels as K
from .lookup import signature_set

CALLS = (
    "read_id string, len long, coarse_split long, matches long, span_p1 long, coarse_score long, arm_end long, arm_start_right long, bin long, "
    "refined_split long, refined_score long, identity_est double, gap_est long, sig string, hifi_identity double"
)
_CALLS = pa.schema([
    ("read_id", pa.string()), ("len", pa.int64()), ("coarse_split", pa.int64()), ("matches", pa.int64()), ("span_p1", pa.int64()), ("coarse_score", pa.int64()),
    ("arm_end", pa.int64()), ("arm_start_right", pa.int64()), ("bin", pa.int64()), ("refined_split", pa.int64()), ("refined_score", pa.int64()),
    ("identity_est", pa.float64()), ("gap_est", pa.int64()), ("sig", pa.string()), ("hifi_identity", pa.float64()),
])


def call_read(read_id: str, seq: str, cfg: ReadConfig, shared: dict | None = None) -> dict | None:
    """One read's row, None without a foldback. Support is gathered with the hifi refinement whatever the mode.

    shared: what several configurations have in common on this read (sketch, matches, refinements); it is filled on the way.
    """
    return _called(read_id, seq, cfg, shared)[0]


def _called(read_id: str, seq: str, cfg: ReadConfig, shared: dict | None = None) -> tuple[dict | None, K.Fold | None, K.Refined | None]:
    """A read's row with the foldback and the refinement that it is made of."""
    a = K.as_array(seq)
    f = K.detect(a, cfg, shared)
    if f is None:
        return None, None, None
    refined = lambda mode: K._kept(shared, ("refined", cfg.refine, mode, f.split, f.span, f.arm_end, f.arm_start_right), lambda: K.refine(a, f, cfg, mode))
    return _row(read_id, a, f, cfg, refined)


def _row(read_id: str, a: np.ndarray, f: K.Fold, cfg: ReadConfig, refined) -> tuple[dict, K.Fold, K.Refined | None]:
    """A read's row with its foldback and the refinement; refined(mode) gives that."""
    row = dict.fromkeys(_CALLS.names) | {"read_id": read_id, "len": len(a), "coarse_split": f.split, "matches": f.matches, "span_p1": f.span, "coarse_score": f.score, "arm_end": f.arm_end, "arm_start_right": f.arm_start_right, "bin": f.bin}
    hifi = refined("hifi")
    r = (refined("ont") or hifi) if cfg.refine.mode == "ont" else hifi
    if hifi is not None and r is not None:
        row |= {"refined_split": r.split, "refined_score": r.score, "identity_est": float(r.identity), "gap_est": r.gap, "hifi_identity": float(hifi.identity)}
        if hifi.identity >= cfg.min_identity:
            row["sig"] = K.signature(a, f, hifi.split, cfg)
    return row, f, r


#: Reads that are refined together.
TOGETHER = 64


def call_reads(reads: list[tuple[str, str]], cfg: ReadConfig) -> list[dict]:
    """Rows of the reads with a foldback, as `call_read` gives them; reads are refined together where edits are counted."""
    out = []
    for i in range(0, len(reads), TOGETHER):
        some = [(name, a, f) for name, a in ((name, K.as_array(seq)) for name, seq in reads[i : i + TOGETHER]) if (f := K.detect(a, cfg))]
        ont = K.refine_many([x[1:] for x in some], cfg, "ont") if cfg.refine.mode == "ont" else [None] * len(some)
        out += [_row(name, a, f, cfg, lambda mode, a=a, f=f, r=r: r if mode == "ont" else K.refine(a, f, cfg, mode))[0] for (name, a, f), r in zip(some, ont)]
    return out


def calls(reads: DataFrame, cfg: ReadConfig) -> DataFrame:
    """One row per read(read_id, seq) with a coarse foldback; refined columns are null where refinement finds nothing.

    Null or short sequences have no row. Sequences stay where they are; only these rows are shuffled later.
    """

    def go(batches):
        for b in batches:
            rows = call_reads([x for x in zip(b.column("read_id").to_pylist(), b.column("seq").to_pylist()) if x[1]], cfg)
            yield pa.RecordBatch.from_pylist(rows, schema=_CALLS)

    return reads.select("read_id", "seq").mapInArrow(go, CALLS)


def support(called: DataFrame) -> DataFrame:
    """sig, n, min_split, max_split, mean_ident: partial and final aggregation over all reads' signatures."""
    rows = called.where("sig IS NOT NULL")
    return rows.groupBy("sig").agg(F.count("*").alias("n"), F.min("refined_split").alias("min_split"), F.max("refined_split").alias("max_split"), F.avg("hifi_identity").alias("mean_ident"))


#: Leading characters of a signature that a part of the rank is made of: signatures are hexadecimal digests, so 4096 even parts.
CELL = 3


def support_rank(sup: DataFrame) -> DataFrame:
    """rank_frac: 1 for the best supported signature down to 0, by n and then signature.

    percent_rank over everything needs one sorted task, and nearly all signatures have the same n. Signatures are counted per n and
    leading characters; running sums over these few counts place each part, and only inside a part rows are ordered.
    """
    sup = sup.withColumn("cell", F.substring("sig", 1, CELL))
    cells = sup.groupBy("n", "cell").agg(F.count("*").alias("c"))
    before = Window.orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, -1)
    per = cells.groupBy("n").agg(F.sum("c").alias("all")).withColumn("above", F.coalesce(F.sum("all").over(before), F.lit(0))).withColumn("m", F.sum("all").over(Window.partitionBy()))
    inside = Window.partitionBy("n").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    at = cells.withColumn("ahead", F.coalesce(F.sum("c").over(inside), F.lit(0))).join(per, "n").select("n", "cell", "m", (F.col("above") + F.col("ahead")).alias("before"))
    rows = sup.withColumn("pos", F.row_number().over(Window.partitionBy("n", "cell").orderBy("sig"))).join(at, ["n", "cell"])
    frac = F.when(F.col("m") <= 1, 1.0).otherwise(1.0 - (F.col("before") + F.col("pos") - 1) / (F.col("m") - 1))
    return rows.select("sig", "n", "min_split", "max_split", "mean_ident", frac.alias("rank_frac"))


def support_histogram(sup: DataFrame, width: int = 10, bar: int = 30) -> DataFrame:
    """Clusters by support in ranges of `width`, with a bar scaled to the largest."""
    h = sup.groupBy((F.floor(F.col("n") / width) * width).cast("long").alias("lo")).agg(F.count("*").alias("clusters"))
    top = F.max("clusters").over(Window.partitionBy())
    return h.select("lo", (F.col("lo") + width - 1).alias("hi"), "clusters", F.floor(F.col("clusters") * bar / top).cast("long").alias("bar"))


def support_summary(sup: DataFrame, cfg: ReadConfig) -> DataFrame:
    return sup.agg(
        F.count("*").alias("clusters"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_n"), F.round(F.avg("n"), 6).alias("avg_n"), F.max("n").alias("max_n"),
        F.count_if(F.col("n") >= cfg.min_support).alias("passing"), F.count_if((F.col("n") >= cfg.min_support) & (F.col("mean_ident") >= cfg.min_identity)).alias("passing_ident"),
    )


def is_real(cfg: ReadConfig):
    ok = F.col("sig").isNotNull() & (F.coalesce(F.col("n"), F.lit(0)) >= cfg.min_support)
    return ok & (F.col("mean_ident") >= cfg.min_support_ident) if cfg.min_support_ident > 0 else ok


def _said(cfg: ReadConfig):
    """The decision on a call that has its signature's support."""
    return (
        F.when(F.col("refined_split").isNull(), F.lit(None).cast("string")).when(F.col("hifi_identity") < cfg.min_identity, "low_ident")
        .when(F.col("sig").isNull(), "unknown").when(is_real(cfg), "real").otherwise("artefact")
    )


def decide(called: DataFrame, sup: DataFrame, cfg: ReadConfig) -> DataFrame:
    """calls with support and `decision`: low_ident, unknown (no signature), real or artefact; null without refinement."""
    ranked = support_rank(sup)
    # reads without a signature stay where they are: joined, they would all be one key
    rows = called.where("sig IS NOT NULL").join(ranked, "sig", "left").unionByName(called.where("sig IS NULL"), allowMissingColumns=True)
    rows = rows.withColumn("decision", _said(cfg))
    if cfg.cut_low_ident:
        rows = rows.withColumn("low_cut", F.col("decision") == "low_ident").withColumn("decision", F.when(F.col("decision") == "low_ident", "artefact").otherwise(F.col("decision")))
    else:
        rows = rows.withColumn("low_cut", F.lit(False))
    return rows


def first_cut(decided: DataFrame) -> DataFrame:
    """Kept prefix after one cut: artefacts keep split + gap / 2, those cut for low identity keep up to the split."""
    end = F.when(F.col("low_cut"), F.col("refined_split")).when(F.col("decision") == "artefact", F.least(F.col("refined_split") + F.floor(F.col("gap_est") / 2), F.col("len"))).otherwise(F.col("len"))
    return decided.withColumn("keep_end", end.cast("long"))


def cut_read(read_id: str, seq: str | None, cfg: ReadConfig, real) -> tuple[str, int, int, str]:
    """(name, keep_start, keep_end, bases kept) of one read: its call again, and its decision from the signatures that pass as real.

    The decision depends on nothing but the read and that set, so it isn't carried to the read but found there anew.
    """
    row, f, r = _called(read_id, seq, cfg) if seq else (None, None, None)
    if row is None or row["refined_split"] is None:
        return read_id, 0, len(seq or ""), seq or ""
    if row["hifi_identity"] < cfg.min_identity:
        if not cfg.cut_low_ident:
            return read_id, 0, len(seq), seq
        end = row["refined_split"]
    elif row["sig"] is None or row["sig"] in real:
        return read_id, 0, len(seq), seq
    else:
        end = K.recursive_cut(K.as_array(seq), f, r, cfg, real)
    return f"{read_id}_chopped_at_{row['refined_split']}", 0, end, seq[:end]


def corrected(reads: DataFrame, sup: DataFrame, cfg: ReadConfig) -> DataFrame:
    """read_id, keep_start, keep_end, seq_out of every read; cuts recurse into the kept part up to max_depth.

    Sequences stay where they are: nothing is joined to them. Signatures that pass as real are looked up in sorted files of the
    shared folder (`lookup`), however many there are.
    """
    shared = reads.sparkSession.sparkContext.broadcast(signature_set(sup.where(is_real(cfg)).select("sig")))
    schema = pa.schema([("read_id", pa.string()), ("keep_start", pa.int64()), ("keep_end", pa.int64()), ("seq_out", pa.string())])

    def go(batches):
        real = shared.value
        for b in batches:
            out = [cut_read(i, s, cfg, real) for i, s in zip(b.column("read_id").to_pylist(), b.column("seq").to_pylist())]
            yield pa.RecordBatch.from_pydict({n: [o[j] for o in out] for j, n in enumerate(schema.names)}, schema=schema)

    return reads.select("read_id", "seq").mapInArrow(go, "read_id string, keep_start long, keep_end long, seq_out string")


def report(decided: DataFrame) -> DataFrame:
    """The 19-column report; reads that weren't refined have no row, three columns are always empty."""
    none = lambda n: F.lit(None).cast("string").alias(n)
    return decided.where("refined_split IS NOT NULL").select(
        "read_id", "len", F.lit("foldback").alias("event"), F.lit(1).alias("called"), "coarse_split", "refined_split", none("delta"), "matches", "span_p1",
        none("p2_span"), none("cross_frac"), "coarse_score", "refined_score", F.round("identity_est", 3).alias("identity_est"), "gap_est",
        F.coalesce("n", F.lit(0)).alias("support_n"), F.round(F.coalesce("rank_frac", F.lit(0.0)), 6).alias("support_rank_frac"),
        F.coalesce(F.col("max_split") - F.col("min_split"), F.lit(0)).alias("support_span"), "decision",
    )


def run_counters(reads: DataFrame, decided: DataFrame, kept: DataFrame) -> DataFrame:
    """Totals of a run from row flags, so that retried tasks don't count twice."""
    a = reads.agg(F.count("*").alias("jobs"))
    b = decided.agg(
        F.count("*").alias("detected"), F.count("refined_split").alias("refined"), F.count_if(F.col("hifi_identity") >= 0).alias("with_identity"), F.count("sig").alias("sig_ok"),
        F.count_if(F.col("decision") == "real").alias("num_real"),
    )
    return a.crossJoin(b).crossJoin(kept.agg(F.count_if(F.col("keep_end") < F.col("len")).alias("num_cut")))


def correct(reads: DataFrame, cfg: ReadConfig) -> tuple[DataFrame, DataFrame]:
    """(corrected reads, report): the whole of read mode. Calls are written once and reused."""
    called = written(calls(reads, cfg), "calls")
    sup = support(called)
    decided = decide(called, sup, cfg)
    return corrected(reads, sup, cfg), report(decided)


def sweep(reads: DataFrame, configs: dict[str, ReadConfig]) -> DataFrame:
    """tag and counts of each decision for every configuration, from one pass over the reads.

    A read is sketched once for all configurations of one sketch, matches are binned once per tolerance and foldbacks refined once,
    so a configuration more costs what it has of its own. Those that differ only across reads share their rows too. Counts of all
    tags come from one aggregation over the rows.
    """
    alike = lambda cfg: replace(cfg, min_support=0, min_support_ident=0.0, max_depth=0, cut_low_ident=False)  # noqa: E731  what calls don't depend on
    keys = list(dict.fromkeys(map(alike, configs.values())))
    schema = pa.schema([*_CALLS, ("key", pa.int32())])

    def go(batches):
        for b in batches:
            rows = []
            for i, s in zip(b.column("read_id").to_pylist(), b.column("seq").to_pylist()):
                shared: dict = {}
                rows += [r | {"key": k} for k, cfg in enumerate(keys) if s and (r := call_read(i, s, cfg, shared))]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    called = written(reads.select("read_id", "seq").mapInArrow(go, CALLS + ", key int"), "sweep-calls")
    some = called.where("sig IS NOT NULL")
    sup = some.groupBy("key", "sig").agg(F.count("*").alias("n"), F.avg("hifi_identity").alias("mean_ident"))
    rows = some.join(sup, ["key", "sig"]).unionByName(called.where("sig IS NULL"), allowMissingColumns=True)
    told, names = [], ("detected", "artefact", "low_ident", "real", "unknown")
    for tag, cfg in configs.items():
        mine, said = F.col("key") == keys.index(alike(cfg)), _said(cfg)
        if cfg.cut_low_ident:
            said = F.when(said == "low_ident", "artefact").otherwise(said)
        told.append(F.struct(F.lit(tag).alias("tag"), F.count_if(mine).alias("detected"), *[F.count_if(mine & (said == d)).alias(d) for d in names[1:]]))
    return rows.agg(F.array(*told).alias("told")).select(F.explode("told").alias("x")).select("x.*")


def position_profile(reads: DataFrame, cfg: ReadConfig, most: int = 500) -> DataFrame:
    """Mean match of the two arms of refined foldbacks at each distance i from the junction, gap corrected.

    One pass: reads are called and compared where they are, and tasks send one row per distance.
    """

    def go(batches):
        good, seen = np.zeros(most, np.int64), np.zeros(most, np.int64)
        for b in batches:
            for i, s in zip(b.column("read_id").to_pylist(), b.column("seq").to_pylist()):
                row = call_read(i, s, cfg) if s else None
                if row is not None and row["refined_split"] is not None:
                    m = K.arm_matches(K.as_array(s), row["refined_split"], row["gap_est"], most)
                    good[: len(m)] += m
                    seen[: len(m)] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(good[at]), pa.array(seen[at])], names=["i", "good", "seen"])

    sums = reads.select("read_id", "seq").mapInArrow(go, "i int, good long, seen long").groupBy("i").agg(F.sum("good").alias("good"), F.sum("seen").alias("n"))
    return sums.select("i", (F.col("good") / F.col("n")).alias("mean_match"), "n")


def arm_length(profile: DataFrame, key: list[str], span: int = 50, least: float = 0.70) -> DataFrame:
    """First distance where the mean match over the `span` distances before it falls below `least`, less half a span; else the full distance."""
    w = Window.partitionBy(*key).orderBy("i").rowsBetween(-span, -1)
    rolled = profile.withColumn("roll", F.when(F.col("i") >= span, F.avg("mean_match").over(w)))
    return rolled.groupBy(*key).agg(F.coalesce(F.min(F.when(F.col("roll") < least, F.col("i"))) - span // 2, F.max("i") + 1).alias("arm_len"))
