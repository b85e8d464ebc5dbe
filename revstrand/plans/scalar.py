"""Queries over scalar sequence functions and sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import seq as S
from ..functions import synth as Y

K, W = 17, 21


def _with(*parts: str, body: str) -> str:
    return "WITH " + ", ".join(p.strip() for p in parts) + body


def _seq_revcomp(s, d):
    r = Y.reads(s, d)
    return r.select("read_id", F.md5(S.revcomp("seq").cast("binary")).alias("rc_md5"), F.md5(F.reverse(S.comp("seq")).cast("binary")).alias("comp_md5"), F.length("seq").cast("long").alias("len"))


def _seq_gc(s, d):
    return Y.reads(s, d).select("read_id", F.round(S.gc_fraction("seq"), 6).alias("gc"))


def _valid_spans(s, d):
    r = Y.reads(s, d)
    return r.select("read_id", S.is_acgt("seq").alias("ok"), S.first_invalid("seq").alias("first_bad"), F.posexplode(S.valid_spans("seq")).alias("i", "x")).select("read_id", "ok", "first_bad", F.col("i").cast("long").alias("i"), F.col("x.start").alias("span_start"), F.col("x.end").alias("span_end"))


def _fasta_wrap(s, d):
    return Y.reads(s, d).select("read_id", F.md5(S.wrap("seq", 60).cast("binary")).alias("wrapped_md5"), F.md5(S.wrap("seq", 0).cast("binary")).alias("flat_md5"))


def _id_canon(s, d):
    return Y.table(s, d, "headers").select(S.canonical_id("header").alias("id")).distinct()


def _first_token(s, d):
    return Y.table(s, d, "headers").select("doc_id", S.first_token("header").alias("token"))


def _label_prefix(s, d):
    return Y.table(s, d, "headers").groupBy(S.label_prefix("label").alias("prefix")).agg(F.count("*").alias("n"))


def _kv_detail(s, d):
    m = Y.table(s, d, "clips").select("clip_no", S.detail_map("detail").alias("m"))
    return m.select("clip_no", F.col("m")["unit_len"].cast("long").alias("unit_len"), F.col("m")["copies"].cast("long").alias("copies"))


def _milli(s, d):
    return Y.table(s, d, "calls").select("read_id", S.milli(F.col("identity_est")).alias("ident"), S.milli(F.col("identity_est") / 7).alias("seventh"))


def _edits(s, d):
    import pyarrow as pa

    from ..operators import kernels

    def go(batches):
        for b in batches:
            for i in range(0, b.num_rows, 1000):  # reads whose points are held at once
                ids, seqs = b.column("read_id").slice(i, 1000), [x.encode() for x in b.column("seq").slice(i, 1000).to_pylist()]
                both = [kernels.revcomp(kernels.as_array(x)).tobytes() for x in seqs]
                cols = kernels.pair_edits(list(zip(seqs, both)), 15), kernels.pair_edits([(x, x[3:]) for x in seqs], 10)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in cols)], names=["read_id", "ed", "ed_shift"])

    return Y.reads(s, d).select("read_id", "seq").mapInArrow(go, "read_id string, ed long, ed_shift long")


def _hamming(s, d):
    return Y.reads(s, d).select("read_id", S.hamming_matches("seq", S.revcomp("seq")).alias("matches"))


def _div_floor(s, d):
    return Y.table(s, d, "calls").select("doc_id", S.div_floor(F.col("doc_id") - 500, F.lit(120)).alias("bin"))


def minimizer_rows(reads: DataFrame, k: int = K, w: int = W, canonical: bool = False, seq: str = "seq") -> DataFrame:
    """read_id, pos, val of sampled k-mers, relationally: for checks and small inputs; production sketches run in the kernel."""
    rows = reads.where(F.length(seq) >= k + w - 1).select("read_id", F.col(seq).alias("s"), F.explode(F.sequence(F.lit(0), F.length(seq) - k)).alias("pos"))
    mer = F.expr(f"substring(s, pos + 1, {k})")
    value = lambda m: F.when(F.rlike(m, F.lit("[^ACGT]")), F.lit(None)).otherwise(F.conv(F.translate(m, "ACTG", "0123"), 4, 10).cast("long"))
    val = F.least(value(mer), value(S.revcomp(mer))) if canonical else value(mer)
    rows = rows.select("read_id", "pos", val.alias("val"))
    key = F.when(F.col("val").isNotNull(), F.col("val") % 2147483647 * 48271 % 2147483647 * 2147483648 + F.col("pos"))
    by = Window.partitionBy("read_id").orderBy("pos")
    low = rows.withColumn("low", F.min(key).over(by.rowsBetween(0, w - 1))).withColumn("_last", F.max("pos").over(Window.partitionBy("read_id"))).where(F.col("pos") <= F.col("_last") - (w - 1))
    low = low.where("low IS NOT NULL").select("read_id", (F.col("low") % 2147483648).cast("int").alias("pos")).distinct()
    return rows.join(low, ["read_id", "pos"]).select("read_id", F.col("pos").cast("long").alias("pos"), "val")


def minimizers_sql(name: str, source: str, canonical: bool = False, k: int = K, w: int = W) -> str:
    value = lambda m: f"CASE WHEN regexp_matches({m}, '[^ACGT]') THEN NULL ELSE list_reduce(list_transform(string_split(translate({m}, 'ACTG', '0123'), ''), lambda x: x::BIGINT), lambda u, v: u * 4 + v) END"
    val = f"least({value('mer')}, {value(Y.rc_sql('mer'))})" if canonical else value("mer")
    return f"""
{name}_k AS (SELECT read_id, pos, last, {val} AS val FROM (SELECT read_id, unnest(range(0, length(seq) - {k - 1})) AS pos, length(seq) - {k} AS last, seq FROM {source} WHERE length(seq) >= {k + w - 1}) t, LATERAL (SELECT substr(seq, (pos + 1)::INT, {k}) AS mer) m),
{name}_w AS (SELECT read_id, pos, last, min(CASE WHEN val IS NOT NULL THEN val % 2147483647 * 48271 % 2147483647 * 2147483648 + pos END) OVER (PARTITION BY read_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING) AS low FROM {name}_k),
{name} AS (SELECT DISTINCT k.read_id, k.pos, k.val FROM (SELECT read_id, low % 2147483648 AS pos FROM {name}_w WHERE pos <= last - {w - 1} AND low IS NOT NULL) w JOIN {name}_k k ON k.read_id = w.read_id AND k.pos = w.pos)"""


def _kernel_minimizers(reads: DataFrame, canonical: bool) -> DataFrame:
    import pyarrow as pa

    from ..config import Sketch
    from ..operators import kernels

    def go(batches):
        for b in batches:
            ids, pos, val = [], [], []
            for i, x in zip(b.column("read_id").to_pylist(), b.column("seq").to_pylist()):
                p, v = kernels.minimizers(kernels.as_array(x), Sketch(K, W, not canonical))
                ids += [i] * len(p)
                pos += p.tolist()
                val += v.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(pos, pa.int64()), pa.array(val, pa.int64())], names=["read_id", "pos", "val"])

    return reads.select("read_id", "seq").mapInArrow(go, "read_id string, pos long, val long")



def _min_fwd(s, d):
    return _kernel_minimizers(Y.reads(s, d), False)


def _min_canon(s, d):
    return _kernel_minimizers(Y.reads(s, d), True)


def _repetitive(s, d):
    import pyarrow as pa

    from ..config import Sketch
    from ..operators import kernels

    def go(batches):
        for b in batches:
            rows = []
            for i, x in zip(b.column("read_id").to_pylist(), b.column("seq").to_pylist()):
                v = kernels.minimizers(kernels.as_array(x), Sketch(K, W))[1]
                if len(v):
                    left, all_ = (kernels.buckets(v, cap)[3] for cap in (64, len(v)))
                    rows.append((i, len(all_), int((left == 0).sum()), int(all_.max())))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), *(pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2, 3))], names=["read_id", "vals", "dropped", "most"])

    return Y.reads(s, d).select("read_id", "seq").mapInArrow(go, "read_id string, vals long, dropped long, most long")


def _gates(s, d):
    r = Y.reads(s, d)
    n = _kernel_minimizers(r, False).groupBy("read_id").agg(F.count("*").alias("n"))
    return r.select("read_id", F.length("seq").alias("len")).join(n, "read_id", "left").select("read_id", (F.col("len") >= K + W + 10).alias("long_enough"), (F.coalesce("n", F.lit(0)) >= 10).alias("enough"))


QUERIES = {
    "seq_revcomp": _seq_revcomp, "seq_gc": _seq_gc, "seq_valid_spans": _valid_spans, "fasta_wrap": _fasta_wrap, "id_canon": _id_canon, "first_token": _first_token,
    "label_prefix": _label_prefix, "kv_detail": _kv_detail, "milli_fmt": _milli, "edit_distance_band": _edits, "hamming_identity": _hamming, "div_floor": _div_floor,
    "minimizers_fwd": _min_fwd, "minimizers_canon": _min_canon, "repetitive_filter": _repetitive, "length_gates": _gates,
}

ORACLE = {
    "seq_revcomp": _with(Y.READS_SQL, body=f" SELECT read_id, md5({Y.rc_sql('seq')}) AS rc_md5, md5(reverse(translate(seq, 'ACGT', 'TGCA'))) AS comp_md5, length(seq)::BIGINT AS len FROM reads"),
    "seq_gc": _with(Y.READS_SQL, body=" SELECT read_id, round(length(regexp_replace(seq, '[^GC]', '', 'g'))::DOUBLE / length(seq)::DOUBLE, 6) AS gc FROM reads"),
    "seq_valid_spans": _with(Y.READS_SQL, body=""", p AS (SELECT read_id, seq, unnest(range(1, length(seq) + 1)) AS q FROM reads),
      e AS (SELECT read_id, q, substr(seq, q::INT, 1) <> 'N' AS ok FROM p),
      g AS (SELECT read_id, q, q - row_number() OVER (PARTITION BY read_id ORDER BY q) AS grp FROM e WHERE ok),
      s AS (SELECT read_id, min(q) - 1 AS a, max(q) AS z FROM g GROUP BY read_id, grp)
      SELECT s.read_id, NOT contains(seq, 'N') AS ok, instr(seq, 'N')::BIGINT AS first_bad, (row_number() OVER (PARTITION BY s.read_id ORDER BY a) - 1)::BIGINT AS i, a::BIGINT AS span_start, z::BIGINT AS span_end FROM s JOIN reads USING (read_id)"""),
    "fasta_wrap": _with(Y.READS_SQL, body=" SELECT read_id, md5(array_to_string(list_transform(range(0, (length(seq) + 59) // 60), lambda i: substr(seq, (i * 60 + 1)::INT, 60)), chr(10))) AS wrapped_md5, md5(seq) AS flat_md5 FROM reads"),
    "id_canon": _with(Y.table_sql("headers"), body=r" SELECT DISTINCT regexp_replace(split_part(header, ' ', 1), '-dup[0-9]+(\.[0-9]+)?$', '') AS id FROM headers_t"),
    "first_token": _with(Y.table_sql("headers"), body=" SELECT doc_id, split_part(header, ' ', 1) AS token FROM headers_t"),
    "label_prefix": _with(Y.table_sql("headers"), body=" SELECT regexp_replace(label, '_[^_]*$', '') AS prefix, count(*) AS n FROM headers_t GROUP BY 1"),
    "kv_detail": _with(Y.table_sql("clips"), body=" SELECT clip_no, regexp_extract(detail, 'unit_len=([0-9]+)', 1)::BIGINT AS unit_len, regexp_extract(detail, 'copies=([0-9]+)', 1)::BIGINT AS copies FROM clips_t"),
    "milli_fmt": _with(Y.table_sql("calls"), body=" SELECT read_id, printf('%d.%03d', floor(identity_est * 1000 + 0.5::DOUBLE)::BIGINT // 1000, floor(identity_est * 1000 + 0.5::DOUBLE)::BIGINT % 1000) AS ident, printf('%d.%03d', floor(identity_est / 7 * 1000 + 0.5::DOUBLE)::BIGINT // 1000, floor(identity_est / 7 * 1000 + 0.5::DOUBLE)::BIGINT % 1000) AS seventh FROM calls_t"),
    "edit_distance_band": _with(Y.READS_SQL, body=f" SELECT read_id, least(levenshtein(seq, {Y.rc_sql('seq')}), 16)::BIGINT AS ed, least(levenshtein(seq, substr(seq, 4)), 11)::BIGINT AS ed_shift FROM reads"),
    "hamming_identity": _with(Y.READS_SQL, body=f" SELECT read_id, (length(seq) - hamming(seq, {Y.rc_sql('seq')}))::BIGINT AS matches FROM reads"),
    "div_floor": " SELECT doc_id, floor((doc_id - 500)::DOUBLE / 120)::BIGINT AS bin FROM documents",
    "minimizers_fwd": _with(Y.READS_SQL, minimizers_sql("m", "reads"), body=" SELECT * FROM m"),
    "minimizers_canon": _with(Y.READS_SQL, minimizers_sql("m", "reads", True), body=" SELECT * FROM m"),
    "repetitive_filter": _with(Y.READS_SQL, minimizers_sql("m", "reads"), body=", c AS (SELECT read_id, val, count(*) AS c FROM m GROUP BY 1, 2) SELECT read_id, count(*) AS vals, count(*) FILTER (c > 64) AS dropped, max(c) AS most FROM c GROUP BY 1"),
    "length_gates": _with(Y.READS_SQL, minimizers_sql("m", "reads"), body=f", c AS (SELECT read_id, count(*) AS n FROM m GROUP BY 1) SELECT read_id, length(seq) >= {K + W + 10} AS long_enough, coalesce(n, 0) >= 10 AS enough FROM reads LEFT JOIN c USING (read_id)"),
}
