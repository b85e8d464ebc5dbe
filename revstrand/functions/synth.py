"""Deterministic sequences and tables derived from the ids of a table, identical in Spark and in SQL.

`portable` tables are written once in the SQL that Spark and DuckDB share ({documents} names the id table). Sequences need
engine-specific array functions, so they are given twice: as Columns here and as SQL text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import seq as S

ARM, GAP, PALINDROMES = 600, 400, 7


def dna(seed: Column, n: int) -> Column:
    """n bases from a seed text: md5 digits mapped to bases."""
    parts = F.transform(F.sequence(F.lit(0), F.lit((n - 1) // 32)), lambda i: F.md5(F.concat_ws(":", seed, i.cast("string")).cast("binary")))
    return F.substring(F.translate(F.array_join(parts, ""), "0123456789abcdef", "ACGTACGTACGTACGT"), 1, n)


def dna_sql(seed: str, n: int) -> str:
    return f"substr(translate(array_to_string(list_transform(range(0, {(n + 31) // 32}), lambda i: md5({seed} || ':' || i)), ''), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, {n})"


def _kind(d: Column) -> Column:
    return F.pmod(d, F.lit(6))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_id, seq by doc_id % 6: clean foldback, gapped one, random, shared palindrome, every 20th base changed, short or with N."""
    ids = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    # ids are dealt out before they become sequences: a file of few bytes is one task, and what follows is much work per byte
    ids = ids.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    d, kind = F.col("doc_id"), _kind(F.col("doc_id"))
    name = d.cast("string")
    own = dna(F.concat(F.lit("a"), name), ARM)
    rows = ids.withColumn("kind", kind).withColumn("arm", F.when(kind == 3, dna(F.concat(F.lit("p"), F.pmod(F.floor(d / 6), F.lit(PALINDROMES)).cast("string")), ARM)).otherwise(own))
    rows = rows.withColumn("rc", S.revcomp("arm"))
    changed = F.regexp_replace("rc", "([ACGT]{19})[ACGT]", "$1A")
    seq = (
        F.when(F.col("kind") == 1, F.concat("arm", dna(F.concat(F.lit("g"), name), GAP), "rc")).when(F.col("kind") == 2, F.concat("arm", dna(F.concat(F.lit("r"), name), ARM)))
        .when(F.col("kind") == 4, F.concat("arm", changed)).when((F.col("kind") == 5) & (d % 12 == 5), F.substring("arm", 1, 40))
        .when(F.col("kind") == 5, F.concat("arm", F.lit("N" * 50), "rc")).otherwise(F.concat("arm", "rc"))
    )
    return rows.select(F.concat(F.lit("r"), name).alias("read_id"), "doc_id", seq.alias("seq"))


def rc_sql(x: str) -> str:
    return f"reverse(translate({x}, '{S.IUPAC}', '{S.COMPLEMENT}'))"


READS_SQL = f"""
reads AS (
  SELECT 'r' || doc_id AS read_id, doc_id, CASE
    WHEN kind = 1 THEN arm || {dna_sql("'g' || doc_id", GAP)} || rc
    WHEN kind = 2 THEN arm || {dna_sql("'r' || doc_id", ARM)}
    WHEN kind = 4 THEN arm || regexp_replace(rc, '([ACGT]{{19}})[ACGT]', '\\1A', 'g')
    WHEN kind = 5 AND doc_id % 12 = 5 THEN substr(arm, 1, 40)
    WHEN kind = 5 THEN arm || '{"N" * 50}' || rc
    ELSE arm || rc END AS seq
  FROM (SELECT *, {rc_sql("arm")} AS rc FROM (
    SELECT doc_id, doc_id % 6 AS kind, CASE WHEN doc_id % 6 = 3 THEN {dna_sql(f"'p' || ((doc_id // 6) % {PALINDROMES})", ARM)} ELSE {dna_sql("'a' || doc_id", ARM)} END AS arm FROM documents))
)"""

# Portable tables. h(doc_id, c) stands for a small pseudo-random number: (doc_id * 7919 + c) % m.
PORTABLE = {
    # calls of read mode
    "calls": """
      SELECT CONCAT('r', CAST(doc_id AS STRING)) AS read_id, CONCAT('s', CAST(doc_id % 3 AS STRING)) AS sample, doc_id, 2000 + (doc_id * 37) % 9000 AS len,
        1000 + (doc_id * 37) % 4500 AS refined_split, (doc_id * 13) % 7 * 20 AS gap_est, 10 + (doc_id * 7) % 90 AS matches,
        CAST(500 + (doc_id * 7919 + 11) % 501 AS DOUBLE) / 1000 AS identity_est,
        CASE WHEN doc_id % 11 = 0 THEN NULL ELSE CONCAT('sig', CAST(CASE WHEN doc_id % 4 = 0 THEN doc_id % 28 ELSE doc_id END AS STRING)) END AS sig
      FROM {documents}""",
    "report": """
      SELECT CONCAT('r', CAST(doc_id AS STRING)) AS read_id, CONCAT('s', CAST(doc_id % 3 AS STRING)) AS sample, 2000 + (doc_id * 37) % 9000 AS len,
        1000 + (doc_id * 37) % 4500 AS refined_split, (doc_id * 13) % 7 * 20 AS gap_est, CAST(500 + (doc_id * 7919 + 11) % 501 AS DOUBLE) / 1000 AS identity_est,
        CASE WHEN doc_id % 5 < 3 THEN 'artefact' WHEN doc_id % 5 = 3 THEN 'real' WHEN doc_id % 10 = 4 THEN 'low_ident' ELSE 'unknown' END AS decision
      FROM {documents} WHERE doc_id % 7 <> 2""",
    "samples": "SELECT CONCAT('r', CAST(doc_id AS STRING)) AS read_id, CONCAT('s', CAST(doc_id % 3 AS STRING)) AS sample, 2000 + (doc_id * 37) % 9000 AS len FROM {documents}",
    # planted repeats and calls on contigs
    "truth": """
      SELECT doc_id AS truth_id, CONCAT('c', CAST(doc_id % 20 AS STRING)) AS contig, doc_id * 300 AS t0, doc_id * 300 + 400 + (doc_id * 31) % 500 AS t1,
        CONCAT('g', CAST(doc_id % 6 AS STRING)) AS scenario_group, CAST(900 + doc_id % 100 AS DOUBLE) / 1000 AS true_identity
      FROM {documents} WHERE doc_id % 2 = 0""",
    "ir_calls": """
      SELECT doc_id AS call_id, CONCAT('c', CAST((doc_id - doc_id % 2) % 20 AS STRING)) AS contig, (doc_id - doc_id % 2) * 300 + (doc_id * 53) % 700 AS start,
        (doc_id - doc_id % 2) * 300 + (doc_id * 53) % 700 + 200 + (doc_id * 17) % 600 AS `end`, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE CAST(400 + (doc_id * 7919) % 601 AS DOUBLE) / 1000 END AS tir_ident,
        (doc_id * 29) % 140 AS kept_pts, (doc_id * 23) % 160 AS matches, (doc_id * 19) % 3000 AS arm_len, (doc_id * 41) % 150000 - 5000 AS spacer, 100000 + (doc_id - doc_id % 2) % 20 * 500 AS contig_len,
        (doc_id * 7919) % 250000 AS interval_len
      FROM {documents}""",
    # candidates of assembly mode, in contig coordinates
    "cands": """
      SELECT CONCAT('c', CAST(doc_id % 10 AS STRING)) AS contig, CAST(doc_id % 5 * 50000 AS BIGINT) AS win_start, CAST((doc_id * 7919) % 1000 AS BIGINT) AS bin, (doc_id * 7919) % 400000 + 5000 AS break_pos,
        20 + doc_id % 80 AS matches, CAST(600 + (doc_id * 31) % 401 AS DOUBLE) / 1000 AS identity_est, CAST(500000 AS BIGINT) AS contig_len,
        (doc_id * 7919) % 400000 + 5000 - 1000 - (doc_id * 3) % 700 AS la0, (doc_id * 7919) % 400000 + 5000 - (doc_id * 5) % 300 AS la1,
        (doc_id * 7919) % 400000 + 5000 + (doc_id * 5) % 400 AS ra0, (doc_id * 7919) % 400000 + 5000 + CASE WHEN doc_id % 9 = 0 THEN 290000 ELSE 1000 END + (doc_id * 3) % 900 AS ra1
      FROM {documents}""",
    "scanned": "SELECT DISTINCT CONCAT('c', CAST(doc_id % 12 AS STRING)) AS contig, CAST(doc_id % 7 * 50000 AS BIGINT) AS win_start FROM {documents}",
    # ids of two tools, a baseline's breakpoints, clips and events
    "ours": "SELECT CONCAT('r', CAST(doc_id AS STRING)) AS id, CASE WHEN doc_id % 5 < 3 THEN 'artefact' WHEN doc_id % 5 = 3 THEN 'low_ident' ELSE 'real' END AS decision, 1000 + (doc_id * 37) % 4500 AS refined_split FROM {documents} WHERE doc_id % 4 <> 1",
    "base": "SELECT CONCAT('r', CAST(doc_id AS STRING)) AS id, CASE WHEN doc_id % 17 = 0 THEN NULL ELSE 1000 + (doc_id * 37) % 4500 + (doc_id * 7919) % 1400 * (doc_id % 3) END AS bp FROM {documents} WHERE doc_id % 3 <> 1",
    "clips": """
      SELECT CONCAT('r', CAST(CAST(floor(doc_id / 2) AS BIGINT) AS STRING)) AS read_id, doc_id AS clip_no, (doc_id * 29) % 50 AS clip_len,
        CASE doc_id % 4 WHEN 0 THEN 'local_inversion' WHEN 1 THEN 'tandem' WHEN 2 THEN 'chimera' ELSE 'other' END AS artifact_class,
        CONCAT('unit_len=', CAST(doc_id % 90 AS STRING), ',copies=', CAST(doc_id % 5 AS STRING)) AS detail
      FROM {documents}""",
    "events": """
      SELECT CONCAT('r', CAST(CAST(floor(doc_id / 3) AS BIGINT) AS STRING)) AS read_id, CASE WHEN doc_id % 5 = 0 THEN 'inter' ELSE CAST((doc_id * 7919) % 5000 AS STRING) END AS distance FROM {documents}""",
    "expect": """
      SELECT CONCAT('r', CAST(doc_id AS STRING)) AS label, CASE WHEN doc_id % 8 = 0 THEN 0 ELSE 1000 + (doc_id * 37) % 4500 + (doc_id * 11) % 220 END AS split,
        CASE WHEN doc_id % 5 < 3 THEN 'artefact' WHEN doc_id % 5 = 3 THEN 'real' ELSE 'low_ident' END AS want
      FROM {documents}""",
    "paf": """
      SELECT doc_id AS line_no, CONCAT('r', CAST(CAST(floor(doc_id / 2) AS BIGINT) AS STRING)) AS qname, CONCAT('r', CAST(CAST(floor(doc_id / 2) AS BIGINT) + CASE WHEN doc_id % 9 = 0 THEN 1 ELSE 0 END AS STRING)) AS tname,
        CASE WHEN doc_id % 7 = 3 THEN '+' ELSE '-' END AS strand, 3000 + CAST(floor(doc_id / 2) AS BIGINT) % 5000 AS tlen, (doc_id * 53) % 1600 AS tstart, 1700 + (doc_id * 31) % 1300 AS tend
      FROM {documents}""",
    "paf_reads": "SELECT CONCAT('r', CAST(doc_id AS STRING)) AS read_id, 3000 + doc_id % 5000 AS len FROM {documents} WHERE doc_id % 2 = 0 OR doc_id < 100",
    "paf2": """
      SELECT doc_id AS line_no, CONCAT('r', CAST(doc_id AS STRING), CASE doc_id % 3 WHEN 0 THEN '-dup1.1' WHEN 1 THEN '-dup1.2' ELSE '-dup023.1' END) AS qname,
        CONCAT('r', CAST(doc_id AS STRING), CASE doc_id % 3 WHEN 0 THEN '-dup1.1' WHEN 1 THEN '-dup1.2' ELSE '-dup023.1' END) AS tname, '-' AS strand, CAST(1500 AS BIGINT) AS tlen, (doc_id * 53) % 700 AS tstart, 800 + (doc_id * 31) % 700 AS tend
      FROM {documents}""",
    "hits": """
      SELECT CONCAT('r', CAST(CAST(floor(doc_id / 2) AS BIGINT) AS STRING)) AS read_id, doc_id AS hit_no, (doc_id * 7) % 400 AS qstart, 500 + (doc_id * 13) % 1000 AS qend, 600 + (doc_id * 17) % 2000 AS send, 100 + (doc_id * 29) % 900 AS length
      FROM {documents}""",
    "headers": """
      SELECT doc_id, CONCAT('read', CAST(doc_id % 300 AS STRING), CASE doc_id % 4 WHEN 0 THEN '-dup1.1' WHEN 1 THEN '-dup023.2' WHEN 2 THEN '-dup2' ELSE '' END, CASE WHEN doc_id % 3 = 0 THEN ' run 7' ELSE '' END) AS header,
        CONCAT('art_hi_', CAST(doc_id % 9 AS STRING), CASE WHEN doc_id % 2 = 0 THEN '_x' ELSE '' END) AS label
      FROM {documents}""",
    "sweeps": """
      SELECT CONCAT('k', CAST(doc_id % 25 AS STRING)) AS tag, SUM(doc_id % 7) AS tp, SUM(doc_id % 3) AS fp, SUM(doc_id % 5) AS fn FROM {documents} GROUP BY CONCAT('k', CAST(doc_id % 25 AS STRING))""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ids = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return spark.sql(PORTABLE[name], documents=ids)


def table_sql(name: str) -> str:
    """The same table as a named subquery for DuckDB."""
    return f"{name}_t AS ({PORTABLE[name].replace('{documents}', 'documents').replace('`', chr(34))})"
