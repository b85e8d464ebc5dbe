"""The alignment-based baseline: classify self-alignments of reads (PAF), chop palindromes, twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_self_hit(paf: DataFrame) -> DataFrame:
    """First minus-strand alignment of each read with itself, in file order."""
    own = paf.where((F.col("qname") == F.col("tname")) & (F.col("strand") == "-"))
    return own.withColumn("_n", F.row_number().over(Window.partitionBy("qname").orderBy("line_no"))).where("_n = 1").drop("_n")


def classify(paf: DataFrame, edge: float = 0.10) -> DataFrame:
    """isend (3 both ends, 1 start, 2 end, 0 inside), relative start and end, overlap share and the range to cut."""
    h = first_self_hit(paf)
    n = F.col("tlen")
    at_start, at_end = F.col("tstart") <= edge * n, F.col("tend") >= (1 - edge) * n
    h = h.withColumn("isend", F.when(at_start & at_end, 3).when(at_start, 1).when(at_end, 2).otherwise(0))
    mid = F.floor((F.col("tstart") + F.col("tend")) / 2).cast("long")
    h = h.withColumn("cut_from", F.when(F.col("isend") == 1, F.lit(0).cast("long")).otherwise(mid)).withColumn("cut_to", F.when(F.col("isend") == 1, mid).otherwise(n))
    six = lambda c: F.round(c, 6)
    return h.select("qname", "tlen", "tstart", "tend", "isend", six(F.col("tstart") / n).alias("start_pos"), six(F.col("tend") / n).alias("end_pos"), "cut_from", "cut_to", six((F.col("tend") - F.col("tstart")) / n).alias("overlap_prop"))


def chop(reads: DataFrame, classes: DataFrame, least: int = 500) -> DataFrame:
    """Children of chopped reads and the reads passed on: out(id, start, end, kind).

    A read is chopped if its alignment touches an end or starts past 0.3 of it; children shorter than `least` go.
    """
    j = reads.select(F.col("read_id").alias("qname"), F.col("len")).join(classes.drop("tlen"), "qname", "left")
    hit = F.coalesce((F.col("isend") != 0) | (F.col("start_pos") > 0.3), F.lit(False))
    tag = F.when(F.col("isend") == 0, "-dup023").otherwise("-dup1")
    mid = F.when(F.col("isend") == 1, F.col("cut_to")).otherwise(F.col("cut_from"))
    child = lambda k, a, b: F.struct(F.concat("qname", tag, F.lit(f".{k}")).alias("id"), a.cast("long").alias("start"), b.cast("long").alias("end"), F.lit("chopped").alias("kind"))
    whole = F.struct(F.col("qname").alias("id"), F.lit(0).cast("long").alias("start"), F.col("len").cast("long").alias("end"), F.lit("include").alias("kind"))
    parts = F.when(hit, F.filter(F.array(child(1, F.lit(0), mid), child(2, mid, F.col("len"))), lambda x: x["end"] - x["start"] >= least)).otherwise(F.array(whole))
    return j.select("qname", F.explode(parts).alias("x")).select(F.col("qname").alias("parent"), "x.*")


def two_iterations(reads: DataFrame, first: DataFrame, second: DataFrame, least: int = 500) -> DataFrame:
    """Classify and chop by the first alignment, then the chopped children once more by the second; all that is left, together."""
    one = chop(reads, classify(first), least)
    again = one.where("kind = 'chopped'").select(F.col("id").alias("read_id"), (F.col("end") - F.col("start")).alias("len"))
    two = chop(again, classify(second), least)
    return one.where("kind = 'include'").select("id", (F.col("end") - F.col("start")).alias("len"), F.lit(1).alias("round")).unionByName(two.select("id", (F.col("end") - F.col("start")).alias("len"), F.lit(2).alias("round")))
