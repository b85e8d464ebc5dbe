"""Mixing sources to target weights by Pareto order sampling.

Each source gets a word budget (its target). A document is expected `target / source size` times: the whole part of that number
is allocated as certain copies; the rest of the budget is drawn. A document's inclusion odds for one more copy are those of the
fraction, times the root of its size over the source's mean size: large documents
come early and small ones are left to fill the budget, so the total is steadier than with equal odds. Documents are ranked by
random odds over inclusion odds (Pareto order sampling). The sample's size is fixed in words: the longest prefix of the ranking
that fits the budget, then in the same order those after it that fit what is left, in ROUNDS prefixes, and at the end the one
document whose size is nearest to what is still missing, if it brings the total nearer to the target.

The prefix is found without bringing a source's documents together: sizes are summed over a grid of rank bins per source, the
bin that crosses the budget is found on that small table and cut into a grid again, until what it holds can be ordered in one
task. A source that holds most rows costs no more than its rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import cut, drop, table

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: Bins of a grid of ranks, and documents of one source that are ordered in one task.
BINS, FEW = 4096, 100_000
#: Prefixes of the ranking that are taken, each of the documents that fit what the one before left.
ROUNDS = 3
#: Grids inside grids; at 4096 ** 4 bins a double has no more digits, so what is left are equal ranks, which go together anyway.
LEVELS = 4


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)).cast("long"), F.lit(0).cast("long"))


def random_unit(key: Column) -> Column:
    """A repeatable number in (0, 1): 52 bits of the md5 of the key."""
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """source, source_size, target of each source. `sizes`: source, source_size.

    Weights repeat over the sources in code point order, null last. Shares above `most` times a source's size stop there;
    the excess goes to the others by weight. With sources in order of cap over weight the stopped ones are a prefix, so one
    pass of running sums finds them; the sums are of whole numbers and exact.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(x).cast("long") for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    t = sizes.withColumn("w", w).withColumn("cap", F.lit(most).cast("long") * F.col("source_size"))
    # cap/w ascending; whole-number cross products would overflow for huge tables, the quotient only decides the order
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"))
    upto, every = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    t = t.withColumn("rest", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(upto), F.lit(0)))
    t = t.withColumn("rest_w", F.sum("w").over(every) - F.coalesce(F.sum("w").over(upto), F.lit(0)))
    level = F.col("rest") / F.col("rest_w")
    t = t.withColumn("free", level * F.col("w") <= F.col("cap"))
    # the first free source in this order fixes the level for all that follow
    t = t.withColumn("first", F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"), "rest", "rest_w"))).over(every))
    t = t.withColumn("n", F.row_number().over(by)).withColumn("n_first", F.min(F.when(F.col("free"), F.col("n"))).over(every))
    at = F.when(F.col("n") >= F.col("n_first"), F.col("first.rest") * F.col("w") / F.col("first.rest_w")).otherwise(F.col("cap").cast("double"))
    return t.select("source", "source_size", F.coalesce(at, F.lit(0.0)).alias("target"))


def rank(u: Column, part: Column, mean_size: Column, size: Column) -> Column:
    """Random odds over inclusion odds: documents are taken from the smallest on."""
    odds = (part / (1 - part)) * F.sqrt(F.greatest(size, F.lit(1)) / mean_size)
    return (u / (1 - u)) / odds


def _on(rows: DataFrame, by_source: DataFrame, how: str = "inner") -> DataFrame:
    """rows with the columns of their source, a null source being one like others."""
    return rows.join(by_source.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), how).drop("_s")


def _crossing(ranked: DataFrame, bins: int, few: int) -> DataFrame:
    """source, lo, hi, base of the range of v, in which ranks lie, that crosses the source's gap, and the words ranked before it.

    ranked: source, v (0 to 1, rising with the rank), size, gap. Sources that fit their gap whole have no row.
    """
    # v may round up to 1, so the first range goes beyond it
    at = ranked.select("source", "gap").distinct().select("source", "gap", F.lit(0.0).alias("lo"), F.lit(2.0).alias("hi"), F.lit(0).cast("decimal(38,0)").alias("base"))
    rows, found, old = ranked.select("source", "v", "size"), None, []
    for _ in range(LEVELS):
        # a range's width is a power of two, so bin limits are exact and a rank is in one bin
        here = _on(rows, at).where((F.col("v") >= F.col("lo")) & (F.col("v") < F.col("hi")))
        here = here.withColumn("bin", F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins).cast("long"))
        grid = here.groupBy("source", "bin").agg(F.sum("size").cast("decimal(38,0)").alias("in_bin"), F.count("*").alias("n"), F.first("gap").alias("gap"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.first("base").alias("base"))
        grid = grid.withColumn("base", F.col("base") + F.sum("in_bin").over(Window.partitionBy("source").orderBy("bin")) - F.col("in_bin"))
        step = (F.col("hi") - F.col("lo")) / bins
        grid = grid.where("base <= gap AND base + in_bin > gap").select("source", "gap", (F.col("lo") + F.col("bin") * step).alias("lo"), (F.col("lo") + (F.col("bin") + 1) * step).alias("hi"), F.col("base").cast("decimal(38,0)").alias("base"), "n")
        found = cut(grid, "mix-cross")
        old.append(found)
        if (found.agg(F.max("n")).first()[0] or 0) <= few:
            break
        at = found.drop("n")
    drop(*old[:-1])
    return found.select("source", "lo", "hi", "base")


def _prefix(ranked: DataFrame, bins: int, few: int) -> DataFrame:
    """source, stop (q, doc_id, size of the first documents that don't fit; null where all do), left (what the prefix leaves of the gap).

    ranked: source, q, v, doc_id, size, gap. Equal ranks are one.
    """
    cross = _crossing(ranked, bins, few)
    edge = _on(ranked, cross).where((F.col("v") >= F.col("lo")) & (F.col("v") < F.col("hi")))
    unit = edge.groupBy("source", *KEY).agg(F.count("*").alias("n"), F.first("base").alias("base"), F.first("gap").alias("gap"))
    upto = Window.partitionBy("source").orderBy(*KEY).rowsBetween(Window.unboundedPreceding, 0)
    unit = unit.withColumn("upto", F.sum(F.col("size") * F.col("n")).over(upto) + F.col("base"))
    stop = unit.where("upto > gap").groupBy("source").agg(F.min(F.struct(*KEY, "n", "upto", "gap")).alias("s"))
    stop = stop.select("source", F.struct(*[F.col(f"s.{k}").alias(k) for k in KEY]).alias("stop"), (F.col("s.gap") - (F.col("s.upto") - F.col("s.size") * F.col("s.n")).cast("double")).alias("_left"))
    sums = ranked.groupBy("source").agg((F.first("gap") - F.sum("size")).alias("_all"))
    return _on(sums, stop, "left").select("source", "stop", F.coalesce("_left", "_all").alias("left"))


#: The order of documents of a source: rank, then id (null first), then size.
KEY = ("q", "doc_id", "size")


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES, seed: str = "", bins: int = BINS, keep: tuple[str, ...] = (), keep_source: bool = False, few: int = FEW) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies (and `source` and the columns in `keep`) of each row of docs(doc_id, text, source).

    Null or empty text: size 0, taken 0. Null source: a source of its own, last. Ranks depend on doc_id, size and `seed` alone, so
    reruns agree; ties go by doc_id (null first) and size. Rows of one doc_id, source and size (repeats, and null ids) have one
    rank and are taken together or not at all; none of them closes a gap. Long texts are counted whole. An empty table gives an
    empty result. Columns of docs that clash with the result's names are ignored unless they are in `keep`, which takes no such name.
    """
    if clash := {"doc_id", "size", "source_size", "target", "taken", "copies", "source"} & set(keep):
        raise ValueError(f"columns of the result can't be kept besides: {sorted(clash)}")
    rows = docs.select(F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"), *[F.col(c).alias(f"_k_{c}") for c in keep])
    u = random_unit(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    full = rows.withColumn("u", u)
    rows = cut(full.select("doc_id", "source", "size", "u"), "mix-sizes")  # texts are read once for the sizes, not by every step
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), (F.sum("size") / F.count("*")).alias("mean_size"))
    goal = _on(targets(sums.select("source", "source_size"), weights, most), sums.select("source", "mean_size"))
    goal = goal.withColumn("mean", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    goal = goal.withColumn("whole", F.floor("mean").cast("long")).withColumn("part", F.col("mean") - F.floor("mean"))
    goal = cut(goal.withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")), "mix-goal")

    # v is the rank with the source's fraction taken out, on (0, 1): as even as random numbers where sizes are alike
    q = F.when((F.col("part") > 0) & (F.col("mean_size") > 0), rank(F.col("u"), F.col("part"), F.col("mean_size"), F.col("size")))
    v = F.col("q") * F.col("part") / (1 - F.col("part") + F.col("q") * F.col("part"))
    # ranks are written once; every round reads them, and then what its predecessor has left
    ranks = cut(_on(rows, goal).withColumn("q", q).where("q IS NOT NULL").withColumn("v", v).select("source", "v", *KEY), "mix-ranks")
    key = F.struct(*KEY)
    at = goal.withColumn("left0", F.col("budget")).withColumn("stop0", F.expr("struct(double('-inf') AS q, cast(null AS long) AS doc_id, 0L AS size)"))
    end = F.expr("struct(double('inf') AS q, cast(null AS long) AS doc_id, 0L AS size)")
    took, open_, old = [], ranks, [goal]
    for i in range(ROUNDS):
        fits = (key > F.col(f"stop{i}")) & (F.col("size") <= F.col(f"left{i}"))
        # what fits now has fitted before, as stops rise and gaps shrink
        ranked = cut(_on(open_, at.select("source", f"stop{i}", f"left{i}")).where(fits).select("source", "v", F.col(f"left{i}").alias("gap"), *KEY), "mix-open")
        found = _prefix(ranked, bins, few).withColumn("_hit", F.lit(True))
        at = _on(at, found, "left").withColumn(f"stop{i + 1}", F.coalesce("stop", end)).withColumn(f"left{i + 1}", F.coalesce("left", f"left{i}"))
        at = cut(at.drop("stop", "left", "_hit"), "mix-stop")
        if open_ is not ranks:
            drop(open_)
        drop(old.pop())
        old.append(at)
        open_ = ranked
        took.append(fits & (key < F.col(f"stop{i + 1}")))
    taken = reduce(Column.__or__, took)
    # of the documents that aren't taken, the one that closes the gap best, if it makes it smaller
    after = _on(ranks, at).where(~taken).withColumn("gap", F.col(f"left{ROUNDS}"))
    closing = after.groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")), *KEY, "gap")).alias("c"))
    closing = closing.where("c.col1 < c.gap").select("source", F.col("c.doc_id").alias("cd"), F.col("c.size").alias("cs"))
    closes = F.col("doc_id").eqNullSafe(F.col("cd")) & (F.col("size") == F.col("cs"))
    closing = _on(after.select("source", "doc_id", "size"), closing).where(closes).groupBy("source").agg(F.count("*").alias("n"), F.first("cd").alias("cd"), F.first("cs").alias("cs")).where("n = 1").drop("n")
    ends = cut(_on(at, closing, "left"), "mix-ends")
    drop(open_, ranks)
    done = _on(full if keep else rows, ends).withColumn("q", q)
    extra = F.when(F.col("q").isNotNull() & (taken | F.coalesce(closes & F.col("cs").isNotNull(), F.lit(False))), 1).otherwise(0)
    done = done.withColumn("copies", (F.col("whole") + extra).cast("long"))
    return done.select("doc_id", F.col("size"), "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", *(["source"] if keep_source else []), *[F.col(f"_k_{c}").alias(c) for c in keep])


def op8_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
