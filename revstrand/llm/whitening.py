"""Embedding whitening from a covariance that is made in tiles.

Vectors are cut into blocks of rows and of columns. Pairs of column blocks are the tile keys: column blocks meet by their block of
rows, each pair is multiplied, and products are added up per tile, so no task holds more than a few tiles and no vector is copied to
more than the tiles of its columns. The assembled matrix (dimension squared) is decomposed on the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import cut, table
from .codes import kept, matrix

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Columns of a tile, rows of a block, and tiles that a task adds up before it passes them on.
TILE, ROWS, HELD = 32, 2048, 64
#: Components are exact up to this size.
MOST = 1 << 42


def whole_vectors(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id and x = floor(64 c) + 1000000 of the rows whose vector and components are neither null nor infinite nor NaN."""
    big = F.raise_error(F.lit("a component is too large for exact sums")).cast("long")
    x = F.transform(vector, lambda c: F.when(F.abs(c.cast("double") * SCALE) < MOST, F.floor(c.cast("double") * SCALE) + OFFSET).otherwise(big))
    return kept(vectors, vector).select(F.col(id).alias("id"), x.alias("x"))


def _blocks(rows: DataFrame, values, width: int) -> DataFrame:
    """row_block, col, n, kind, body: the values of every block of rows, cut into blocks of TILE columns.

    rows must be a written table: a task that is run again then makes the same blocks, so those of one row block fit together.
    """

    def go(batches):
        part, no = TaskContext.get().partitionId(), 0
        for b in batches:
            v = values(b)
            if v.dtype.kind == "i" and (not v.size or np.abs(v).max() < 1 << 31):
                v = v.astype(np.int32)
            for i in range(0, len(v), ROWS):
                out = []
                for c in range(0, width, TILE):
                    out.append(((part << 32) + no, c // TILE, len(v[i : i + ROWS]), v.dtype.str, np.ascontiguousarray(v[i : i + ROWS, c : c + TILE]).tobytes()))
                no += 1
                yield pa.RecordBatch.from_pydict({k: [o[j] for o in out] for j, k in enumerate(("row_block", "col", "n", "kind", "body"))})

    return rows.mapInArrow(go, "row_block long, col long, n long, kind string, body binary")


def covariance(rows: DataFrame, values, centre: np.ndarray, n: int) -> np.ndarray:
    """Covariance (divisor n) of values(batch) over all rows of a written table, centred on `centre` before multiplying."""
    width = len(centre)
    left = _blocks(rows, values, width)
    right = left.select(F.col("row_block"), F.col("col").alias("col2"), F.col("kind").alias("kind2"), F.col("body").alias("body2"))
    pairs = left.join(right, (left["row_block"] == right["row_block"]) & (F.col("col") <= F.col("col2"))).select("col", "col2", "n", "kind", "body", "kind2", "body2")

    def go(batches):
        held: dict[tuple[int, int], np.ndarray] = {}

        def flushed():
            for (a, z), t in held.items():
                cells = t.reshape(-1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), a)), pa.array(np.full(len(cells), z)), pa.array(np.arange(len(cells))), pa.array(cells)], names=["col", "col2", "cell", "v"])
            held.clear()

        for b in batches:
            for a, z, m, ka, xa, kz, xz in zip(*(b.column(c).to_pylist() for c in b.schema.names)):
                one = np.frombuffer(xa, ka).reshape(m, -1) - centre[a * TILE : (a + 1) * TILE]
                two = one if a == z else np.frombuffer(xz, kz).reshape(m, -1) - centre[z * TILE : (z + 1) * TILE]
                held[a, z] = held[a, z] + one.T @ two if (a, z) in held else one.T @ two
                if len(held) > HELD:
                    yield from flushed()
        yield from flushed()

    cells = pairs.mapInArrow(go, "col long, col2 long, cell long, v double").groupBy("col", "col2", "cell").agg(F.sum("v").alias("v")).toArrow()
    col, col2, cell, v = (np.asarray(cells.column(c)) for c in ("col", "col2", "cell", "v"))
    out = np.zeros((width, width))
    wide = np.minimum((col2 + 1) * TILE, width) - col2 * TILE
    i, j = col * TILE + cell // wide, col2 * TILE + cell % wide
    out[i, j] = out[j, i] = v / n
    return out


def _totals(rows: DataFrame, values, width: int) -> list:
    """Exact sums of integers, or plain sums of numbers, per dimension; tasks send a row per dimension."""

    def go(batches):
        total = None
        for b in batches:
            v = values(b)
            s = v.sum(axis=0)
            total = s if total is None else total + s
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array([str(x) if whole else repr(float(x)) for x in total.tolist()])], names=["i", "v"])

    whole = values is _x
    some = rows.mapInArrow(go, "i long, v string")
    got = some.groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)" if whole else "double")).alias("v")).toArrow().to_pydict()
    out = [0] * width
    for i, v in zip(got["i"], got["v"]):
        out[i] = int(v) if whole else v
    return out


def _x(batch) -> np.ndarray:
    a = batch.column("x")
    width = len(a[0]) if len(a) else 0
    return matrix(a, width).astype(np.int64)


class Whitening:
    """What turns a vector into its components: n and sums of the fit list, unit eigenvectors (columns) and eigenvalues."""

    def __init__(self, n: int, sums: list[int], trace: float, values: np.ndarray, vectors: np.ndarray):
        self.n, self.sums, self.trace, self.values, self.vectors = n, sums, trace, values, vectors
        self.pivot = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.pivot) - self.rest / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x) @ self.vectors) / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2 over the dimensions, exactly; None where it exceeds a long."""
        y = x - self.pivot
        if y.size and (float(np.abs(y).max()) + 1) ** 2 * float(self.n) ** 2 * y.shape[1] < 2.0**62:
            t = y * self.n - self.rest
            return (t * t).sum(axis=1).tolist()
        t = y.astype(object) * self.n - self.rest.astype(object)
        return [v if v < 1 << 63 else None for v in (t * t).sum(axis=1)]


def fit(distinct: DataFrame, n: int, width: int, components: int = COMPONENTS) -> Whitening:
    """The whitening of a written table of distinct x. Components whose eigenvalue is nothing but rounding are left out."""
    sums = _totals(distinct, _x, width)
    pivot = np.array([s // n for s in sums], np.int64)
    v = covariance(distinct, lambda b: _x(b) - pivot, np.array([s % n / n for s in sums]), n)
    e, w = np.linalg.eigh(v)
    order = [i for i in np.argsort(-e, kind="stable")[:components] if e[i] > 0 and e[i] > max(e) * width * 1e-14]
    return Whitening(n, sums, float(np.trace(v)), e[order], w[:, order])


def whiten(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error: a row per kept row and component.

    Rows with a null vector or a null or non-finite component are left out. The fit takes each distinct x once; repeated rows stay
    rows of the result, null ids too. Components of equal eigenvalue come in any order; those without variance (a constant
    dimension, fewer distinct vectors than components) are left out, so a table with one distinct vector, an empty table and empty
    vectors give no rows. Vectors of differing lengths and components of 2^36 or more are refused. deviation is null where it
    exceeds a long. Other columns are ignored. On the driver: the matrix, dimension squared.
    """
    spark = vectors.sparkSession
    kind = f"{id} {vectors.schema[id].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = whole_vectors(vectors, id, vector)
    distinct = cut(rows.select("x").distinct(), "whitening-fit")
    n, least, width = distinct.agg(F.count("*"), F.min(F.size("x")), F.max(F.size("x"))).first()
    if n and least != width:
        raise ValueError(f"vectors have {least} to {width} components")
    w = fit(distinct, n, width, components) if n and width else None
    if w is None or not len(w.values):
        return spark.createDataFrame([], kind)
    k = len(w.values)
    shared = spark.sparkContext.broadcast(w)
    mean = np.array(_totals(distinct, lambda b: shared.value.whitened(_x(b)), k)) / n
    error = float(np.abs(covariance(distinct, lambda b: shared.value.whitened(_x(b)), mean, n) - np.eye(k)).max())

    def go(batches):
        w = shared.value
        share = w.values / w.trace
        for b in batches:
            if not b.num_rows:
                continue
            x = _x(b)
            m, at = len(x), np.repeat(np.arange(len(x)), k)
            cols = [b.column("id").take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, w.n)), pa.array(w.deviation(x), pa.int64()).take(pa.array(at))]
            cols += [pa.array(w.whitened(x).reshape(-1)), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error))]
            yield pa.RecordBatch.from_arrays(cols, names=[id, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(go, kind)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whitened components of every kept row of `embeddings`."""
    return whiten(table(spark, sf_dir, "embeddings"))
