"""Vector code compression: product quantisation by Elkan's form of Lloyd's iteration, in exact integers.

A vector is cut into equal parts, and every part position has a codebook. Each round assigns parts to their nearest entries and
moves the entries to their parts' means. Bounds live from round to round in a written table, next to the vectors: an upper bound of
each part's distance to its entry and a lower bound of its distance to every entry. When entries move, the bounds are shifted by
how far they moved. An entry is passed over only where its lower bound, or half its distance from the part's own entry, is strictly
above the upper bound; what is left is compared by integer squares, so ties go to the lower index and results equal the full search.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import cut, drop, scratch_path, table

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Steps of a stored lower bound. Bounds are rounded down to one of them, which costs pruning and never a result.
LEVELS = 31
#: Rows that are compared at once, and room for rounding in the bounds (distances are rounded 2^-52 or so).
BLOCK, SLACK = 4096, 1e-12


def kept(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector and its components are neither null nor infinite nor NaN."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.where(F.col(vector).isNotNull() & ~bad)


def matrix(column, width: int) -> np.ndarray:
    """An Arrow list column as a matrix; all vectors must have `width` components."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if (np.diff(np.asarray(a.offsets)) != width).any():
        raise ValueError(f"all vectors must have {width} components")
    return np.asarray(a.flatten()).reshape(len(a), width)


def whole(x: np.ndarray, scale: int, parts: int) -> np.ndarray:
    """floor(scale * x). Refused where squared distances of such vectors could leave a long."""
    y = np.floor(x.astype(np.float64) * scale)
    if y.size and np.abs(y).max() ** 2 * 4 * y.shape[1] >= 2.0**62:
        raise ValueError("components are too large for exact squared distances")
    return y.astype(np.int64)


def _up(x):
    return x * (1 + SLACK)


def _down(x):
    return x * (1 - SLACK)


class Books:
    """Codebooks (part, entry, position) with half the distances between entries, and how far each entry moved to get here."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None = None):
        self.entries = entries
        e = entries.astype(np.float64)
        square = (e * e).sum(2)
        gap = np.stack([((e[p][:, None, :] - e[p][None, :, :]) ** 2).sum(2) for p in range(len(e))]) if len(e) else square
        self.half = _down(np.sqrt(gap)) / 2
        self.moved = np.zeros(square.shape) if before is None else _up(np.sqrt(((entries - before).astype(np.float64) ** 2).sum(2)))


def nearest(x: np.ndarray, book: np.ndarray, half: np.ndarray, at: np.ndarray, upper: np.ndarray, lower: np.ndarray):
    """The nearest entry of each row of x, ties to the lower index. at, upper and lower (rows by entries) are brought up to date."""
    own = half.copy()
    np.fill_diagonal(own, np.inf)
    rows = np.flatnonzero(~(own.min(axis=1)[at] > upper)) if len(book) > 1 else np.arange(len(x))
    y, cur, low = x[rows], at[rows], lower[rows]
    best = ((y - book[cur]) ** 2).sum(axis=1)
    top = _up(np.sqrt(best.astype(np.float64)))
    low[np.arange(len(rows)), cur] = _down(np.sqrt(best.astype(np.float64)))
    for j in range(len(book)):
        see = np.flatnonzero((cur != j) & ~(low[:, j] > top) & ~(half[j][cur] > top))
        if not len(see):
            continue
        d = ((y[see] - book[j]) ** 2).sum(axis=1)
        low[see, j] = _down(np.sqrt(d.astype(np.float64)))
        win = (d < best[see]) | ((d == best[see]) & (j < cur[see]))
        to = see[win]
        cur[to], best[to], top[to] = j, d[win], _up(np.sqrt(d[win].astype(np.float64)))
    at[rows], upper[rows], lower[rows] = cur, top, low


_STATE = "x binary, at binary, upper binary, step binary, lower binary"


def _gathered(batches, rows: int = BLOCK):
    """The batches in larger ones, so that numpy works on enough rows at once."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _fixed(column, kind, width: int) -> np.ndarray:
    """A binary column of equal lengths as a matrix."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(a.to_pylist()), kind).reshape(len(a), width)


def _binary(values: np.ndarray) -> pa.Array:
    step, body = values.shape[1] * values.itemsize, np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(np.arange(len(values) + 1, dtype=np.int32) * step), pa.py_buffer(body.tobytes())])


def _assigned(t: pa.Table, books: Books, scale: int):
    """x, entries, upper and lower bounds of a block of rows, from their vectors (first round) or from what the last round kept."""
    parts, k, w = books.entries.shape
    if "vector" in t.column_names:
        x = whole(matrix(t.column("vector"), parts * w), scale, parts)
        at, upper, lower = np.zeros((len(x), parts), np.int64), np.full((len(x), parts), np.inf), np.zeros((parts, len(x), k))
    else:
        x = _fixed(t.column("x"), np.int32, parts * w).astype(np.int64)
        at = _fixed(t.column("at"), np.uint8, parts).astype(np.int64)
        moved = books.moved[np.arange(parts), at]
        upper = _up(_fixed(t.column("upper"), np.float64, parts) + moved)
        step, level = _fixed(t.column("step"), np.float64, parts), _fixed(t.column("lower"), np.uint8, parts * k).reshape(-1, parts, k)
        lower = np.stack([_down(np.maximum(_down(level[:, p] * step[:, p, None]) - books.moved[p], 0)) for p in range(parts)])
    for p in range(parts):
        a, u, one = at[:, p].copy(), upper[:, p].copy(), lower[p]
        nearest(x[:, p * w : (p + 1) * w], books.entries[p], books.half[p], a, u, one)
        at[:, p], upper[:, p] = a, u
    return x, at, upper, lower


def _round(rows: DataFrame, shared, scale: int, keep: str) -> DataFrame:
    """One assignment of all parts; returns the columns kept with the bounds of the next round."""
    kind = None

    def go(batches):
        books = shared.value
        for t in _gathered(batches):
            x, at, upper, lower = _assigned(t, books, scale)
            step = np.maximum(lower.max(axis=2).T / LEVELS, 1e-300)
            level = np.stack([np.minimum(np.floor(_down(lower[p] / step[:, p, None])), LEVELS) for p in range(len(lower))], axis=1).astype(np.uint8)
            cols = [_binary(x.astype(np.int32)), _binary(at.astype(np.uint8)), _binary(upper), _binary(step), _binary(level.reshape(len(x), -1))]
            yield from pa.Table.from_arrays([*(t.column(c) for c in names), *cols], names=[*names, "x", "at", "upper", "step", "lower"]).combine_chunks().to_batches(max_chunksize=BLOCK)

    names = [f.name for f in rows.schema.fields if f.name in ("id", "label")]
    kind = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in names), _STATE])
    return rows.mapInArrow(go, kind)


def _sums(state: DataFrame, parts: int, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts (part, entry) and component sums (part, entry, position): tasks send one row per used entry and position."""

    def go(batches):
        count, total = np.zeros((parts, k), np.int64), np.zeros((parts, k, w), np.int64)
        for t in _gathered(batches):
            x, at = _fixed(t.column("x"), np.int32, parts * w).astype(np.int64), _fixed(t.column("at"), np.uint8, parts).astype(np.int64)
            for p in range(parts):
                count[p] += np.bincount(at[:, p], minlength=k)
                order = np.argsort(at[:, p], kind="stable")
                first = np.flatnonzero(np.diff(at[order, p], prepend=-1))
                total[p][at[order[first], p]] += np.add.reduceat(x[order, p * w : (p + 1) * w], first, axis=0)
        p, e = np.nonzero(count)
        rows = np.concatenate([count[p, e][:, None], total[p, e]], axis=1)  # position -1: the count
        at = np.repeat(p * k + e, w + 1)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.tile(np.arange(-1, w), len(p))), pa.array(rows.reshape(-1))], names=["at", "i", "v"])

    some = state.select("x", "at").mapInArrow(go, "at long, i long, v long")
    got = some.groupBy("at", "i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).toArrow()
    count, total = np.zeros(parts * k, object), np.zeros((parts * k, w), object)
    for at, i, v in zip(*(got.column(c).to_pylist() for c in ("at", "i", "v"))):
        if i < 0:
            count[at] = int(v)
        else:
            total[at, i] = int(v)
    return count, total


def moved(entries: np.ndarray, count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Entries at floor(sum / count) of their parts; unused ones stay."""
    out = entries.reshape(-1, entries.shape[2]).copy()
    for at in np.flatnonzero(count):
        out[at] = [v // count[at] for v in total[at]]
    return out.reshape(entries.shape)


def digest(entries: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, entries.reshape(-1).tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(id, label, code, error of every kept row; codebooks by part, entry and position).

    Rows with a null vector or a null or non-finite component are left out. Codebooks begin as the parts of the `entries` (256 at
    most) smallest kept ids, null ids last; of equal ids the smaller vector comes first; with fewer rows there are fewer entries.
    Repeated rows stay rows and count as often as they occur. Vectors of differing lengths, of a length that isn't divided by
    `parts`, or with components beyond about 2^17 (where squares leave a long) are refused. An empty table gives an empty result
    and empty codebooks. Other columns are ignored. Only codebooks, counts and sums are on the driver: entries x components.
    """
    spark = vectors.sparkSession
    if not 1 <= entries <= 256:
        raise ValueError("codes have one byte a part")
    rows = kept(vectors, vector).select(F.col(id).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    kind = f"{id} {rows.schema['id'].dataType.simpleString()}, {label} {rows.schema['label'].dataType.simpleString()}, code string, error long"
    begin = rows.select("id", "vector").orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).toArrow()
    if not begin.num_rows:
        return spark.createDataFrame([], kind), np.zeros((parts, 0, 0), np.int64)
    width = len(begin.column("vector")[0])
    if width % parts or not width:
        raise ValueError(f"{width} components can't be cut into {parts} equal parts")
    w = width // parts
    first = whole(matrix(begin.column("vector"), width), scale, parts)
    books, state = Books(np.stack([first[:, p * w : (p + 1) * w] for p in range(parts)])), rows
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)
        path = scratch_path(spark, "codes-bounds")
        kept_rows = _round(state, shared, scale, "label")
        kept_rows.write.option("compression", "zstd").parquet(path)
        done = spark.read.schema(kept_rows.schema).parquet(path)
        done._written = path
        shared.destroy()
        if state is not rows:
            drop(state)
        state = done
        count, total = _sums(state, parts, books.entries.shape[1], w)
        books = Books(moved(books.entries, count, total), books.entries)
    shared = spark.sparkContext.broadcast(books)
    hexed = np.array([f"{i:02x}" for i in range(256)])

    def final(batches):
        entries = shared.value.entries
        for t in _gathered(batches):
            x, at, _, _ = _assigned(t, shared.value, scale)
            near = np.concatenate([entries[p][at[:, p]] for p in range(parts)], axis=1)
            code = hexed[at[:, 0]]
            for p in range(1, parts):
                code = np.char.add(code, hexed[at[:, p]])
            cols = [t.column("id"), t.column("label"), pa.array(code.tolist(), pa.string()), pa.array(((x - near) ** 2).sum(axis=1))]
            yield from pa.Table.from_arrays(cols, names=[id, label, "code", "error"]).combine_chunks().to_batches(max_chunksize=BLOCK)

    out = cut(state.mapInArrow(final, kind), "codes")
    shared.destroy()
    if state is not rows:
        drop(state)
    return out, books.entries


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every kept row of `embeddings`."""
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    per = coded.groupBy(F.col("label").alias("_l")).agg(F.sum("error").alias("label_error"))
    both = coded.join(per, F.col("label").eqNullSafe(F.col("_l")))  # a hot label is split by adaptive execution; its rows are small
    return both.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _floor_div(a: str, b: str) -> str:
    return f"(({a}) - ((({a}) % ({b})) + ({b})) % ({b})) // ({b})"


def oracle(scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """DuckDB SQL of the same rows: every distance of every round, without bounds."""
    ctes = [
        f"""k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, [floor(c::DOUBLE * {scale})::BIGINT for c in embedding] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)""",
        f"v AS MATERIALIZED (SELECT r, p, x[p * (len(x) // {parts}) + 1 : (p + 1) * (len(x) // {parts})] AS x FROM k, range({parts}) t(p))",
        f"b0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS c FROM v WHERE r <= {entries})",
    ]
    near = "SELECT v.r, v.p, arg_min(b.e, {key}) AS e FROM v JOIN b{i} b USING (p) GROUP BY v.r, v.p"
    key = f"list_sum(list_transform(list_zip(v.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT::HUGEINT * {entries} + b.e"
    for i in range(rounds):
        ctes += [
            f"a{i} AS MATERIALIZED ({near.format(i=i, key=key)})",
            f"""s{i} AS (SELECT p, e, i, {_floor_div("sum(c)::BIGINT", "count(*)")} AS c FROM (SELECT v.p, a.e, unnest(v.x) AS c, generate_subscripts(v.x, 1) AS i FROM v JOIN a{i} a USING (r, p)) GROUP BY p, e, i)""",
            f"""b{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.c, b.c) AS c FROM b{i} b LEFT JOIN (SELECT p, e, list(c::BIGINT ORDER BY i) AS c FROM s{i} GROUP BY p, e) n USING (p, e))""",
        ]
    ctes += [
        f"a{rounds} AS MATERIALIZED ({near.format(i=rounds, key=key)})",
        f"""f AS (SELECT v.r, string_agg(format('{{:02x}}', a.e), '' ORDER BY v.p) AS code, sum(list_sum(list_transform(list_zip(v.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT)::BIGINT AS error
  FROM v JOIN a{rounds} a USING (r, p) JOIN b{rounds} b USING (p, e) GROUP BY v.r)""",
        f"h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})",
    ]
    return "WITH " + ",\n".join(ctes) + "\nSELECT k.vec_id, f.code, f.error, (sum(f.error) OVER (PARTITION BY k.label))::BIGINT AS label_error, h.codebooks_sha256 FROM k JOIN f USING (r), h"
