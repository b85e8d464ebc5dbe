"""Benchmark decontamination by q-gram lemma filtering.

Every q-gram of every benchmark item is indexed once. Items are read as overlapping windows (patterns). A pattern of n bytes that
occurs with at most e edits shares at least n + 1 - q (e + 1) q-grams with its occurrence, and they lie on diagonals at most e
apart. Shared q-grams are counted per slice of a document and item, then in overlapping bands of diagonals, then per pattern;
what reaches the bound in all three is verified by an alignment banded to the same diagonals. The first two counts are taken in
hashed cells, so a collision can only keep a region that the third count drops.

Items are a stated query set: their index is written to the shared folder in blocks of bounded size, and every batch of texts goes
through all blocks, one at a time. Documents are read once and never shuffled, however large the benchmark is.
"""

from __future__ import annotations

import functools
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as X
from ._spark import scratch_path, table
from .token_counts import _filesystem

Q = 8
#: Bytes of a pattern and edits per byte.
WINDOW, EDIT_RATE = 80, 0.1
#: Items shorter than this (normalised) are searched verbatim, as whole words: an edit would make them another text.
LEAST = 24
#: Bytes of item text that one block indexes.
BLOCK_BYTES = 2 << 20
#: Bytes of a document that are counted together; slices overlap by a pattern and its edits.
SLICE = 512
#: Edits of what has more than its budget.
FAR = 1 << 14
_BITS = 22
#: Pairs of a document's and an item's q-gram that are held at a time, and cells that they are counted in.
_CHUNK, _CELLS = 1 << 20, 1 << 22
_U = np.uint64


def normalised(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes where every run of other characters than letters and digits is one blank, and n+1 offsets."""
    data, off = X.raw(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    blank = X.PUNCT[data]
    keep = np.ones(len(data), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    firsts = off[:-1][off[:-1] < len(data)]
    keep[firsts] = ~blank[firsts]
    flat = np.where(blank, np.uint8(0x20), data)[keep]
    return flat, np.concatenate([[0], np.cumsum(keep)])[off]


@dataclass
class Patterns:
    """A block of items: the patterns of long ones with their budgets and bounds, the index of q-grams, and the short ones."""

    body: np.ndarray
    start: np.ndarray  # of each pattern, in body
    size: np.ndarray
    item: np.ndarray  # id
    row: np.ndarray  # number of the pattern's item in the block
    edits: np.ndarray
    bound: np.ndarray
    row_bound: np.ndarray  # least bound of an item's patterns
    codes: np.ndarray
    post_to: np.ndarray
    post_row: np.ndarray
    post_at: np.ndarray  # in body
    sieve: np.ndarray
    band: int
    short: dict[bytes, list[int]]


def _codes(flat: np.ndarray) -> np.ndarray:
    return np.lib.stride_tricks.as_strided(flat, (max(len(flat) - Q + 1, 0), Q), (1, 1)).copy().view(np.uint64).reshape(-1) if len(flat) >= Q else np.zeros(0, np.uint64)


def _slot(codes: np.ndarray) -> np.ndarray:
    return ((codes * _U(0x9E3779B97F4A7C15)) >> _U(64 - _BITS)).astype(np.int64)


def patterns(items: list[tuple[int, str]], window: int = WINDOW, rate: float = EDIT_RATE) -> Patterns:
    """Windows of each item, an edit budget apart, the last one at the item's end, and the index of the items' q-grams.

    As windows are no further apart than the budget, any verbatim excerpt of window - budget bytes or more is found wherever in
    the item it begins: some window then differs from it at its ends only, within the budget.
    """
    step = max(int(window * rate), 1)
    flat, off = normalised(pa.array([t for _, t in items], pa.large_string()))
    spans, short, at, row = [], {}, [], []
    for i, (name, _) in enumerate(items):
        a, z = int(off[i]), int(off[i + 1])
        z -= int(z > a and flat[z - 1] == 0x20)
        if z - a < LEAST:
            if z > a:
                short.setdefault(bytes(flat[a:z]), []).append(name)
            continue
        starts = [*range(a, z - window, step), z - window] if z - a > window else [a]
        spans += [(s, min(window, z - a), name, i) for s in dict.fromkeys(starts)]
        at.append(np.arange(a, z - Q + 1))
        row.append(np.full(z - a - Q + 1, i))
    start, size, item, own = (np.array([s[k] for s in spans], np.int64) for k in range(4))
    edits = np.floor(size * rate).astype(np.int64)
    while len(edits) and (few := (edits > 0) & (size + 1 - Q * (edits + 1) < 2)).any():
        edits = np.where(few, edits - 1, edits)
    bound = np.maximum(size + 1 - Q * (edits + 1), 1)
    row_bound = np.full(len(items), 1 << 30)
    np.minimum.at(row_bound, own, bound)
    at, row = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (at, row))
    code = _codes(flat)[at] if len(at) else np.zeros(0, np.uint64)
    order = np.argsort(code, kind="stable")
    codes, first = np.unique(code[order], return_index=True)
    sieve = np.zeros(1 << _BITS, bool)
    sieve[_slot(codes)] = True
    return Patterns(flat, start, size, item, own, edits, bound, row_bound, codes, np.append(first, len(code)), row[order], at[order], sieve, max(int(edits.max(initial=0)), 1), short)


def _often(cell: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which rows' cells hold at least `least` rows; cells share counters, so some with fewer may pass."""
    slot = (X.mix(cell.view(np.uint64)) >> _U(64 - _BITS)).astype(np.int64)
    return np.bincount(slot, minlength=_CELLS)[slot] >= least


def _bands(flat: np.ndarray, off: np.ndarray, p: Patterns) -> np.ndarray:
    """(document, pattern, first diagonal) of bands of diagonals that reach the bound. Diagonals: document less body position."""
    none = np.zeros((0, 3), np.int64)
    code = _codes(flat)
    hit = np.flatnonzero(p.sieve[_slot(code)])
    if not len(hit) or not len(p.codes):
        return none
    k = np.searchsorted(p.codes, code[hit])
    k[k == len(p.codes)] = 0
    same = p.codes[k] == code[hit]
    hit, k = hit[same], k[same]
    doc = np.searchsorted(off, hit, "right") - 1
    inside = hit + Q <= off[doc + 1]
    hit, doc, k = hit[inside], doc[inside], k[inside]
    # whatever a pattern and its edits cover lies in the slice that it begins in, as slices overlap
    lap = int(p.size.max()) + p.band
    per = np.diff(off) // SLICE + 1
    base = np.concatenate([[0], np.cumsum(per)])
    begins = np.repeat(off[:-1], per) + (np.arange(base[-1]) - np.repeat(base[:-1], per)) * SLICE
    pos = hit - off[doc]
    again = (pos % SLICE < lap) & (pos >= SLICE)
    part = base[doc] + pos // SLICE
    back = [np.flatnonzero(again & (pos % SLICE + j * SLICE < lap) & (pos >= (j + 1) * SLICE)) for j in range(-(-lap // SLICE))]
    who = np.concatenate([np.arange(len(hit)), *back])
    part = np.concatenate([part, *(part[b] - j - 1 for j, b in enumerate(back))])
    count = np.bincount(part, minlength=base[-1])
    keep = count[part] >= p.row_bound.min()
    who, part = who[keep], part[keep]
    order = np.argsort(part, kind="stable")
    who, part = who[order], part[order]
    n = p.post_to[k[who] + 1] - p.post_to[k[who]]
    to = np.concatenate([[0], np.cumsum(n)])
    out, lo, rows = [none], 0, np.int64(len(p.row_bound))
    pat_key = p.row * (len(p.body) + 1) + p.start
    while lo < len(who):  # whole slices at a time, so that their counts are complete
        hi = max(int(np.searchsorted(to, to[lo] + _CHUNK, "right")) - 1, lo + 1)
        hi = int(np.searchsorted(part, part[hi - 1], "right"))
        own = np.repeat(np.arange(lo, hi), n[lo:hi])
        post = np.arange(to[lo], to[hi]) - np.repeat(to[lo:hi] - p.post_to[k[who[lo:hi]]], n[lo:hi])
        lo = hi
        row = p.post_row[post]
        cell = part[own] * rows + row
        on = _often(cell, p.row_bound[row])
        own, post, row, cell = own[on], post[on], row[on], cell[on]
        if not len(own):
            continue
        # A q-gram on diagonal d counts for the band of width 2*band at d // band and for the one before: any band+1 diagonals lie in one.
        at = p.post_at[post]
        diag = hit[who[own]] - at + len(p.body)
        band = diag // p.band
        cell, at, row, band = np.concatenate([cell, cell]), np.concatenate([at, at]), np.concatenate([row, row]), np.concatenate([band, band - 1])
        on = _often(X.mix(cell.view(np.uint64)).view(np.int64) + band, p.row_bound[row])
        at, row, band, own = at[on], row[on], band[on], np.concatenate([own, own])[on]
        if not len(own):
            continue
        # the patterns that hold the q-gram
        key = row * (len(p.body) + 1) + at
        size = p.size[np.searchsorted(p.row, row)]
        a, z = np.searchsorted(pat_key, key - (size - Q), "left"), np.searchsorted(pat_key, key, "right")
        m = z - a
        pat = np.arange(m.sum()) - np.repeat(np.concatenate([[0], np.cumsum(m)[:-1]]) - a, m)
        if not len(pat):
            continue
        part_of, band = part[own], band - begins[part[own]] // p.band
        first, low, wide = int(part_of.min()), int(band.min()), np.int64(band.max() - band.min() + 1)
        key = (np.repeat(part_of - first, m) * len(p.size) + pat) * wide + np.repeat(band - low, m)
        key, count = np.unique(key, return_counts=True)
        pat = key // wide % len(p.size)
        key, pat = key[count >= p.bound[pat]], pat[count >= p.bound[pat]]
        part_of = key // wide // len(p.size) + first
        d = np.searchsorted(base, part_of, "right") - 1
        out.append(np.unique(np.stack([d, pat, (key % wide + low + begins[part_of] // p.band) * p.band - len(p.body)], 1), axis=0))
    return np.concatenate(out)


def banded_edits(flat: np.ndarray, off: np.ndarray, p: Patterns, found: np.ndarray) -> np.ndarray:
    """Least edits between each pattern and any stretch of its document that ends within the band's diagonals.

    Alignments that are over the pattern's budget already are given up and counted as FAR. Bytes outside the document equal none,
    so that covering one costs what leaving it out does.
    """
    out = np.full(len(found), FAR, np.int16)
    slack = p.band
    width = 2 * p.band + 2 * slack + 1  # the band and as much again to either side, for indels
    cols = np.arange(width, dtype=np.int16)
    for size in np.unique(p.size[found[:, 1]]):
        live = np.flatnonzero(p.size[found[:, 1]] == size)
        doc, pat, diag = found[live].T
        at = (diag + p.start[pat] - slack)[:, None] + np.arange(size + width - 1)
        inside = (at >= off[doc][:, None]) & (at < off[doc + 1][:, None])
        text = np.where(inside, flat[np.clip(at, 0, max(len(flat) - 1, 0))], np.uint8(0))
        body = p.body[p.start[pat][:, None] + np.arange(size)]
        most = p.edits[pat]
        # row i, column j: the pattern's first i bytes against a stretch that ends at its i+j-th byte; row 0 is free to start anywhere
        row = np.zeros((len(live), width), np.int16)
        for i in range(int(size)):
            step = row + (text[:, i : i + width] != body[:, i : i + 1])
            step[:, :-1] = np.minimum(step[:, :-1], row[:, 1:] + 1)  # a pattern byte that the document lacks
            row = np.minimum.accumulate(step - cols, axis=1) + cols  # a document byte that the pattern lacks
            if i % 8 == 7:
                on = row.min(axis=1) <= most
                if not on.all():
                    live, row, text, body, most = live[on], row[on], text[on], body[on], most[on]
        out[live] = row.min(axis=1)
    return out


def _verbatim(flat: np.ndarray, off: np.ndarray, short: dict[bytes, list[int]]) -> Iterator[tuple[int, int, int]]:
    """(document, item, start) of every short item that stands in a document as whole words."""
    starts, ends, to = X.word_spans(flat, off)
    if not short or not len(starts):
        return
    words = X.span_hashes(flat, starts, ends)
    by: dict[int, list[tuple[int, bytes]]] = {}
    for t in short:
        body = np.frombuffer(t, np.uint8)
        a, z, _ = X.word_spans(body, np.array([0, len(body)]))
        h = X.span_hashes(body, a, z)
        by.setdefault(len(h), []).append((int(X.ngrams(h, np.array([0, len(h)]), len(h), 3)[0][0]), t))
    for n, found in by.items():
        name = {h: t for h, t in found}
        grams, first, _ = X.ngrams(words, to, n, 3)
        for i in np.flatnonzero(np.isin(grams, np.array(list(name), np.uint64))):
            a = int(first[i])
            t = name[int(grams[i])]
            if bytes(flat[starts[a] : ends[a + n - 1]]) == t:
                d = int(np.searchsorted(to, a, "right")) - 1
                for item in short[t]:
                    yield d, item, int(starts[a] - off[d])


def matches(texts: pa.Array, p: Patterns) -> list[list[tuple[int, int, int]]]:
    """Per document, item, start (byte of the normalised text) and edits of its best verified pattern, by item."""
    flat, off = normalised(texts)
    found = _bands(flat, off, p)
    got: list[dict[int, tuple[int, int]]] = [{} for _ in range(len(off) - 1)]
    for lo in range(0, len(found), 4096):
        part = found[lo : lo + 4096]
        edits = banded_edits(flat, off, p, part)
        for (d, k, g), e in zip(part[edits <= p.edits[part[:, 1]]], edits[edits <= p.edits[part[:, 1]]]):
            item, here = int(p.item[k]), (int(e), max(int(g + p.start[k] - off[d]), 0))
            got[d][item] = min(got[d].get(item, here), here)
    for d, item, a in _verbatim(flat, off, p.short):
        got[d][item] = min(got[d].get(item, (0, a)), (0, a))
    return [sorted((i, a, e) for i, (e, a) in g.items()) for g in got]


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded text; the driver holds one block at a time."""
    block, size = [], 0
    for r in benchmark.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").toLocalIterator():
        if size > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += len(r["text"].encode())
    if block:
        yield block


def _stored(p: Patterns, path: str) -> str:
    """A block's index as a file of the shared folder."""
    store, at = _filesystem(path)
    store.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(at) as f:
        pickle.dump(p, f, 5)
    return path


@functools.lru_cache(maxsize=1)
def _loaded(path: str) -> Patterns:
    """A block's index in a task, which holds one at a time."""
    store, at = _filesystem(path)
    with store.open_input_stream(at) as f:
        return pickle.load(f)


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, rate: float = EDIT_RATE) -> DataFrame:
    """docs' rows with `leaks`: array of (item_id, start, edits) of benchmark items that the text holds, by item.

    An item leaks if one of its windows stands in the text with at most window * rate edits; an item of under a window is a
    window, one of under LEAST bytes must stand there verbatim as whole words. Short windows have a smaller budget where the full one
    would leave fewer than two q-grams to share (24 to about 47 bytes at the defaults). Null or empty text: no leaks. Null items and
    items without a letter or digit are none; an empty benchmark leaks nowhere. Items of equal text are all named. Long texts
    are searched whole, in slices. Other columns pass through; an own column `leaks` is replaced. Repeated rows are judged alike.
    """
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("edits", pa.int64())]))
    folder = scratch_path(docs.sparkSession, "benchmark")
    paths = [_stored(patterns(block, window, rate), f"{folder}/{i:06d}.patterns") for i, block in enumerate(_blocks(benchmark))]

    @F.arrow_udf("array<struct<item_id:long,start:long,edits:long>>")
    def told(texts: pa.Array) -> pa.Array:  # only texts go to Python, and no text comes back
        got: list[list] = [[] for _ in range(len(texts))]
        for path in paths:
            p = _loaded(path)
            for own, more in zip(got, [g for t in X.spread(texts) for g in matches(t, p)]):  # to the end of spread, which gives memory back
                own += more
        return pa.array([[{"item_id": i, "start": a, "edits": e} for i, a, e in sorted(g)] for g in got], kind)

    return docs.withColumn("leaks", told(F.col("text")))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", (F.size("leaks") > 0).alias("contaminated"), F.transform("leaks", lambda x: x["item_id"]).alias("item_ids"), F.coalesce(F.array_min(F.transform("leaks", lambda x: x["edits"])), F.lit(-1).cast("long")).alias("least_edits"))
