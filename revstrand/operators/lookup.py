"""A set of signatures that tasks look up without a join: sorted files in the shared folder with a sparse index of their blocks.

The index, one key per block, is all that goes through the driver, and blocks grow so that it stays bounded. A task reads the block
that could hold a signature and keeps those it read last, so a small set is read once and a large one costs one read per lookup.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections import OrderedDict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.ranges import open_store
from ..storage import shared_folder

#: Bytes of a signature (an md5 digest), signatures of a block, blocks of an index, and blocks that a task keeps.
WIDTH, BLOCK, MOST_BLOCKS, KEPT = 16, 4096, 1 << 18, 256


class SignatureSet:
    """Signatures (32 hexadecimal digits) in sorted files; `in` reads at most one block."""

    def __init__(self, firsts: list[bytes], blocks: list[tuple[str, int, int]], kept: int = KEPT):
        self.firsts, self.blocks, self.kept = firsts, blocks, kept
        self._cache: OrderedDict[int, bytes] = OrderedDict()

    def __reduce__(self):
        return SignatureSet, (self.firsts, self.blocks, self.kept)

    def _block(self, i: int) -> bytes:
        if i in self._cache:
            self._cache.move_to_end(i)
            return self._cache[i]
        path, at, n = self.blocks[i]
        store, inner = open_store(path)
        with store.open_input_file(inner) as f:
            body = f.read_at(n * WIDTH, at * WIDTH)
        self._cache[i] = body
        if len(self._cache) > self.kept:
            self._cache.popitem(last=False)
        return body

    def __contains__(self, sig: str) -> bool:
        key = bytes.fromhex(sig)
        i = bisect_right(self.firsts, key) - 1
        if i < 0:
            return False
        body = self._block(i)
        lo, hi = 0, len(body) // WIDTH
        while lo < hi:
            mid = (lo + hi) // 2
            if body[mid * WIDTH : (mid + 1) * WIDTH] < key:
                lo = mid + 1
            else:
                hi = mid
        return body[lo * WIDTH : (lo + 1) * WIDTH] == key


def signature_set(sigs: DataFrame, block: int = BLOCK) -> SignatureSet:
    """The set of sigs(sig); what isn't 32 hexadecimal digits is no signature. Files go when the driver ends.

    Every attempt of a task writes a file of its own name; only those that successful tasks report are in the index.
    """
    spark = sigs.sparkSession
    path = shared_folder(spark, "signatures")
    some = sigs.where(F.rlike("sig", F.lit("^[0-9a-f]{32}$"))).select(F.unhex("sig").alias("key"))
    each = max(block, -(-some.count() // MOST_BLOCKS))

    def go(batches):
        store, at = open_store(path)
        store.create_dir(at, recursive=True)
        name, n, firsts, held = f"{uuid.uuid4().hex}.sorted", 0, [], None
        for b in batches:
            keys = b.column("key").to_pylist()
            if keys and held is None:
                held = store.open_output_stream(f"{at}/{name}")
            if keys:
                firsts += [(keys[i], n + i) for i in range(-n % each, len(keys), each)]
                held.write(b"".join(keys))
                n += len(keys)
        if held is not None:
            held.close()
            size = [min(each, n - i) for _, i in firsts]
            yield pa.RecordBatch.from_pydict({"first": [k for k, _ in firsts], "file": [name] * len(firsts), "at": [i for _, i in firsts], "n": size})

    order = some.distinct().repartitionByRange("key").sortWithinPartitions("key")
    rows = sorted((bytes(r["first"]), f"{path}/{r['file']}", r["at"], r["n"]) for r in order.mapInArrow(go, "first binary, file string, at long, n long").collect())
    return SignatureSet([r[0] for r in rows], [r[1:] for r in rows])
