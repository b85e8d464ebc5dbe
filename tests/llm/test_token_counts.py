import base64
import random

import numpy as np
import pytest
from revstrand.llm import token_counts as K


def lengths(ids, eod):
    out, n = [], 0
    for x in ids:
        if x == eod:
            out.append(n)
            n = 0
        else:
            n += 1
    return out + ([n] if n else [])


@pytest.mark.parametrize("block", [2, 3, 8, 50, 4096])
def test_flat_files_against_a_plain_scan(spark, tmp_path, block, monkeypatch):
    monkeypatch.setattr(K, "SUPER", 3)
    r, want = random.Random(block), {}
    for i, n in enumerate((0, 1, 7, 200)):
        ids = [r.choice([9, 1, 2, 3, 4, 5, 6]) for _ in range(n)] if i < 3 else [*[1] * 60, 9, 9, *[r.choice([9, 2, 3, 4]) for _ in range(n)], *[5] * 30]
        (tmp_path / f"f{i}.tok").write_bytes(np.array(ids, np.uint16).tobytes() + b"x" * (i == 2))
        want |= {(f"f{i}.tok", k): v for k, v in enumerate(lengths(ids, 9))}
    got = K.stitched(K.scan_blocks(spark, f"file://{tmp_path}", None, 9, 2, block)).collect()
    assert {(x["file"], x["ordinal"]): x["n_tokens"] for x in got} == want and len(got) == len(want)


def test_counts_against_the_tokenizer(spark, docs, corpus):
    import tiktoken

    with open(K.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    e = tiktoken.Encoding("own", pat_str=K.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = K.count_tokens(docs, block=4096).collect()
    assert sorted((x[0], len(e.encode_ordinary(x[1] or ""))) for x in corpus) == sorted(map(tuple, got))
    assert K.count_tokens(docs.where("false")).count() == 0


def test_a_column_of_the_results_name_is_ignored(spark):
    rows = spark.createDataFrame([(1, "two words", 99, "f"), (2, None, 98, "g")], "doc_id long, text string, n_tokens long, file string")
    assert sorted(map(tuple, K.count_tokens(rows).collect())) == [(1, 2), (2, 0)]
