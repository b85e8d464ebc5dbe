import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from revstrand.llm import chat as C

T = C.Template()
ROWS = [
    (1, 1, "assistant", "plain <|im_end|> \\ <\\|im_end|> [INST] <<|im_start|>"), (1, 0, "user", "</s>[INST] ok [/INST]"), (2, 0, "system", None), (2, 1, None, ""), (2, 1, None, ""),
    (3, 0, "assi\nstant", "x\n\ny"), (3, 1, "<|im_sep|>", "é😀"), (4, 0, "assistant", "a" * 50_000 + "<|im_sep|>"), (None, 0, "assistant", "t"), (5, None, "user", "\\<|im_end|>\\\\"), (6, 0, "assistant", "<"), (6, 1, "assistant", "|im_end|>"),
]
SCHEMA = "conv_id long, turn long, role string, text string"


def expect(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    return {c: [(r, x) for _, r, x in sorted(v)] for c, v in by.items()}


def test_round_trip_and_digests(spark):
    rows = spark.createDataFrame([(*r, "clash", 3) for r in ROWS], SCHEMA + ", formatted string, n_turns int").repartition(4)
    f = C.format_chats(rows)
    got = {r["conv_id"]: r for r in f.collect()}
    want = expect(ROWS)
    assert set(got) == set(want) and all(r["round_trip"] for r in got.values())
    for c, r in got.items():
        assert [(x["role"], x["text"]) for x in r["recovered"]] == want[c]
        assert not r["escaped"] or any(k in x + y for x, y in want[c] for k in (*T.controls, "\\"))
        at, loss = 0, ""
        for n, y in r["loss_runs"]:
            loss += r["formatted"][at : at + n] if y else ""
            at += n
        assert at == len(r["formatted"])
        if not r["escaped"]:
            assert loss == "".join(x for role, x in want[c] if role == "assistant")
    for r in C.digests(f).collect():
        turns, loss = want[r["conv_id"]], "".join(x for role, x in want[r["conv_id"]] if role == "assistant")
        told = "".join(f"{a}\n{b}\n" for a, b in turns)
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256(told.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert C.format_chats(rows.where("false")).count() == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<", "|", "\\", "s", ">", "[", "]", "/", "INST", "im_end", "<|im_end|>", "</s>", "<|im_sep|>", "\n", "$", "é"]), max_size=8).map("".join), min_size=1, max_size=30))
def test_any_content_survives(spark, texts):
    rows = spark.createDataFrame([(0, i, t[::-1][:9], t) for i, t in enumerate(texts)], SCHEMA)
    r = C.format_chats(rows).first()
    assert r["round_trip"] and [x["text"] for x in r["recovered"]] == texts


def test_loss_is_read_through_the_mask(spark):
    f = C.format_chats(spark.createDataFrame([(1, 0, "user", "abc"), (1, 1, "assistant", "de"), (1, 2, "assistant", "")], SCHEMA))
    flip = f.withColumn("loss_runs", F.transform("loss_runs", lambda x: F.struct(x["n"].alias("n"), (~x["loss"]).alias("loss"))))
    short = f.withColumn("loss_runs", F.transform("loss_runs", lambda x: F.struct((x["n"] + 1).alias("n"), x["loss"].alias("loss"))))
    got = [x.select(C.loss_text(T)).first()[0] for x in (f, flip, short)]
    assert got[0] == "de" and "abc" in got[1] and "de" not in got[1] and got[2] is None
    assert f.select(C.loss_text(C.Template(loss_roles=("user",)))).first()[0] == "de"  # the mask decides, not the role


def test_parser_rejects_other_text(spark):
    one = spark.createDataFrame([("<|im_start|>user<|im_sep|>hi<|im_end|>",), ("x",), ("<|im_start|>user<|im_sep|>a <s> b<|im_end|>\n",), ("",)], "t string")
    assert [r[0] for r in one.select(C.parsed(one["t"], T)).collect()] == [None, None, None, []]


def test_ambiguous_templates_are_refused():
    with pytest.raises(ValueError):
        C.Template(close="<|x<|")
    with pytest.raises(ValueError):
        C.Template(reserved=("<\\s>",))


def test_no_python_in_the_plan(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    plan = C.digests(C.format_chats(rows))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
