import random

import numpy as np
import pyarrow as pa
import pytest
from revstrand.llm import decontaminate as D


def norm(t):
    out = "".join(c if c.isalnum() or ord(c) > 127 else " " for c in (t or "").lower())
    return " ".join(out.split())


def least_edits(pattern, text):
    """Sellers: least edits of the pattern in any stretch of the text."""
    row = [0] * (len(text) + 1)
    for a in pattern:
        new = [row[0] + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def brute(text, items, window, rate):
    text, hit = norm(text).encode(), set()
    for name, t in items:
        t = norm(t).encode()
        if not t:
            continue
        if len(t) < 24:  # verbatim, as whole words
            if b" " + t + b" " in b" " + text + b" ":
                hit.add(name)
            continue
        at = [0] if len(t) <= window else [*range(0, len(t) - window, int(window * rate)), len(t) - window]
        for s in at:
            p = t[s : s + window]
            e = int(len(p) * rate)
            while e > 0 and len(p) + 1 - D.Q * (e + 1) < 2:
                e -= 1
            if least_edits(p, text) <= e:
                hit.add(name)
    return hit


@pytest.fixture(scope="module")
def planted():
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(2, 7)))
    say = lambda n: " ".join(word() for _ in range(n))
    items = [(i, say(r.choice([3, 8, 15, 40]))) for i in range(12)] + [(99, "tiny"), (97, "Tiny!"), (96, "so small a text: 22b"), (98, ""), (95, "?!")]
    texts = [None, "", "tiny", " Tiny! ", "not tiny at all", "not atiny", "this is so small, a text 22B it is", "this is so small, a text 22bits"]
    for _ in range(60):
        t = list(r.choice(items)[1])
        for _ in range(r.choice([0, 0, 2, 5, 9, 14, 30])):
            if t:
                i = r.randrange(len(t))
                t[i : i + 1] = r.choice([[], ["x"], [t[i], "q"]])
        cut = "".join(t)[r.choice([0, 0, 30]) :]
        texts.append(say(r.randint(0, 60)) + " " + r.choice([str.upper, str])(cut) + ",, " + say(r.randint(0, 60)))
    return items, texts


def test_against_full_alignment(planted):
    items, texts = planted
    p = D.patterns(items)
    got = [{i for i, _, _ in g} for g in D.matches(pa.array(texts), p)]
    want = [brute(t, items, D.WINDOW, D.EDIT_RATE) for t in texts]
    assert got == want and sum(map(len, want)) > 15


def test_query_edges(spark, docs, planted):
    bench = spark.createDataFrame([*planted[0], (None, "x"), (7, None)], "item_id long, text string")
    got = D.find(docs.withColumn("leaks", docs.doc_id), bench)
    assert got.count() == docs.count() and got.where("size(leaks) > 0").count() == 0
    assert D.find(docs.where("false"), bench).count() == 0
    assert D.find(docs, bench.where("false")).where("size(leaks) > 0").count() == 0
    longest = max(planted[0], key=lambda x: len(x[1]))
    one = spark.createDataFrame([(1, "so: " + longest[1] + "!")], "doc_id long, text string")
    hit = D.find(one, bench).first()["leaks"]
    assert [x["item_id"] for x in hit] == [longest[0]] and hit[0]["edits"] == 0


def test_short_items_and_items_of_equal_text():
    p = D.patterns([(1, "tiny"), (2, "Tiny!"), (3, "one item of 22 bytes!"), (4, "An item that is as long as a pattern would be, said twice."), (5, "an item that is AS LONG as a pattern would be - said twice")])
    texts = ["so tiny it is", "untiny", "there is one ITEM of 22 bytes, inside", "he: an item that is as long as a pattern would be, said twice, here"]
    assert [[i for i, _, _ in g] for g in D.matches(pa.array(texts), p)] == [[1, 2], [], [3], [4, 5]]


def test_shared_words_in_another_order_are_no_leak():
    """Many shared q-grams, but on no common diagonals: whatever count ends the search, there is nothing to verify."""
    r = random.Random(3)
    for n in (0, 1, 4):
        words = ["".join(r.choice("abcdefgh") for _ in range(10)) for _ in range(20)]
        p = D.patterns([(1, " ".join(words))])
        mixed = words[::-1]
        text = " ".join(x + " " + "".join(r.choice("stuvwxyz") for _ in range(n)) for x in mixed)
        got = {i for i, _, _ in D.matches(pa.array([text]), p)[0]}
        assert got == brute(text, [(1, " ".join(words))], D.WINDOW, D.EDIT_RATE)


def test_long_texts_are_searched_whole():
    r = random.Random(9)
    say = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(n))
    items = [(i, say(30)) for i in range(5)]
    filler, p = say(30000), D.patterns(items)
    for at in (0, 1, 511, 512, 513, 77777, len(filler) - 1):  # wherever slices begin and end
        text = filler[:at] + " " + items[at % 5][1] + " " + filler[at:]
        assert [i for i, _, _ in D.matches(pa.array([text]), p)[0]] == [at % 5]


def test_blocks_give_the_same(spark, planted, monkeypatch):
    items, texts = planted
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = {r["doc_id"]: {x["item_id"] for x in r["leaks"]} for r in D.find(rows, bench).collect()}
    monkeypatch.setattr(D, "BLOCK_BYTES", 200)
    assert {r["doc_id"]: {x["item_id"] for x in r["leaks"]} for r in D.find(rows, bench).collect()} == one
    assert np.any([len(x) for x in one.values()])


def test_excerpts_are_found_at_every_offset(spark):
    r = random.Random(4)
    say = lambda n, letters: " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 8))) for _ in range(n))
    item = say(60, "abcde")
    body = norm(item).encode()
    most = int(D.WINDOW * D.EDIT_RATE)
    rows = []
    for size in (D.WINDOW - most, 75, D.WINDOW, 100):
        for at in range(len(body) - size + 1):
            rows.append((len(rows), say(8, "vwxyz") + " " + body[at : at + size].decode() + " " + say(8, "vwxyz")))
    clean = [(10**6 + i, say(40, "abcde")) for i in range(50)]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {x["doc_id"]: len(x["leaks"]) for x in D.find(spark.createDataFrame(rows + clean, "doc_id long, text string"), bench).collect()}
    assert [i for i, _ in rows if not got[i]] == []
    near = {i: min(least_edits(body[s : s + D.WINDOW], norm(t).encode()) for s in range(len(body) - D.WINDOW + 1)) <= most for i, t in clean[:5]}
    assert {i: bool(got[i]) for i in near} == near
