"""The positional index against brute force."""

import random
import re

import pytest

from pixelloom.llm.decontaminate import decontaminate

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(t):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, size):
    out = {}
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for name, text in items:
            x = words(text)
            k = min(size, len(x))
            for a in range(max(len(x) - size + 1, 1) if x else 0):
                for p in range(len(w) - k + 1):
                    if w[p : p + k] == x[a : a + k]:
                        hit |= set(range(p, p + k))
                        found.add(str(name))
        out[i] = (len(w), len(hit), len(found), ",".join(sorted(found)), bool(hit))
    return out


@pytest.mark.parametrize("sizes", [{}, {"segment_bytes": 500, "block_bytes": 100}])
def test_matches_as_by_brute_force(spark, sizes):
    r = random.Random(5)
    vocab = ["The", "of", "É", "x1", "and", "ZZ", "été", "go", "it", "9"]
    some = lambda k: r.choice([" ", ", ", "\n"]).join(r.choice(vocab) for _ in range(k))
    items = [(10, some(30)), (9, some(12)), (100, some(4)), (7, "The of"), (5, ""), (6, None), (11, some(10))]
    docs = [(i, some(r.randint(0, 60))) for i in range(30)]
    docs += [(100 + i, f"{some(3)} ... {(items[i % 7][1] or '').upper()}; {some(5)}") for i in range(14)] + [(200, None), (201, ""), (202, "...")]
    want = brute(docs, items, 10)
    got = decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), **sizes).collect()
    assert {x.doc_id: (x.n_words, x.n_hit, x.n_items, x["items"], x.contaminated) for x in got} == want and sum(v[4] for v in want.values()) > 10


def test_proximity(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    docs = [(1, "x delta y beta gamma alpha z"), (2, "alpha a b c d beta e f g h gamma delta"), (3, "alpha beta gamma"), (4, "alpha beta gamma delta")]
    got = {r.doc_id: (r.n_items, r.n_near) for r in decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), items, proximity=5).collect()}
    assert got == {1: (0, 1), 2: (0, 0), 3: (0, 0), 4: (1, 1)}


def test_proximity_as_by_brute_force(spark):
    r = random.Random(9)
    vocab = [f"w{i}" for i in range(14)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([3, 4, 7])))) for i in range(25)]
    docs = [(i, " ".join(r.choice(vocab) for _ in range(r.randint(0, 50)))) for i in range(60)]
    want = {}
    for i, t in docs:
        w, near = words(t), set()
        for name, text in items:
            x = words(text)
            sets = [set(x[a : a + 4]) for a in range(max(len(x) - 3, 1))]
            if any(s <= set(w[p : p + 6]) for s in sets for p in range(len(w))):
                near.add(name)
        want[i] = len(near)
    got = {x.doc_id: x.n_near for x in decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), size=4, proximity=6, segment_bytes=400).collect()}
    assert got == want and sum(want.values()) > 50


def test_odd_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(None, "a b", "x"), (1, "a b", "y"), (1, "a b", "y")], "doc_id long, text string, term string")
    assert sorted(str(r.doc_id) + str(r.n_words) + str(r.n_hit) for r in decontaminate(docs, none).collect()) == ["120", "120", "None20"]
    items = spark.createDataFrame([(None, "a b"), (3, "b"), (3, "a")], "item_id long, text string")
    assert {r["items"] for r in decontaminate(docs, items).collect()} == {",3"}
    assert decontaminate(docs.limit(0), items).count() == 0
