"""Near copies by Jaccard similarity against brute force, and the pipeline's stage that removes them."""

import random
import re

import pytest

import corpus_pipeline
from pixelloom.llm.shingle_dedup import shingle_groups
from tests.llm.test_dedup import WORD, frame, groups, texts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, k=5):
    w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or {tuple(w)}


def near(rows):
    """Groups of row numbers."""
    s = [shingles(t) for _, t in rows]
    pairs = [(a, b) for b in range(len(s)) for a in range(b) if 5 * len(s[a] & s[b]) >= 4 * len(s[a] | s[b])]
    return pairs, groups(pairs, range(len(s)))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], SCHEMA)


def edited(seed=5):
    """Texts of 40 to 120 words with up to 4 words replaced, chains of such, a line that all of some have, odd texts."""
    r = random.Random(seed)
    word = lambda: f"W{r.randint(0, 5000)}"
    out = []
    for _ in range(12):
        w = [word() for _ in range(r.randint(40, 120))]
        for _ in range(8):
            w = list(w)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = word()
            out.append(" ".join(w))
    line = " ".join(word() for _ in range(12))
    out += [f"{line} {' '.join(word() for _ in range(n))}" for n in (1, 2, 3, 4, 30, 31)] + [line, line.upper(), None, "", "a b", "A  b", "a b c"]
    return list(enumerate(out))


@pytest.mark.parametrize("bits", [20, 2])
def test_groups_as_by_brute_force(spark, bits):
    rows = edited() + [(1000 + i, t) for i, t in texts(3)]
    pairs, want = near(rows)
    got = {r.doc_id: r.component for r in shingle_groups(frame(spark, rows), bits=bits).collect()}
    assert len(got) == len(rows) and sum(rows[a][1] != rows[b][1] for a, b in pairs) > 50
    first = {}
    for n, (i, _) in enumerate(rows):
        assert first.setdefault(want[n], got[i]) == got[i]
    assert len(set(first.values())) == len(first)


def test_stage_removes_near_copies(spark):
    """One word of 60 differs: similarity above 0.8, but fingerprints of 3-word shingles are more than 2 bits apart."""
    r = random.Random(11)
    rows = []
    for d in range(0, 40, 2):
        w = [f"w{r.randint(0, 9999)}" for _ in range(60)]
        rows += [(d, " ".join(w)), (d + 1, " ".join([*w[:30], "other", *w[31:]]))]
    got = {x.doc_id for x in corpus_pipeline.near_dedup(spark, table(spark, rows), "").collect()}
    assert got == set(range(0, 40, 2))


def test_stage_judges_rows_not_ids(spark):
    r = random.Random(12)
    a, b, c, d, e = [[f"w{r.randint(0, 9999)}" for _ in range(60)] for _ in range(5)]
    text, copy = " ".join, lambda w: " ".join([*w[:30], "other", *w[31:]])
    rows = [(None, text(a)), (None, copy(a)), (5, text(b)), (None, copy(b)), (None, text(c)), (None, text(c)), (7, text(d)), (7, text(e)), (3, copy(e))]
    got = [(x.doc_id, x.text) for x in corpus_pipeline.near_dedup(spark, table(spark, rows), "").collect()]
    assert len(got) == 5 and sum(x in got for x in rows[:2]) == 1
    assert {x for x in got if x not in rows[:2]} == {(5, text(b)), (None, text(c)), (7, text(d)), (3, copy(e))}


@pytest.mark.parametrize("bits", [20, 1])
def test_a_common_passage_makes_no_pairs(spark, monkeypatch, bits):
    """Texts that share 60 of 100 words: similarity 0.4.  Whatever the table tells, pairs looked at grow with the texts, not their square."""
    from pixelloom.llm import shingle_dedup

    looked = []
    real = shingle_dedup.stage

    def stage(df, name, *more):
        out = real(df, name, *more)
        if name in ("pairs", "stars"):
            looked.append(out.count())
        return out

    monkeypatch.setattr(shingle_dedup, "stage", stage)
    r = random.Random(3)
    common = [f"c{i}" for i in range(60)]
    counts = []
    for n in (100, 200):
        rows = [(i, " ".join([*common, *(f"w{r.randint(0, 10**9)}" for _ in range(40))])) for i in range(n)]
        rows += [(1000, rows[7][1] + " more"), (1001, "again " + rows[7][1])]
        looked.clear()
        got = {x.doc_id: x.component for x in shingle_groups(frame(spark, rows), bits=bits).collect()}
        assert got[7] == got[1000] == got[1001] and len(set(got.values())) == n
        counts.append(sum(looked))
    assert counts[1] <= 2.2 * counts[0] + 50 and counts[1] < 5 * 200


def test_exact_order_as_by_brute_force(spark, monkeypatch):
    """Every list counts as long, so all links that stars leave open come from the exact order."""
    from pixelloom.llm import shingle_dedup

    monkeypatch.setattr(shingle_dedup, "LONG", 1)
    rows = edited(9) + [(1000 + i, t) for i, t in texts(4)]
    _, want = near(rows)
    got = {r.doc_id: r.component for r in shingle_groups(frame(spark, rows), bits=1).collect()}
    first = {}
    for n, (i, _) in enumerate(rows):
        assert first.setdefault(want[n], got[i]) == got[i]
    assert len(set(first.values())) == len(first)
