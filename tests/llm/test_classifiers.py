"""Held-out accuracy of the two classifiers, and odd tables."""

import random

import pytest
from pyspark.sql import functions as F

from pixelloom.llm.fm_toxicity import remainder, toxicity_scores
from pixelloom.llm.knn_quality import quality_scores

INSULTS, GROUPS = ["moronic", "vermin", "scumbag"], ["northerners", "southerners"]


def corpus(n=900, seed=2):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abdeghilnorst") for _ in range(r.randint(2, 9))) for _ in range(900)]
    rows = []
    for i in range(n):
        w = [r.choice(vocab) for _ in range(r.randint(5, 120))]
        toxic, good = int(r.random() < 0.3), int(r.random() < 0.75)
        for _ in range(3 if toxic else 0):
            w.insert(r.randint(0, len(w)), r.choice(INSULTS) + r.choice(["", "s", "ly"]))
        if not good:
            w = [x.upper() + "!!" for x in w] if i % 2 else [x + r.choice(["###", "%%%"]) for x in w]
        rows.append((i, " ".join(w), good, toxic))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "en") for i, t, _, _ in rows] + [(5000, None, "en"), (5001, "", None)], "doc_id long, text string, score string")
    return docs, spark.createDataFrame([(i, g, t) for i, _, g, t in rows], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("column", ["quality", "toxic"])
def test_held_out_accuracy(spark, tables, column):
    docs, labels = tables
    make = quality_scores if column == "quality" else toxicity_scores
    out = make(docs.select("doc_id", "text"), labels, lambda doc: remainder(doc, 4) != 2)
    assert out.count() == docs.count()
    assert out.filter("score is null or score < 0 or score > 1").count() == 0
    held = out.join(labels, "doc_id").filter(remainder(F.col("doc_id"), 4) == 2)
    right = held.agg(F.avg((F.col("predicted") == F.col(column)).cast("double"))).first()[0]
    assert right > 0.97


def test_labels_of_held_out_rows_are_not_learnt(spark, tables):
    docs, labels = tables
    flipped = labels.withColumn("toxic", F.when(remainder(F.col("doc_id"), 3) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r.doc_id: r.score for r in toxicity_scores(docs.select("doc_id", "text"), x, lambda doc: remainder(doc, 3) != 1).collect()} for x in (labels, flipped))
    assert a == b


def test_factors_learn_pairs():
    """Insult or group alone is clean, both together are toxic: linear weights alone rank no better than chance here."""
    import numpy as np

    from pixelloom.llm.fm_toxicity import fit_machine, margins

    r = np.random.default_rng(0)
    a, b = r.random(3000) < 0.5, r.random(3000) < 0.5
    label = (a & b).astype(float)
    doc = np.concatenate([np.flatnonzero(a), np.flatnonzero(b)])
    term = np.concatenate([np.zeros(a.sum(), int), np.ones(b.sum(), int)])
    order = np.lexsort((term, doc))
    m = fit_machine(doc[order], term[order], label, 0.5, 16, epochs=60)
    assert m.factors[m.chosen[0]] @ m.factors[m.chosen[1]] > 1
    z = lambda t: m.bias + margins(m.chosen[np.array(t)], np.array([0]), m.linear, m.factors)[0][0]
    assert z([0, 1]) > 1 and z([0]) < 0 and z([1]) < 0


def test_terms_that_only_pairs_explain_are_chosen():
    """Toxic if two terms are both there or both missing: neither says anything alone, among forty others."""
    import numpy as np

    from pixelloom.llm.fm_toxicity import fit_machine, margins

    r = np.random.default_rng(1)
    x = r.random((2500, 40)) < 0.5
    label = (x[:, 3] == x[:, 17]).astype(float)
    doc, term = np.nonzero(x)
    m = fit_machine(doc[: (doc < 2000).sum()], term[: (doc < 2000).sum()], label[:2000], 0.5, 64)
    assert m.chosen[3] >= 0 and m.chosen[17] >= 0
    right = 0
    for i in range(2000, 2500):
        t = m.chosen[np.flatnonzero(x[i])]
        t = t[t >= 0]
        z = m.bias + (margins(t, np.array([0]), m.linear, m.factors)[0][0] if len(t) else 0)
        right += (z > 0) == label[i]
    assert right > 450


def test_margins_are_the_sum_over_pairs():
    import numpy as np

    from pixelloom.llm.fm_toxicity import Machine, hashed_terms, margins

    r = np.random.default_rng(4)
    w, v = r.normal(size=6), r.normal(size=(6, 3))
    rows = [[0, 2, 5], [1], [0, 1, 2, 3, 4, 5], [3, 4]]
    cuts = np.cumsum([0, *map(len, rows)])[:-1]
    got = margins(np.concatenate(rows), cuts, w, v)[0]
    want = [sum(w[i] for i in t) + sum(v[i] @ v[j] for k, i in enumerate(t) for j in t[k + 1 :]) for t in rows]
    assert np.allclose(got, want)
    # Scores of texts are those margins, by hand, through slope and shift.
    texts = ["insulting northerners", "", "plain text of no kind", "northerners northerners"]
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)])
    doc, term = hashed_terms(data, offsets, 512)
    chosen = np.full(512, -1, np.int32)
    some = np.unique(term)[:6]
    chosen[some] = np.arange(len(some))
    m = Machine(chosen, -0.3, w, v, 1.5, 0.2)
    for i, s in enumerate(m.score(data, offsets)):
        t = sorted({int(chosen[x]) for x in term[doc == i]} - {-1})
        z = -0.3 + sum(w[k] for k in t) + sum(v[k] @ v[n] for a, k in enumerate(t) for n in t[a + 1 :])
        assert abs(s - 1 / (1 + np.exp(-(1.5 * z + 0.2)))) < 1e-12


def test_votes_as_by_brute_force_with_ties():
    import numpy as np

    from pixelloom.llm.knn_quality import Space

    r = np.random.default_rng(5)
    voters = np.round(r.normal(size=(40, 4)))
    voters = voters[(voters != 0).any(axis=1)]
    voters /= np.linalg.norm(voters, axis=1, keepdims=True)
    labels = r.random(len(voters))
    x = voters[r.integers(0, len(voters), 30)]
    for k in (1, 3, 7, 100):
        got = Space(np.ones(1), np.ones((1, 1)), voters, labels, 0.4, k).score(x)
        order = r.permutation(len(voters))
        again = Space(np.ones(1), np.ones((1, 1)), voters[order], labels[order], 0.4, k).score(x)
        for i, q in enumerate(x):
            cosine = voters @ q
            least = sorted(cosine)[-min(k, len(cosine))]
            votes = [(max(c, 0) ** 4, y) for c, y in zip(cosine, labels) if c >= least - 1e-12]
            want = (sum(w * y for w, y in votes) + 1e-3 * 0.4) / (sum(w for w, _ in votes) + 1e-3)
            assert abs(got[i] - want) < 1e-9 and abs(again[i] - want) < 1e-9


@pytest.mark.parametrize("make", [quality_scores, toxicity_scores])
def test_scores_do_not_depend_on_partitions(spark, tables, make):
    docs, labels = tables
    every = lambda doc: F.lit(True)
    a, b = ({r.doc_id: r.score for r in make(docs.select("doc_id", "text").repartition(n), labels.repartition(n), every).collect()} for n in (1, 7))
    assert a == pytest.approx(b, rel=1e-9)


@pytest.mark.parametrize("make", [quality_scores, toxicity_scores])
def test_odd_tables(spark, tables, make):
    docs, labels = tables
    every = lambda doc: F.lit(True)
    assert make(docs.select("doc_id", "text").limit(0), labels, every).count() == 0
    rows = make(docs.select("doc_id", "text").filter("doc_id >= 4999"), labels.limit(0), every).collect()
    assert len(rows) == 2 and all(r.score is not None and r.predicted == 0 for r in rows)
    odd = spark.createDataFrame([(None, 1, 1), (1, None, 0), (1, 1, 1), (2, 7, 9)], "doc_id long, quality int, toxic int")
    extra = spark.createDataFrame([(1, "a b", 1, "z"), (1, "a b", 2, "z"), (None, "c", 3, None)], "doc_id long, text string, x0 int, label string")
    out = make(extra, odd, every)
    assert out.columns == ["doc_id", "text", "x0", "label", "score", "predicted"] and out.count() == 3
    own = make(docs, labels, every)  # has a column score, which is replaced
    assert own.columns == ["doc_id", "text", "score", "predicted"] and dict(own.dtypes)["score"] == "double" and own.count() == docs.count()
