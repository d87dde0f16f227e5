"""Collocations against counting by hand, with sketches so small that most phrases collide."""

import random
import re
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from pixelloom.llm import collocations as module
from pixelloom.llm.collocations import collocations, phrase_counts

SPLIT = re.compile(r"[.,;:!?\x0a-\x0d]")


def brute(rows, least, longest, top, scale=2_000_000, covered=80):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in SPLIT.split(text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f.setdefault(lang, Counter())[tuple(w[i : i + k])] += 1
    out = []
    for lang, count in f.items():
        found = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items()):
                continue
            cuts = [(int(Fraction(scale * a, count[p[:k]] + count[p[k:]])), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def texts(seed, n=400):
    rnd = random.Random(seed)
    words = ["New", "york", "city", "of", "the", "café", "Été", "a", " b", "\x00", "x" * 80, *(f"w{i}" for i in range(60))]
    out = []
    for _ in range(n):
        w = [rnd.choice(words[:6] if rnd.random() < 0.4 else words) + rnd.choice(["", "", "", "", ",", "\t", "\n", "!", ".."]) for _ in range(rnd.randrange(0, 50))]
        if rnd.random() < 0.5:
            w[len(w) // 2 : 0] = ["in", "New", "York", "city"]
        out.append((rnd.choice(["en", "en", "de", None, ""]), rnd.choice([" ", "  "]).join(w)))
    return [*out, (None, None), ("en", None), ("en", ""), ("fr", " .,; "), *[("en", "again and again and again and again")] * 9]


@pytest.mark.parametrize("seed,power", [(1, 16), (2, 3)])
def test_equals_counting(spark, monkeypatch, seed, power):
    if power < 16:
        for name in ("LEAST", "MOST", "STRIPE"):
            monkeypatch.setattr(module, name, power)
    given = texts(seed)
    docs = spark.createDataFrame([(*x, "clash", 1) for x in given], "lang string, text string, phrase string, a long").repartition(5)
    assert rows_of(collocations(docs, least=6, longest=4, top=50)) == brute(given, 6, 4, 50)
    counts = phrase_counts(docs.fillna("und", ["lang"]), 4, 6)
    assert {r.lang: r.f for r in counts.filter("k = 0").collect()} == {lang: n for lang, n in ((lang, sum(len(re.findall(r"[^\x20\x09.,;:!?\x0a-\x0d]+", t or "")) for x, t in given if (x if x is not None else "und") == lang)) for lang in ("en", "de", "und", "", "fr"))}


def test_one_language_and_ties(spark):
    given = [("en", "b a. a b. c d")] * 7
    docs = spark.createDataFrame(given, "lang string, text string")
    got = rows_of(collocations(docs, least=7, top=2))
    assert got == brute(given, 7, 4, 2) and [g[2] for g in got] == ["c d", "a b"]


def test_large_counts_are_exact(spark, monkeypatch):
    """Counts whose products pass 64 bits."""
    big = 9 * 10**18
    counts = spark.createDataFrame([("en", 0, "", big), ("en", 1, "a", big), ("en", 1, "b", big - 1), ("en", 2, "a b", big - 7)], "lang string, k long, phrase string, f long")
    monkeypatch.setattr(module, "phrase_counts", lambda *_: counts)
    docs = spark.createDataFrame([], "lang string, text string")
    assert rows_of(collocations(docs)) == [("en", 1, "a b", big - 7, big, big - 1, big, 2_000_000 * (big - 7) // (2 * big - 1))]


def test_hot_text_and_empty_table(spark):
    docs = spark.range(3000).select(F.lit("en").alias("lang"), F.when(F.col("id") % 3 == 0, F.lit("the same line of words")).otherwise(F.concat(F.lit("word"), F.col("id"))).alias("text"))
    got = rows_of(collocations(docs))
    assert [(g[2], g[3]) for g in got] == [("line of words", 1000), ("same line of", 1000)][:0] + [("same line of words", 1000), ("the same line of", 1000)]
    assert collocations(docs.limit(0)).count() == 0
