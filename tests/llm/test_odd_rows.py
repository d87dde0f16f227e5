"""What every operator does with nulls, empty and very long texts, repeated rows and clashing names, in one table."""

import pytest
from pyspark.sql import functions as F

from pixelloom.llm import queries
from pixelloom.llm.decontaminate import decontaminate
from pixelloom.llm.fm_toxicity import toxicity_scores
from pixelloom.llm.hilbert import hilbert_shards
from pixelloom.llm.knn_quality import quality_scores
from pixelloom.llm.license_scan import license_scan
from pixelloom.llm.segment_bpe import bpe_encode
from pixelloom.llm.shingle_dedup import drop_near_copies
from pixelloom.llm.simhash import simhash_groups
from pixelloom.llm.substring_dedup import substring_dedup
from pixelloom.llm.suffix_dedup import suffix_dedup
from pixelloom.llm.token_alignment import token_alignment
from pixelloom.llm.wfst import encode_documents

NAMES = ["doc_id", "text", "lang", "source", "n_chars", "doc", "fp", "row", "block", "part", "payload", "term", "cell", "x0", "score", "size", "label"]
LONG = " ".join(f"word{i % 40_000}" for i in range(120_000))


@pytest.fixture(scope="module")
def docs(spark):
    texts = [(None, None), (1, ""), (1, None), (2, LONG), (3, LONG + " end"), (None, "mit license for all of you"), (5, "x"), (5, "x"), (6, " \n "), (7, "\U0001f600" * 3000), (-4, "one two three four five six seven eight nine ten eleven")]
    rows = [(i, t, None if k % 3 == 0 else "en", None if k % 2 else "web", None, *["clash"] * 12) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, ", ".join(f"`{n}` {'long' if n in ('doc_id', 'n_chars') else 'string'}" for n in NAMES)).repartition(3)


@pytest.fixture(scope="module")
def tables(spark):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (None, 1, 1), (2, None, None), (3, 1, 0), (-4, 0, 1)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "three four five"), (None, None), (2, ""), (3, LONG)], "item_id long, text string")
    return labels, items


def operators(labels, items):
    every = lambda doc: F.lit(True)
    return {
        "op1": lambda d: substring_dedup(d, extra=["row", "block"]),
        "op2": lambda d: toxicity_scores(d, labels, every),
        "op3": license_scan,
        "op4": lambda d: encode_documents(d, queries.MODEL),
        "op6": lambda d: quality_scores(d, labels, every),
        "op7": simhash_groups,
        "op8": lambda d: suffix_dedup(d, extra=["row", "block"]),
        "op9": hilbert_shards,
        "op10": lambda d: decontaminate(d, items, proximity=20),
        "op11": lambda d: token_alignment(d, queries.BYTE_BPE, queries.MODEL),
        "op12": lambda d: bpe_encode(d, queries.WORD_BPE),
    }


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op6", "op7", "op8", "op9", "op10", "op11", "op12"])
def test_one_row_for_each_row(docs, tables, name):
    make = operators(*tables)[name]
    rows = make(docs).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in docs.select("doc_id").collect())
    assert make(docs.limit(0)).count() == 0
    if name == "op10":
        assert sorted(r.n_items for r in rows) == [0] * 8 + [1, 1, 1] and max(r.n_words for r in rows) == 120_001
    if name in ("op1", "op8"):
        assert {r.doc_id for r in rows if r.n_removed > 0} == ({2, 3} if name == "op1" else {2, 3, 7})
        assert all({r["row"], r["block"]} == {"clash"} for r in rows)


def test_near_copies_of_odd_rows(docs):
    kept = drop_near_copies(docs).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(map(str, [1, 2, None, 5, 7, -4]))
    assert all(r.score == "clash" and r.size == "clash" for r in kept) and drop_near_copies(docs.limit(0)).count() == 0
