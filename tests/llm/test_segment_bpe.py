"""Segment-tree BPE against the tokenizers library and against merging by search."""

import hashlib
import random

import numpy as np
import pytest

from pixelloom.llm import queries
from pixelloom.llm.segment_bpe import SegmentBPE, bpe_decode, bpe_encode, merge_word

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.WORD_BPE)


def by_search(ids, ranks, made):
    ids = [*ids]
    while found := [(ranks[k], i) for i in range(len(ids) - 1) if (k := ids[i] << 4 | ids[i + 1]) in ranks]:
        rank, i = min(found)
        ids[i : i + 2] = [made[rank]]
    return ids


def test_merges_lowest_rank_first_and_leftmost_of_equals():
    rnd = random.Random(4)
    for _ in range(400):
        pairs = [(a, b) for a in range(12) for b in range(12)]
        rnd.shuffle(pairs)
        ranks = {a << 4 | b: i for i, (a, b) in enumerate(pairs[: rnd.randrange(1, 60)])}
        made = [rnd.randrange(12) for _ in ranks]  # what pairs become merges on
        ids = [rnd.randrange(12) for _ in range(rnd.randrange(0, 70))]
        assert merge_word(ids, ranks, made, 4) == by_search(ids, ranks, made)


def test_long_words_take_n_log_n(library):
    rnd = random.Random(5)
    tokenizer = SegmentBPE(open(queries.WORD_BPE, "rb").read())
    for word in ("".join(rnd.choice("abcdefghij") for _ in range(150_000)), "ha" * 60_000):
        assert tokenizer.encode(word).tolist() == library.encode(word, add_special_tokens=False).ids


PARTS = ["a", "café", "<|endoftext|>", "<|startoftext|>", "<|endof", " ", "̈", "\x1c", "\x85", "'s", "'LL", "1", "İ", "Σ", "\n", "̸", "=", " ", "ᄀ", "ᅡ", "‍", "\U0001f600", "Å", "　", "ﬁ", "ǅ", "Wort", "!?", "_"]


def test_equals_the_library(spark, library):
    rnd = random.Random(6)
    texts = [None, "", " \n ", *("".join(rnd.choice(PARTS) for _ in range(rnd.randrange(1, 40))) for _ in range(1500))]
    texts += ["".join(chr(rnd.choice([rnd.randrange(1, 0xD800), rnd.randrange(0xE000, 0x110000)])) for _ in range(40)) for _ in range(500)]
    docs = spark.createDataFrame([(i if i % 7 else None, t, "clash", "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string, doc string").repartition(3)
    rows = bpe_encode(docs, queries.WORD_BPE, with_text=True).collect()
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    shown = [library.decode(w, skip_special_tokens=False) for w in want]
    digest = lambda ids: hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert sorted((len(w), w, digest(w), d, hashlib.sha256(d.encode()).hexdigest()) for w, d in zip(want, shown)) == sorted((r.n_tokens, r.ids, r.ids_sha256, r.decoded, r.decoded_sha256) for r in rows)
    assert sum(r.doc_id is None for r in rows) == len(range(0, len(texts), 7))
    back = bpe_decode(bpe_encode(docs, queries.WORD_BPE), queries.WORD_BPE)
    assert sorted(r.text for r in back.collect()) == sorted(shown)


def test_query_equals_the_library(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op12_segment_bpe"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_empty_tables_and_other_files(spark):
    assert bpe_encode(spark.createDataFrame([], "doc_id long, text string"), queries.WORD_BPE).count() == 0
    assert bpe_decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>"), queries.WORD_BPE).collect() == [(1, ""), (2, "")]
    with pytest.raises(ValueError):
        SegmentBPE(open(queries.BYTE_BPE, "rb").read())
