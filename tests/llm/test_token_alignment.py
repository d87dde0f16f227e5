"""Alignment of two tokenizers against a walk over both token lists, in parts and stripes of any number."""

import hashlib
from collections import Counter

import pytest

from pixelloom.llm import queries, token_alignment
from pixelloom.llm.token_alignment import _byte_letters

SF = "/root/testdata/sf0.001"
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def tokens():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(queries.BYTE_BPE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=queries.MODEL)
    byte = {c: n for n, c in _byte_letters().items()}

    def read(text):
        one, two = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in one]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in two]
        return one, two, bytes_a, bytes_b

    return read


def walk(text, tokens):
    """(groups, links) of a text, None if either side does not give it back."""
    if not text:
        return None
    a, b, x, y = tokens(text)
    want = b" " + text.encode()
    if b"".join(x) != want or b"".join(y) != want:
        return None
    spans = []
    for ids, parts in ((a, x), (b, y)):
        at, out = 0, []
        for i, p in zip(ids, parts):
            out.append((at, at + len(p), i))
            at += len(p)
        spans.append(out)
    ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
    start, groups = 0, []
    for e in ends:
        groups.append(tuple([i for s, t, i in side if start <= s and t <= e] for side in spans))
        start = e
    links = [(i, j) for s, e, i in spans[0] for t, f, j in spans[1] if max(s, t) < min(e, f)]
    return groups, links


def brute(texts, tokens):
    walked = [walk(t, tokens) for t in texts]
    count = Counter(link for w in walked if w for link in w[1])
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = []
    for w in walked:
        if w is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        groups, links = w
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(count[k] == best[k[1]] for k in links), sum(count[k] for k in links), hashlib.sha256(shown.encode()).hexdigest()))
    return out, count, best


ODD = [None, "", " ", "a", "x ▁ y", "<|endoftext|> and <s>", "tab\tand\nline", "\U0001f600 café naïve", "中文", "same text here", "same text here", "a" * 3000, "  two  spaces ", "\x00\x01", "́e"]


@pytest.mark.parametrize("part,block", [(None, None), (200, None), (64, 3 << 20)])
def test_equals_a_walk(spark, tokens, monkeypatch, part, block):
    if part:
        monkeypatch.setattr(token_alignment, "PART", part)
    if block:
        monkeypatch.setattr(token_alignment, "BLOCK", block)
    docs = spark.createDataFrame([(None if i == 3 else i // 2, t, "clash", "clash", "clash") for i, t in enumerate(ODD)], "doc_id long, text string, doc string, cell string, batch string").repartition(3)
    want, count, best = brute(ODD, tokens)
    rows = token_alignment.token_alignment(docs, queries.BYTE_BPE, queries.MODEL).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in rows) == sorted(want)
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(None if i == 3 else i // 2) for i in range(len(ODD)))
    if block is None:
        pairs = token_alignment.token_alignment(docs, queries.BYTE_BPE, queries.MODEL, counts=True).collect()
        assert {(r.a, r.b): (r.n, r.best) for r in pairs} == {k: (n, n == best[k[1]]) for k, n in count.items()}


def test_query_equals_a_walk(spark, tokens):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) < 6000").collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) < 6000")
    want = dict(zip(texts, brute(list(texts.values()), tokens)[0]))
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in token_alignment.token_alignment(docs, queries.BYTE_BPE, queries.MODEL).collect()}
    assert got == want
    whole = queries.QUERIES["op11_token_alignment"](spark, SF)
    assert whole.count() == 200 and set(whole.columns) == {"doc_id", *COLUMNS}


def test_empty_table(spark):
    assert token_alignment.token_alignment(spark.createDataFrame([], "doc_id long, text string"), queries.BYTE_BPE, queries.MODEL).count() == 0
