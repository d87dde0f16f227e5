"""Registered queries against their SQL, and by brute force where there is none."""

import hashlib

import pytest

from pixelloom.llm import queries
from tests.llm.test_dedup import brute, groups, simhash
from tests.oracle import connection, rows_of, rows_of_sql

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connection(SF)


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_equals_sql(spark, duck, name):
    got, want = rows_of(queries.QUERIES[name](spark, SF)), rows_of_sql(duck, queries.ORACLES[name])
    assert got[0] == want[0] and got[1] == want[1] and got[1]


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_op7(spark, texts):
    fps = {d: simhash(t) for d, t in texts.items()}
    want = groups([(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2], fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.QUERIES["op7_simhash"](spark, SF).collect()}
    assert got == {d: (f"{f:016x}", want[d]) for d, f in fps.items()}


def test_op8_by_brute_force_too(spark, texts):
    want = brute([(d, (t or "").encode()) for d, t in texts.items()], 100)
    for r in queries.QUERIES["op8_suffix_dedup"](spark, SF).collect():
        w, gone = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.kept_sha256) == (len(w), sum(gone), hashlib.sha256(bytes(x for x, g in zip(w, gone) if not g)).hexdigest())


@pytest.mark.parametrize("name,column,modulus,held", [("op2_fm_toxicity", "toxic", 3, 1), ("op6_knn_quality", "quality", 4, 2)])
def test_classifiers(spark, texts, name, column, modulus, held):
    import zlib

    labels = {r.doc_id: r[column] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries.QUERIES[name](spark, SF).collect()
    assert {r.doc_id for r in rows} == set(texts)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == held) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    learnt = [r for r in rows if not r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in learnt) / len(learnt) > 0.85


def test_op4(spark, texts):
    from pixelloom.llm.wfst import decode_documents

    out = queries.QUERIES["op4_wfst_sentencepiece"](spark, SF)
    assert {r.doc_id: r.text for r in decode_documents(out, queries.MODEL).collect()} == {d: t or "" for d, t in texts.items()}
