"""Curve, shards and slots."""

import itertools
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from pixelloom.llm.hilbert import hilbert_index, hilbert_shards, write_shards


def test_curve_is_hilbert(spark):
    """Each cell once; neighbours on the curve are neighbours in space."""
    for n, bits in ((2, 3), (3, 3), (4, 2)):
        cells = spark.createDataFrame(list(itertools.product(range(1 << bits), repeat=n)), ", ".join(f"x{i} int" for i in range(n)))
        got = cells.withColumn("at", hilbert_index([F.col(f"x{i}") for i in range(n)], bits)).orderBy("at").collect()
        assert [r["at"] for r in got] == list(range(1 << bits * n))
        for a, b in zip(got, got[1:]):
            assert sum(abs(x - y) for x, y in zip(a[:n], b[:n])) == 1


def check(rows, got, shards, least_even):
    assert len(got) == len(rows)
    text = defaultdict(list)
    for i, t, *_ in rows:
        text[i].append(t or "")
    slots, sizes, homes = defaultdict(list), Counter(), defaultdict(set)
    for r in got:
        assert any(r.size == len(t.encode()) + 1 and r.text_crc32 == zlib.crc32(t.encode()) for t in text[r.doc_id])
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
        homes[r.text_crc32, r.size].add(r.shard)
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    share = sum(sizes.values()) / shards
    assert all(abs(sizes[s] - share) <= least_even * share for s in range(shards))
    return homes


def test_shards(spark):
    rows = [(i, "x" * (i * 7919 % 900) + str(i % 2500), f"l{i % 4}", f"s{i % 9}") for i in range(3000)]
    rows += [(i, "copied text " * 9, f"l{i % 3}", "hot") for i in range(3000, 3100)] + [(4000, None, None, None), (4001, "", "l1", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    homes = check(rows, hilbert_shards(docs).collect(), 8, 0.05)
    assert all(len(h) == 1 for h in homes.values())


def test_a_text_that_fills_a_third(spark):
    """Only the hot text is cut; smaller groups stay whole, also those whose checksums fall on the hot text's bucket."""
    hot = "the same text over and over"
    rows = [(i, hot, "l", "s") for i in range(2000)] + [(5000 + i, f"text number {i} is short", f"l{i % 5}", "s") for i in range(4000)]
    beside = [t for t in (f"a text beside it {k:05d}" for k in range(2000)) if zlib.crc32(t.encode()) % 64 == zlib.crc32(hot.encode()) % 64][:6]
    rows += [(10_000 + 100 * k + j, t, "l", "s") for k, t in enumerate(beside) for j in range(4 if k % 2 else 40)]
    homes = check(rows, hilbert_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect(), 8, 0.1)
    assert len(beside) == 6
    split = {k for k, h in homes.items() if len(h) > 1}
    assert split == {(zlib.crc32(hot.encode()), len(hot) + 1)}


def test_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, cell int, size int"
    assert hilbert_shards(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a", None, "s", 1, 1), (2**63 - 1, "c", "l", "s", 1, 1), (-(2**63), "c", "l", "s", 1, 1), (1, "a", "l", None, 1, 1), (1, "a", "l", None, 2, 2), (1, "b", "l", "s", 2, 2)]
    docs = spark.createDataFrame(rows, schema)
    check(rows, hilbert_shards(docs).collect(), 8, 9)


def test_no_python_and_files(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = hilbert_shards(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    write_shards(docs, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.select(docs.columns).exceptAll(docs).count() == 0 and back.count() == docs.count()
    assert back.select("shard").distinct().count() == 8


def test_few_copies_of_a_large_text_are_cut(spark):
    """Nine copies of a text of 100,000 bytes among 10,000 small ones: far from a thousandth of the rows, but most of the bytes."""
    large = "large " * 16_667
    rows = [(i, large, "l", "s") for i in range(9)] + [(100 + i, f"small {i}", f"l{i % 5}", "s") for i in range(10_000)]
    got = hilbert_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)).collect()
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.size
    assert len(sizes) == 8 and max(sizes.values()) <= 2 * len(large) + 100_000
    homes = check(rows, got, 8, 9)
    assert {k for k, h in homes.items() if len(h) > 1} == {(zlib.crc32(large.encode()), len(large) + 1)}


def test_copies_without_ids_are_dealt_by_rows(spark, monkeypatch):
    from pixelloom.llm import hilbert

    seen = {}
    real = hilbert.stage
    monkeypatch.setattr(hilbert, "stage", lambda df, name: seen.setdefault(name, real(df, name)))
    for doc in ("null", "7"):
        seen.clear()
        docs = spark.range(0, 9000, 1, 4).selectExpr(f"if(id < 8000, {doc}, id) AS doc_id", "if(id < 8000, 'a copy', concat('text ', id)) AS text", "'l' AS lang", "'s' AS source")
        got = hilbert_shards(docs).collect()
        assert len(got) == 9000
        slots = defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert seen["placed"].groupBy("cell", "unit", "salt").count().agg(F.max("count")).first()[0] < 400


def test_files_of_repeated_rows(spark, tmp_path):
    rows = [(None, "a"), (None, "a"), (1, "a"), (1, "a"), (1, "b"), (2, None), (3, "")] * 3
    docs = spark.createDataFrame([(*r, "l", "s") for r in rows], "doc_id long, text string, lang string, source string")
    write_shards(docs, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out")).select(docs.columns)
    assert back.count() == docs.count() and back.exceptAll(docs).count() == 0
