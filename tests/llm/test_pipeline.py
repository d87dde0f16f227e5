"""The pipeline's stages against brute force, each on its own input."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pixelloom.llm.common import stage
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_dedup import WORD, brute, groups
from tests.llm.test_shingle_dedup import shingles

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, function in corpus_pipeline.STAGES:
        out.append(stage(function(spark, out[-1], SF), name))
    return out


def test_columns(outputs):
    for df in outputs[1:-1]:
        assert df.columns == outputs[0].columns


def test_quality_goes_by_labels(spark, outputs):
    kept = {r.doc_id for r in outputs[1].collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    right = sum((d in kept) == bool(q) for d, q in labels.items())
    assert right / len(labels) > 0.95 and outputs[1].exceptAll(outputs[0]).count() == 0


def test_one_of_each_group_stays(outputs):
    """By five-word shingles and a Jaccard similarity of 0.8, the rule for stages on word shingles."""
    sets = {r.doc_id: shingles(r.text) for r in outputs[1].collect()}
    ids = sorted(sets)
    want = groups([(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])], ids)
    assert {r.doc_id for r in outputs[2].collect()} == {d for d, c in want.items() if d == c}


def test_repeated_spans_go(outputs):
    before = {r.doc_id: r.text for r in outputs[2].collect()}
    gone = brute([(d, re.findall(WORD, t)) for d, t in before.items()], 20)
    for r in outputs[3].collect():
        words, flags = gone[r.doc_id]
        assert re.findall(WORD, r.text) == [w for w, g in zip(words, flags) if not g] and r.n_chars == len(r.text)
        if not any(flags):
            assert r.text == before[r.doc_id]


def test_leaks_go(spark, outputs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = leaks([(r.doc_id, r.text) for r in outputs[3].collect()], items, 10)
    assert {r.doc_id for r in outputs[4].collect()} == {d for d, v in found.items() if not v[4]}


def test_run_is_the_stages(spark, outputs):
    assert outputs[5].filter("not exact").count() == 0 and outputs[5].count() == outputs[4].count()
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == outputs[5].columns and got.count() == outputs[5].count()


def test_empty_and_odd(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(3).union(docs.limit(3)).union(spark.createDataFrame([(None, None, None, None, None), (9999, "", None, None, 0)], docs.schema))
    for source in (docs.limit(0), odd):
        df = source
        for name, function in corpus_pipeline.STAGES:
            df = stage(function(spark, df, SF), name)
        assert df.count() <= 5


CLASHES = ["score", "predicted", "kept_id", "kept", "spans", "bad_id", "bad", "block", "doc", "hash", "row", "node", "h", "term", "n_words", "x0", "column3", "Kept", "id"]


def test_rows_and_columns_of_any_name(spark):
    """Ids that are null or repeated, and extra columns that bear the names that operators use inside."""
    r = random.Random(8)
    words = [w for x in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(60).collect() for w in x.text.split()][:4000]
    some = lambda k: " ".join(r.choice(words) for _ in range(k))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").filter("length(text) > 80").first().text
    shared, twin = some(30), some(80)
    rows = [(None, f"{some(20)} {item}"), (None, some(60)), (None, some(61)), (7, some(62)), (7, f"{some(10)} {item} {some(5)}"), (7, some(63)), (5, twin), (None, twin + " end"), (8, twin), (9, twin), (9, twin)]
    rows += [(20, f"{some(40)} {shared}"), (20, f"{some(41)} {shared}"), (None, None), (30, "")]
    names = ["doc_id", "text", "lang", "source", "n_chars", *CLASHES]
    table = [(i, t, "en", "web", len(t or ""), *[f"{c}{k}" for c in CLASHES]) for k, (i, t) in enumerate(rows)]
    docs = spark.createDataFrame(table, ", ".join(f"`{n}` {'long' if n in ('doc_id', 'n_chars') else 'string'}" for n in names))
    before = spark.conf.get("spark.sql.caseSensitive")
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        out = {}
        for name, function in corpus_pipeline.STAGES[:-1]:
            source = docs if name != "span_dedup" else out["near_dedup"]
            out[name] = stage(function(spark, source, SF), name)
            assert out[name].columns == names and out[name].schema.simpleString() == docs.schema.simpleString()
        row = lambda name: sorted(int(x["score"][5:]) for x in out[name].collect())
        for name in out:
            for x in out[name].collect():
                assert len({x[c].removeprefix(c) for c in CLASHES}) == 1  # each row's own values
        assert set(row("quality")) <= set(range(len(rows)))
        near = row("near_dedup")
        assert set(near) >= {0, 1, 2, 3, 4, 5, 6, 11, 12} and not {7, 8, 9, 10} & set(near) and len(near) == 10
        assert row("span_dedup") == near
        cut = {int(x["score"][5:]): x.text for x in out["span_dedup"].collect()}
        assert sum(cut[k].endswith(shared) for k in (11, 12)) == 1 and all(cut[k] == rows[k][1] for k in near if k not in (4, 11, 12, 0) and rows[k][1])
        assert row("decontamination") == [k for k in range(len(rows)) if k not in (0, 4)]
    finally:
        spark.conf.set("spark.sql.caseSensitive", before)


def test_a_shared_hash_costs_no_clean_text(spark, tmp_path, monkeypatch):
    """The first hash of all texts is one and the same here: only the text that is hit goes, and its copies."""
    import corpus_pipeline

    class Poor:
        def __getattr__(self, name):
            return getattr(F, name)

        @staticmethod
        def xxhash64(*columns):
            return F.lit(1).cast("long") if len(columns) == 1 else F.xxhash64(*columns)

    item = "one two three four five six seven eight nine ten eleven"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, f"before {item} after"), (2, "clean text"), (2, None), (None, "another clean text"), (5, f"before {item} after"), (6, "")]
    docs = spark.createDataFrame([(i, t, "one", "two") for i, t in rows], "doc_id long, text string, one string, two string")
    monkeypatch.setattr(corpus_pipeline, "F", Poor())
    kept = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == sorted((str(i), str(t)) for i, t in rows if item not in (t or ""))
