"""Colour reduction of many histograms at once against the kernel that takes one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.functions.color import coarse_key
from pixelloom.operators import grouped, reduction
from pixelloom.operators.kernels import Options, quantize_histogram
from pixelloom.plans import catalogue
from pixelloom.sources import png

SF = "/root/testdata/sf0.001"


def histograms(rnd, sizes, levels):
    """Buckets with clear ones, few alphas and, of few levels, many equal gains."""
    cnt, a = rnd.integers(1, 5, sizes.sum()), rnd.choice([0, 1, 128, 255], sizes.sum())
    rgb = rnd.integers(0, levels, (len(cnt), 3)) * (255 // (levels - 1))
    return cnt, np.concatenate([rgb * (a * cnt)[:, None], (a * cnt)[:, None]], axis=1).astype(float), np.concatenate([[0], np.cumsum(sizes)])


@pytest.mark.parametrize("options", [Options(max_colors=16), Options(max_colors=1), Options(max_colors=2, kmeans=0), Options(max_colors=7, kmeans=5), Options()])
@pytest.mark.parametrize("levels", [3, 256])
def test_many_histograms_at_once_equal_one_by_one(monkeypatch, options, levels):
    monkeypatch.setattr(reduction, "GO", 256)
    rnd = np.random.default_rng(options.max_colors + levels)
    sizes = np.concatenate([rnd.integers(1, 60, 30), [reduction.SMALL + 5, 400, 1, 2, 3]])
    cnt, sums, ends = histograms(rnd, sizes, levels)
    pal, entries, label = reduction.quantize_histograms(cnt, sums, ends, options)
    at = np.cumsum([0, *entries])
    assert len(entries) == len(sizes) and at[-1] == len(pal)
    for i, (lo, hi) in enumerate(zip(ends, ends[1:])):
        want, place, _ = quantize_histogram(cnt[lo:hi], sums[lo:hi], options)
        assert np.array_equal(pal[at[i] : at[i + 1]], want) and np.array_equal(label[lo:hi], place)


def test_shares_hold_whole_images(monkeypatch):
    monkeypatch.setattr(reduction, "SHARED", 10)
    assert list(reduction.shares(np.array([0, 4, 10, 11, 40, 41, 45]))) == [(0, 2), (2, 3), (3, 4), (4, 6)]
    assert list(reduction.shares(np.array([7]))) == []


def test_images_of_a_batch_share_the_reduction(spark, monkeypatch):
    """No image is reduced by itself; the batch's images are cut in rounds."""
    rows = catalogue.QUERIES["quantize"](spark, SF).groupBy("image_id").agg(F.max("idx").alias("n")).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/part.parquet").count() and max(r.n for r in rows) == 15
    monkeypatch.setattr(reduction, "quantize_histogram", None)
    cnt, sums, ends = histograms(np.random.default_rng(1), np.full(50, 100), 256)
    assert reduction.quantize_histograms(cnt, sums, ends, Options(max_colors=16))[1].max() == 16


def test_encoding_shuffles_rows_of_the_table_alone(spark):
    plan = catalogue.QUERIES["encode_png"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM") > 0


def test_files_of_one_batch_with_keys_of_each_precision(spark):
    """Few colours, many opaque ones and many translucent ones, by a small limit of exact colours."""
    alpha = F.when(F.col("image_id") == 2, 100 + F.col("x")).otherwise(255)
    level = lambda n: F.when(F.col("image_id") == 0, 40).otherwise((F.col("x") * n + F.col("y") * 29 + F.col("image_id")) % 256)
    p = spark.range(3 * 80).selectExpr("id div 80 AS image_id", "10 AS width", "8 AS height", "int(id % 10) AS x", "int(id % 80 div 10) AS y")
    p = p.withColumns({"a": alpha.cast("int"), **{c: level(n).cast("int") for c, n in zip("rgb", (7, 31, 53))}})
    options = Options(max_colors=8)
    entry = {(r.image_id, r.key): (r.bits, [r.a, r.r, r.g, r.b]) for r in grouped.palettes(p, options, limit=20).collect()}
    files = {r.image_id: r for r in grouped.encode_png(p.coalesce(1), options, limit=20).collect()}
    keyed = p.withColumn("bits", F.when(F.col("image_id") == 0, 0).when(F.col("image_id") == 1, 6).otherwise(5))
    keyed = keyed.select("*", coarse_key(F.col("bits"), *[F.col(c) for c in "argb"]).alias("key")).collect()
    images = {i: png.decode(bytes(f.content)) for i, f in files.items()}
    assert {i: f.lossless for i, f in files.items()} == {0: True, 1: False, 2: False}
    for q in keyed:
        bits, color = entry[q.image_id, q.key]
        assert bits == q.bits and images[q.image_id][q.y, q.x].tolist() == color
