"""Every registered raster query against its SQL, and the driver's entry points."""

import importlib
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.operators import grouped, kernels
from pixelloom.operators.kernels import Options
from pixelloom.plans import catalogue, views
from pixelloom.sources import png
from tests.oracle import connection, rows_of, rows_of_sql

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connection(SF)


@pytest.mark.parametrize("name", list(catalogue.ORACLES))
def test_equals_sql(spark, duck, name):
    got, want = rows_of(catalogue.QUERIES[name](spark, SF)), rows_of_sql(duck, catalogue.ORACLES[name])
    assert got[0] == want[0] and len(got[1]) == len(want[1]) > 0
    assert got[1] == want[1]


def test_only_these_have_no_sql():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLES) == {"quantize", "encode_png", "quantize_dither"}


def rasters_of(spark, view, some):
    """(h, w, 4: a, r, g, b) of some images of a view."""
    out = {}
    for r in getattr(views, view)(spark, SF).filter(F.col("image_id").isin(some)).collect():
        out.setdefault(r.image_id, np.zeros((r.height, r.width, 4), np.int64))[r.y, r.x] = (r.a, r.r, r.g, r.b)
    return out


def naive_weights(raster, strength=3.0):
    """By a least-squares plane through each pixel's surroundings, then the least weight around it."""
    p = raster[..., 1:] * raster[..., :1] / 255.0
    p = np.concatenate([p, raster[..., :1]], axis=2)
    h, w, _ = p.shape
    grid = np.array([(u, v, 1) for v in (-1, 0, 1) for u in (-1, 0, 1)], float)
    weight = np.zeros((h, w), int)
    for y in range(h):
        for x in range(w):
            near = np.array([p[min(max(y + v, 0), h - 1), min(max(x + u, 0), w - 1)] for u, v, _ in grid.astype(int)])
            fit = np.linalg.lstsq(grid, near, rcond=None)[0]
            d = np.sqrt(round(((near - grid @ fit) ** 2).sum(), 9) / 6) / 12
            weight[y, x] = int(strength / (1 + d * d) + 0.5) + 1
    wide = np.pad(weight, 1, "edge")
    return np.min([wide[v : v + h, u : u + w] for v in range(3) for u in range(3)], axis=0)


def naive_palette(raster, weight, options):
    packed = grouped.pack(raster)
    packed = np.where(raster[..., 0].ravel() == 0, 0, packed)
    keys, first, of = np.unique(packed, return_index=True, return_inverse=True)
    flat, w = raster.reshape(-1, 4).astype(float), weight.ravel().astype(float)
    cnt = np.bincount(of, weights=w)
    sums = np.stack([np.bincount(of, weights=w * flat[:, c] * (flat[:, 0] if c else 1)) for c in (1, 2, 3, 0)], axis=1)
    order = np.argsort(first)
    pal, label, lossless = kernels.quantize_histogram(cnt[order], sums[order], options)
    return {int(k): int(i) for k, i in zip(keys[order], label)}, pal, lossless


def test_quantize_by_naive_weights_and_histograms(spark):
    some = [1, 2, 3, 5, 8, 13]
    found = {}
    for r in catalogue.QUERIES["quantize"](spark, SF).filter(F.col("image_id").isin(some)).collect():
        found.setdefault(r.image_id, {})[r.key] = (r.idx, r.a, r.r, r.g, r.b, r.bits, r.lossless)
    for image, raster in rasters_of(spark, "synth", some).items():
        index, pal, lossless = naive_palette(raster, naive_weights(raster), Options(max_colors=16))
        assert found[image] == {k: (i, *pal[i].tolist(), 0, lossless) for k, i in index.items()}


def naive_dither(raster, pal, amount):
    """Rows in turns from the left and from the right; each pixel's error to the next one and to three of the row below."""
    h, w, _ = raster.shape
    owed = [[[0.0, 0.0, 0.0] for _ in range(w)] for _ in range(h)]
    index = np.zeros((h, w), int)
    entries = [[e[c] * e[0] / 255 for c in (1, 2, 3)] + [e[0]] for e in pal.tolist()]
    for y in range(h):
        step = -1 if y % 2 else 1
        for x in range(w)[::step]:
            a, *rgb = raster[y, x].tolist()
            aim = [min(max(v * a / 255 + owed[y][x][c] * amount, 0), a) for c, v in enumerate(rgb)]
            if a == 255:
                aim = [float(np.floor(v + 0.5)) for v in aim]
            far = [sum((s - t) ** 2 for s, t in zip([*aim, a], e)) for e in entries]
            pick = index[y, x] = min(range(len(far)), key=lambda i: (round(far[i], 6), i))
            if not a:
                continue
            for dx, dy, part in ((1, 0, 7), (-1, 1, 3), (0, 1, 5), (1, 1, 1)):
                tx, ty = x + dx * step, y + dy
                if 0 <= tx < w and ty < h:
                    for c in range(3):
                        owed[ty][tx][c] += (aim[c] - entries[pick][c]) * part / 16
    return index


@pytest.mark.parametrize("amount", [0.3, 0.5, 1.0])
def test_palette_dither_by_a_naive_walk(amount):
    rnd = np.random.default_rng(int(amount * 10))
    for size in ((7, 9), (1, 12), (12, 1), (16, 16)):
        raster = rnd.integers(0, 256, (*size, 4))
        raster[..., 0] = rnd.choice([0, 128, 255, 255], size)
        pal = rnd.integers(0, 256, (6, 4))
        pal[0] = 0
        assert (kernels.dither_palette(raster, pal, amount) == naive_dither(raster, pal, amount)).all()


@pytest.mark.parametrize("name,view,options", [("encode_png", "synth", Options(max_colors=16)), ("quantize_dither", "rgba4", Options(max_colors=4, dither=0.5))])
def test_encoded_files_hold_the_reduced_pixels(spark, name, view, options):
    some = [0, 1, 2, 3, 5, 8]
    rows = catalogue.QUERIES[name](spark, SF).filter(F.col("image_id").isin(some)).collect()
    rasters = rasters_of(spark, view, some)
    assert {r.image_id for r in rows} == set(rasters) and len(rows) >= 5
    for r in rows:
        raster = rasters[r.image_id]
        index, pal, lossless = naive_palette(raster, naive_weights(raster), options)
        got = png.decode(bytes(r.content))
        assert (r.width, r.height, r.colors, r.lossless) == (raster.shape[1], raster.shape[0], len(pal), lossless)
        if options.dither and not lossless:
            want = pal[naive_dither(raster, pal, options.dither)]
        else:
            keys = np.where(raster[..., 0] == 0, 0, grouped.pack(raster).reshape(raster.shape[:2]))
            want = pal[np.vectorize(index.get)(keys)]
        assert (got == want).all()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries()) >= set(catalogue.QUERIES)


def test_entry_without_the_optional_package(monkeypatch):
    import importlib.util

    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name.startswith(("pixelloom.llm", "corpus_pipeline")) else real(name, *a))
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    e = importlib.import_module("__spark_entry__")
    assert list(e.queries()) == list(catalogue.QUERIES) and e.oracle_sql() == catalogue.ORACLES
    sys.modules.pop("__spark_entry__")


def test_same_rows_from_one_partition_and_many(spark):
    from pixelloom.operators import stencil

    p = views.synth(spark, SF).filter("image_id < 20")
    for make in (lambda d: stencil.importance(d), lambda d: grouped.palettes(d, Options(max_colors=8))):
        assert rows_of(make(p.coalesce(1))) == rows_of(make(p.repartition(7, "x")))


def test_skips_unused_columns_and_pushes_filters(spark):
    plan = catalogue.QUERIES["bayer"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "label" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert "p_name" not in views.synth(spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["place_crop", "align_box", "box_shrink", "binary_mask_bytes", "color_histogram", "distinct_colors", "scale_mixed", "ssim", "color_error_white", "png_filter_choice"])
def test_pixels_of_images_are_not_shuffled(spark, name):
    """The only exchanges are of rows of the table, before pixels are made of them, and nothing is broadcast."""
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM") > 0


def test_rasters_are_compared_without_a_broadcast(spark):
    assert "Broadcast" not in catalogue.QUERIES["similarity_resized"](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["header_size", "png_round_trip", "png_icc"])
def test_rasters_dealt_by_image_are_not_dealt_again(spark, name):
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan[plan.rindex("MapInArrow") :].count("Exchange hashpartitioning") == 1
    assert plan.count("Exchange hashpartitioning") == (2 if name == "png_round_trip" else 1)  # its sums by image are a shuffle


def test_rasters_of_a_batch_keep_to_their_own_pixels(spark):
    """Too many pixels are cut, and the next raster begins where its own begin; high bits of a packed pixel count nothing."""
    rows = [(i, w, 2, [(k << 32) + 4000000000 + 100 * i + k for k in range(2 * w + i % 3)]) for i, w in enumerate([3, 1, 4, 2, 5, 1])]
    rasters = spark.createDataFrame(rows, "image_id long, width int, height int, argb array<bigint>").coalesce(1)
    want = sorted((i, h * w, sum((v >> 24 & 255) + (v & 255) for v in argb[: w * h])) for i, w, h, argb in rows)
    for dealt in (True, False):
        got = grouped.each_raster(rasters, lambda r: (r[..., 0].size, int((r[..., 0] + r[..., 3]).sum())), "n bigint, s bigint", dealt)
        assert sorted(map(tuple, got.collect())) == want
    with pytest.raises(Exception, match="bad image"):
        grouped.each_raster(spark.createDataFrame([(1, 2, 2, [1, 2, 3])], rasters.schema), lambda r: (r.size,), "n bigint").collect()
