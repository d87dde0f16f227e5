"""Published values of colours, masks and dithers."""

import pytest
from pyspark.sql import functions as F

from pixelloom.functions import color
from pixelloom.operators import masks, measure, pixels, resample

SCHEMA = "image_id long, width int, height int, x int, y int, a int, r int, g int, b int"


def image(spark, rows, width=None, image_id=1):
    """Pixels from rows of packed ARGB, all in one line unless a width is given."""
    w = width or len(rows)
    return spark.createDataFrame([(image_id, w, len(rows) // w, i % w, i // w, c >> 24 & 255, c >> 16 & 255, c >> 8 & 255, c & 255) for i, c in enumerate(rows)], SCHEMA)


def packed(df):
    return [r.a << 24 | r.r << 16 | r.g << 8 | r.b for r in df.orderBy("y", "x").collect()]


def test_compose():
    white, blue = (255, 255, 255), (0, 0, 255)
    assert color.compose((255, *white), (204, *blue)) == (92, 92, 255)
    assert color.compose((77, *white), (128, *blue)) == (58, 58, 122)


def test_compose_columns(spark):
    rows = [(255, 255, 255, 255, 204, 0, 0, 255), (77, 255, 255, 255, 128, 0, 0, 255), (0, 9, 8, 7, 0, 1, 2, 3), (13, 200, 100, 50, 255, 1, 2, 3)]
    df = spark.createDataFrame(rows, "a int, r int, g int, b int, a2 int, r2 int, g2 int, b2 int")
    out = df.select(*[c.alias(n) for n, c in zip("rgb", color.compose_columns(tuple(F.col(c) for c in "argb"), tuple(F.col(c + "2") for c in "argb")))])
    assert [tuple(x) for x in out.collect()] == [color.compose(x[:4], x[4:]) for x in rows]


def test_gray(spark):
    df = image(spark, [0xFF000000, 0, 0x80000000, 0x00FF0000])
    assert [r.g for r in df.select(color.on_white(*[F.col(c) for c in "argb"]).alias("g")).collect()] == [0, 255, 128, 255]
    grays = [0, 0x40, 0x80, 0xC0, 0xFF]
    df = image(spark, [0xFF000000 + g * 0x10101 for g in grays])
    assert [r.r for r in pixels.gray_pixels(df).orderBy("x").collect()] == grays
    assert [r.v for r in df.select(color.rgb_to_gray(F.col("r"), F.col("g"), F.col("b")).alias("v")).collect()][::4] == [0.0, 1.0]


@pytest.mark.parametrize("name", ["BAYER", "CLUSTERED"])
def test_every_level_lights_its_share(spark, name):
    levels = spark.range(256).select(F.col("id").alias("image_id"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("p"), F.col("id").cast("int").alias("gray"))
    bits = masks.ordered_dither(levels.select("image_id", "width", "height", (F.col("p") % 8).alias("x"), F.floor(F.col("p") / 8).cast("int").alias("y"), "gray"), name)
    lit = {r.image_id: r.n for r in bits.groupBy("image_id").agg(F.sum("bit").alias("n")).collect()}
    assert lit == {g: min(64, (g + 3) // 4) for g in range(256)}


def test_color_key(spark):
    df = image(spark, [0xFFFFFFFF, 0xFFF8F8F8, 0xFFFA0000, 0xFF000000])
    alpha = lambda t: [r.a for r in pixels.color_key(df, (255, 255, 255), t).orderBy("x").collect()]
    assert alpha(0) == [0, 255, 255, 255] and alpha(0.05) == [0, 0, 255, 255]
    for bad in (-0.1, 1.1, float("nan")):
        with pytest.raises(ValueError):
            pixels.color_key(df, (0, 0, 0), bad)


def test_place_align_rotate_join(spark):
    red, green, blue = 0xFFFF0000, 0xFF00FF00, 0xFF0000FF
    df = image(spark, [red, green, blue])
    assert packed(pixels.place(df, -1, 0, 2, 1)) == [green, blue]
    assert packed(pixels.place(df, 1, 0, 3, 1)) == [0, red, green]
    box = pixels.align(image(spark, [red] * 8, 4), "CENTER", 2, 2).select("width", "height").distinct().collect()
    assert [tuple(r) for r in box] == [(4, 4)]
    tall = pixels.rotate_quarter(image(spark, [red, green, blue, 0], 2), 90)
    assert packed(tall) == [blue, red, 0, green] and packed(pixels.rotate_quarter(df, 180)) == [blue, green, red]
    assert pixels.rotate_quarter(df, 360) is df
    both = pixels.join_canvas(image(spark, [red]), image(spark, [green, 0x80000000], 1), "HORIZONTAL")
    assert packed(both) == [red, green, 0xFFFFFFFF, 0xFF7F7F7F]
    for call in (lambda: pixels.align(df, "MIDDLE", 2, 2), lambda: pixels.align(df, "TOP", 0, 2), lambda: pixels.rotate_quarter(df, 45), lambda: pixels.join_canvas(df, df, "UP")):
        with pytest.raises(ValueError):
            call()


def test_masks(spark):
    df = image(spark, [0x7F000000, 0x80000000] * 5)
    assert [r.value for r in masks.pack_bits(masks.binary_mask(df)).orderBy("byte_no").collect()] == [0b01010101, 0b01000000]
    assert masks.has_alpha(df).first().has_alpha and not masks.has_alpha(image(spark, [0xFF000000])).first().has_alpha
    assert [r.alpha_mask for r in pixels.grayed(image(spark, [0xFF102030])).collect()] == [None]


def test_explode_and_assemble(spark):
    argb = [0xFF123456, 0, 0x80FF3300, 0xFF0033FF, 7, 9]
    rasters = spark.createDataFrame([(1, 3, 2, argb + [5, 5])], "image_id long, width int, height int, argb array<long>")
    assert pixels.assemble(pixels.explode_pixels(rasters)).first().argb == argb


def test_measures(spark):
    black, white = image(spark, [0xFF000000]), image(spark, [0xFFFFFFFF])
    pair = measure.pair_pixels(black, white)
    assert measure.ssim(pair).first().ssim == pytest.approx(6.5025 / (65025 + 6.5025))
    assert measure.color_error(pair, "BLACK").first()["mean"] == pytest.approx(100, abs=1e-5)
    half = measure.pair_pixels(image(spark, [0xFF000000]), image(spark, [0x80FFFFFF]))
    assert measure.color_error(half, "BLACK").first()["max"] == pytest.approx(100 * (128 / 255) ** (1 / 3), abs=1e-4)
    hidden = measure.pair_pixels(image(spark, [0x00FF0000, 0xFF000000]), image(spark, [0x0000FF00, 0xFF000000]))
    assert measure.max_error(hidden).first().max_error == 0 and measure.premultiplied_error(hidden).first().premul_error == 0
    assert measure.avg_error(hidden).first().avg_error == 0 and measure.similarity(hidden).first().similarity < 1
    with pytest.raises(Exception, match="dimensions"):
        measure.max_error(measure.pair_pixels(black, image(spark, [0xFF000000] * 2))).collect()
    with pytest.raises(ValueError):
        measure.color_error(pair, "GREY")


@pytest.mark.parametrize("w,h", [(1, 1), (7, 9), (8, 8), (13, 17), (16, 5)])
def test_ssim_by_its_definition(spark, w, h):
    import numpy as np

    r = np.random.default_rng(w * h)
    p, q = r.integers(0, 256, (2, h, w))
    of = lambda m: image(spark, [0xFF000000 + int(v) * 0x10101 for v in m.ravel()], w)
    bw, bh = min(8, w), min(8, h)
    scores = []
    for iy in range((h - bh + 3) // 4 + 1):
        for ix in range((w - bw + 3) // 4 + 1):
            y, x = min(iy * 4, h - bh), min(ix * 4, w - bw)
            a, b = p[y : y + bh, x : x + bw].astype(float), q[y : y + bh, x : x + bw].astype(float)
            n = max(1, a.size - 1)
            va, vb, c = ((a - a.mean()) ** 2).sum() / n, ((b - b.mean()) ** 2).sum() / n, ((a - a.mean()) * (b - b.mean())).sum() / n
            scores.append((2 * a.mean() * b.mean() + 6.5025) * (2 * c + 58.5225) / ((a.mean() ** 2 + b.mean() ** 2 + 6.5025) * (va + vb + 58.5225)))
    assert measure.ssim(measure.pair_pixels(of(p), of(q))).first().ssim == pytest.approx(np.mean(scores), abs=1e-9)


def test_resize(spark):
    flat = image(spark, [0xFF4080C0] * 60, 10)
    assert set(packed(resample.resize(flat, 10, 6, 4, 3))) == {0xFF4080C0}
    assert resample.resize(flat, 10, 6, 10, 6) is flat
    half = image(spark, [0x00FF0000 if x < 10 else 0xFF0000FF for _ in range(8) for x in range(20)], 20)
    assert all(r.r == 0 and r.g == 0 for r in resample.resize(half, 20, 8, 5, 2).collect())
    assert [resample.shrink_factor(*s) for s in ((3000, 750), (10, 9), (10, 100))] == [2, 1, 1]
    assert resample.subsampling(6000, 4000, 750, 500) == 4 and resample.subsampling(10**6, 10**6, 1, 1) == 64
    for s, t in ((10, 3), (3, 10), (1, 5), (7, 7)):
        by = {}
        for i, k, w in resample.weights(s, t):
            assert 0 <= k < s
            by[i] = by.get(i, 0) + w
        assert all(v == pytest.approx(1) for v in by.values()) and len(by) == t
    with pytest.raises(ValueError):
        resample.resize(flat, 10, 6, 0, 3)
