"""One palette for all images: the kernel's result on the pixels of all of them together."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.operators import kernels
from pixelloom.operators.kernels import Options
from pixelloom.operators.shared_palette import shared_palette


def collection(spark, seed, n=3, w=11, h=9, levels=256):
    rnd = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        c = rnd.integers(0, levels, (h, w, 4)) * (255 // (levels - 1))
        c[..., 0] = rnd.choice([0, 90, 255, 255], (h, w))
        rows += [(i, w, h, x, y, *map(int, c[y, x])) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "image_id long, width int, height int, x int, y int, a int, r int, g int, b int").repartition(3)


def kernel(rows, options):
    """Colours of the palette with what each holds, by the kernel over one histogram."""
    hist = {}
    for r in rows:
        key = 0 if r.a == 0 else r.a << 24 | r.r << 16 | r.g << 8 | r.b
        h = hist.setdefault(key, np.zeros(5, np.int64))
        h += [1, r.r * r.a, r.g * r.a, r.b * r.a, r.a]
    keys = sorted(hist)
    table = np.stack([hist[k] for k in keys])
    pal, label, lossless = kernels.quantize_histogram(table[:, 0], table[:, 1:].astype(float), options)
    return pal.tolist(), dict(zip(keys, label.tolist())), lossless


@pytest.mark.parametrize("options", [Options(max_colors=2, kmeans=0, importance=0), Options(max_colors=7, kmeans=0, importance=0), Options(max_colors=16, kmeans=3, importance=0), Options(max_colors=1, importance=0), Options(max_colors=256, importance=0)])
def test_equals_the_kernel(spark, options):
    df = collection(spark, 5)
    entries, keys = shared_palette(df, options)
    got = [[r.a, r.r, r.g, r.b] for r in entries.orderBy("idx").collect()]
    want, of, _ = kernel(df.collect(), options)
    assert got == want and {r.key: r.idx for r in keys.collect()} == of
    assert entries.agg(F.sum("n")).first()[0] == df.count()


def test_few_colours_stay_as_they_are(spark):
    df = collection(spark, 6, levels=2)
    entries, keys = shared_palette(df, Options(max_colors=64, importance=0))
    pal = {r.idx: (r.a, r.r, r.g, r.b) for r in entries.collect()}
    for r in keys.collect():
        a, *rgb = (r.key >> n & 255 for n in (24, 16, 8, 0))
        assert pal[r.idx] == ((a, *rgb) if a else (0, 0, 0, 0))


def test_weights_fallback_and_nothing(spark):
    df = collection(spark, 7)
    entries, keys = shared_palette(df, Options(max_colors=8), limit=50)
    assert entries.count() <= 8 and {r.bits for r in keys.select("bits").distinct().collect()} == {5}
    assert entries.agg(F.sum("n")).first()[0] >= df.count()
    empty = shared_palette(df.limit(0), Options(max_colors=8, importance=0))
    assert empty[0].count() == empty[1].count() == 0
