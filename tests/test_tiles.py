"""Tiles give the rows of the whole image, whatever their size, and no task holds a large image."""

import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from pixelloom.operators import stencil, tiles
from pixelloom.sources import png
from tests.oracle import rows_of


def image(spark, sizes):
    """Some images with noise, edges and every alpha."""
    p = spark.createDataFrame([(i, w, h) for i, (w, h) in enumerate(sizes)], "image_id long, width int, height int")
    p = p.select("*", F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)).alias("p"))
    p = p.select("image_id", "width", "height", (F.col("p") % F.col("width")).cast("int").alias("x"), F.floor(F.col("p") / F.col("width")).cast("int").alias("y"))
    return colored(p)


def colored(p):
    noise = lambda n: F.pmod(F.xxhash64("image_id", "x", "y", F.lit(n)), F.lit(40)) + (F.col("x") * 5 + F.col("y") * 3) % 216
    return p.select("*", *[noise(n).cast("int").alias(c) for n, c in enumerate("argb")])


SIZES = [(37, 23), (1, 1), (1, 19), (16, 16), (17, 5)]


@pytest.mark.parametrize("wide,high", [(4, 4), (8, 3), (1, 1), (64, 64), (16, 1)])
def test_tiles_give_the_rows_of_the_whole_image(spark, wide, high):
    p = image(spark, SIZES).cache()
    for operator, reach in ((stencil.importance, 2), (lambda q: stencil.sharpen(q, 2), 2), (lambda q: stencil.erode(q.select("image_id", "x", "y", "width", "height", "b"), "b"), 1), (stencil.filtered, 1)):
        assert rows_of(tiles.in_tiles(p, operator, reach, wide, high)) == rows_of(operator(p))
    p.unpersist()


def test_a_short_halo_is_too_little(spark):
    p = image(spark, [(20, 20)])
    assert rows_of(tiles.in_tiles(p, stencil.importance, 1, 5, 5)) != rows_of(stencil.importance(p))


def test_named_operators(spark):
    p = image(spark, [(30, 21)])
    assert rows_of(tiles.importance(p, side=7)) == rows_of(stencil.importance(p))
    assert rows_of(tiles.filter_choice(p, side=7)) == rows_of(stencil.filter_choice(p))
    assert rows_of(tiles.sharpen(p, 3, side=7)) == rows_of(stencil.sharpen(p, 3)) and rows_of(tiles.sharpen(p, 0)) == rows_of(p)
    with pytest.raises(ValueError):
        tiles.erode(p, "b", side=0)


def test_one_large_image_is_many_tasks(spark):
    p = image(spark, [(512, 384)])
    seen = []
    tiles.in_tiles(p, lambda q: seen.append(q) or q, 2, 64, 64)
    rows = seen[0].groupBy("image_id").count().collect()
    assert len(rows) == 8 * 6 and max(r["count"] for r in rows) == 68 * 68
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = tiles.importance(p, side=64)._jdf.queryExecution().executedPlan().toString()
        by_task = tiles.importance(p, side=64).groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("Exchange hashpartitioning") == 1
    assert len(by_task) == 4 and max(r["count"] for r in by_task) < 512 * 384 * 0.6


@pytest.mark.parametrize("wide,high", [(5, 4), (8, 3), (1, 1), (64, 64)])
def test_blocks_are_dealt_by_tile_before_they_become_pixels(spark, monkeypatch, wide, high):
    monkeypatch.setattr(tiles, "TASK", 100)
    sizes = [(40, 15), (8, 3), (24, 6)]
    blocks = [(i, w, h, x, y) for i, (w, h) in enumerate(sizes) for x in range(0, w, 8) for y in range(0, h, 3)]
    tasks = []

    def pixels(deal):
        dealt = deal(spark.createDataFrame(blocks, "image_id long, width int, height int, x int, y int"), len(blocks), 8, 3)
        tasks.append(dealt.rdd.getNumPartitions())
        dealt = dealt.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(23))))
        dealt = dealt.withColumns({"x": F.col("x") + F.col("k") % 8, "y": F.col("y") + F.floor(F.col("k") / 8).cast("int")}).drop("k")
        return colored(dealt.withColumn("of", F.col("image_id")).withColumn("image_id", F.col("of.image_id"))).withColumn("image_id", F.col("of")).drop("of")

    p = image(spark, sizes).cache()
    for operator, reach in ((stencil.importance, 2), (lambda q: stencil.sharpen(q, 2), 2), (stencil.filtered, 1)):
        assert rows_of(tiles.in_tiles(pixels, operator, reach, wide, high)) == rows_of(operator(p))
    p.unpersist()
    assert tasks == [-(-len(blocks) * 24 // 100)] * 3


@pytest.mark.parametrize("name", ["tiled_erode", "tiled_importance", "tiled_sharpen", "tiled_filter_choice"])
def test_tasks_of_tiled_queries_grow_with_the_image(spark, monkeypatch, name):
    """Rows of the table are shuffled, to as many tasks as their pixels need, and pixels are not."""
    from pixelloom.plans import catalogue

    monkeypatch.setattr(tiles, "TASK", 1000, raising=False)
    plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"Exchange hashpartitioning\(image_id#\d+, (\d+)\)", plan) == ["32"]
    assert "sequence(0, 31" not in plan[plan.rindex("Exchange") :]


def test_empty_table(spark):
    assert tiles.importance(image(spark, [(3, 3)]).limit(0)).count() == 0


@pytest.mark.parametrize("rows,alpha", [(1, True), (7, False), (100, True)])
def test_a_file_from_bands(spark, rows, alpha):
    from pixelloom.operators.pixels import explode_pixels
    from pixelloom.sources import images

    p = image(spark, SIZES)
    files = tiles.banded_png(p, rows, alpha)
    got = explode_pixels(images.decode_png(files)).select(p.columns)
    assert rows_of(got) == rows_of(p if alpha else p.withColumn("a", F.lit(255)))
    for r in files.collect():
        found = [(t, d) for _, t, _, d in png.chunks(bytes(r.content))]
        assert [t for t, _ in found].count("IDAT") == -(-r.height // rows)
        assert len(zlib.decompress(b"".join(d for t, d in found if t == "IDAT"))) == r.height * (r.width * (4 if alpha else 3) + 1)
    with pytest.raises(Exception):
        tiles.banded_png(p.filter("not (image_id = 0 and x = 3 and y = 3)"), rows).collect()


@pytest.mark.parametrize("rows,alpha", [(5, True), (64, False)])
def test_parts_join_to_a_file(spark, rows, alpha):
    """No task holds a file: parts in their order are one, and each band is read by itself."""
    from pixelloom.operators.pixels import explode_pixels
    from pixelloom.sources import images

    p = image(spark, SIZES)
    parts = tiles.banded_parts(p, rows, alpha)
    want = rows_of(p if alpha else p.withColumn("a", F.lit(255)))
    assert rows_of(tiles.parts_pixels(parts, rows, alpha).select(p.columns)) == want
    files = {}
    for r in parts.orderBy("image_id", "part").collect():
        files[r.image_id] = files.get(r.image_id, b"") + bytes(r.content)
    files = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "image_id long, content binary")
    assert rows_of(explode_pixels(images.decode_png(files)).select(p.columns)) == want


def test_checksums_combine():
    rnd = random.Random(2)
    for _ in range(300):
        a, b = (bytes(rnd.randrange(256) for _ in range(rnd.randrange(400))) for _ in range(2))
        assert png.joined_checksum(zlib.adler32(a), zlib.adler32(b), len(b)) == zlib.adler32(a + b)
    a = bytes([255]) * 300_000
    assert png.joined_checksum(zlib.adler32(a), zlib.adler32(a), len(a)) == zlib.adler32(a + a)


def test_palettes_of_tiles(spark):
    from pixelloom.operators.grouped import palettes
    from pixelloom.operators.kernels import Options

    p = image(spark, [(45, 37), (9, 9)])
    for options in (Options(max_colors=12), Options(max_colors=7, importance=0)):
        assert rows_of(palettes(p, options, side=16)) == rows_of(palettes(p, options))
