"""Sums of doubles that do not depend on the order of rows."""

import math
import random

from pyspark.sql import functions as F

from pixelloom.functions.exact import exact_avg, exact_sum
from pixelloom.operators import measure
from pixelloom.plans import views


def test_bits_do_not_depend_on_partitions(spark):
    rnd = random.Random(3)
    values = [rnd.uniform(-1000, 1000) * 10 ** rnd.randrange(-12, 3) for _ in range(5000)] + [0.1] * 1000 + [-0.0, 1e9, -1e9, 2.0**-60]
    got = set()
    for seed, parts in ((1, 1), (2, 3), (3, 16)):
        mixed = random.Random(seed).sample(values, len(values))
        df = spark.createDataFrame([(v,) for v in mixed], "v double").repartition(parts)
        row = df.agg(exact_sum(F.col("v")).alias("s"), exact_avg(F.col("v")).alias("m")).first()
        got.add((row.s.hex(), row.m.hex()))
    assert len(got) == 1
    total = float.fromhex(next(iter(got))[0])
    assert abs(total - math.fsum(values)) <= math.ulp(total) + len(values) * 2.0**-82


def test_nulls_groups_and_nothing(spark):
    df = spark.createDataFrame([(1, 0.5), (1, None), (1, -2.25), (2, None)], "k int, v double")
    rows = {r.k: (r.s, r.m) for r in df.groupBy("k").agg(exact_sum(F.col("v")).alias("s"), exact_avg(F.col("v")).alias("m")).collect()}
    assert rows[1] == (-1.75, -0.875) and rows[2][0] is None
    assert df.filter("k > 5").agg(exact_sum(F.col("v")).alias("s")).first().s is None


def test_measures_are_bit_equal_under_any_partitioning(spark):
    sf = "/root/testdata/sf0.001"
    one = views.synth(spark, sf)
    two = views.coarser(one)
    got = []
    for parts in (2, 7):
        pairs = measure.pair_pixels(one.repartition(parts), two.repartition(parts + 1, "x"))
        got.append(sorted((r.image_id, r.mean.hex(), r.ssim.hex()) for r in measure.color_error(pairs, "CHECKERBOARD").join(measure.ssim(pairs), "image_id").collect()))
    assert got[0] == got[1] and len(got[0]) == one.select("image_id").distinct().count()
