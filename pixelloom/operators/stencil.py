"""Operators on a pixel's surroundings.  Separable ones are two passes of row and column windows; none joins with itself."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.functions.color import premultiplied


def _row():
    return Window.partitionBy("image_id", "y").orderBy("x")


def _column():
    return Window.partitionBy("image_id", "x").orderBy("y")


def erode(plane: DataFrame, value: str) -> DataFrame:
    """3x3 minimum of a column, cut at the edges."""
    down = plane.withColumn(value, F.min(value).over(_column().rowsBetween(-1, 1)))
    return down.withColumn(value, F.min(value).over(_row().rowsBetween(-1, 1)))


def importance(pixels: DataFrame, strength: float = 3.0, detail: float = 12.0, dealt: bool = False) -> DataFrame:
    """The pixels with the column weight, 1 to 1 + strength: smooth places weigh most, as banding shows there.

    How rough a place is: d, the root mean square, in premultiplied channel steps over `detail`, by which the nine pixels
    around it (edges repeat) depart from their best-fitting plane.  In sums over the nine, the departure is
    sum(p^2) - sum(p)^2 / 9 - (sum(u p)^2 + sum(v p)^2) / 6 with u and v from -1 to 1.  The weight is
    1 + round(strength / (1 + d^2)), then a 3x3 minimum.

    All passes are windows within an image, so the pixels are dealt by image once (dealt: they are already) and only sorted
    between passes.
    """
    if not 0 <= strength <= 126:
        raise ValueError(f"importance must be 0..126: {strength}")
    value = {"r": premultiplied(F.col("r"), F.col("a")), "g": premultiplied(F.col("g"), F.col("a")), "b": premultiplied(F.col("b"), F.col("a")), "a": F.col("a").cast("double")}
    p = (pixels if dealt else pixels.repartition("image_id")).select("image_id", "width", "height", "x", "y", *"argb", *[v.alias("p" + c) for c, v in value.items()])
    at = lambda c, n, w: F.coalesce(F.lag(c, n).over(w) if n > 0 else F.lead(c, -n).over(w), F.col(c))  # noqa: E731  clamped at the edge
    rows = p
    for c in value:
        left, here, right = at("p" + c, 1, _row()), F.col("p" + c), at("p" + c, -1, _row())
        rows = rows.withColumns({"s" + c: left + here + right, "q" + c: left * left + here * here + right * right, "u" + c: right - left})
    sums = {}
    for c in value:
        for kind in "squ":
            up, here, down = at(kind + c, 1, _column()), F.col(kind + c), at(kind + c, -1, _column())
            sums["t" + kind + c] = up + here + down
            if kind == "s":
                sums["v" + c] = down - up
    both = rows.withColumns(sums)
    left_over = reduce(lambda s, t: s + t, [F.col("tq" + c) - F.col("ts" + c) * F.col("ts" + c) / 9 - (F.col("tu" + c) * F.col("tu" + c) + F.col("v" + c) * F.col("v" + c)) / 6 for c in value])
    d = F.sqrt(F.greatest(left_over, F.lit(0.0)) / 6) / detail
    weight = (F.floor(F.lit(float(strength)) / (d * d + 1) + 0.5) + 1).cast("int")
    return erode(both.select("image_id", "width", "height", "x", "y", *"argb", weight.alias("weight")), "weight")


def sharpen(pixels: DataFrame, level: int = 1) -> DataFrame:
    """3x3 kernel of 9 and -1, `level` times: 10 times the pixel less the sum of its surroundings.

    Premultiplied, clamped to the alpha after each pass; edge pixels, where the kernel does not fit, become clear zero.
    """
    if level < 0:
        raise ValueError(f"level must not be negative: {level}")
    p = pixels
    for _ in range(level):
        p = p.select("image_id", "width", "height", "x", "y", "a", *[F.floor(premultiplied(F.col(c), F.col("a")) + 0.5).cast("int").alias(c) for c in "rgb"])
        p = p.withColumns({"s" + c: F.sum(c).over(_row().rowsBetween(-1, 1)) for c in "argb"})
        p = p.withColumns({"t" + c: F.sum("s" + c).over(_column().rowsBetween(-1, 1)) for c in "argb"})
        inner = (F.col("x") > 0) & (F.col("y") > 0) & (F.col("x") < F.col("width") - 1) & (F.col("y") < F.col("height") - 1)
        new = {c: F.least(F.greatest(F.col(c) * 10 - F.col("t" + c), F.lit(0)), F.lit(255)) for c in "argb"}
        a = F.when(inner, new["a"]).otherwise(0)
        straight = lambda c: F.when(a == 0, F.lit(0)).otherwise(F.floor(F.least(new[c], a) * F.lit(255.0) / a + 0.5))
        p = p.select("image_id", "width", "height", "x", "y", a.cast("int").alias("a"), *[straight(c).cast("int").alias(c) for c in "rgb"])
    return p


FILTERS = ("NONE", "SUB", "UP", "AVERAGE", "PAETH")


def paeth(left: Column, up: Column, corner: Column) -> Column:
    p = left + up - corner
    dl, du, dc = F.abs(p - left), F.abs(p - up), F.abs(p - corner)
    return F.when((dl <= du) & (dl <= dc), left).when(du <= dc, up).otherwise(corner)


def filtered(pixels: DataFrame, channels: str = "rgb") -> DataFrame:
    """(image_id, y, x, channel, v, f0 .. f4): each byte of the scanlines under the five row filters."""
    lagged = pixels.withColumns({"left_" + c: F.coalesce(F.lag(c).over(_row()), F.lit(0)) for c in channels})
    lagged = lagged.withColumns({"up_" + c: F.coalesce(F.lag(c).over(_column()), F.lit(0)) for c in channels} | {"corner_" + c: F.coalesce(F.lag("left_" + c).over(_column()), F.lit(0)) for c in channels})
    one = F.explode(F.array(*[F.struct(F.lit(i).alias("channel"), F.col(c).alias("v"), F.col("left_" + c).alias("l"), F.col("up_" + c).alias("u"), F.col("corner_" + c).alias("k")) for i, c in enumerate(channels)]))
    flat = lagged.select("image_id", "y", "x", one.alias("s")).select("image_id", "y", "x", "s.*")
    v, left, up, corner = (F.col(c) for c in ("v", "l", "u", "k"))
    kinds = [v, v - left, v - up, v - F.floor((left + up) / 2), v - paeth(left, up, corner)]
    return flat.select("image_id", "y", "x", "channel", "v", *[F.pmod(k, F.lit(256)).cast("int").alias(f"f{i}") for i, k in enumerate(kinds)])


def filter_choice(pixels: DataFrame, channels: str = "rgb") -> DataFrame:
    """(image_id, y, filter, cost): the filter with the least sum of absolute signed bytes; the first among equals."""
    return cheapest(filtered(pixels, channels))


def cheapest(filtered: DataFrame) -> DataFrame:
    cost = lambda c: F.sum(F.when(F.col(c) < 128, F.col(c)).otherwise(F.lit(256) - F.col(c)))
    sums = filtered.groupBy("image_id", "y").agg(*[cost(f"f{i}").alias(f"c{i}") for i in range(5)])
    best = F.array_min(F.array(*[F.struct(F.col(f"c{i}").alias("cost"), F.lit(i).alias("filter")) for i in range(5)]))
    return sums.select("image_id", "y", best["filter"].alias("filter"), best["cost"].alias("cost"))
