"""Histograms, palettes and nearest entries, natively: hash aggregates, ranks and small constant tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.functions.color import clamp, coarse_key, exact_key, half_up, premultiplied

#: Distinct colours up to which the exact histogram is kept.
EXACT_LIMIT = 1 << 18


def histogram(pixels: DataFrame, bits: Column | int = 0, weight: Column | None = None) -> DataFrame:
    """(image_id, key, cnt, sr, sg, sb, sa, first_pos): one row per colour key of an image.

    Sums are of channel * alpha * weight, all long, so partial sums commute.  first_pos, the first place in row-major
    order, stands for the order in which a scan would meet the keys.
    """
    w = F.lit(1) if weight is None else weight
    bits = bits if isinstance(bits, Column) else F.lit(bits)
    a = F.col("a").cast("long") * w
    key = coarse_key(bits, *[F.col(c) for c in "argb"])
    return pixels.groupBy("image_id", key.alias("key")).agg(
        F.sum(F.lit(1).cast("long") * w).alias("cnt"), *[F.sum(F.col(c) * a).alias("s" + c) for c in "rgb"], F.sum(a).alias("sa"), F.min(F.col("y").cast("long") * F.col("width") + F.col("x")).alias("first_pos")
    )


def adaptive_histogram(pixels: DataFrame, limit: int = EXACT_LIMIT, weight: Column | None = None) -> DataFrame:
    """histogram() with the column bits: 0 while an image's colours fit the limit, else 6 if it is opaque and 5 if not.

    Pixels are read once: coarse buckets are sums of exact ones, as all sums are additive.  An image's exact buckets, of
    which there are as many as it has colours, are counted in one task.
    """
    exact = histogram(pixels, 0, weight)
    part = lambda n: F.shiftright("key", n).bitwiseAND(F.lit(255)).cast("int")
    a, r, g, b = (part(n) for n in (24, 16, 8, 0))
    image = Window.partitionBy("image_id")
    counted = exact.withColumns({"n": F.count("*").over(image), "least": F.min(a).over(image)})
    bits = F.when(F.col("n") <= limit, 0).when(F.col("least") == 255, 6).otherwise(5)
    keyed = counted.withColumn("bits", bits).withColumn("key", coarse_key(F.col("bits"), a, r, g, b))
    return keyed.groupBy("image_id", "bits", "key").agg(*[F.sum(c).alias(c) for c in ("cnt", "sr", "sg", "sb", "sa")], F.min("first_pos").alias("first_pos"))


def distinct_colors(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("image_id").agg(F.countDistinct(exact_key(*[F.col(c) for c in "argb"])).alias("colors"))


def mean_color(cnt: Column, sr: Column, sg: Column, sb: Column, sa: Column) -> tuple[Column, ...]:
    """(a, r, g, b) of summed pixels: alpha is the mean, colours are means weighted by alpha; clear is all zero."""
    a = F.when(cnt <= 0, 0).otherwise(clamp(half_up(sa / cnt)))
    empty = (a == 0) | (sa <= 0)
    return F.when(empty, 0).otherwise(a), *[F.when(empty, 0).otherwise(clamp(half_up(s / sa))) for s in (sr, sg, sb)]


def lossless_palette(hist: DataFrame, max_colors: int = 256) -> DataFrame:
    """(image_id, idx, key, a, r, g, b) of the images whose colours fit: translucent entries first, then by first place."""
    if not 1 <= max_colors <= 256:
        raise ValueError(f"max_colors must be 1..256: {max_colors}")
    color = mean_color(*[F.col(c) for c in ("cnt", "sr", "sg", "sb", "sa")])
    entries = hist.select("image_id", "key", "first_pos", *[c.alias(n) for c, n in zip(color, "argb")], F.count("*").over(Window.partitionBy("image_id")).alias("n"))
    order = Window.partitionBy("image_id").orderBy((F.col("a") == 255).cast("int"), "first_pos")
    return entries.filter(F.col("n") <= max_colors).select("image_id", (F.row_number().over(order) - 1).alias("idx"), "key", *"argb")


def index_plane(pixels: DataFrame, palette: DataFrame, bits: int = 0) -> DataFrame:
    """(image_id, width, height, x, y, idx): each pixel's palette entry, by its key."""
    keyed = pixels.select("image_id", "width", "height", "x", "y", coarse_key(F.lit(bits), *[F.col(c) for c in "argb"]).alias("key"))
    return keyed.join(palette.select("image_id", "key", "idx"), ["image_id", "key"]).select("image_id", "width", "height", "x", "y", "idx")


def bit_depth(n: Column) -> Column:
    return F.when(n <= 2, 1).when(n <= 4, 2).when(n <= 16, 4).otherwise(8)


def palette_layout(palette: DataFrame) -> DataFrame:
    """(image_id, entries, depth, plte_bytes, trns_bytes) of the chunks that would hold a palette."""
    out = palette.groupBy("image_id").agg(F.count("*").alias("entries"), F.coalesce(F.max(F.when(F.col("a") < 255, F.col("idx") + 1)), F.lit(0)).alias("trns_bytes"))
    return out.select("image_id", "entries", bit_depth(F.col("entries")).alias("depth"), (F.col("entries") * 3).alias("plte_bytes"), "trns_bytes")


def nearest_entry(a: Column, r: Column, g: Column, b: Column, palette: list[tuple[int, int, int, int]]) -> Column:
    """Number of the nearest of at most 256 entries, the first among equals, in premultiplied space, as a column expression."""
    if not 1 <= len(palette) <= 256:
        raise ValueError("a palette has 1 to 256 entries")
    point = [a.cast("double"), *[premultiplied(c, a) for c in (r, g, b)]]
    ranked = []
    for i, e in enumerate(palette):
        d = [(p - F.lit(float(v))) * (p - F.lit(float(v))) for p, v in zip(point, (e[0], *[c * e[0] / 255.0 for c in e[1:]]))]
        ranked.append(F.struct((d[1] + d[2] + d[3] + d[0]).alias("d"), F.lit(i).alias("i")))
    return (F.least(*ranked) if len(ranked) > 1 else ranked[0])["i"]


def nearest_centroid(buckets: DataFrame, centroids: DataFrame) -> DataFrame:
    """(image_id, key, idx): the nearest of an image's centroids (image_id, idx, pr, pg, pb, pa) to each of its buckets.

    An image has at most 256 centroids; they are gathered to one array per image and searched in the row.
    """
    table = centroids.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("idx", "pr", "pg", "pb", "pa"))).alias("c"))

    def ranked(e: Column) -> Column:
        d = [(F.col(n) - e[n]) * (F.col(n) - e[n]) for n in ("pr", "pg", "pb", "pa")]
        return F.struct((d[0] + d[1] + d[2] + d[3]).alias("d"), e["idx"].alias("idx"))

    return buckets.join(table, "image_id").select("image_id", "key", F.array_min(F.transform("c", ranked))["idx"].alias("idx"))


def bucket_points(hist: DataFrame) -> DataFrame:
    """Premultiplied coordinates of histogram buckets, unrounded."""
    return hist.select("image_id", "key", "cnt", *[(F.col("s" + c) / F.col("cnt") / 255).alias("p" + c) for c in "rgb"], (F.col("sa") / F.col("cnt")).alias("pa"))
