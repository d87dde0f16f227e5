"""Masks, thresholds and ordered dithers: predicates on pixels, and their packing to bits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.functions.color import luminance

#: The standard 8x8 Bayer matrix, and a published 8x8 clustered-dot screen; levels are 0 to 63 times 4.
BAYER = [
    [0, 128, 32, 160, 8, 136, 40, 168],
    [192, 64, 224, 96, 200, 72, 232, 104],
    [48, 176, 16, 144, 56, 184, 24, 152],
    [240, 112, 208, 80, 248, 120, 216, 88],
    [12, 140, 44, 172, 4, 132, 36, 164],
    [204, 76, 236, 108, 196, 68, 228, 100],
    [60, 188, 28, 156, 52, 180, 20, 148],
    [252, 124, 220, 92, 244, 116, 212, 84],
]
CLUSTERED = [
    [96, 40, 48, 104, 140, 188, 196, 148],
    [32, 0, 8, 56, 180, 236, 244, 204],
    [88, 24, 16, 64, 172, 228, 252, 212],
    [120, 80, 72, 112, 132, 164, 220, 156],
    [136, 184, 192, 144, 100, 44, 52, 108],
    [176, 232, 240, 200, 36, 4, 12, 60],
    [168, 224, 248, 208, 92, 28, 20, 68],
    [128, 160, 216, 152, 124, 84, 76, 116],
]
SCREENS = {"BAYER": BAYER, "CLUSTERED": CLUSTERED}


def has_alpha(pixels: DataFrame) -> DataFrame:
    """(image_id, has_alpha): whether any pixel is not wholly opaque."""
    return pixels.groupBy("image_id").agg(F.bool_or(F.col("a") < 255).alias("has_alpha"))


def alpha_mask(pixels: DataFrame) -> DataFrame:
    return pixels.select("image_id", "width", "height", "x", "y", F.col("a").alias("gray"))


def binary_mask(pixels: DataFrame, threshold: int = 128) -> DataFrame:
    return pixels.select("image_id", "width", "height", "x", "y", (F.col("a") >= threshold).cast("int").alias("bit"))


def threshold(pixels: DataFrame, level: int) -> DataFrame:
    """bit 1, white, where the luminance reaches the level; alpha is ignored."""
    bit = luminance(F.col("r"), F.col("g"), F.col("b")) >= level
    return pixels.select("image_id", "width", "height", "x", "y", bit.cast("int").alias("bit"))


def screen(x: Column, y: Column, matrix: list[list[int]]) -> Column:
    """The matrix's threshold for a place: a look-up in a constant array, not a join."""
    cells = F.array(*[F.lit(v) for row in matrix for v in row])
    return F.element_at(cells, (y % 8) * 8 + x % 8 + 1)


def ordered_dither(gray: DataFrame, algorithm: str = "BAYER") -> DataFrame:
    """gray (image_id, width, height, x, y, gray) to bits: white where the screen is below the level."""
    if algorithm not in SCREENS:
        raise ValueError(f"unknown screen: {algorithm}")
    bit = screen(F.col("x"), F.col("y"), SCREENS[algorithm]) < F.col("gray")
    return gray.select("image_id", "width", "height", "x", "y", bit.cast("int").alias("bit"))


def is_binary(pixels: DataFrame) -> DataFrame:
    """(image_id, is_binary): whether all pixels are opaque and either black or white."""
    level = lambda v: (F.col("r") == v) & (F.col("g") == v) & (F.col("b") == v)
    return pixels.groupBy("image_id").agg(F.bool_and((F.col("a") == 255) & (level(0) | level(255))).alias("is_binary"))


def bits_to_pixels(bits: DataFrame) -> DataFrame:
    """Bits as opaque black and white pixels."""
    v = F.col("bit") * 255
    return bits.select("image_id", "width", "height", "x", "y", F.lit(255).alias("a"), v.alias("r"), v.alias("g"), v.alias("b"))


def pack_bits(bits: DataFrame) -> DataFrame:
    """(image_id, y, byte_no, value): eight bits to a byte, the first highest; a row starts a new byte."""
    weight = F.element_at(F.array(*[F.lit(1 << (7 - i)) for i in range(8)]), F.col("x") % 8 + 1)
    return bits.groupBy("image_id", "y", F.floor(F.col("x") / 8).cast("int").alias("byte_no")).agg(F.sum(F.col("bit") * weight).cast("int").alias("value"))
