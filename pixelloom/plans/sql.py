"""The engine from spark.sql: views over the driver's tables, and the operators' scalar functions.

Colour functions are SQL functions, which Catalyst inlines; byte-level ones are Arrow functions, png_chunks a table
function.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from pixelloom.sources import images

from . import views

_CHANNELS = "a INT, r INT, g INT, b INT"
FUNCTIONS = {
    "luminance(r INT, g INT, b INT) RETURNS INT": "shiftright(54 * r + 183 * g + 19 * b + 128, 8)",
    f"on_white({_CHANNELS}) RETURNS INT": "CASE WHEN a = 255 THEN luminance(r, g, b) ELSE 255 - shiftright((255 - luminance(r, g, b)) * a, 8) END",
    "luma(r INT, g INT, b INT) RETURNS INT": "(299 * r + 587 * g + 114 * b) div 1000",
    "premultiplied(c INT, a INT) RETURNS DOUBLE": "c * a / 255.0D",
    f"color_key({_CHANNELS}) RETURNS BIGINT": "CASE WHEN a = 0 THEN 0L ELSE ((a * 256L + r) * 256L + g) * 256L + b END",
    f"coarse_color_key({_CHANNELS}) RETURNS BIGINT": "CASE WHEN a = 0 THEN 0L ELSE (shiftright(r, 2) * 64L + shiftright(g, 2)) * 64L + shiftright(b, 2) END",
    "srgb_to_linear(c INT) RETURNS DOUBLE": "CASE WHEN c / 255.0D <= 0.04045D THEN c / 255.0D / 12.92D ELSE power((c / 255.0D + 0.055D) / 1.055D, 2.4D) END",
    "blend(c INT, a INT, ground INT) RETURNS INT": "CAST(floor((c * a + ground * (255 - a)) / 255.0D + 0.5D) AS INT)",
    "bit_depth(entries BIGINT) RETURNS INT": "CASE WHEN entries <= 2 THEN 1 WHEN entries <= 4 THEN 2 WHEN entries <= 16 THEN 4 ELSE 8 END",
    "color_bin(value DOUBLE, least DOUBLE, scale DOUBLE) RETURNS INT": "CAST(greatest(0D, least(255D, floor((value - least) * scale))) AS INT)",
}


def register_functions(spark: SparkSession) -> None:
    for signature, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    for f in ("image_size", "reconcile_jpeg", "png_profile", "text_metadata", "add_text"):
        spark.udf.register(f, getattr(images, f))
    spark.udtf.register("png_chunks", images.PngChunks)


def register_views(spark: SparkSession, sf_dir: str) -> None:
    for name in ("gray8", "gray8_pixels", "rgba4", "synth", "big"):
        getattr(views, name)(spark, sf_dir).createOrReplaceTempView(name)


def register(spark: SparkSession, sf_dir: str) -> None:
    register_functions(spark)
    register_views(spark, sf_dir)
