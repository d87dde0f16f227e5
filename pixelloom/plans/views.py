"""Rasters made of the driver's tables, as DataFrames and as the SQL that gives the same rows in DuckDB.

gray8: an embedding's 64 values as 8x8 grey levels.  rgba4: the same values as 4x4 RGBA.  synth: a small gradient image
per part, with every alpha.  mosaic: one large image of all events.  big: all line items as one colour multiset, without places.

Rows of the tables become many pixels each, so they are dealt by image first (dealt): pixels are then made by many tasks, and what is
grouped by image later, alone or with more columns, shuffles no pixel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.operators.tiles import TASK, Deal


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, n: int, pixels: int, *keys: str) -> DataFrame:
    """n rows, of so many pixels each, over tasks of TASK pixels: however small their file is, and however large it grows."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-n * pixels // TASK)), *keys)


def _level(v):
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor(v.cast("double") * 255 + 128))).cast("int")


def gray8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, width, height, x, y, gray."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("i", "v")).filter("i < 64")
    return e.select("image_id", F.lit(8).alias("width"), F.lit(8).alias("height"), (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"), _level(F.col("v")).alias("gray"))


def gray8_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gray8 as opaque pixels."""
    return gray8(spark, sf_dir).select("image_id", "width", "height", "x", "y", F.lit(255).alias("a"), F.col("gray").alias("r"), F.col("gray").alias("g"), F.col("gray").alias("b"))


def rgba4(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("p"))
    part = lambda i: _level(F.element_at("embedding", F.col("p") * 4 + (i + 1)))
    return e.select("image_id", F.lit(4).alias("width"), F.lit(4).alias("height"), (F.col("p") % 4).alias("x"), F.floor(F.col("p") / 4).cast("int").alias("y"), part(3).alias("a"), part(0).alias("r"), part(1).alias("g"), part(2).alias("b"))


def synth(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    p = part.select(F.col("p_partkey").alias("image_id"), (F.col("p_size") % 9 + 8).cast("int").alias("width"), (F.col("p_partkey") % 7 + 8).cast("int").alias("height"))
    p = dealt(p, part.count(), 132, "image_id")
    g = p.withColumn("pos", F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)))
    g = g.withColumns({"x": F.col("pos") % F.col("width"), "y": F.floor(F.col("pos") / F.col("width")).cast("int")})
    return g.select(
        "image_id", "width", "height", "x", "y", ((F.col("x") + F.col("y")) % 256).alias("a"),
        F.floor(F.col("x") * 255 / F.greatest(F.col("width") - 1, F.lit(1))).cast("int").alias("r"),
        F.floor(F.col("y") * 255 / F.greatest(F.col("height") - 1, F.lit(1))).cast("int").alias("g"),
        ((F.col("x") * 7 + F.col("y") * 3 + F.col("image_id")) % 256).cast("int").alias("b"),
    )


def coarser(pixels: DataFrame, step: int = 16) -> DataFrame:
    """The same images with colours cut to multiples of step."""
    return pixels.withColumns({c: (F.floor(F.col(c) / step) * step).cast("int") for c in "rgb"})


def big(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One image's colours; x is 0, y counts nothing: places are not unique and not used."""
    part = lambda e: e.cast("int")
    item = table(spark, sf_dir, "lineitem")
    return item.select(F.lit(0).cast("long").alias("image_id"), F.lit(1).alias("width"), F.lit(1).alias("height"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(255).alias("a"), part(F.col("l_partkey") % 256).alias("r"), part(F.col("l_suppkey") % 256).alias("g"), part((F.col("l_orderkey") * 31 + F.col("l_linenumber") * 7) % 256).alias("b"))


def mosaic(spark: SparkSession, sf_dir: str, deal: Deal | None = None) -> DataFrame:
    """One image, 640 pixels wide and as high as there are events for: 32 pixels of each, 20 events a row.  deal: of tiles.in_tiles."""
    events = table(spark, sf_dir, "events")
    n = events.count()
    place = F.col("event_id") * 32
    first = [F.lit(0).cast("long").alias("image_id"), F.lit(640).alias("width"), F.lit(-(-n // 20)).alias("height"), (place % 640).cast("int").alias("x"), F.floor(place / 640).cast("int").alias("y")]
    rows = events.select("event_id", "user_id", *first)
    # Else by runs of events, so that neighbours in a row mostly stay together.
    p = deal(rows, n, 32, 1) if deal else dealt(rows.withColumn("run", F.floor(F.col("event_id") / 320)), n, 32, "run")
    p = p.select("image_id", "event_id", "user_id", "width", "height", "x", "y", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("k")).withColumn("x", F.col("x") + F.col("k"))
    level = lambda c: (c % 256).cast("int")
    return p.select(
        "image_id", "width", "height", "x", "y", F.when(F.col("event_id") % 5 == 0, F.col("k") + 160).otherwise(255).cast("int").alias("a"),
        level(F.col("x") * 2 + F.col("y")).alias("r"), level(F.col("user_id") * 3 + F.col("k")).alias("g"), level(F.col("event_id") * 31).alias("b"),
    )


_L = "greatest(0, least(255, floor(embedding[{}]::DOUBLE * 255 + 128)))::INTEGER"
SQL = f"""
gray8 AS (SELECT vec_id AS image_id, 8 AS width, 8 AS height, (i % 8)::INTEGER AS x, (i // 8)::INTEGER AS y, {_L.format('i + 1')} AS gray
  FROM (SELECT vec_id, embedding, unnest(range(least(64, len(embedding)))) AS i FROM embeddings)),
gray8p AS (SELECT image_id, width, height, x, y, 255 AS a, gray AS r, gray AS g, gray AS b FROM gray8),
rgba4 AS (SELECT vec_id AS image_id, 4 AS width, 4 AS height, (p % 4)::INTEGER AS x, (p // 4)::INTEGER AS y, {_L.format('4 * p + 4')} AS a, {_L.format('4 * p + 1')} AS r, {_L.format('4 * p + 2')} AS g, {_L.format('4 * p + 3')} AS b
  FROM (SELECT vec_id, embedding, unnest(range(16)) AS p FROM embeddings)),
synth AS (SELECT image_id, width, height, x, y, (x + y) % 256 AS a, x * 255 // greatest(width - 1, 1) AS r, y * 255 // greatest(height - 1, 1) AS g, ((7 * x + 3 * y + image_id) % 256)::INTEGER AS b
  FROM (SELECT image_id, width, height, (pos % width)::INTEGER AS x, (pos // width)::INTEGER AS y
    FROM (SELECT image_id, width, height, unnest(range(width * height)) AS pos
      FROM (SELECT p_partkey AS image_id, (8 + p_size % 9)::INTEGER AS width, (8 + p_partkey % 7)::INTEGER AS height FROM part)))),
coarser AS (SELECT image_id, width, height, x, y, a, r // 16 * 16 AS r, g // 16 * 16 AS g, b // 16 * 16 AS b FROM synth),
pairs AS (SELECT s.*, c.a AS a2, c.r AS r2, c.g AS g2, c.b AS b2 FROM synth s JOIN coarser c USING (image_id, x, y)),
mosaic AS (SELECT 0::BIGINT AS image_id, 640 AS width, ((max(event_id) OVER () + 20) // 20)::INTEGER AS height, (p % 640)::INTEGER AS x, (p // 640)::INTEGER AS y, CASE WHEN event_id % 5 = 0 THEN 160 + k ELSE 255 END::INTEGER AS a,
  ((p % 640 * 2 + p // 640) % 256)::INTEGER AS r, ((user_id * 3 + k) % 256)::INTEGER AS g, (event_id * 31 % 256)::INTEGER AS b FROM (SELECT event_id, user_id, k, event_id * 32 + k AS p FROM events, (SELECT unnest(range(32)) AS k))),
big AS (SELECT 0::BIGINT AS image_id, 255 AS a, (l_partkey % 256)::INTEGER AS r, (l_suppkey % 256)::INTEGER AS g, ((31 * l_orderkey + 7 * l_linenumber) % 256)::INTEGER AS b FROM lineitem)
"""


def sql(body: str) -> str:
    """A query over the views, for DuckDB; its own tables may be recursive."""
    if "fs(" in body:
        return f"WITH RECURSIVE {SQL.strip()}{body.strip()}"
    return f"WITH {SQL.strip()}\n{body.strip()}" if not body.lstrip().startswith(",") else f"WITH {SQL.strip()}{body.strip()}"
