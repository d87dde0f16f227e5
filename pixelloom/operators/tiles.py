"""Neighbourhood operators over tiles, so that one large image is the work of many tasks.

A tile owns `wide` x `high` pixels of an image and sees a halo around them, as far as the operator reaches.  Pixels of a halo are
copied to the tiles that need them, about 4 * reach / side of all; each tile then goes through the operator as an image of its own,
and what it makes of its halo is dropped, as the true neighbours of those pixels lie outside.  The image's own edges stay edges, since
a tile has no halo there.  A small image is one tile, and nothing is copied.

Where rows become many pixels each, the rows are dealt by tile and pixels made of them afterwards (Deal): a shuffle of rows instead of
pixels, over tasks of so many pixels, however large the image grows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.sources import png

from . import stencil

#: Side of a tile in pixels.
SIDE = 512
#: Pixels that a task makes of its rows, about.
TASK = 1 << 19

#: deal(rows, n, w, h) of in_tiles, and pixels as its functions take them.
Deal = Callable[[DataFrame, int, int, int], DataFrame]
Pixels = DataFrame | Callable[[Deal], DataFrame]


def _tiles(at: Column, size: Column, side: int, reach: int, long: int = 1) -> Column:
    """Numbers of the tiles along one side of the image that see a place, or some of so many places from there."""
    last = F.floor((size - 1) / side)
    return F.sequence(F.greatest(F.floor((at - reach) / side), F.lit(0)), F.least(F.floor((at + long - 1 + reach) / side), last))


def _copied(rows: DataFrame, reach: int, wide: int, high: int, w: int = 1, h: int = 1) -> DataFrame:
    """Pixels, or rows that stand for blocks of w x h pixels from (x, y) on, for each tile that sees some of them."""
    seen = rows.withColumn("tile_y", F.explode(_tiles(F.col("y"), F.col("height"), high, reach, h)))
    seen = seen.withColumn("tile_x", F.explode(_tiles(F.col("x"), F.col("width"), wide, reach, w)))
    return seen.withColumn("image_id", F.struct("tile_y", "tile_x", "image_id")).drop("tile_y", "tile_x")


def _within(at: str, tile: str, side: int, reach: int) -> Column:
    first = F.col(f"image_id.{tile}") * side
    return (F.col(at) >= first - reach) & (F.col(at) < first + side + reach)


def in_tiles(pixels: Pixels, operator: Callable[[DataFrame], DataFrame], reach: int, wide: int = SIDE, high: int = SIDE) -> DataFrame:
    """operator(pixels), computed tile by tile.

    pixels: image_id, width, height, x, y and whatever the operator reads.  operator: takes pixels, keeps image_id, x and y, works on
    each image by itself and makes each pixel of what lies at most `reach` rows and columns away.  Inside, image_id is
    (tile_y, tile_x, image_id).  No task needs more of an image at once than a tile and its halo; halos of several tiles deep are fine.

    Pixels given as a table are shuffled, over as many tasks as Spark's settings say.  For large ones give a function of deal: it calls
    deal(rows, n, w, h) with n rows that stand for blocks of w x h pixels within their image, x and y being the first, gets them dealt
    by tile over tasks of TASK pixels, and returns the pixels that it makes of them, with the image_id it got.
    """
    if wide < 1 or high < 1 or reach < 0:
        raise ValueError(f"bad tiles: {wide}x{high}, reach {reach}")
    if isinstance(pixels, DataFrame):
        made = operator(_copied(pixels, reach, wide, high).repartition("image_id"))
    else:

        def deal(rows: DataFrame, n: int, w: int, h: int) -> DataFrame:
            tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n * w * h // TASK))
            return _copied(rows, reach, wide, high, w, h).repartition(tasks, "image_id")

        # A block may lie across the edge of what a tile sees.
        made = operator(pixels(deal).filter(_within("y", "tile_y", high, reach) & _within("x", "tile_x", wide, reach)))
    own = (F.floor(F.col("y") / high) == F.col("image_id.tile_y")) & (F.floor(F.col("x") / wide) == F.col("image_id.tile_x"))
    return made.filter(own).withColumn("image_id", F.col("image_id.image_id"))


def importance(pixels: Pixels, strength: float = 3.0, detail: float = 12.0, side: int = SIDE) -> DataFrame:
    """stencil.importance of images of any size: its fit and its minimum reach one pixel each."""
    return in_tiles(pixels, lambda p: stencil.importance(p, strength, detail, dealt=True), 2, side, side)


def erode(plane: Pixels, value: str, side: int = SIDE) -> DataFrame:
    return in_tiles(plane, lambda p: stencil.erode(p, value), 1, side, side)


def sharpen(pixels: Pixels, level: int = 1, side: int = SIDE) -> DataFrame:
    """stencil.sharpen of images of any size; each pass reaches one pixel further."""
    return pixels if level == 0 and isinstance(pixels, DataFrame) else in_tiles(pixels, lambda p: stencil.sharpen(p, level), level, side, side)


def filtered(pixels: Pixels, channels: str = "rgb", side: int = SIDE) -> DataFrame:
    """stencil.filtered of images of any size."""
    return in_tiles(pixels, lambda p: stencil.filtered(p, channels), 1, side, side)


def filter_choice(pixels: Pixels, channels: str = "rgb", side: int = SIDE) -> DataFrame:
    """stencil.filter_choice of images of any size: tiles sum up their parts of a row, rows their tiles."""
    return stencil.cheapest(filtered(pixels, channels, side))


def _bands(pixels: DataFrame, rows: int, alpha: bool, level: int) -> DataFrame:
    """(image_id, width, height, band, data, checksum, length): each band of `rows` rows deflated by a task of its own."""
    if rows < 1:
        raise ValueError(f"bad bands: {rows}")
    order = "rgba" if alpha else "rgb"
    seen = pixels.select("image_id", "width", "height", "x", "y", *[F.col(c).cast("int").alias(c) for c in "argb"], F.floor(F.col("y") / rows).alias("band"))

    def deflate(table: pa.Table) -> pa.Table:
        number, w, h = (table.column(c)[0].as_py() for c in ("band", "width", "height"))
        n = min((number + 1) * rows, h) - number * rows
        place = (table.column("y").to_numpy() - number * rows) * w + table.column("x").to_numpy()
        if len(place) != n * w or (np.bincount(place, minlength=n * w) != 1).any():
            raise ValueError(f"image {table.column('image_id')[0]}: pixels are missing or stand twice")
        lines = np.empty((n * w, len(order)), np.uint8)
        lines[place] = np.stack([table.column(c).to_numpy() for c in order], axis=1)
        data, checksum, length = png.band(lines.reshape(n, -1), (number + 1) * rows >= h, level)
        return pa.table({"image_id": table.column("image_id").slice(0, 1), "width": pa.array([w], pa.int32()), "height": pa.array([h], pa.int32()), "band": pa.array([number]), "data": pa.array([data], pa.binary()), "checksum": pa.array([checksum]), "length": pa.array([length])})

    kind = pixels.schema["image_id"].dataType.simpleString()
    return seen.groupBy("image_id", "band").applyInArrow(deflate, f"image_id {kind}, width int, height int, band long, data binary, checksum long, length long")


def _whole(table: pa.Table, rows: int) -> tuple[int, int, pa.Table]:
    table = table.sort_by("band")
    w, h = table.column("width")[0].as_py(), table.column("height")[0].as_py()
    if table.column("band").to_pylist() != [*range(-(-h // rows))]:
        raise ValueError(f"image {table.column('image_id')[0]}: rows are missing")
    return w, h, table


def banded_png(pixels: DataFrame, rows: int = SIDE, alpha: bool = True, level: int = 2) -> DataFrame:
    """(image_id, width, height, content): PNG files of the pixels as they are, each band of `rows` rows deflated by a task of its own.

    A band ends with a sync flush and brings the checksum of its bytes; checksums of bands combine to that of the image, so only
    compressed bytes meet in one task.  Images need all their pixels, one each; others fail.  Files too large for a cell: banded_parts.
    """

    def join(table: pa.Table) -> pa.Table:
        w, h, table = _whole(table, rows)
        bands = [*zip(*(table.column(c).to_pylist() for c in ("data", "checksum", "length")))]
        return pa.table({"image_id": table.column("image_id").slice(0, 1), "width": pa.array([w], pa.int32()), "height": pa.array([h], pa.int32()), "content": pa.array([png.from_bands(w, h, bands, alpha)], pa.binary())})

    kind = pixels.schema["image_id"].dataType.simpleString()
    return _bands(pixels, rows, alpha, level).groupBy("image_id").applyInArrow(join, f"image_id {kind}, width int, height int, content binary")


def banded_parts(pixels: DataFrame, rows: int = SIDE, alpha: bool = True, level: int = 2) -> DataFrame:
    """(image_id, width, height, part, content): the files of banded_png in parts, which joined in their order are a PNG file.

    Part 0 is the head, then each band is a part, and the last one holds the checksum of all; no task holds a file.  Bands are staged in
    spark.checkpoint.dir, as they are read twice.
    """
    from pixelloom.sources.images import scratch_folder

    spark = pixels.sparkSession
    folder = scratch_folder(spark)
    _bands(pixels, rows, alpha, level).write.parquet(folder)
    bands = spark.read.parquet(folder)

    def ends(table: pa.Table) -> pa.Table:
        w, h, table = _whole(table, rows)
        content = png.band_parts(w, h, [*zip(table.column("checksum").to_pylist(), table.column("length").to_pylist())], alpha)
        twice = lambda v, kind: pa.array([v, v], kind)
        return pa.table({"image_id": pa.concat_arrays([table.column("image_id").slice(0, 1).combine_chunks()] * 2), "width": twice(w, pa.int32()), "height": twice(h, pa.int32()), "part": pa.array([0, len(table) + 1]), "content": pa.array([*content], pa.binary())})

    def chunks(it):
        for b in it:
            content = pa.array([png.chunk(b"IDAT", v.as_py()) for v in b.column("data")], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("image_id", "width", "height", "part")), content], ["image_id", "width", "height", "part", "content"])

    ddl = f"image_id {pixels.schema['image_id'].dataType.simpleString()}, width int, height int, part long, content binary"
    data = bands.select("image_id", "width", "height", (F.col("band") + 1).alias("part"), "data").mapInArrow(chunks, ddl)
    return data.unionByName(bands.drop("data").groupBy("image_id").applyInArrow(ends, ddl))


def parts_pixels(parts: DataFrame, rows: int, alpha: bool = True) -> DataFrame:
    """Pixels of banded_parts with bands of so many rows, band by band: no task holds an image."""
    order = "rgba" if alpha else "rgb"
    kind = parts.schema["image_id"].dataType.simpleString()

    def read(it):
        for b in it:
            for i in range(b.num_rows):
                w, h, part, content = (b.column(c)[i].as_py() for c in ("width", "height", "part", "content"))
                if not 1 <= part <= -(-h // rows):
                    continue  # the head, and the checksum with IEND
                if content[4:8] != b"IDAT" or int.from_bytes(content[-4:], "big") != png.zlib.crc32(content[4:-4]):
                    raise ValueError(f"part {part} is broken")
                lines = png.read_band(content[8:-4], w, len(order)).reshape(-1, len(order)).astype(np.int64)
                first = (part - 1) * rows
                if len(lines) != (min(first + rows, h) - first) * w:
                    raise ValueError(f"part {part} is broken")
                a = lines[:, 3] if alpha else 255
                packed = a << 24 | lines[:, 0] << 16 | lines[:, 1] << 8 | lines[:, 2]
                yield pa.RecordBatch.from_arrays([b.column("image_id").slice(i, 1), pa.array([w], pa.int32()), pa.array([h], pa.int32()), pa.array([first], pa.int32()), pa.array([packed], pa.list_(pa.int64()))], ["image_id", "width", "height", "first", "argb"])

    bands = parts.mapInArrow(read, f"image_id {kind}, width int, height int, first int, argb array<bigint>")
    p = bands.select("image_id", "width", "height", "first", F.posexplode("argb").alias("pos", "c"))
    level = lambda s: F.shiftright("c", s).bitwiseAND(F.lit(255)).cast("int")
    return p.select("image_id", "width", "height", (F.col("pos") % F.col("width")).alias("x"), (F.col("first") + F.floor(F.col("pos") / F.col("width"))).cast("int").alias("y"), *[level(s).alias(c) for c, s in zip("argb", (24, 16, 8, 0))])
