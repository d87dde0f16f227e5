"""Between the two physical forms, and geometry: rasters (a row per image) and pixels (a row per pixel).

rasters: image_id, width, height, argb ARRAY<BIGINT> (packed, non-negative).  pixels: image_id, width, height, x, y, a, r, g, b.
Geometry moves coordinates; the only operators with a shuffle are those that must fill or overlay a canvas.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.functions.color import blend

PIXEL = ["image_id", "width", "height", "x", "y", "a", "r", "g", "b"]
ALIGNMENTS = ("TOP_LEFT", "TOP", "TOP_RIGHT", "RIGHT", "BOTTOM_RIGHT", "BOTTOM", "BOTTOM_LEFT", "LEFT", "CENTER")


def explode_pixels(rasters: DataFrame) -> DataFrame:
    """Rasters to pixels; entries past width * height are dropped."""
    p = rasters.select("image_id", "width", "height", F.posexplode("argb").alias("pos", "c")).filter(F.col("pos") < F.col("width") * F.col("height"))
    x, y = F.col("pos") % F.col("width"), F.floor(F.col("pos") / F.col("width")).cast("int")
    part = lambda s: F.shiftright("c", s).bitwiseAND(F.lit(255)).cast("int")
    return p.select("image_id", "width", "height", x.alias("x"), y.alias("y"), part(24).alias("a"), part(16).alias("r"), part(8).alias("g"), part(0).alias("b"))


def assemble(pixels: DataFrame) -> DataFrame:
    """Pixels to rasters, in row-major order.  The array is as large as one image, which is what a raster is."""
    packed = ((F.col("a").cast("long") * 256 + F.col("r")) * 256 + F.col("g")) * 256 + F.col("b")
    ordered = F.sort_array(F.collect_list(F.struct("y", "x", packed.alias("c"))))
    return pixels.groupBy("image_id", "width", "height").agg(F.transform(ordered, lambda p: p["c"]).alias("argb"))


def canvas(images: DataFrame) -> DataFrame:
    """(image_id, width, height, x, y) for every place of the images given as (image_id, width, height)."""
    grid = images.select("image_id", "width", "height", F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)).alias("pos"))
    return grid.select("image_id", "width", "height", (F.col("pos") % F.col("width")).alias("x"), F.floor(F.col("pos") / F.col("width")).cast("int").alias("y"))


def sizes(pixels: DataFrame) -> DataFrame:
    return pixels.select("image_id", "width", "height").distinct()


def place(pixels: DataFrame, dx: int | Column, dy: int | Column, width: int | Column, height: int | Column) -> DataFrame:
    """Images with their corner at (dx, dy) on a clear canvas; what falls outside is cut off."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    w, h = lit(width).cast("int"), lit(height).cast("int")
    x, y = F.col("x") + lit(dx), F.col("y") + lit(dy)
    held = ["image_id", "width", "height", "x", "y", *"argb"]
    moved = pixels.select("image_id", w.alias("width"), h.alias("height"), x.cast("int").alias("x"), y.cast("int").alias("y"), *"argb").filter("x >= 0 and y >= 0 and x < width and y < height")
    grid = canvas(sizes(pixels).select("image_id", w.alias("nw"), h.alias("nh")).toDF("image_id", "width", "height"))
    # One aggregate and no join: pixels lie over the clear places of the canvas, which hold nulls.
    both = moved.select(*held).unionByName(grid.select(*held[:5], *[F.lit(None).cast(pixels.schema[c].dataType).alias(c) for c in "argb"]))
    return both.groupBy(*held[:5]).agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in "argb"])


def align_box(width: Column, height: Column, box_width: int, box_height: int) -> tuple[Column, Column]:
    """The box that an image is aligned in: enlarged at its own proportions where the image would not fit."""
    rate = F.greatest(width / F.lit(float(box_width)), height / F.lit(float(box_height)))
    fits = (width <= box_width) & (height <= box_height)
    return tuple(F.when(fits, F.lit(s)).otherwise(F.ceil(F.lit(s) * rate)).cast("int") for s in (box_width, box_height))


def align(pixels: DataFrame, alignment: str, box_width: int, box_height: int) -> DataFrame:
    """Images in a clear box, at one of ALIGNMENTS; halves are cut to whole pixels."""
    if alignment not in ALIGNMENTS:
        raise ValueError(f"unknown alignment: {alignment}")
    if box_width < 1 or box_height < 1:
        raise ValueError(f"bad box: {box_width}x{box_height}")
    bw, bh = align_box(F.col("width"), F.col("height"), box_width, box_height)

    def offset(room: Column, low: str, high: str) -> Column:
        return F.lit(0) if low in alignment else room if high in alignment else F.floor(room / 2).cast("int")

    return place(pixels, offset(bw - F.col("width"), "LEFT", "RIGHT"), offset(bh - F.col("height"), "TOP", "BOTTOM"), bw, bh)


def rotate_quarter(pixels: DataFrame, degree: int) -> DataFrame:
    """Clockwise by a multiple of 90 degrees, on a fitting canvas: a projection, without a shuffle."""
    if degree % 90:
        raise ValueError("only multiples of 90; other angles: rotate_raster")
    turn = degree % 360
    if turn == 0:
        return pixels
    w, h, x, y = (F.col(c) for c in ("width", "height", "x", "y"))
    to = {90: (h - 1 - y, x, h, w), 180: (w - 1 - x, h - 1 - y, w, h), 270: (y, w - 1 - x, h, w)}[turn]
    return pixels.select("image_id", to[2].alias("width"), to[3].alias("height"), to[0].alias("x"), to[1].alias("y"), "a", "r", "g", "b")


def join_canvas(first: DataFrame, second: DataFrame, orient: str = "HORIZONTAL") -> DataFrame:
    """The second image beside (or, VERTICAL, below) the first with its image_id, over white; images without a partner go.

    One shuffle by image and no join: both tables are read once, whatever their size.
    """
    if orient not in ("HORIZONTAL", "VERTICAL"):
        raise ValueError(f"unknown orientation: {orient}")
    below = orient == "VERTICAL"
    held = ["image_id", "width", "height", "x", "y", "a", "r", "g", "b"]
    both = first.select(*held, F.lit(0).alias("side")).unionByName(second.select(*held, F.lit(1).alias("side")))
    # Every pixel row carries its image's size, so a window over the image tells the other one's.
    image = Window.partitionBy("image_id")
    size = lambda c, side: F.max(F.when(F.col("side") == side, F.col(c))).over(image)
    both = both.withColumns({f"{c[0]}{side + 1}": size(c, side) for c in ("width", "height") for side in (0, 1)}).filter("w1 is not null and w2 is not null")
    w1, h1, w2, h2, side = (F.col(c) for c in ("w1", "h1", "w2", "h2", "side"))
    width, height = (F.greatest(w1, w2), h1 + h2) if below else (w1 + w2, F.greatest(h1, h2))
    over = lambda c: blend(F.col(c), F.col("a"), F.lit(255)).alias(c)
    white = [F.lit(255).alias(c) for c in "rgb"]
    own = F.struct((F.col("x") + (F.lit(0) if below else w1 * side)).alias("x"), (F.col("y") + (h1 * side if below else F.lit(0))).alias("y"), *map(over, "rgb"), F.lit(1).alias("run"))
    # What the smaller image leaves of its strip is white; the first image's corner pixel stands for the rows of it, which then
    # become pixels one by one, so no row of the plan holds an area.
    small, big, depth = (F.least(w1, w2), F.greatest(w1, w2), F.when(w1 < w2, h1).otherwise(h2)) if below else (F.least(h1, h2), F.greatest(h1, h2), F.when(h1 < h2, w1).otherwise(w2))
    begin = F.when(w1 < w2, 0).otherwise(h1) if below else F.when(h1 < h2, 0).otherwise(w1)
    x, y, lines, run = (small, begin, depth, big - small) if below else (begin, small, big - small, depth)
    rest = F.transform(F.sequence(F.lit(0), lines - 1), lambda i: F.struct(x.alias("x"), (y + i).alias("y"), *white, run.alias("run")))
    corner = (side == 0) & (F.col("x") == 0) & (F.col("y") == 0) & (big > small)
    laid = both.select("image_id", width.alias("width"), height.alias("height"), F.explode(F.when(corner, F.concat(F.array(own), rest)).otherwise(F.array(own))).alias("p"))
    laid = laid.select("image_id", "width", "height", "p.*", F.explode(F.sequence(F.lit(0), F.col("p.run") - 1)).alias("i"))
    return laid.select("image_id", "width", "height", (F.col("x") + F.col("i")).alias("x"), "y", F.lit(255).alias("a"), "r", "g", "b")


def color_key(pixels: DataFrame, color: tuple[int, int, int], tolerance: float) -> DataFrame:
    """Pixels near a colour on every channel become clear black, whatever their alpha."""
    if not 0 <= tolerance <= 1:
        raise ValueError(f"tolerance must be 0..1: {tolerance}")
    limit = int(tolerance * 255 + 0.5)
    near = [F.abs(F.col(c) - v) <= limit for c, v in zip("rgb", color)]
    hit = near[0] & near[1] & near[2]
    return pixels.select("image_id", "width", "height", "x", "y", *[F.when(hit, F.lit(0)).otherwise(F.col(c)).alias(c) for c in "argb"])


def flatten_white(pixels: DataFrame) -> DataFrame:
    return pixels.select("image_id", "width", "height", "x", "y", F.lit(255).alias("a"), *[blend(F.col(c), F.col("a"), F.lit(255)).alias(c) for c in "rgb"])


def opacity(pixels: DataFrame, factor: float) -> DataFrame:
    """Alpha times a factor; 1 and more leave it.  Pixels that end clear lose their colour."""
    if factor >= 1:
        factor = 1.0
    if factor < 0:
        raise ValueError(f"factor must not be negative: {factor}")
    a = F.floor(F.col("a") * F.lit(float(factor)) + 0.5).cast("int")
    return pixels.select("image_id", "width", "height", "x", "y", a.alias("a"), *[F.when(a == 0, F.lit(0)).otherwise(F.col(c)).alias(c) for c in "rgb"])


def gray_pixels(pixels: DataFrame) -> DataFrame:
    """The grey level over white in r, g and b, opaque."""
    from pixelloom.functions.color import on_white

    g = on_white(F.col("a"), F.col("r"), F.col("g"), F.col("b"))
    return pixels.select("image_id", "width", "height", "x", "y", F.lit(255).alias("a"), g.alias("r"), g.alias("g"), g.alias("b"))


def grayed(pixels: DataFrame, threshold: int = 128) -> DataFrame:
    """(..., gray, alpha_mask, binary_mask): masks are null where the image has no alpha; unused ones are pruned."""
    from pixelloom.functions.color import on_white

    has = F.max(F.col("a") < 255).over(Window.partitionBy("image_id"))
    g = on_white(F.col("a"), F.col("r"), F.col("g"), F.col("b"))
    return pixels.select("image_id", "width", "height", "x", "y", g.alias("gray"), F.when(has, F.col("a")).alias("alpha_mask"), F.when(has, (F.col("a") >= threshold).cast("int")).alias("binary_mask"))
