"""The kernels over DataFrames: one call per image, rasters in and rasters, planes or bytes out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.sources import png

from . import tiles
from .kernels import Options, default_options, dither_palette, floyd_steinberg, resize_raster, rotate_raster
from .masks import ordered_dither
from .palette import EXACT_LIMIT, adaptive_histogram
from .pixels import assemble
from .reduction import quantize_histograms, shares
from .stencil import importance


def unpack(argb, width: int, height: int) -> np.ndarray:
    """(h, w, 4) of packed pixels; more than width * height are cut, fewer fail."""
    c = np.asarray(argb, np.int64)[: width * height]
    if width <= 0 or height <= 0 or len(c) < width * height:
        raise ValueError(f"bad image: {width}x{height}, {len(c)} pixels")
    return c.astype(">u4").view(np.uint8).astype(np.int64).reshape(height, width, 4)


def pack(raster: np.ndarray) -> np.ndarray:
    r = raster.reshape(-1, 4).astype(np.int64)
    return r[:, 0] << 24 | r[:, 1] << 16 | r[:, 2] << 8 | r[:, 3]


def spread(images: DataFrame) -> DataFrame:
    """Rows by image over all cores: kernels cost time rather than bytes, so tasks must not be merged for being small."""
    spark = images.sparkSession
    return images.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "image_id")


#: Results that leave a kernel in one batch: so many rows, or so many bytes.
BATCH, BATCH_BYTES = 256, 1 << 22


def batched(rows, schema: pa.Schema):
    """Arrow batches of tuples: many small results share one, a large one has its own."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(v.nbytes if isinstance(v, np.ndarray) else len(v) if isinstance(v, (bytes, str)) else 8 for v in row)
        if len(held) == BATCH or size >= BATCH_BYTES:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    def column(values, kind):
        if pa.types.is_list(kind) and all(isinstance(v, np.ndarray) for v in values):
            ends = np.cumsum([0, *map(len, values)])
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values)).cast(kind.value_type)).cast(kind)
        return pa.array([v.tolist() if isinstance(v, np.ndarray) else v for v in values]).cast(kind)

    return pa.RecordBatch.from_arrays([column(v, f.type) for v, f in zip(zip(*rows), schema)], schema=schema)


def arrow_schema(ddl: str) -> pa.Schema:
    """On the driver: columns as Arrow has them."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def each_raster(rasters: DataFrame, function, schema: str, dealt: bool = False) -> DataFrame:
    """function(raster (h, w, 4)) -> tuple of values, for each row of rasters; a row at a time is held, and results up to BATCH_BYTES.

    dealt: the rasters are dealt by image to enough tasks already.
    """
    ddl = f"image_id bigint, {schema}"
    out = arrow_schema(ddl)

    def rows(it):
        for batch in it:
            ids, ws, hs = (batch.column(i).to_pylist() for i in range(3))
            at, flat = batch.column(3).offsets.to_numpy(), batch.column(3).values.to_numpy()
            for i, (image, w, h) in enumerate(zip(ids, ws, hs)):
                yield image, *function(unpack(flat[at[i] : at[i + 1]], w, h))

    given = rasters.select(F.col("image_id").cast("long").alias("image_id"), "width", "height", "argb")
    return (given if dealt else spread(given)).mapInArrow(lambda it: batched(rows(it), out), ddl)


def scan(rasters: DataFrame, body, schema: str) -> DataFrame:
    """The user hook: body(raster) for each image, each result its own row; order and place are the engine's."""
    return each_raster(rasters, body, schema)


def floyd_steinberg_bits(rasters: DataFrame) -> DataFrame:
    """(image_id, width, height, bits): the blue channel as the grey level."""
    return each_raster(rasters, lambda r: (r.shape[1], r.shape[0], floyd_steinberg(r[..., 3]).ravel().astype(int)), "width int, height int, bits array<int>")


def dither(pixels: DataFrame, algorithm: str) -> DataFrame:
    """(image_id, width, height, x, y, bit) of grey pixels, read from the blue channel: BAYER, CLUSTERED or FLOYD_STEINBERG."""
    if algorithm == "FLOYD_STEINBERG":
        rows = floyd_steinberg_bits(assemble(pixels)).select("image_id", "width", "height", F.posexplode("bits").alias("p", "bit"))
        return rows.select("image_id", "width", "height", (F.col("p") % F.col("width")).alias("x"), F.floor(F.col("p") / F.col("width")).cast("int").alias("y"), "bit")
    return ordered_dither(pixels.select("image_id", "width", "height", "x", "y", F.col("b").alias("gray")), algorithm)


def similarity_any(first: DataFrame, second: DataFrame) -> DataFrame:
    """(image_id, similarity) of two rasters of any sizes: both are resampled to the smaller width and height first."""
    other = second.select("image_id", F.col("width").alias("w2"), F.col("height").alias("h2"), F.col("argb").alias("argb2"))
    # Sorted and merged: Spark takes tables of pixels for as small as the files they are made of, and would broadcast them.
    both = first.select(F.col("image_id").cast("long").alias("image_id"), "width", "height", "argb").join(other.hint("merge"), "image_id")
    ddl = "image_id bigint, similarity double"
    out = arrow_schema(ddl)

    def compare(it):
        for batch in it:
            for i in range(batch.num_rows):
                image, w, h, w2, h2 = (batch.column(c)[i].as_py() for c in ("image_id", "width", "height", "w2", "h2"))
                size = min(w, w2), min(h, h2)
                one, two = (resize_raster(unpack(batch.column(c)[i].values.to_numpy(), *s), *size) for c, s in (("argb", (w, h)), ("argb2", (w2, h2))))
                value = 1 - np.abs(one[..., 1:] - two[..., 1:]).sum() / (size[0] * size[1] * 3.0) / 255
                yield image, float(value)

    return both.mapInArrow(lambda it: batched(compare(it), out), ddl)


def resized(rasters: DataFrame, to_width: int, to_height: int) -> DataFrame:
    return each_raster(rasters, lambda r: (to_width, to_height, pack(resize_raster(r, to_width, to_height))), "width int, height int, argb array<bigint>")


def rotated(rasters: DataFrame, degree: int, fit: bool = True) -> DataFrame:
    def turn(r):
        out = rotate_raster(r, degree, fit)
        return out.shape[1], out.shape[0], pack(out)

    return each_raster(rasters, turn, "width int, height int, argb array<bigint>")


def _histograms(pixels: DataFrame, options: Options, limit: int, side: int | None = None, dealt: bool = False) -> DataFrame:
    """(image_id, bits, h): one row per image, its buckets in the order in which a scan meets the colours."""
    weight = F.col("weight") if options.importance > 0 else None
    if side:
        weighted = tiles.importance(pixels, options.importance, side=side) if weight is not None else pixels
    else:
        # Dealt by image once: windows, both aggregates and the lists below all keep to that.
        pixels = pixels if dealt else spread(pixels)
        weighted = importance(pixels, options.importance, dealt=True) if weight is not None else pixels
    hist = adaptive_histogram(weighted, limit, weight)
    return hist.groupBy("image_id", "bits").agg(F.sort_array(F.collect_list(F.struct("first_pos", "key", "cnt", "sr", "sg", "sb", "sa"))).alias("h"))


def _fitted(histograms: pa.ListArray, lo: int, hi: int, options: Options) -> tuple[np.ndarray, ...]:
    """Palettes on end, entries in each, ends of the lists of keys, and these in order with the entry of each, of images lo to hi."""
    ends = histograms.offsets.to_numpy()[lo : hi + 1].astype(np.int64)
    flat = histograms.values.slice(ends[0], ends[-1] - ends[0])
    key, cnt = (flat.field(c).to_numpy() for c in ("key", "cnt"))
    sums = np.stack([flat.field(c).to_numpy() for c in ("sr", "sg", "sb", "sa")], axis=1).astype(float)
    ends -= ends[0]
    pal, count, label = quantize_histograms(cnt, sums, ends, options)
    order = np.lexsort((key, np.repeat(np.arange(hi - lo), np.diff(ends))))
    return pal, count, ends, key[order], label[order]


def fits(pixels: DataFrame, options: Options | None = None, limit: int = EXACT_LIMIT, side: int | None = None, dealt: bool = False) -> DataFrame:
    """One row per image: bits, lossless, its colour keys in order with the entry of each, and the palette, packed.

    Weights, histogram and fallback are native; only histograms reach the kernel, 2^20 + 1 rows of an image at most.  side: compute
    weights and partial histograms in tiles of so many pixels a side, for images too large for a task.  dealt: the pixels are
    dealt by image to enough tasks already.
    """
    options = options or default_options()

    def fit(it):
        for batch in it:
            bits = batch.column(1)
            # Images share the Arrow work and the rounds of the reduction.
            for lo, hi in shares(batch.column(2).offsets.to_numpy()):
                pal, count, ends, keys, entries = _fitted(batch.column(2), lo, hi, options)
                some = bits.slice(lo, hi - lo)
                lossless = (some.to_numpy() == 0) & (np.diff(ends) <= options.max_colors)
                at = pa.array(ends, pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(keys)), pa.ListArray.from_arrays(at, pa.array(entries.astype(np.int32)))]
                colors = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *count]), pa.int32()), pa.array(pack(pal)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), some, pa.array(lossless), *lists, colors], ["image_id", "bits", "lossless", "keys", "entries", "palette"])

    return _histograms(pixels, options, limit, side, dealt).mapInArrow(fit, "image_id bigint, bits int, lossless boolean, keys array<bigint>, entries array<int>, palette array<bigint>")


def palettes(pixels: DataFrame, options: Options | None = None, limit: int = EXACT_LIMIT, side: int | None = None, dealt: bool = False) -> DataFrame:
    """(image_id, bits, key, idx, lossless, a, r, g, b): the entry of each colour key and its colour."""
    each = fits(pixels, options, limit, side, dealt).select("image_id", "bits", "lossless", "palette", F.explode(F.arrays_zip("keys", "entries")).alias("k"))
    packed = F.element_at("palette", F.col("k.entries") + 1)
    part = lambda n: F.shiftright(packed, n).bitwiseAND(F.lit(255)).cast("int")
    return each.select("image_id", "bits", F.col("k.keys").alias("key"), F.col("k.entries").alias("idx"), "lossless", *[part(n).alias(c) for c, n in zip("argb", (24, 16, 8, 0))])


def _keys(argb: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Colour keys of packed pixels, each at its own precision, as functions.color makes them."""
    a, r, g, b = (argb >> n & 255 for n in (24, 16, 8, 0))
    key = argb
    if bits.any():
        five = 1 + ((a >> 3) << 15 | (r >> 3) << 10 | (g >> 3) << 5 | b >> 3)
        key = np.where(bits == 0, argb, np.where(bits == 6, (r >> 2) << 12 | (g >> 2) << 6 | b >> 2, five))
    return np.where(a == 0, 0, key)


def encode_png(pixels: DataFrame, options: Options | None = None, limit: int = EXACT_LIMIT, dealt: bool = False) -> DataFrame:
    """(image_id, width, height, colors, lossless, content): reduced images as PNG, palette or, if asked for, true colour."""
    options = options or default_options()
    ddl = "image_id bigint, width int, height int, colors int, lossless boolean, content binary"
    out = arrow_schema(ddl)

    def write(it):
        for batch in it:
            ids, ws, hs = (batch.column(c).to_pylist() for c in ("image_id", "width", "height"))
            bits, h, flat = batch.column("bits").to_numpy(), batch.column("h"), batch.column("argb").values.to_numpy()
            pixel = batch.column("argb").offsets.to_numpy().astype(np.int64)
            for lo, hi in shares(pixel + h.offsets.to_numpy()):
                pal, count, ends, keys, entries = _fitted(h, lo, hi, options)
                argb, at = flat[pixel[lo] : pixel[hi]], pixel[lo : hi + 1] - pixel[lo]
                image = np.repeat(np.arange(hi - lo), np.diff(at))
                # A key is 32 bits wide: with the number of its image before it, one search finds the entries of all pixels.
                own = np.repeat(np.arange(hi - lo), np.diff(ends)) << 32 | keys
                index = entries[np.searchsorted(own, image << 32 | _keys(argb, bits[lo:hi][image]))]
                first = np.cumsum([0, *count])
                for i in range(hi - lo):
                    w, tall, colors = ws[lo + i], hs[lo + i], pal[first[i] : first[i + 1]]
                    lossless = bool(bits[lo + i] == 0 and ends[i + 1] - ends[i] <= options.max_colors)
                    mine = slice(at[i], at[i + 1])
                    if options.dither and not lossless:
                        plane = dither_palette(unpack(argb[mine], w, tall), colors, options.dither)
                    else:
                        plane = index[mine].reshape(tall, w)
                    form = png.indexed if lossless or options.palettize_lossy else png.truecolor
                    yield ids[lo + i], w, tall, len(colors), lossless, form(plane, colors, options.deflate)

    # Both sides keep to the dealing by image, so neither is shuffled for the join, and its sorts can spill.
    pixels = pixels if dealt else spread(pixels)
    both = assemble(pixels).hint("merge").join(_histograms(pixels, options, limit, dealt=True), "image_id")
    return both.select(F.col("image_id").cast("long").alias("image_id"), "width", "height", "argb", "bits", "h").mapInArrow(lambda it: batched(write(it), out), ddl)


def fast_png(rasters: DataFrame, alpha: bool = True, level: int = 2, dealt: bool = False) -> DataFrame:
    """(image_id, content): true-colour PNG of the pixels as they are, every row under the Up filter.  dealt: as in each_raster."""
    return each_raster(rasters, lambda r: (png.fast(r, alpha, level),), "content binary", dealt)


__all__ = ["assemble", "dither", "encode_png", "similarity_any", "fast_png", "floyd_steinberg_bits", "palettes", "resized", "rotated", "scan"]
