"""Reading image files into DataFrames, and byte-level functions as Arrow column functions and table functions."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import decode, formats, lossy, png

SIZE = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())])


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, modificationTime, length, content) of files; content is not read unless it is used."""
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def native_size(content: Column) -> Column:
    """Size of PNG, GIF and BMP files from their headers, JVM-side; null for others."""
    number = lambda at, n, little=False: F.conv(_bytes(content, at, n, little), 16, 10).cast("long")
    head = lambda at, n: F.hex(F.substring(content, at + 1, n))
    size = lambda w, h: F.when((w > 0) & (h > 0) & (w < 2**31) & (h < 2**31), F.struct(w.cast("int").alias("width"), h.cast("int").alias("height")))
    signed = lambda v: F.when(v >= 2**31, v - 2**32).otherwise(v)
    n = F.octet_length(content)
    is_png = (n >= 24) & (head(0, 4) == "89504E47") & (head(12, 4) == "49484452")
    is_gif = (n >= 16) & (head(0, 3) == "474946")
    declared, start, dib = number(2, 4, True), number(10, 4, True), number(14, 4, True)
    is_bmp = (n >= 26) & (head(0, 2) == "424D") & ((declared == 0) | (declared == n)) & (dib >= 40) & (dib < 2**31) & (start >= dib + 14) & (start <= n)
    return F.when(is_png, size(number(16, 4), number(20, 4))).when(is_gif, size(number(6, 2, True), number(8, 2, True))).when(is_bmp, size(signed(number(18, 4, True)), F.abs(signed(number(22, 4, True)))))


def is_binary_file(content: Column) -> Column:
    """Whether a PNG holds grey levels or palette entries of one bit a pixel, by its header alone; null for other files."""
    part = lambda at, n: F.hex(F.substring(content, at + 1, n))
    return F.when((part(0, 4) == "89504E47") & (part(12, 4) == "49484452"), (part(24, 1) == "01") & part(25, 1).isin("00", "03"))


def _bytes(content: Column, at: int, n: int, little: bool) -> Column:
    order = range(n - 1, -1, -1) if little else range(n)
    return F.concat(*[F.hex(F.substring(content, at + i + 1, 1)) for i in order])


@F.pandas_udf(SIZE)
def image_size(content: pd.Series) -> pd.DataFrame:
    """(width, height) from the header of PNG, JPEG, GIF or BMP files; null fields for others."""
    found = [formats.image_size(bytes(c) if c is not None else None) or (None, None) for c in content]
    return pd.DataFrame(found, columns=["width", "height"], dtype="Int32")


@F.pandas_udf(T.BinaryType())
def reconcile_jpeg(content: pd.Series) -> pd.Series:
    return content.map(lambda c: formats.reconcile_jpeg(bytes(c)) if c is not None else None)


@F.pandas_udf(T.BinaryType())
def png_profile(content: pd.Series) -> pd.Series:
    return content.map(lambda c: png.profile(bytes(c)) if c is not None else None)


@F.pandas_udf(T.BinaryType())
def with_profile(content: pd.Series, icc: pd.Series) -> pd.Series:
    return pd.Series([png.with_profile(bytes(c), bytes(p) if p is not None else None) if c is not None else None for c, p in zip(content, icc)])


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def text_metadata(content: pd.Series) -> pd.Series:
    return content.map(lambda c: formats.read_text(bytes(c)) if c is not None else {})


@F.pandas_udf(T.BinaryType())
def add_text(content: pd.Series, entries: pd.Series) -> pd.Series:
    return pd.Series([formats.write_text(bytes(c), dict(e or {})) if c is not None else None for c, e in zip(content, entries)])


@F.pandas_udf(T.StringType())
def chunk_types(content: pd.Series) -> pd.Series:
    """Names of a PNG's whole chunks, in order."""
    return content.map(lambda c: " ".join(kind for _, kind, _, _ in png.chunks(bytes(c))) if c is not None else None)


@F.udtf(returnType="pos long, type string, length long, data binary")
class PngChunks:
    """png_chunks(content): one row per whole chunk."""

    def eval(self, content: bytes):
        yield from png.chunks(bytes(content) if content is not None else None)


def image_type(name: Column) -> Column:
    return F.when(F.upper(name).isin(*formats.IMAGE_TYPES), F.upper(name))


def alpha_supported(name: Column) -> Column:
    return F.lower(name).isin("png", "gif", "tiff")


RASTER = "image_id bigint, width int, height int, argb array<bigint>"


_RASTER = pa.schema([("image_id", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("argb", pa.list_(pa.field("element", pa.int64())))])


def _rows(it, decode):
    from pixelloom.operators.grouped import batched, pack

    def rasters():
        for batch in it:
            for image, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    r = decode(content.as_py())
                except (ValueError, KeyError, IndexError, png.zlib.error, png.struct.error):
                    continue
                yield image, r.shape[1], r.shape[0], pack(r)

    return batched(rasters(), _RASTER)


def decode_png(files: DataFrame, srgb: bool = False, step_to: tuple[int, int] | None = None) -> DataFrame:
    """Rasters of PNG files (image_id, content); broken ones are left out.

    srgb: apply an embedded profile, for which samples of other depths are narrowed by shifts.  step_to: a target size
    that the pixels are decimated for while they are decoded, by a power of two that leaves twice the target, so that a
    thumbnail never holds the whole image.
    """

    def decode(content: bytes) -> np.ndarray:
        from pixelloom.operators.resample import subsampling

        size = formats.image_size(content)
        r = png.decode(content, subsampling(*size, *step_to) if step_to and size else 1, shift=srgb)
        return formats.to_srgb(r, png.profile(content))[0] if srgb else r

    return files.select(F.col("image_id").cast("long"), "content").mapInArrow(lambda it: _rows(it, decode), RASTER)


def decode_tiff(files: DataFrame) -> DataFrame:
    """Rasters of TIFF files of 8-bit RGB or RGBA strips (image_id, content); others are left out."""
    return files.select(F.col("image_id").cast("long"), "content").mapInArrow(lambda it: _rows(it, formats.read_tiff), RASTER)


def _read_any(content: bytes | None, step_to: tuple[int, int] | None = None) -> np.ndarray:
    """The raster of a file of any kind that is decoded here; others raise ValueError."""
    from pixelloom.operators.resample import subsampling

    if content is None:
        raise ValueError("no content")
    size = formats.image_size(content)
    step = subsampling(*size, *step_to) if step_to and size else 1
    if content[:4] == b"\x89PNG":
        return png.decode(content, step)
    if content[:2] == b"\xff\xd8":
        return decode.read_jpeg(content, step)
    if content[:3] == b"GIF":
        return decode.read_gif(content)[::step, ::step]
    if content[:2] == b"BM":
        return decode.read_bmp(content, step)
    out = formats.read_tiff(content)
    step = subsampling(out.shape[1], out.shape[0], *step_to) if step_to else 1
    return out[::step, ::step]


def decode_files(files: DataFrame, step_to: tuple[int, int] | None = None) -> DataFrame:
    """Rasters of PNG, JPEG, GIF, BMP and TIFF files in a column (image_id, content), by what the bytes say they are.

    step_to: a target size for which the pixels are decimated while they are decoded, by a power of two that leaves twice the target: PNG
    and BMP leave rows and pixels out, JPEG transforms fewer coefficients; GIF and TIFF are cut after decoding.  Of a GIF the first
    picture counts.  Null, broken and other content, also progressive JPEG, is left out; rows that share an id stay rows of their own.
    """

    return files.select(F.col("image_id").cast("long"), "content").mapInArrow(lambda it: _rows(it, lambda c: _read_any(c, step_to)), RASTER)


def thumbnails(files: DataFrame, to_width: int, to_height: int) -> DataFrame:
    """Rasters of to_width x to_height of image files in a column (image_id, content), resampled as resample.resize does it.

    PNG files are resampled while their scanlines are inflated, in the memory of the thumbnail; others are decoded first.  Null, broken
    and unknown content is left out.
    """

    def read(content: bytes) -> np.ndarray:
        from pixelloom.operators.kernels import resize_raster, resize_rows

        if content is not None and content[:4] == b"\x89PNG":
            w, h, rows = png.scanlines(content)
            return resize_rows(rows, w, h, to_width, to_height)
        return resize_raster(_read_any(content), to_width, to_height)

    return files.select(F.col("image_id").cast("long"), "content").mapInArrow(lambda it: _rows(it, read), RASTER)


def read_images(spark: SparkSession, path: str, step_to: tuple[int, int] | None = None) -> DataFrame:
    """(path, width, height, argb) through the built-in image source: PNG, JPEG, GIF, BMP, TIFF; undecodable files are dropped.

    The source's bytes are BGR, BGRA or grey, row by row.  step_to: a target size for which pixels are decimated, by a
    power of two that leaves twice the target, before anything is made of them.
    """
    images = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")

    def unpack(it):
        from pixelloom.operators.resample import subsampling

        for batch in it:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in ("origin", "width", "height", "nChannels", "data")}
                w, h, n = (row[c].as_py() for c in ("width", "height", "nChannels"))
                step = subsampling(w, h, *step_to) if step_to else 1
                d = np.frombuffer(row["data"].as_buffer(), np.uint8).reshape(h, w, n)[::step, ::step].astype(np.int64)
                a = d[..., 3] if n == 4 else np.full(d.shape[:2], 255)
                b, g, r = (d[..., min(c, n - 1)] if n >= 3 else d[..., 0] for c in range(3))
                packed = (a << 24 | r << 16 | g << 8 | b).ravel()
                yield pa.RecordBatch.from_pydict({"path": pa.array([row["origin"].as_py()]), "width": pa.array([d.shape[1]], pa.int32()), "height": pa.array([d.shape[0]], pa.int32()), "argb": pa.array([packed], pa.list_(pa.int64()))})

    return images.mapInArrow(unpack, "path string, width int, height int, argb array<bigint>")


def scratch_folder(spark: SparkSession) -> str:
    """A new folder that all machines share, below spark.checkpoint.dir, or a temporary one on this machine alone; gone when the JVM ends."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="pixelloom-")
    path = f"{top.rstrip('/')}/files-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def file_writer(kind: str, quality: float = -1):
    """What makes a file of a raster, and the suffix of such files."""
    form = formats.resolve_type(kind)
    writers = {
        "PNG": lambda r: png.fast(r, bool((r[..., 0] != 255).any())), "BMP": formats.write_bmp, "TIFF": formats.write_tiff,
        "JPG": lambda r: lossy.write_jpeg(r, quality if quality >= 0 else 0.75), "GIF": lossy.write_gif,
    }
    if form is None:
        raise ValueError(f"no writer for {kind}")
    return writers[form], form.lower()


def encode_files(rasters: DataFrame, kind: str, quality: float = -1) -> DataFrame:
    """(image_id, content) of rasters as PNG, BMP, TIFF, JPG or GIF files, made on the executors.

    Kinds without alpha are flattened on white.  quality: of JPG, 0 to 1, negative for the usual one.
    """
    from pixelloom.operators.grouped import each_raster

    write, _ = file_writer(kind, quality)
    return each_raster(rasters, lambda r: (write(r),), "content binary")


def write_files(files: DataFrame, path: str, suffix: str) -> int:
    """Write the content of each row (image_id, content) to path/image_id.suffix; the number of files written comes back.

    path: a local or remote folder that executors reach by pyarrow's file systems.  A file is written under a name of
    its own and moved into place, so a task that is run again leaves no half-written file.  Rows without id or content
    are left out; of repeated ids one file stays.
    """

    def write(it):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
        store.create_dir(base)
        for batch in it:
            done = 0
            for image, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                if image is None or not content.is_valid:
                    continue
                part = f"{base}/.{image}-{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(content.as_buffer())
                store.move(part, f"{base}/{image}.{suffix}")
                done += 1
            yield pa.RecordBatch.from_pydict({"n": pa.array([done], pa.int64())})

    return files.select(F.col("image_id").cast("long"), "content").mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


def write_with_jvm(spark: SparkSession, raster: np.ndarray, kind: str, quality: float = -1) -> bytes:
    """One raster through the JVM's image writers, on the driver; encode_files is the way for tables.

    A writer that refuses alpha gets the image flattened on white.  quality: 0 to 1, negative for the writer's own.
    """
    jvm = spark._jvm
    h, w, _ = raster.shape
    io = jvm.javax.imageio

    def image(r: np.ndarray, has_alpha: bool):
        out = jvm.java.awt.image.BufferedImage(w, h, 2 if has_alpha else 1)
        c = r.reshape(-1, 4).astype(np.int64)
        packed = (c[:, 0] << 24 | c[:, 1] << 16 | c[:, 2] << 8 | c[:, 3]).astype(">u4")
        ints = jvm.java.nio.ByteBuffer.wrap(packed.tobytes()).asIntBuffer()
        array = spark.sparkContext._gateway.new_array(jvm.int, w * h)
        ints.get(array)
        out.setRGB(0, 0, w, h, array, 0, w)
        return out

    alpha = bool((raster[..., 0] != 255).any()) and formats.alpha_supported(kind)
    flat = raster.copy()
    if not alpha:
        a = raster[..., :1] / 255.0
        flat[..., 1:], flat[..., 0] = np.floor(raster[..., 1:] * a + 255 * (1 - a) + 0.5), 255
    writers = io.ImageIO.getImageWritersByFormatName(kind)
    if not writers.hasNext():
        raise ValueError(f"no writer for {kind}")
    writer = writers.next()
    param = writer.getDefaultWriteParam()
    if quality >= 0 and param.canWriteCompressed():
        param.setCompressionMode(2)
        param.setCompressionType(param.getCompressionTypes()[0])
        param.setCompressionQuality(float(quality))
    stream = jvm.java.io.ByteArrayOutputStream()
    target = io.ImageIO.createImageOutputStream(stream)
    try:
        writer.setOutput(target)
        writer.write(None, io.IIOImage(image(flat, alpha), None, None), param)
    finally:
        target.close()
        writer.dispose()
    return bytes(stream.toByteArray())
