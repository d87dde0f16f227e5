"""Streams of image files: an extension, as the batch operators are stateless and run on streams as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.sources.images import image_size

FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_files(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """New files of a folder, by Spark's binaryFile source."""
    return spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_per_trigger).load(path)


def stream_sizes(files: DataFrame) -> DataFrame:
    """(path, modificationTime, length, width, height) of a stream of files, from headers alone."""
    return files.select("path", "modificationTime", "length", image_size("content").alias("s")).select("path", "modificationTime", "length", "s.width", "s.height")


def size_counts(files: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Images and bytes by window of modification time; files later than the watermark are not counted any more."""
    sized = stream_sizes(files).withWatermark("modificationTime", late)
    return sized.groupBy(F.window("modificationTime", window).alias("window")).agg(F.count("width").alias("images"), F.sum("length").alias("bytes"))
