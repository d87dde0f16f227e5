"""What the operators share: staging in the shared folder, Arrow text buffers, vectorised words and fingerprints.

Null handling, the same everywhere unless an operator says otherwise: a null text is an empty text, a null id is
an id of its own that sorts before the others.  Operators read only the columns that they are told to read, so extra
columns, whatever their names, pass by.
"""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import threading
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------- shared folder


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir.

    A session that names none gets a temporary folder if it runs on this machine alone, as in tests; on a cluster that
    is an error, as executors could not read each other's files.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="pixelloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stage(df: DataFrame, name: str, buckets: tuple[str, int] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage is cut, and a lost executor costs one task.

    buckets: a column and a number; the table is dealt by it once, and grouping by that column then needs no shuffle.
    Shuffle files of the write are released at once where Spark can do so; the table itself goes when the JVM ends.
    """
    spark = df.sparkSession
    unique = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/pixelloom/{unique}"
    with freeing(spark):
        if buckets:
            by, n = buckets
            df.repartition(n, by).write.option("compression", "zstd").option("path", path).bucketBy(n, by).saveAsTable(unique)
        else:
            df.write.option("compression", "zstd").parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    if (passing := _passing.get()) is not None:
        passing.append(path)
    if not buckets:
        return spark.read.schema(df.schema).parquet(path)
    out = spark.table(unique)
    spark.sql(f"DROP TABLE {unique}")  # the name alone: the files are outside the warehouse
    return out


#: Folders of the tables staged since the innermost settle() of this thread began.
_passing: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("passing", default=None)


def settle(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """Stage what make() gives, and delete all that this thread staged on the way to it."""
    passing: list[str] = []
    token = _passing.set(passing)
    try:
        df = make()
    finally:
        _passing.reset(token)
    try:
        return stage(df, name)
    finally:
        for path in passing:
            _delete(spark, path)


_lock = threading.Lock()
#: How many callers want shuffle files freed now, and the session's setting from before the first.
_wanting: list = [0, None]


@contextlib.contextmanager
def freeing(spark: SparkSession):
    """Shuffle files go when the job that wrote them ends, not when the driver happens to collect its garbage.

    The setting is the session's; it goes back to what it was when the last of the callers, in whatever threads, is done.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    with _lock:
        if not _wanting[0]:
            _wanting[1] = spark.conf.get(key, None)
            spark.conf.set(key, "true")
        _wanting[0] += 1
    try:
        yield
    finally:
        with _lock:
            _wanting[0] -= 1
            if not _wanting[0]:
                spark.conf.unset(key) if _wanting[1] is None else spark.conf.set(key, _wanting[1])


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def release(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(spark, path)


# ---------------------------------------------------------------- texts in Arrow buffers


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all values, concatenated, and the n + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) else b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def strings(data: np.ndarray, offsets: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """The reverse of text_buffer."""
    if data.nbytes < 2**31 - 1:
        return pa.Array.from_buffers(kind or pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
    large = pa.large_binary() if kind == pa.binary() else pa.large_string()
    return pa.Array.from_buffers(large, len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])


def batches(it, rows: int = 4096, size: int = 2 << 20):
    """Cut record batches to pieces of at most `rows` rows and about `size` bytes, single rows kept whole."""
    for batch in it:
        if batch.num_rows == 0:
            continue
        # Bytes of the variable-length columns, row by row.
        ends = np.zeros(batch.num_rows, np.int64)
        for col in batch.columns:
            if pa.types.is_string(col.type) or pa.types.is_binary(col.type):
                ends += np.cumsum(np.asarray(pc.fill_null(pc.binary_length(col), 0), np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = min(at + rows, max(at + 1, int(np.searchsorted(ends, base + size, "right"))))
            yield batch.slice(at, to - at)
            at = to


# ---------------------------------------------------------------- words

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.arange(256, dtype=np.uint8)
#: Letters A to Z as a to z; every other byte is unchanged.
LOWER = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)
#: Bytes of words in the class [^\x20\x09-\x0D].
SPACED = ~_SPACE
#: Bytes of words in the class [^\x00-\x2F\x3A-\x60\x7B-\x7F] of a text in lower case.
ALNUM = ((_BYTE >= 0x30) & (_BYTE <= 0x39)) | ((_BYTE >= 0x61) & (_BYTE <= 0x7A)) | (_BYTE >= 0x80)


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes in the class, and n + 1 offsets of each text's words in them."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    is_in = inside[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = is_in[:-1]
    cuts = offsets[:-1][np.diff(offsets) > 0]  # a word ends with its text
    before[cuts] = False
    starts = np.flatnonzero(is_in & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = is_in[1:]
    after[cuts[1:] - 1] = False
    ends = np.flatnonzero(is_in & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


# ---------------------------------------------------------------- fingerprints

_M = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xE7037ED1A0B428DB)]
#: Words of more bytes are hashed one by one.
LONG_WORD = 64
_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit over the word."""
    x = x ^ (x >> np.uint64(32))
    x *= _M[0]
    x ^= x >> np.uint64(29)
    x *= _M[1]
    x ^= x >> np.uint64(32)
    return x


def pair(a: np.ndarray, b: np.ndarray, seed: int = 0) -> np.ndarray:
    """A fingerprint of two fingerprints in order.  Mixing between the steps leaves no algebra that structured texts could cancel."""
    x = a * _M[2 + seed] + b
    x ^= x >> np.uint64(32)
    x *= _M[seed]
    x ^= x >> np.uint64(29)
    return x


def eight(data: np.ndarray) -> np.ndarray:
    """Of each byte the 8 bytes from there on, as a number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded.data, 0, (1,))


def grams(codes: np.ndarray, k: int, span: int = 1) -> np.ndarray:
    """Fingerprints of all stretches of k symbols, by doubling; a code covers `span` symbols from its own on."""
    n, level, width = len(codes), codes, span
    if n < k:
        return np.zeros(0, np.uint64)
    while width * 2 <= k:
        level = pair(level[: n - 2 * width + 1], level[width : n - width + 1])
        width *= 2
    return mix(level[: n - k + 1]) if width == k else pair(level[: n - k + 1], level[k - width : n - width + 1])


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each word, eight bytes at a time."""
    size = ends - starts
    out = mix(size.astype(np.uint64) * _M[3])
    if len(size) == 0:
        return out
    lead = eight(data)
    short = np.flatnonzero(size <= LONG_WORD)
    at, left, h = starts[short], size[short], out[short]
    done = 0
    while len(at):
        h = pair(h, lead[at] & _KEEP[np.minimum(left, 8)])
        out[short] = h
        done += 8
        more = left > 8
        short, at, left, h = short[more], at[more] + 8, left[more] - 8, h[more]
    out = mix(out)
    raw = data.data
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]], 7)
    return out


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the stretches [start, start + length), one after another."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    out = np.arange(total, dtype=np.int64)
    return out + np.repeat(starts - (ends - lengths), lengths)


# ---------------------------------------------------------------- blocks of documents


def in_blocks(docs: DataFrame, id_col: str, text_col: str, extra: list[str], block_bytes: int) -> tuple[DataFrame, int]:
    """(block, doc, hash, text, x0, x1 ...) and the number of blocks, each of about block_bytes of text.

    A row's block comes from hashes of its id, its text and its partition, so neither rows that share an id or a text nor
    wholly equal rows gather in one block.  The table is staged in buckets of blocks: whoever groups it by block later
    needs no shuffle.  The extra columns come along under names that clash with nothing.
    """
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`").cast("string")
    chosen = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.xxhash64(text).alias("hash"), text.alias("text"), *[F.col(f"`{c}`").alias(f"x{i}") for i, c in enumerate(extra)])
    total = docs.select(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(64))).first()[0] or 0
    blocks = int(total // block_bytes + 1)
    buckets = min(max(int(total // (8 * block_bytes)) + 1, int(spark.conf.get("spark.sql.shuffle.partitions"))), 100_000)
    put = chosen.select(F.pmod(F.xxhash64("doc", "hash", F.spark_partition_id()), F.lit(blocks)).alias("block"), "*")
    return stage(put, "blocks", ("block", buckets)), blocks
