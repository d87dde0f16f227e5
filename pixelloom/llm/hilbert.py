"""Sharding along a Hilbert curve, with DataFrame functions only.

Documents are described by several quantised dimensions of metadata; neighbours on the curve are neighbours in all of
them, so a shard, a run of the curve, spans a small box of each dimension, and a reader with a predicate on any of them
skips most shards.  Runs are cut by bytes.

Equal texts are one group and take the metadata of their least member, so a group has one place on the curve and stays
whole, unless it alone is larger than a shard.  Order is made without one big sort: cell of the curve, then unit, then
salt.  A text with a thousandth of all rows, or more bytes than a shard's share, is a unit of its own, salted by ids (or by rows,
if most have none or all ids lie in a narrow range), with more salts the more rows it has; only if its bytes exceed a shard's share do cuts follow the salts.
All others are in units by their checksum, salted by what is left of it, so that no cut splits a group.  Only totals by
cell, of which there are 8^dims at most, pass through a single window; rows are numbered within (cell, unit, salt), so
no task gets a hot source, text or cell whole.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

BITS = 3
#: Units of a cell (at least; eight for each shard), salts of a unit (at least), rows to a salt of a hot text, share of rows that makes one hot.
BUCKETS, SALTS, SALT_ROWS, HOT = 64, 32, 100_000, 1000


def curve_place(x: list[int], bits: int) -> int:
    """Place on the Hilbert curve of the cell with these coordinates, each below 2^bits, by Skilling's transform."""
    x, n = list(x), len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(n):
            if x[i] >> b & 1:
                x[0] ^= low
            else:
                t = (x[0] ^ x[i]) & low
                x[0] ^= t
                x[i] ^= t
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = 0
    for b in range(bits - 1, 0, -1):
        if x[n - 1] >> b & 1:
            t ^= (1 << b) - 1
    place = 0
    for b in range(bits - 1, -1, -1):
        for c in x:
            place = place << 1 | ((c ^ t) >> b & 1)
    return place


def hilbert_index(dims: list[Column], bits: int = BITS) -> Column:
    """Place on the Hilbert curve of a cell whose coordinates are integers below 2^bits.

    The curve over all cells (2^(bits * dims), 32,768 at most) is one constant array in the plan; a row costs one look-up.
    """
    n = len(dims)
    if bits * n > 15:
        raise ValueError("bits times dimensions must be 15 or less")
    cells = itertools.product(range(1 << bits), repeat=n)
    curve = F.lit([curve_place(list(x), bits) for x in cells])
    number = F.lit(0)
    for c in dims:
        number = number * (1 << bits) + c
    return F.element_at(curve, (number + 1).cast("int"))


def hilbert_shards(docs: DataFrame, shards: int = 8, meta: tuple[str, ...] = ("lang", "source"), id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard, cell): law `bytes`, one row per row of docs.

    size: UTF-8 bytes of the text (null: none) plus 1.  shard: the run, of `shards`, in which the middle of the row's
    unit falls, counting bytes along the curve; a unit of more than a shard's share is cut by its salts instead, which
    splits equal texts only if they alone have more bytes than a shard's share.  slot: the row's number in its shard, from 0 and gapless.  grown_shard: null under this
    law.  Null metadata and null ids are values like others, ids are cast to long; repeated rows get a slot each; an empty table gives none.
    """
    if not 1 <= len(meta) + 1 <= 7:
        raise ValueError("one to six metadata columns")
    text = F.col(f"`{text_col}`").cast("string")
    narrow = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("hash"),
        *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")).alias(f"m{i}") for i, c in enumerate(meta)],
    )
    # One place for all equal texts: text hash, checksum and size stand for the text.
    narrow = stage(narrow.withColumn("row", F.monotonically_increasing_id()), "narrow")
    all_rows, all_bytes = narrow.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    group = ["hash", "crc", "size"]
    least = narrow.groupBy(*group).agg(F.min(F.struct(*[f"m{i}" for i in range(len(meta))])).alias("m"), F.count("*").alias("n"), F.least(F.count("doc"), F.try_add(F.try_subtract(F.max("doc"), F.min("doc")), F.lit(1))).alias("ids"))
    levels = 1 << bits
    # Sizes by powers of 4, from 16 on; compared as integers, as logarithms round.
    scale = sum(((F.col("size") >= 4 ** (j + 1)).cast("int") for j in range(1, levels)), F.lit(0))
    cell = hilbert_index([*[F.pmod(F.crc32(F.col(f"m.m{i}").cast("binary")), levels).cast("int") for i in range(len(meta))], scale], bits)
    placed = least.select(*group, cell.alias("cell"), "n", "ids")
    # Texts with a thousandth of all rows or more, or with more than a shard's bytes, are a thousand and `shards` at most, so they
    # are broadcast, and no join task gets one whole.
    hot = placed.filter((F.col("n") * HOT >= all_rows) | (F.col("n") * F.col("size") * shards > all_bytes))
    plain = narrow.select("doc", "row", *group)
    buckets = max(BUCKETS, 8 * shards)
    by_id = F.crc32(F.coalesce(F.col("doc").cast("string"), F.lit("")).cast("binary"))
    salts = F.greatest(F.lit(SALTS), F.ceil(F.col("n") / SALT_ROWS))
    # Rows without ids, or with a few over and over, are told apart by their numbers.
    salt = F.pmod(F.when(F.coalesce(F.col("ids") * 2 <= F.col("n"), F.lit(True)), F.col("row")).otherwise(by_id), salts)
    alone = plain.join(F.broadcast(hot), group).select("doc", "size", "crc", "cell", (F.col("crc") + buckets).alias("unit"), salt.alias("salt"))
    others = plain.drop("row").join(F.broadcast(hot), group, "left_anti").join(placed, group)
    others = others.select("doc", "size", "crc", "cell", F.pmod(F.col("crc"), F.lit(buckets)).cast("long").alias("unit"), F.pmod(F.floor(F.col("crc") / buckets), F.lit(SALTS)).cast("long").alias("salt"))
    rows = alone.union(others)
    # The totals and the numbering both start from here.
    rows = stage(rows, "placed")
    # Totals: cells (bounded by 8^dims) in a row, units and salts within their cell.
    parts = rows.groupBy("cell", "unit", "salt").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    cells = parts.groupBy("cell").agg(F.sum("b").alias("b"))
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("cell", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("base"), F.sum("b").over(Window.partitionBy(F.lit(0))).alias("total"))
    in_cell = Window.partitionBy("cell").orderBy("unit", "salt").rowsBetween(Window.unboundedPreceding, -1)
    unit = Window.partitionBy("cell", "unit")
    parts = parts.join(cells, "cell").withColumn("at", F.col("base") + F.coalesce(F.sum("b").over(in_cell), F.lit(0)))
    parts = parts.withColumn("unit_b", F.sum("b").over(unit)).withColumn("unit_at", F.min("at").over(unit))
    whole = F.col("unit_b") * shards <= F.col("total")
    middle = F.when(whole, 2 * F.col("unit_at") + F.col("unit_b")).otherwise(2 * F.col("at") + F.col("b"))
    parts = parts.withColumn("shard", F.least(F.floor(middle * shards / (2 * F.col("total"))), F.lit(shards - 1)).cast("int"))
    # Slots: first rows of a (cell, shard), then of the parts in it, then of the row in its part.
    heads = parts.groupBy("shard", "cell").agg(F.sum("n").alias("n"))
    heads = heads.select("shard", "cell", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("head"))
    in_shard = Window.partitionBy("cell", "shard").orderBy("unit", "salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("cell", "unit", "salt", "shard", F.coalesce(F.sum("n").over(in_shard), F.lit(0)).alias("tail")).join(heads, ["shard", "cell"])
    number = F.row_number().over(Window.partitionBy("cell", "unit", "salt").orderBy("doc", "crc", "size")) - 1
    out = rows.withColumn("number", number).join(parts, ["cell", "unit", "salt"])
    return out.select(F.col("doc").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("head") + F.col("tail") + F.col("number")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "cell")


def write_shards(docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", **options) -> None:
    """Write docs as Parquet, one folder per shard, sorted by cell within files so that row groups can be skipped too.

    Rows that share both id and text go to the first of their shards together, since nothing tells one from another.
    """
    placed = hilbert_shards(docs, shards, id_col=id_col, text_col=text_col, **options).select(F.col(id_col).alias("placed_id"), F.col("size").alias("placed_size"), F.col("text_crc32").alias("placed_crc"), F.struct("shard", "cell").alias("place"))
    placed = placed.groupBy("placed_id", "placed_size", "placed_crc").agg(F.min("place").alias("place")).select("placed_id", "placed_size", "placed_crc", "place.*")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    same = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("placed_id")) & (F.crc32(text) == F.col("placed_crc"))
    same &= F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)) + 1 == F.col("placed_size")
    out = docs.join(placed, same).drop("placed_id", "placed_size", "placed_crc")
    out.repartition("shard", F.pmod(F.col("cell"), F.lit(16))).sortWithinPartitions("shard", "cell").write.partitionBy("shard").parquet(path)


def oracle(shards: int = 8, bits: int = BITS) -> str:
    """The same in DuckDB's SQL, over documents; crc32 is a fold over bytes with the usual table."""
    table = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    levels, buckets = 1 << bits, max(BUCKETS, 8 * shards)
    curve = ", ".join(str(curve_place(list(x), bits)) for x in itertools.product(range(levels), repeat=3))

    def crc(value: str) -> str:
        code = f"list_transform(range(octet_length(encode({value}))), lambda i: ('0x' || substr(hex(encode({value})), 2 * i + 1, 2))::BIGINT)"
        return f"xor(coalesce(list_reduce({code}, lambda c, x: xor(c >> 8, list_extract(t, (xor(c, x) & 255) + 1)), 4294967295::BIGINT), 4294967295), 4294967295)"

    scale = " + ".join(f"(size >= {4 ** (j + 1)})::INTEGER" for j in range(1, levels))
    hot = f"(g.n * {HOT} >= (SELECT count(*) FROM d) OR g.n * d.size * {shards} > (SELECT sum(size) FROM d))"
    return f"""
WITH t AS (SELECT [{", ".join(map(str, table))}]::BIGINT[] AS t),
d AS (SELECT doc_id, coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) + 1 AS size, {crc("coalesce(text, '')")} AS crc, {crc("coalesce(doc_id::VARCHAR, '')")} AS id_crc, struct_pack(a := coalesce(lang, chr(0)), b := coalesce(source, chr(0))) AS m FROM documents, t),
g AS (SELECT text, min(m) AS m, count(*) AS n FROM d GROUP BY 1),
r AS (SELECT d.doc_id, d.size, d.crc, CASE WHEN {hot} THEN d.crc + {buckets} ELSE d.crc % {buckets} END AS unit,
  CASE WHEN {hot} THEN d.id_crc % greatest({SALTS}, ceil(g.n / {SALT_ROWS})::BIGINT) ELSE d.crc // {buckets} % {SALTS} END AS salt, list_extract([{curve}], ({crc("g.m.a")} % {levels} * {levels} + {crc("g.m.b")} % {levels}) * {levels} + {scale} + 1) AS cell FROM d JOIN g ON g.text = d.text, t),
p AS (SELECT cell, unit, salt, sum(size)::BIGINT AS b FROM r GROUP BY 1, 2, 3),
q AS (SELECT *, sum(b) OVER (ORDER BY cell, unit, salt)::BIGINT - b AS pos, sum(b) OVER ()::BIGINT AS total FROM p),
u AS (SELECT *, sum(b) OVER (PARTITION BY cell, unit)::BIGINT AS unit_b, min(pos) OVER (PARTITION BY cell, unit) AS unit_pos FROM q),
s AS (SELECT cell, unit, salt, least(CASE WHEN unit_b * {shards} <= total THEN 2 * unit_pos + unit_b ELSE 2 * pos + b END * {shards} // (2 * total), {shards - 1})::INTEGER AS shard FROM u)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY cell, unit, salt, doc_id, crc, size) - 1 AS slot, NULL::INTEGER AS grown_shard, cell::INTEGER AS cell
FROM r JOIN s USING (cell, unit, salt)
"""
