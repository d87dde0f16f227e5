"""Embedding near-dedup by spherical k-means cells.

Cells come from spherical k-means on a bounded sample; every vector belongs to the cell of its nearest centre.  A pair
above the threshold may lie in two cells.  The segment between its vectors then crosses the plane that separates the two
centres, so one of the two lies within half the largest possible distance, sqrt(2 - 2t) / 2, of that plane: each vector
also visits every cell whose plane is that near.  No pair above the threshold is lost, and each is counted in one cell.

Within a cell, vectors at home meet all others: sketches in single precision rule out most pairs, double precision
decides.  Equal vectors are one vector with a weight.  Cells larger than a block are dealt as pairs of blocks, one of them
of vectors at home, so a cell with a third of all rows is many tasks.  Links leave a task as counts by vector and as
stars, never as all pairs.  Copies of vectors for the cells that they visit are made in waves, so disk stays within a few
times the input however many cells a vector visits.
"""

from __future__ import annotations

import functools
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import freeing, gather, mix, release, stage, strings, text_buffer
from .components import components, union


#: A vector is hot with one in so many of all rows.
HOT = 1000
#: Bytes that leave for cells at once, at least; beyond that, twice the distinct vectors.
WAVE = 128 << 20


def _key() -> tuple[Column, Column]:
    """128 bits that only equal vectors have in common."""
    return F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(5), "v").alias("h2")


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    # Scaled first, so that neither very large nor very small vectors overflow when squared.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """k unit centres of unit vectors; a centre that loses all vectors stays where it was."""
    r = np.random.default_rng(seed)
    centres = x[r.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([np.argmax(x[lo : lo + 4096] @ centres.T, axis=1) for lo in range(0, len(x), 4096)])
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(norm > 1e-12, total / np.where(norm > 1e-12, norm, 1), centres)
    return centres


def cells_of(x: np.ndarray, centres: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each unit vector, and a table of the cells that it visits (home included)."""
    cosine = x @ centres.T
    home = np.argmax(cosine, axis=1)
    gap = np.sqrt(np.maximum(2 - 2 * (centres @ centres.T), 0))[home]
    margin = cosine[np.arange(len(x)), home][:, None] - cosine
    visits = margin <= reach * gap + 1e-7  # more than rounding can take away
    visits[np.arange(len(x)), home] = True
    return home, visits


def sketches(x: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Coordinates in some directions and the length of the rest: products of sketches are at least those of the vectors."""
    y = x @ basis
    rest = np.sqrt(np.maximum(1 - (y * y).sum(axis=1, keepdims=True), 0))
    return np.hstack([y, rest]).astype(np.float32)


def compare(x: np.ndarray, basis: np.ndarray, home: np.ndarray, visits: np.ndarray, weight: np.ndarray, cell: int, left: np.ndarray, same: bool, threshold: float, block: tuple[int, int] = (256, 2048)) -> tuple[np.ndarray, np.ndarray]:
    """(links of each vector found here, labels of the sets they join).

    Vectors of the left block, all at home in the cell, meet those of the right one; if both are the same block, all of
    its vectors.  visits: the cells of the left vectors, a row each.  A pair with homes a and b is found in a if the other
    visits a, in b likewise, and counts in the smaller of those.

    Sketches in single precision rule out nearly all pairs; the others are compared in double precision.
    """
    links = np.zeros(len(x), np.int64)
    label = np.arange(len(x))
    rows = np.flatnonzero(left)
    others = np.arange(len(x)) if same else np.flatnonzero(~left)
    short = sketches(x, basis)
    # More than rounding to single precision can take away.
    least = np.float32(threshold - 1e-5 - 1e-7 * short.shape[1])
    waiting, held = [], 0
    for lo in range(0, len(rows), block[0]):
        i = rows[lo : lo + block[0]]
        for lo2 in range(0, len(others), block[1]):
            j = others[lo2 : lo2 + block[1]]
            hit = np.flatnonzero((short[i] @ short[j].T >= least).ravel())
            if len(hit) == 0:
                continue
            sure = np.zeros(len(hit), bool)
            if len(hit) > 4096:  # too many to look at one by one
                product = (x[i] @ x[j].T).ravel()
                hit = np.flatnonzero(product >= threshold - 1e-9)
                sure = product[hit] >= threshold + 1e-9
            p, q = hit // len(j), hit % len(j)
            a, b = i[p], j[q]
            keep = np.where(home[b] == cell, (a < b) | (not same), (home[b] > cell) | ~visits[lo + p, home[b]])
            a, b, p, q, sure = a[keep], b[keep], p[keep], q[keep], sure[keep]
            near = np.flatnonzero(~sure)
            for at in range(0, len(near), 16384):
                k = near[at : at + 16384]
                sure[k] = (x[a[k]] * x[b[k]]).sum(axis=1) >= threshold
            a, b, p, q = a[sure], b[sure], p[sure], q[sure]
            if len(a) == 0:
                continue
            # Sums of weights are numbers of rows, which doubles hold exactly.
            links[i] += np.bincount(p, weight[b], len(i)).astype(np.int64)
            links[j] += np.bincount(q, weight[a], len(j)).astype(np.int64)
            waiting.append((a, b))
            held += len(a)
            if held > 1 << 18:
                union(label, *map(np.concatenate, zip(*waiting)))
                waiting, held = [], 0
    if waiting:
        union(label, *map(np.concatenate, zip(*waiting)))
    return links, label


def waves(homes: np.ndarray, visitors: np.ndarray, block_rows: int, row_bytes: int, home_bytes: int, most: int) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(blocks of vectors at home, blocks of visitors, waves), the first two by cell.

    Task (cell, i, r) compares block i of those at home with block r: one of those at home from i on, or one of visitors,
    whose numbers follow.  A cell that fits one block has no blocks of visitors, all of it is block 0.  A wave is a range of
    i for each cell, such that its tasks get about `most` bytes; a single i may take more, twice the cell at most.
    """
    own = np.where(homes > 0, -(-homes // block_rows), 0)
    other = np.where((homes > 0) & (homes + visitors > block_rows), -(-visitors // block_rows), 0)
    out, lo, hi, full = [], np.zeros(len(own), np.int64), np.zeros(len(own), np.int64), 0
    for cell in np.flatnonzero(homes):
        for i in range(own[cell]):
            each = homes[cell] / own[cell]
            size = each * (own[cell] + other[cell] - i) * home_bytes + (each * (own[cell] - 1 - i) + visitors[cell]) * row_bytes
            if full and full + size > most:
                out.append((lo, hi))
                lo, hi, full = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64), 0
            if lo[cell] == hi[cell]:
                lo[cell] = i
            hi[cell] = i + 1
            full += size
    return own, other, [*out, (lo, hi)] if full else out


def embedding_groups(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", cell_rows: int = 1000, least_cells: int = 64, most_cells: int = 2048, sample: int = 20_000, block_rows: int = 20_000) -> DataFrame:
    """(id, n_links, component_id, kept): one row per row of vectors.

    n_links: other vectors with a cosine of at least threshold; component_id: the least id that links reach; kept: whether
    it is the row's own.  Vectors that are null, zero, or hold null or non-finite components link with nothing.  Vectors
    of different lengths never link.  Null ids: such rows are compared like others and get the least id of their group,
    null if there is none, and are not kept if there is one.  Other ids are cast to long.  Repeated rows are rows of their own; all rows that carry a
    component's least id are kept.

    cell_rows: vectors per cell aimed at, once there are least_cells cells (with fewer, nearly every vector visits every
    cell, and visits would grow faster than the input); most_cells: centres that are broadcast at most; sample: vectors that k-means
    sees at most; block_rows: vectors of a cell in one task.
    """
    spark = vectors.sparkSession
    kind = vectors.select(F.col(f"`{vector_col}`")).schema[0].dataType
    element = "float" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "double"  # single precision stays: half the bytes
    v = F.col(f"`{vector_col}`").cast(f"array<{element}>")
    fine = F.coalesce((F.size(v) > 0) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0), F.lit(False))
    # -0.0 and 0.0 are one value: adding 0.0 makes them so.
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.when(fine, F.transform(v, lambda e: e + F.lit(0.0).cast(element))).alias("v"))
    with freeing(spark):
        member, every = _members(rows, element, threshold, cell_rows, least_cells, most_cells, sample, block_rows)
    # Vectors with a thousandth of all rows, a thousand of them at most, are broadcast; so no join task gets one whole.
    hot = F.broadcast(member.filter(F.col("n") * HOT >= every))
    whole, same = rows.filter("v is not null").select("id", *_key()), ["h1", "h2"]
    linked = whole.join(hot, same).select("id", "n_links", "component_id").union(whole.join(hot, same, "left_anti").join(member, same).select("id", "n_links", "component_id"))
    alone = rows.filter("v is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.union(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _members(rows: DataFrame, element: str, threshold: float, cell_rows: int, least_cells: int, most_cells: int, sample: int, block_rows: int) -> tuple[DataFrame, int]:
    """Staged (h1, h2, n, n_links, component_id), a row per distinct vector, and the number of rows that have a vector."""
    spark = rows.sparkSession
    distinct = rows.filter("v is not null").groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    # From here on 128 bits of hashes stand for a vector: only this table and the next are as wide as the input.
    distinct = stage(distinct.select(F.monotonically_increasing_id().alias("node"), *_key(), "id", "n", "v"), "vectors")
    every = distinct.agg(F.sum("n")).first()[0] or 0
    sizes = [tuple(r) for r in distinct.groupBy(F.size("v").alias("s")).count().orderBy("s").toLocalIterator()]
    models = [_model(distinct.filter(F.size("v") == size), count, size, threshold, cell_rows, least_cells, most_cells, sample) for size, count in sizes]
    placed = [_place(distinct.filter(F.size("v") == size), model) for (size, _), model in zip(sizes, models)]
    release(distinct)
    found = spark.createDataFrame([], "node long, root long, links long")
    for (size, count), model, homes in zip(sizes, models, placed):
        width = size * (4 if element == "float" else 8)
        for part in _links(homes, model, np.dtype(f"f{width // size}"), width, max(WAVE, 2 * width * count), block_rows):
            found = found.union(part)
    roots = components(found.filter("root <> node").select(F.col("node").alias("u"), F.col("root").alias("v")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    keys = [homes.select("node", "h1", "h2", "id", "n") for homes in placed] or [spark.createDataFrame([], "node long, h1 long, h2 long, id long, n long")]
    nodes = functools.reduce(DataFrame.union, keys).join(roots, "node", "left").join(counts, "node", "left").select("h1", "h2", "id", "n", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    least = nodes.groupBy("root").agg(F.min("id").alias("component_id"))
    member = stage(nodes.join(least, "root").select("h1", "h2", "n", "n_links", "component_id"), "members")
    for homes in placed:
        release(homes)
    return member, every


class Model(NamedTuple):
    """Centres of cells, how near a plane a vector visits the other side, directions of sketches, and the threshold."""

    centres: np.ndarray
    reach: float
    basis: np.ndarray
    threshold: float


def _model(distinct: DataFrame, count: int, size: int, threshold: float, cell_rows: int, least_cells: int, most_cells: int, sample: int) -> Model:
    share = min(1.0, sample / max(count, 1))
    seen = distinct.filter(F.pmod(F.xxhash64("node", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30))).select("v").toArrow()
    k = int(max(1, min(max(least_cells, -(-count // cell_rows)), most_cells, len(seen) // 4)))
    x = _unit(_matrix(seen.column("v"))) if len(seen) else np.eye(1, size)
    directions = np.linalg.eigh(x.T @ x)[1][:, ::-1]  # that of the largest share first
    return Model(spherical_kmeans(x, k), np.sqrt(max(2 - 2 * threshold, 0)) / 2, directions[:, : max(24, -(-3 * size // 8))], threshold)


def _place(distinct: DataFrame, model: Model) -> DataFrame:
    """The distinct vectors of one length with their home cell and, as bits, the cells that they visit."""
    shared = distinct.sparkSession.sparkContext.broadcast(model)

    def place(it):
        for batch in it:
            for lo in range(0, batch.num_rows, 1024):
                b = batch.slice(lo, 1024)
                home, visits = cells_of(_unit(_matrix(b.column(5))), shared.value.centres, shared.value.reach)
                raw = np.asarray(b.column(5).flatten()).view(np.uint8).reshape(b.num_rows, -1)
                bits = np.packbits(visits, axis=1)
                binary = [strings(m.ravel(), np.arange(len(m) + 1) * m.shape[1], pa.binary()) for m in (raw, bits)]
                yield pa.RecordBatch.from_arrays([*b.columns[:5], binary[0], pa.array(home, pa.int32()), binary[1]], names)

    # As bytes, vectors pass between Spark and Python in one piece each.
    names = ["node", "h1", "h2", "id", "n", "v", "home", "also"]
    placed = distinct.select(*names[:6]).mapInArrow(place, "node long, h1 long, h2 long, id long, n long, v binary, home int, also binary")
    return stage(placed, "homes")


def _links(homes: DataFrame, model: Model, element: np.dtype, width: int, most: int, block_rows: int) -> list[DataFrame]:
    """Staged tables (node, root, links) of the vectors that have links.

    Vectors leave for the cells that they visit in waves of about `most` bytes, each gone when its links are staged: as
    every vector visits many cells, all at once would be many times the input.
    """
    shared = homes.sparkSession.sparkContext.broadcast(model)
    k = len(model.centres)

    def tally(it):
        own, other = np.zeros(k, np.int64), np.zeros(k, np.int64)
        for batch in it:
            for lo in range(0, batch.num_rows, 4096):
                b = batch.slice(lo, 4096)
                home = np.bincount(b.column(0).to_numpy(), minlength=k)
                own += home
                other += _bits(b.column(1), len(home)).sum(axis=0, dtype=np.int64) - home
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(own), pa.array(other)], ["cell", "own", "other"])

    sums = homes.select("home", "also").mapInArrow(tally, "cell long, own long, other long").groupBy("cell").agg(F.sum("own"), F.sum("other")).collect()  # a row per cell: most_cells at most
    n_own, n_other = np.zeros((2, k), np.int64)
    for cell, a, b in sums:
        n_own[cell], n_other[cell] = a, b
    own, other, plan = waves(n_own, n_other, block_rows, width + 80, width + 80 + -(-k // 8), most)

    def meet(table: pa.Table) -> pa.Table:
        x = _unit(text_buffer(table.column("v"))[0].view(element).reshape(table.num_rows, -1).astype(np.float64))
        node, left = table.column("node").to_numpy(), table.column("left").to_numpy()
        cell, i, r = (table.column(c)[0].as_py() for c in ("cell", "i", "r"))
        # The cells that each left vector visits come with it: computed anew they might differ by a rounding.
        links, label = compare(x, shared.value.basis, table.column("home").to_numpy(), _bits(table.column("also"), k), table.column("n").to_numpy(), cell, left, i == r, shared.value.threshold)
        some = np.flatnonzero(links)
        return pa.table({"node": node[some], "root": node[label[some]], "links": links[some]})

    def wave(lo, hi):
        some = np.flatnonzero(hi)
        first, last = some[0] // 8, some[-1] // 8 + 1
        wanted = (hi > 0)[8 * first : 8 * last]

        def deal(it):
            for batch in it:
                for at in range(0, batch.num_rows, 1024):
                    b = batch.slice(at, 1024)
                    node, home = (b.column(c).to_numpy() for c in (0, 2))
                    bits = text_buffer(b.column(4))[0].reshape(len(node), -1)
                    e, cell = np.nonzero(np.unpackbits(np.ascontiguousarray(bits[:, first:last]), axis=1)[:, : len(wanted)] & wanted)
                    cell += 8 * first
                    own_row = home[e] == cell
                    spread = (mix(node.astype(np.uint64)) >> np.uint64(1)).astype(np.int64)[e]
                    side = np.where(own_row, spread % own[cell], own[cell] + spread % np.maximum(other[cell], 1))
                    side[~own_row & (other[cell] == 0)] = 0
                    # As the block i of a task: one row for each r.  As its block r: one row for each i.
                    as_left = np.where((side >= lo[cell]) & (side < hi[cell]), own[cell] + other[cell] - side, 0)
                    as_right = np.maximum(np.minimum(hi[cell], side) - lo[cell], 0)
                    i = np.concatenate([np.repeat(side, as_left), gather(lo[cell], as_right)])
                    r = np.concatenate([gather(side, as_left), np.repeat(side, as_right)])
                    k_left = np.repeat(np.arange(len(e)), as_left)
                    entry = np.concatenate([k_left, np.repeat(np.arange(len(e)), as_right)])
                    left = np.arange(len(entry)) < len(k_left)
                    left &= own_row[entry]
                    for p in range(0, len(entry), 8192):
                        some, is_left = entry[p : p + 8192], left[p : p + 8192]
                        rows = pa.array(e[some])
                        # Only left vectors need the cells that they visit.
                        ends = np.concatenate([[0], np.cumsum(is_left * bits.shape[1])])
                        also = strings(bits[e[some[is_left]]].ravel(), ends, pa.binary())
                        columns = [pa.array(c, pa.int32()) for c in (cell[some], i[p : p + 8192], r[p : p + 8192], home[e[some]])]
                        yield pa.RecordBatch.from_arrays([*columns, pa.array(is_left), also, b.column(0).take(rows), b.column(1).take(rows), b.column(3).take(rows)], ["cell", "i", "r", "home", "left", "also", "node", "n", "v"])

        dealt = homes.select("node", "n", "home", "v", "also").mapInArrow(deal, "cell int, i int, r int, home int, left boolean, also binary, node long, n long, v binary")
        return stage(dealt.groupBy("cell", "i", "r").applyInArrow(meet, "node long, root long, links long"), "links")

    parts = []
    for lo, hi in plan:
        parts.append(wave(lo, hi))
        if len(parts) == 16:  # or plans would grow with the number of waves
            merged = stage(functools.reduce(DataFrame.union, parts), "links")
            for part in parts:
                release(part)
            parts = [merged]
    return parts


def _bits(column: pa.Array | pa.ChunkedArray, k: int) -> np.ndarray:
    """Tables of k booleans from packed bits; empty values have no row."""
    return np.unpackbits(text_buffer(column)[0].reshape(-1, -(-k // 8)), axis=1)[:, :k].astype(bool)
