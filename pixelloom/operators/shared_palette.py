"""One palette for a whole collection of images, by bisection and k-means over a distributed histogram.

The histogram, a row per colour of the collection, stays a table.  A round takes two aggregates of it: the bounds of the boxes that are
new, and sums by box, axis and bin, 1,024 rows a box; the driver picks cuts from these, and a row finds its box by walking the
tree of cuts, a few numbers a box.  Boxes are cut level by level, ahead of need, and the greedy order (the box with most to gain first)
is then followed in the tree, so rounds grow with the depth of the tree, not with the number of colours.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.sources.images import scratch_folder

from . import tiles
from .kernels import Options, assign, default_options, palette_of
from .palette import EXACT_LIMIT, histogram

AXES = "rgba"


@dataclass
class Box:
    """A node of the tree: bounds on four axes, and its best cut with the boxes that it makes."""

    low: np.ndarray
    high: np.ndarray
    gain: float = 0.0
    axis: int = 0
    cut: int = 0
    left: int = -1
    right: int = -1


def _points() -> list[Column]:
    """Premultiplied means of a bucket, as the kernel has them."""
    return [F.col("s" + c) / F.col("cnt") / F.lit(255.0) if c != "a" else F.col("sa") / F.col("cnt") for c in AXES]


def _walk(boxes: list[Box], depth: int) -> Column:
    """The number of the box that a row lies in."""
    if depth == 0:
        return F.lit(0)
    of = lambda name, kind: F.lit([kind(getattr(b, name)) for b in boxes])
    low, wide = (F.lit([float(v[b.axis]) for b, v in zip(boxes, values)]) for values in ([b.low for b in boxes], [b.high - b.low for b in boxes]))
    axis, cut, left, right = of("axis", int), of("cut", int), of("left", int), of("right", int)
    point = F.array(*_points())

    def step(box: Column, _: Column) -> Column:
        i = box + 1
        goes = _bin(F.element_at(point, F.element_at(axis, i) + 1), F.element_at(low, i), F.element_at(wide, i)) <= F.element_at(cut, i)
        return F.when(F.element_at(left, i) < 0, box).when(goes, F.element_at(left, i)).otherwise(F.element_at(right, i))

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step)


def _bin(p: Column, low: Column, wide: Column) -> Column:
    return F.greatest(F.least(F.floor((p - low) * (F.lit(255.0) / F.when(wide > 0, wide).otherwise(1.0))), F.lit(255)), F.lit(0)).cast("int")


def _bounds(hist: DataFrame, box: Column, new: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Bounds of the boxes named, of which there are few."""
    p = hist.select(box.alias("box"), *[x.alias(c) for x, c in zip(_points(), AXES)]).filter(F.col("box").isin(new))
    rows = p.groupBy("box").agg(*[F.min(c).alias("l" + c) for c in AXES], *[F.max(c).alias("h" + c) for c in AXES]).collect()
    return {r.box: (np.array([r["l" + c] for c in AXES]), np.array([r["h" + c] for c in AXES])) for r in rows}


def _cuts(hist: DataFrame, box: Column, boxes: list[Box], new: list[int]) -> None:
    """Find the best cut of each of the boxes named: the sums of 256 bins on each axis reach the driver."""
    lows, wides = F.lit([[float(x) for x in b.low] for b in boxes]), F.lit([[float(x) for x in b.high - b.low] for b in boxes])
    at = lambda table, k: F.element_at(F.element_at(table, F.col("box") + 1), k + 1)
    sums = ["cnt", *["s" + c for c in AXES]]
    rows = hist.select(box.alias("box"), *[x.alias("p" + c) for x, c in zip(_points(), AXES)], *sums).filter(F.col("box").isin(new))
    bins = F.explode(F.array(*[F.struct(F.lit(k).alias("axis"), _bin(F.col("p" + c), at(lows, k), at(wides, k)).alias("bin")) for k, c in enumerate(AXES)]))
    table = rows.select("box", *sums, bins.alias("b")).groupBy("box", "b.axis", "b.bin").agg(*[F.sum(c).alias(c) for c in sums]).toArrow()
    of = {c: table.column(c).to_numpy() for c in ("box", "axis", "bin", *sums)}
    for number in new:
        b = boxes[number]
        for axis in range(4):
            mine = np.flatnonzero((of["box"] == number) & (of["axis"] == axis))
            mine = mine[np.argsort(of["bin"][mine])]
            w = of["cnt"][mine].astype(float)
            s = np.stack([of["s" + c][mine] / (255.0 if c != "a" else 1.0) for c in AXES], axis=1)
            wl, sl = np.cumsum(w)[:-1], np.cumsum(s, axis=0)[:-1]
            wr = w.sum() - wl
            if b.high[axis] <= b.low[axis] or not len(wl):
                continue
            apart = sl / wl[:, None] - (s.sum(axis=0) - sl) / wr[:, None]
            gain = wl * wr / w.sum() * (apart * apart).sum(axis=1)
            k = int(np.round(gain, 6).argmax())
            if gain[k] > 0 and (b.gain <= 0 or np.round(gain[k], 6) > np.round(b.gain, 6)):
                b.gain, b.axis, b.cut = float(gain[k]), axis, int(of["bin"][mine][k])


def _greedy(boxes: list[Box], most: int) -> tuple[list[int], bool]:
    """The leaves after cutting the box with most to gain, again and again, in the kernel's order; whether all cuts needed are known."""
    leaves = [0]
    while len(leaves) < most:
        pick = int(np.argmax([boxes[i].gain for i in leaves]))
        b = boxes[leaves[pick]]
        if b.gain <= 0:
            break
        if b.left < 0:
            return leaves, False
        leaves[pick : pick + 1] = [b.left]
        leaves.append(b.right)
    return leaves, True


def shared_palette(pixels: DataFrame, options: Options | None = None, limit: int = EXACT_LIMIT, side: int = tiles.SIDE) -> tuple[DataFrame, DataFrame]:
    """(idx, a, r, g, b, n) of one palette for all images together, and (key, bits, idx): the entry of each colour key.

    Up to `limit` colours the histogram is exact (bits 0), beyond that it has buckets of 5 bits.  n: pixels of an entry, weighted if
    importance is on.  Results are those of the kernel for one image; entries are in the order of boxes (if all colours
    fit, of keys), translucent ones first.
    An empty table gives two empty ones.
    """
    options = options or default_options()
    spark = pixels.sparkSession
    weighted = tiles.importance(pixels, options.importance, side=side) if options.importance > 0 else pixels
    weight = F.col("weight") if options.importance > 0 else None
    folder = scratch_folder(spark)
    one = weighted.withColumn("image_id", F.lit(0))
    kept = lambda df, name: (df.write.parquet(f"{folder}/{name}"), spark.read.parquet(f"{folder}/{name}"))[1]
    hist, bits = kept(histogram(one, 0, weight).drop("first_pos", "image_id"), "exact"), 0
    colors = hist.count()
    if colors > limit:
        bits = 5
        hist = kept(histogram(one, 5, weight).drop("first_pos", "image_id"), "coarse")
        colors = hist.count()
    if not colors:
        return spark.createDataFrame([], "idx int, a int, r int, g int, b int, n long"), spark.createDataFrame([], "key long, bits int, idx int")
    clear = hist.filter("sa = 0") if options.max_colors > 1 else hist.limit(0)
    first = int(not clear.isEmpty())
    rest = hist.filter("sa > 0") if first else hist
    most = min(options.max_colors, colors) - first
    if colors <= options.max_colors:
        # Each colour is an entry, in the order of keys: 256 rows at most.
        order = {k: i for i, k in enumerate(sorted(r.key for r in hist.select("key").collect()))}
        label, n_entries = F.element_at(F.create_map(*[F.lit(x) for pair in order.items() for x in pair]), F.col("key")), colors
    else:
        boxes, depth = [Box(*_bounds(rest, F.lit(0), [0])[0])], 0
        _cuts(rest, F.lit(0), boxes, [0])
        while True:
            leaves, known = _greedy(boxes, most)
            if known:
                break
            # One level more: all boxes that can gain and that the greedy order may still reach.
            frontier = sorted((i for i, b in enumerate(boxes) if b.left < 0 and b.gain > 0), key=lambda i: -boxes[i].gain)[:most]
            new = []
            for i in frontier:
                boxes[i].left, boxes[i].right = len(boxes), len(boxes) + 1
                new += [len(boxes), len(boxes) + 1]
                boxes += [Box(boxes[i].low, boxes[i].high), Box(boxes[i].low, boxes[i].high)]
            depth += 1
            walk = _walk(boxes, depth)
            for i, (low, high) in _bounds(rest, walk, new).items():
                boxes[i].low, boxes[i].high = low, high
            _cuts(rest, walk, boxes, new)
        # Boxes below the leaves are those of the leaf they belong to.
        place = {leaf: i + first for i, leaf in enumerate(leaves)}
        for i in reversed(range(len(boxes))):
            if i in place:
                boxes[i].left = boxes[i].right = -1
        final = F.element_at(F.lit([place.get(i, -1) for i in range(len(boxes))]), _walk(boxes, depth) + 1)
        label = F.when(F.col("sa") == 0, F.lit(0)).otherwise(final) if first else final
        n_entries = len(leaves) + first
    labelled = kept(hist.select("key", "cnt", *["s" + c for c in AXES], label.cast("int").alias("idx")), "labels0")

    def totals(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Pixels and channel sums of each entry: 256 rows at most."""
        cnt, sums = np.zeros(n_entries), np.zeros((n_entries, 4))
        for r in df.groupBy("idx").agg(F.sum("cnt").alias("cnt"), *[F.sum("s" + c).alias("s" + c) for c in AXES]).collect():
            cnt[r.idx], sums[r.idx] = r.cnt, [r["s" + c] for c in AXES]
        return cnt, sums

    if colors > options.max_colors:
        centroids = np.zeros((n_entries, 4))
        for turn in range(options.kmeans + (options.kmeans > 0)):
            cnt, sums = totals(labelled)
            some = cnt > 0
            centroids[some] = sums[some] / cnt[some, None] / np.array([255.0, 255.0, 255.0, 1.0])
            shared = spark.sparkContext.broadcast(centroids.copy())

            def move(it, shared=shared):
                for batch in it:
                    cnt, *sums = (batch.column(c).to_numpy().astype(float) for c in ("cnt", *["s" + c for c in AXES]))
                    p = np.stack(sums, axis=1) / cnt[:, None]
                    p[:, :3] /= 255
                    old = batch.column("idx").to_numpy().astype(np.int64)
                    yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(assign(p, shared.value, first, old), pa.int32()), batch.columns[-1]], [*batch.schema.names[:-1], "idx", "old"])

            moved = kept(labelled.mapInArrow(move, labelled.schema.simpleString()[7:-1].replace(":", " ") + ", old int"), f"labels{turn + 1}")
            labelled, same = moved.drop("old"), moved.filter("idx <> old").isEmpty()
            if same:
                break
    cnt, sums = totals(labelled)
    pal = palette_of(cnt, sums, np.arange(n_entries), n_entries)
    used = np.flatnonzero(cnt)
    order = np.concatenate([used[pal[used, 0] != 255], used[pal[used, 0] == 255]])
    to = np.full(n_entries, -1)
    to[order] = np.arange(len(order))
    entries = spark.createDataFrame([(k, *map(int, pal[i]), int(cnt[i])) for k, i in enumerate(order)], "idx int, a int, r int, g int, b int, n long")
    keys = labelled.select("key", F.lit(bits).alias("bits"), F.element_at(F.lit(to.tolist()), F.col("idx") + 1).cast("int").alias("idx"))
    return entries, keys
