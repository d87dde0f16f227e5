"""Near copies: SimHash links first, then every other pair of enough similarity, all held against whole sets of shingles.

Two texts are near copies if the sets of their five-word shingles have a Jaccard similarity of 0.8 or more.  SimHash
fingerprints of the sets, linked by op7's grid, find the closest of them; but texts of that similarity differ in ten bits
of 64 on average, which no grid over popcounts can reach, so a prefix filter that loses no pair completes them:

All shingles stand in one order, the rare ones first.  Two sets of similarity t share at least t of the members of each,
so the first that they share is among the first a - ceil(t a) + 1 of a set of a members, of both sets.  Blocks of
documents ask an index, dealt by shingle, which members of their prefixes another block has too; most have none.  Only
those that are shared become rows, pairs that meet in one are verified on the whole sets.  The order comes from a table
of counts of fixed size: where its counts are coarse, more pairs are verified, but any order finds the same pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, SPACED, batches, gather, in_blocks, mix, pair, release, settle, stage, text_buffer, word_codes, word_spans
from .components import components
from .repeats import in_order, key_bounds, pack, unpack
from .simhash import majority, near_fingerprints

#: Similarity as a fraction, so that all tests are made in integers.
ENOUGH = (4, 5)
#: The table of counts has 2 to this power entries.
BITS = 20
#: Members of a list up to which all pairs of it are looked at.
LONG = 32
MESSAGE = "block long, part long, payload binary"
#: Messages about the rows of a block go to this part.
ROWS = -1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit fingerprints of each text's shingles, ascending, and n + 1 offsets into them.

    A text of fewer words than a shingle is one shingle, also one without words.
    """
    low = LOWER[data]
    s, e, docs = word_spans(low, offsets, SPACED)
    n_words = np.diff(docs)
    count = np.maximum(n_words - shingle + 1, 1)
    first = gather(docs[:-1], count)
    codes, size = word_codes(low, s, e), np.repeat(np.minimum(n_words, shingle), count)
    h = size.astype(np.uint64)
    for k in range(shingle):
        some = slice(None) if size.min(initial=shingle) > k else np.flatnonzero(size > k)
        h[some] = pair(h[some], codes[first[some] + k])
    h = mix(h)
    owner = np.repeat(np.arange(len(count)), count)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.searchsorted(owner[new], np.arange(len(count) + 1))


def shingle_counts(texts: DataFrame, shingle: int, bits: int) -> np.ndarray:
    """How many shingles of all texts fall on each entry of the table: 2^bits numbers reach the driver."""

    def count(it):
        total = np.zeros(1 << bits, np.int64)
        for batch in batches(it, size=1 << 20):
            h, _ = shingle_sets(*text_buffer(batch.column(0)), shingle)
            total += np.bincount((h >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        some = np.flatnonzero(total)
        for lo in range(0, len(some), 1 << 16):
            part = some[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], ["entry", "n"])

    rows = texts.mapInArrow(count, "entry int, n long").groupBy("entry").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << bits, np.int64)
    out[rows.column("entry").to_numpy()] = rows.column("n").to_numpy()
    return np.minimum(out, np.iinfo(np.uint32).max).astype(np.uint32)


def prefixes(h: np.ndarray, at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into h, its set, its place in the set's order) of the members of each set's prefix."""
    num, den = ENOUGH
    size = np.diff(at)
    owner = np.repeat(np.arange(len(size)), size)
    bits = len(counts).bit_length() - 1
    order = np.lexsort((h, counts[(h >> np.uint64(64 - bits)).astype(np.int64)], owner))
    place = np.arange(len(h)) - at[:-1][owner]
    keep = place < (size - -(-num * size // den) + 1)[owner]
    return order[keep], owner[keep], place[keep]


class Shingled:
    """A block's rows in order, with their sets; node: a fingerprint of each set; one: the first row of each node."""

    def __init__(self, table: pa.Table, shingle: int):
        self.table = in_order(table)
        self.number = int(self.table.column("block")[0].as_py())
        self.h, self.at = shingle_sets(*text_buffer(self.table.column("text")), shingle)
        raw = self.h.tobytes()
        self.node = np.fromiter((xxhash.xxh64_intdigest(raw[8 * a : 8 * b], 42) for a, b in zip(self.at[:-1].tolist(), self.at[1:].tolist())), np.uint64, len(self.at) - 1).view(np.int64)
        self.one = np.unique(self.node, return_index=True)[1]

    def prefix(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(shingle, row, place) of the members of the distinct sets' prefixes, in the order of shingles."""
        some, owner, place = prefixes(self.h, self.at, counts)
        keep = np.isin(owner, self.one)
        some, owner, place = some[keep], owner[keep], place[keep]
        by = np.argsort(self.h[some], kind="stable")
        return self.h[some][by], owner[by], place[by]


def _low(h: np.ndarray, parts: int) -> np.ndarray:
    """The 32 bits of a shingle that follow those which tell its part."""
    return ((h << np.uint64((parts - 1).bit_length())) >> np.uint64(32)).astype(np.uint32)


def judge_shared(table: pa.Table) -> pa.Table:
    """For each member of the blocks' prefixes whether another block has one of the same bits."""
    got = [unpack(x.as_py(), np.uint32)[0] for x in table.column("payload")]
    every = np.concatenate(got)
    values, which, n = np.unique(every, return_inverse=True, return_counts=True)
    shared = n[which.ravel()] > 1
    ends = np.cumsum([len(x) for x in got])
    bits = [np.packbits(shared[e - len(x) : e]).tobytes() for e, x in zip(ends, got)]
    return table.set_column(table.schema.get_field_index("payload"), "payload", pa.array(bits, pa.binary()))


@dataclass
class Near:
    """blocks: the staged rows; rows: (row, node, known, id); roots: (node, root) of the groups of more than one set."""

    blocks: DataFrame
    rows: DataFrame
    roots: DataFrame


def near_groups(docs: DataFrame, shingle: int, id_col: str, text_col: str, extra: list[str], bits: int = BITS, block_bytes: int = 3 << 20, part_bytes: int = 24 << 20) -> Near:
    """Members of a prefix's list are first held against one alone, then those that are left against one of them, so that a
    dense group costs as many pairs as members; then all pairs that these links leave apart are.  Members of lists that are still
    long by then get an order of their own, by counting their shingles exactly.

    The one is that whose prefix is shared by others most fully: the text that copies were made from, as every change
    brings shingles of its own into a copy's prefix.
    """
    counts = docs.sparkSession.sparkContext.broadcast(shingle_counts(docs.select(F.col(f"`{text_col}`").cast("string")), shingle, bits))
    blocks, n_blocks = in_blocks(docs, id_col, text_col, extra, block_bytes)
    n_parts = 1 << int(np.ceil(np.log2(max(1, n_blocks * block_bytes / part_bytes))))
    bare = blocks.select("block", "doc", "hash", "text")
    kinds = {"block": pa.int64(), "part": pa.int64(), "payload": pa.binary()}

    def send(table: pa.Table) -> pa.Table:
        b = Shingled(table, shingle)
        ids = b.table.column("doc").combine_chunks()
        h = np.unique(b.prefix(counts.value)[0])
        at = key_bounds(h, n_parts)
        parts = np.flatnonzero(np.diff(at)).tolist()
        payload = [pack(_low(h[at[i] : at[i + 1]], n_parts)) for i in parts]
        payload.append(pack(b.node, majority(b.h, b.at), np.asarray(ids.is_valid()).astype(np.uint8), np.asarray(ids.fill_null(0), np.int64)))
        return pa.table({k: pa.array(v, kinds[k]) for k, v in (("block", [b.number] * len(payload)), ("part", [*parts, ROWS]), ("payload", payload))})

    def unpack_rows(it):
        for batch in it:
            for number, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                node, fp, known, ids = unpack(payload.as_py(), np.int64, np.uint64, np.uint8, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((number << 24) + np.arange(len(node))), pa.array(node), pa.array(fp.view(np.int64)), pa.array(known.astype(bool)), pa.array(ids)], ["row", "node", "fp", "known", "id"])

    sent = stage(bare.groupBy("block").applyInArrow(send, MESSAGE), "prefixes")
    rows = stage(sent.filter(F.col("part") == ROWS).select("block", "payload").mapInArrow(unpack_rows, "row long, node long, fp long, known boolean, id long"), "rows")
    judged = sent.filter(F.col("part") != ROWS).groupBy("part").applyInArrow(judge_shared, MESSAGE)

    def hit(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return pa.table({"h": pa.array([], pa.int64()), "node": pa.array([], pa.int64()), "size": pa.array([], pa.int32()), "place": pa.array([], pa.int32())})
        b = Shingled(left, shingle)
        h, owner, place = b.prefix(counts.value)
        values, which, n = np.unique(h, return_inverse=True, return_counts=True)
        shared, at = n > 1, key_bounds(values, n_parts)
        for i, data in zip(right.column("part").to_pylist(), right.column("payload")):
            shared[at[i] : at[i + 1]] |= np.unpackbits(np.frombuffer(data.as_py(), np.uint8))[: at[i + 1] - at[i]].astype(bool)
        keep = shared[which.ravel()]
        owner = owner[keep]
        return pa.table({"h": h[keep].view(np.int64), "node": b.node[owner], "size": np.diff(b.at)[owner].astype(np.int32), "place": place[keep].astype(np.int32)})

    records = stage(bare.groupBy("block").cogroup(judged.groupBy("block")).applyInArrow(hit, "h long, node long, size int, place int"), "shared_prefixes")
    release(sent)
    roots = settle(docs.sparkSession, lambda: _roots(bare, rows, records.distinct(), shingle), "roots")
    release(records)
    return Near(blocks, rows, roots)


def _roots(bare: DataFrame, rows: DataFrame, records: DataFrame, shingle: int) -> DataFrame:
    num, den = ENOUGH
    lists = records.groupBy("h").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least <> most").select("h")
    shared = stage(records.join(lists, "h", "left_semi"), "shared")
    full = shared.groupBy("node").agg((F.count("*") / (F.first("size") - F.ceil(F.first("size") * F.lit(num) / F.lit(den)) + 1)).alias("full"))
    hits = stage(shared.join(full, "node"), "hits")
    release(shared)

    def close(a: str, b: str) -> str:
        """Sizes allow the similarity, and so does what is left of both sets, if this is the first member they share."""
        rest = f"least({a}.size - {a}.place, {b}.size - {b}.place)"
        return f"{den} * least({a}.size, {b}.size) >= {num} * greatest({a}.size, {b}.size) and {num + den} * {rest} >= {num} * ({a}.size + {b}.size)"

    def emit(left: pa.Table, right: pa.Table) -> pa.Table:
        """The sets of the rows asked for."""
        if not len(left) or not len(right):
            return pa.table({"node": pa.array([], pa.int64()), "hs": pa.array([], pa.list_(pa.int64()))})
        b = in_order(left).take(pa.array(right.column("row").to_numpy() & 0xFFFFFF))
        h, at = shingle_sets(*text_buffer(b.column("text")), shingle)
        return pa.table({"node": right.column("node"), "hs": pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(h.view(np.int64)))})

    one = rows.groupBy("node").agg(F.min("row").alias("row"))

    def sets_of(nodes: DataFrame) -> DataFrame:
        asked = one.join(nodes, "node", "left_semi").select(F.shiftright("row", 24).alias("block"), "row", "node")
        return stage(bare.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(emit, "node long, hs array<long>"), "sets")

    def verified(pairs: DataFrame) -> DataFrame:
        sets = sets_of(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct())
        of = lambda c: sets.select(F.col("node").alias(c), F.col("hs").alias(f"{c}s"))
        both = pairs.join(of("u"), "u").join(of("v"), "v").withColumn("n", F.size(F.array_intersect("us", "vs")))
        out = stage(both.filter((num + den) * F.col("n") >= num * (F.size("us") + F.size("vs"))).select("u", "v"), "verified")
        release(sets)
        return out

    # SimHash: sets of one fingerprint, and fingerprints that the grid links.
    prints = stage(rows.groupBy("fp").agg(F.min("node").alias("least"), F.max("node").alias("most")), "prints")
    linked = near_fingerprints(prints)
    ends = lambda c: prints.select(F.col("fp").alias(c), F.col("least").alias(f"{c}n"))
    proposed = linked.join(ends("u"), "u").join(ends("v"), "v").select(F.least("un", "vn").alias("u"), F.greatest("un", "vn").alias("v"))
    proposed = proposed.union(rows.join(prints.filter("least <> most"), "fp").filter("node <> least").select(F.col("least").alias("u"), F.col("node").alias("v")))

    def stars(placed: DataFrame) -> DataFrame:
        """Each member of a list with the one of fullest prefix."""
        centre = placed.groupBy("h").agg(F.max(F.struct("full", "node", "size", "place", "root")).alias("m"))
        held = placed.alias("a").join(centre, "h").filter("a.root <> m.root").filter(close("a", "m"))
        return held.select(F.least("m.node", "a.node").alias("u"), F.greatest("m.node", "a.node").alias("v")).distinct()

    def rooted(hits: DataFrame, found: DataFrame) -> DataFrame:
        return stage(hits.join(components(found), "node", "left").select("h", "node", "size", "place", "full", F.coalesce("root", "node").alias("root")), "placed")

    def link(hits: DataFrame, found: DataFrame, tried: DataFrame, most: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """More links, all pairs looked at, and the sets in lists that are still apart and longer than `most`."""
        placed = rooted(hits, found)
        # Of those that the fullest one did not draw, the fullest.
        first = placed.groupBy("h").agg(F.max(F.struct("full", "node", "root")).alias("m"))
        others = placed.join(first, "h").filter("root <> m.root").drop("m")
        again = stage(stars(others).join(tried, ["u", "v"], "left_anti"), "stars")
        release(placed)
        found, tried = found.union(verified(again)), tried.union(again)
        placed = rooted(hits, found)
        lists = placed.groupBy("h").agg(F.count("*").alias("n"), F.min("root").alias("least"), F.max("root").alias("most")).filter("least <> most")
        short = lists if most is None else lists.filter(F.col("n") <= most)
        held = placed.join(short.select("h"), "h", "left_semi")
        pairs = held.alias("a").join(held.alias("b"), F.expr(f"a.h = b.h and a.node < b.node and a.root <> b.root and {close('a', 'b')}"))
        pairs = stage(pairs.select(F.col("a.node").alias("u"), F.col("b.node").alias("v")).distinct().join(tried, ["u", "v"], "left_anti"), "pairs")
        apart = placed.limit(0) if most is None else placed.join(lists.filter(F.col("n") > most).select("h"), "h", "left_semi")
        apart = stage(apart.select("node").distinct(), "apart")
        release(placed)
        return found.union(verified(pairs)), tried.union(pairs), apart

    tried = stage(stars(hits.withColumn("root", F.col("node"))).union(proposed).distinct(), "stars")
    found, tried, apart = link(hits, verified(tried), tried, LONG)
    if apart.isEmpty():
        return components(found)
    # The table told too little about these: their order is made anew, by how many of them hold a shingle.  What all of them share
    # then comes last, so a passage common to texts that differ otherwise leads to no pairs.
    sets = sets_of(apart)
    members = sets.select("node", F.size("hs").alias("size"), F.explode("hs").alias("h"))
    members = members.join(members.groupBy("h").agg(F.count("*").alias("n")), "h")
    members = members.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy("n", "h")) - 1)
    reach = F.col("size") - F.ceil(F.col("size") * F.lit(num) / F.lit(den)) + 1
    few = members.filter((F.col("place") < reach) & (F.col("n") > 1))
    exact = stage(few.select("h", "node", "size", "place", (F.count("*").over(Window.partitionBy("node")) / reach).alias("full")), "exact")
    release(sets)
    placed = rooted(exact, found)
    again = stage(stars(placed).join(tried, ["u", "v"], "left_anti"), "stars")
    release(placed)
    found, _, _ = link(exact, found.union(verified(again)), tried.union(again), None)
    return components(found)


def shingle_groups(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", **sizes: int) -> DataFrame:
    """(id, component): one row per row of docs; rows of one component are linked by similarities of 0.8 or more.

    Words are those of op7.  Shingles are compared by 64-bit fingerprints; texts of equal sets are one node.
    """
    near = near_groups(docs, shingle, id_col, text_col, [], **sizes)
    out = near.rows.join(near.roots, "node", "left")
    return out.select(F.when(F.col("known"), F.col("id")).alias(id_col), F.coalesce("root", "node").alias("component"))


def drop_near_copies(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", **sizes: int) -> DataFrame:
    """docs with one row of each group of near copies: that of the least id, any one of those that share it.

    A row without an id stays only if no row of its group has one.  Null and empty texts, and any without words, are
    copies of each other.  Rows are judged by themselves, whatever ids they share; all columns come along unchanged.
    """
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    near = near_groups(docs, shingle, id_col, text_col, rest, **sizes)
    member = near.rows.join(near.roots, "node", "left").select("row", "known", "id", F.coalesce("root", "node").alias("component"))
    first = member.groupBy("component").agg(F.min(F.struct(~F.col("known"), "id", "row")).alias("m"), F.count("*").alias("n")).filter("n > 1").select("component", F.col("m.row").alias("first"))
    # Staged, so that a join with one very large group can be split, or the few groups broadcast.
    gone = member.join(stage(first, "firsts"), "component").filter("row <> first").select(F.shiftright("row", 24).alias("block"), "row")
    names = ["doc", "text", *[f"x{i}" for i in range(len(rest))]]
    fields = {f.name: f for f in near.blocks.schema.fields}

    def keep(left: pa.Table, right: pa.Table) -> pa.Table:
        stays = np.ones(len(left), bool)
        stays[right.column("row").to_numpy() & 0xFFFFFF] = False
        return in_order(left).filter(pa.array(stays)).select(names)

    kept = near.blocks.groupBy("block").cogroup(gone.groupBy("block")).applyInArrow(keep, T.StructType([fields[n] for n in names])).toDF(id_col, text_col, *rest)
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    return kept.select(*[F.col(f"`{c}`").cast(kinds[c]).alias(c) if c in (id_col, text_col) else F.col(f"`{c}`") for c in docs.columns])
