"""SimHash near-dedup by segment popcounts.

A fingerprint's embedding counts the bits set in each of its 8 bytes.  One differing bit changes one count by one, so
the Manhattan distance of embeddings is a lower bound of the Hamming distance.  The range join runs on a grid over the
embeddings: a fingerprint belongs to one cell and visits the later cells that its ball touches; within a cell, candidates
agree in a third of the bits and are verified bit by bit.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACED, batches, eight, gather, release, stage, text_buffer, word_spans
from .components import components, union

SEED = 42
#: Cells are this wide in each of the 8 counts; the shift puts a boundary near the middle of the likely counts.
WIDTH, SHIFT = 3, 1


#: The primes of XXH64.
_P = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _rotate(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _lane(x: np.ndarray) -> np.ndarray:
    return _rotate(x, 31) * _P[0]


def xxh64(data: np.ndarray, at: np.ndarray, size: np.ndarray, seed: int = SEED, most: int = 1024) -> np.ndarray:
    """XXH64 of stretches of data, all at once; those of more than `most` bytes one by one."""
    lead, one, two = eight(data), _P[0], _P[1]
    h = np.full(len(at), (seed + int(_P[4])) % 2**64, np.uint64)
    wide = np.flatnonzero((size >= 32) & (size <= most))
    if len(wide):
        acc = [np.full(len(wide), (seed + x) % 2**64, np.uint64) for x in (int(one) + int(two), int(two), 0, -int(one))]
        todo, k = np.arange(len(wide)), 0
        while len(todo):
            base = at[wide[todo]] + 32 * k
            for j, a in enumerate(acc):
                a[todo] = _rotate(a[todo] + lead[base + 8 * j] * two, 31) * one
            k += 1
            todo = todo[size[wide[todo]] >= 32 * (k + 1)]
        x = _rotate(acc[0], 1) + _rotate(acc[1], 7) + _rotate(acc[2], 12) + _rotate(acc[3], 18)
        for a in acc:
            x = (x ^ _lane(a * two)) * one + _P[3]
        h[wide] = x
    h += size.astype(np.uint64)
    at, left = at + (size & ~31), size & 31
    for _ in range(3):
        some = np.flatnonzero(left >= 8)
        h[some] = _rotate(h[some] ^ _lane(lead[at[some]] * two), 27) * one + _P[3]
        at[some] += 8
        left[some] -= 8
    some = np.flatnonzero(left >= 4)
    h[some] = _rotate(h[some] ^ (lead[at[some]] & np.uint64(0xFFFFFFFF)) * one, 23) * two + _P[2]
    at[some] += 4
    left[some] -= 4
    for _ in range(3):
        some = np.flatnonzero(left > 0)
        h[some] = _rotate(h[some] ^ (lead[at[some]] & np.uint64(0xFF)) * _P[4], 11) * one
        at[some] += 1
        left[some] -= 1
    h = (h ^ (h >> np.uint64(33))) * two
    h = (h ^ (h >> np.uint64(29))) * _P[2]
    h ^= h >> np.uint64(32)
    raw = data.data
    for i in np.flatnonzero(size > most).tolist():
        begin = int(at[i] - (size[i] - left[i]))
        h[i] = xxhash.xxh64_intdigest(raw[begin : begin + size[i]], seed)
    return h


def majority(h: np.ndarray, at: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """Of each run of hashes, at[i] to at[i + 1], the bits set in more than half of them; 0 of an empty run."""
    count = np.diff(at)
    ones = np.zeros((len(count), 64), np.int32)
    for lo in range(0, len(h), step):
        hi = min(lo + step, len(h))
        bits = np.unpackbits(h[lo:hi].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        d0, d1 = np.searchsorted(at, lo, "right") - 1, np.searchsorted(at, hi, "left")
        cut = np.maximum(at[d0:d1], lo) - lo
        some = count[d0:d1] > 0
        ones[np.arange(d0, d1)[some]] += np.add.reduceat(bits, cut[some], axis=0, dtype=np.int32)
    return np.packbits(2 * ones > count[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int) -> np.ndarray:
    """The 64-bit SimHash of each text; 0 where a text has no words."""
    low = LOWER[data]
    s, e, docs = word_spans(low, offsets, SPACED)
    n_words = np.diff(docs)
    # Words with one space after each, so that a shingle is one stretch of bytes.
    length = e - s + 1
    flat = np.append(low, np.uint8(32))[gather(s, length)]
    ends = np.cumsum(length)
    flat[ends - 1] = 32
    begin = ends - length
    count = np.where(n_words >= shingle, n_words - shingle + 1, np.minimum(n_words, 1))
    first = gather(docs[:-1], count)
    last = first + np.repeat(np.minimum(n_words, shingle), count) - 1
    return majority(xxh64(flat, begin[first], ends[last] - 1 - begin[first]), np.concatenate([[0], np.cumsum(count)]))


def _moves(radius: int) -> list[tuple[tuple[int, int], ...]]:
    """Sets of dimensions with a number of cells each, up or down, that may cost no more than the radius."""
    least = {n: (abs(n) - 1) * WIDTH + 1 for n in range(-9 // WIDTH, 9 // WIDTH + 1) if n}
    out, last = [], [((), 0)]
    while last:
        last = [((*move, (dim, n)), price + least[n]) for move, price in last for dim in range(move[-1][0] + 1 if move else 0, 8) for n in least if price + least[n] <= radius]
        out += [move for move, _ in last]
    return out


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def visits(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of each fingerprint: (row, cell, home).  The later of two cells is the one where a pair meets."""
    counts = _popcount(fp.view(np.uint8).reshape(-1, 8)).astype(np.int64)
    grid = (counts + SHIFT) // WIDTH
    inside = (counts + SHIFT) % WIDTH
    weight = 8 ** np.arange(8, dtype=np.int64)
    home = grid @ weight
    rows, cells, homes = [np.arange(len(fp))], [home], [np.ones(len(fp), bool)]
    cost = lambda n: n * WIDTH - inside if n > 0 else inside + 1 + (-n - 1) * WIDTH
    costs = {n: cost(n) for move in _moves(radius) for _, n in move}
    for move in _moves(radius):
        price = sum(costs[n][:, dim] for dim, n in move)
        step = sum(n * int(weight[dim]) for dim, n in move)
        ok = np.flatnonzero(price <= radius) if step > 0 else np.zeros(0, np.int64)
        for dim, n in move:
            ok = ok[(grid[ok, dim] + n >= 0) & (grid[ok, dim] + n < 8)]
        rows.append(ok)
        cells.append(home[ok] + step)
        homes.append(np.zeros(len(ok), bool))
    return np.concatenate(rows), np.concatenate(cells), np.concatenate(homes)


def _flips(bits: list[int], radius: int) -> np.ndarray:
    masks = [0]
    for n in range(1, radius + 1):
        masks += [sum(1 << b for b in c) for c in itertools.combinations(bits, n)]
    return np.array(masks, np.uint64)


def _blocks(radius: int) -> list[np.uint64]:
    """Masks of radius + 1 blocks of bits: by pigeonhole, fingerprints within the radius agree in one of them."""
    cuts = np.linspace(0, 64, radius + 2).astype(int)
    return [np.uint64(sum(1 << b for b in range(lo, hi))) for lo, hi in zip(cuts[:-1], cuts[1:])]


def link(fp: np.ndarray, home: np.ndarray, cell: np.ndarray, radius: int, only: int = -1) -> np.ndarray:
    """Labels (least index of the set) after linking all pairs of distinct fingerprints of one cell within the radius.

    A pair counts if one of the two is at home there.  only: the one block of bits in which pairs are to agree.  A
    block's group is compared pairwise while small; in a large one each member looks up its neighbours by flipping the
    other bits, so the work is linear in the group.
    """
    label = np.arange(len(fp))
    for mask in _blocks(radius)[only:][:1] if only >= 0 else _blocks(radius):
        key = fp & mask
        order = np.lexsort((fp, key, cell))
        k, c = key[order], cell[order]
        starts = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])])) if len(k) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(k)))
        flips = _flips([b for b in range(64) if not int(mask) >> b & 1], radius)[1:]
        small = (sizes > 1) & (sizes <= len(flips))
        # Small groups: each member with the next one, the one after, ... in one sweep over all groups.
        rank = np.arange(len(k)) - np.repeat(starts, sizes)
        room = np.repeat(np.where(small, sizes, 0), sizes) - rank
        live = np.flatnonzero(room > 1)
        gap = 1
        while len(live):
            a, b = order[live], order[live + gap]
            ok = _popcount(fp[a] ^ fp[b]) <= radius
            ok &= home[a] | home[b]
            union(label, a[ok], b[ok])
            gap += 1
            live = live[room[live] > gap]
        for g in np.flatnonzero(sizes > len(flips)):
            members = order[starts[g] : starts[g] + sizes[g]]
            values = fp[members]  # sorted
            for flip in flips:
                want = values ^ flip
                at = np.minimum(np.searchsorted(values, want), len(values) - 1)
                a = np.flatnonzero(values[at] == want)
                a, b = members[a], members[at[a]]
                ok = home[a] | home[b]
                union(label, a[ok], b[ok])
    return label


def near_fingerprints(fps: DataFrame, radius: int = 2, cell_rows: int = 200_000) -> DataFrame:
    """(u, v): links between distinct fingerprints (column fp) that span the same components as all pairs within the radius.

    Links are emitted as stars, so a group of n fingerprints costs n rows a cell, not n squared.  A cell with more than
    cell_rows rows is dealt once for each of the radius + 1 blocks of bits, by the bits in it, to parts of about that
    many rows: the copies of a row do not grow with the cell.  Counts by cell are a table of at most 8^8 rows in theory
    and some thousands in fact, and are joined, not collected.
    """

    def visit(it):
        for batch in it:
            fp = np.asarray(batch.column(0), np.int64).view(np.uint64)
            rows, cells, home = visits(fp, radius)
            for lo in range(0, len(rows), 1 << 16):
                cut = slice(lo, lo + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(cells[cut], pa.int64()), pa.array(fp[rows[cut]].view(np.int64)), pa.array(home[cut])], ["cell", "fp", "home"])

    def meet(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy().view(np.uint64)
        label = link(fp, table.column("home").to_numpy(), table.column("cell").to_numpy(), radius, table.column("k")[0].as_py())
        some = np.flatnonzero(label != np.arange(len(label)))
        signed = fp.view(np.int64)
        return pa.table({"u": pa.array(signed[some]), "v": pa.array(signed[label[some]])})

    visited = stage(fps.select("fp").mapInArrow(visit, "cell long, fp long, home boolean"), "cells")
    sizes = visited.groupBy("cell").agg(F.ceil(F.count("*") / cell_rows).alias("parts"))
    # Small cells are put together to tasks of about a quarter of cell_rows.
    together = visited.count() * 4 // cell_rows + 1
    whole = F.array(F.struct(F.lit(-1).alias("k"), F.lit(None).cast("long").alias("one"), F.pmod(F.xxhash64("cell"), F.lit(together)).alias("part")))
    by_bits = F.array(*[F.struct(F.lit(k).alias("k"), F.col("cell").alias("one"), F.pmod(F.xxhash64(F.col("fp").bitwiseAND(F.lit(mask.view(np.int64).item()))), "parts").alias("part")) for k, mask in enumerate(_blocks(radius))])
    tasks = visited.join(sizes, "cell").select("cell", "fp", "home", F.explode(F.when(F.col("parts") == 1, whole).otherwise(by_bits)).alias("to"))
    links = stage(tasks.select("cell", "to.k", "to.one", "to.part", "fp", "home").groupBy("one", "k", "part").applyInArrow(meet, "u long, v long").distinct(), "links")
    release(visited)
    return links


def fingerprint_table(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    def take(it):
        for batch in batches(it):
            fp = fingerprints(*text_buffer(batch.column(1)), shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc", "fp"])

    chosen = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return chosen.mapInArrow(take, "doc long, fp long")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def simhash_groups(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id): one row per document; component_id is the least id that links reach.

    Words: maximal runs of bytes other than space and \\x09-\\x0D, after A-Z are lower-cased.  A text of fewer words than
    a shingle is one shingle; a null text, or one without words, has fingerprint 0, which links like any other.  Equal
    fingerprints (so all copies) are one node; documents with a null id get the least id of their group, null if it has
    none; other ids are cast to long.  Repeated rows are rows of their own with the same answer; an empty table gives none.
    """
    table = stage(fingerprint_table(docs, id_col, text_col, shingle), "fingerprints")
    nodes = stage(table.groupBy("fp").agg(F.min("doc").alias("least")), "nodes")
    links = near_fingerprints(nodes, radius)
    roots = components(links)
    release(links)
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    member = rooted.join(least, "root").select("fp", "component_id")
    return table.join(member, "fp").select(F.col("doc").alias(id_col), "fp", "component_id")
