"""Benchmark decontamination with a distributed positional inverted index of the training documents.

The index is cut by documents: a task turns some megabytes of text into a segment, one row for each distinct word with
the sorted list of its places in the segment, plus one header row with the segment's documents.  It is a table in the
shared folder, as large as the text at most.  A benchmark is compiled to windows, the distinct words of the windows pick
the lists to read, and a segment answers by itself: for each window it takes the list of the word that is rarest there,
moves it by the word's offset in the window, and intersects it with the other lists, rarest first.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, batches, gather, stage, strings, text_buffer, word_codes, word_spans

INDEX = "segment long, term long, n int, places binary"


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_buffer(column)
    low = LOWER[data]
    s, e, docs = word_spans(low, offsets, ALNUM)
    return word_codes(low, s, e), docs


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = 4 << 20) -> DataFrame:
    """The index, as a staged table.  A header row has a null term; its list holds ids, their validity and word offsets."""

    def segments(it):
        number = TaskContext.get().partitionId() << 32
        for batch in batches(it, 1 << 20, segment_bytes):
            codes, at = _words(batch.column(1))
            ids = batch.column(0)
            head = b"".join(x.tobytes() for x in (np.asarray(ids.fill_null(0), np.int64), np.asarray(ids.is_valid()).astype(np.int64), at.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([None], pa.int64()), pa.array([len(ids)], pa.int32()), pa.array([head], pa.binary())], ["segment", "term", "n", "places"])
            order = np.argsort(codes, kind="stable")
            sorted_codes = codes[order]
            first = np.flatnonzero(np.concatenate([[True], sorted_codes[1:] != sorted_codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
            ends = np.append(first, len(codes))
            places = order.astype(np.int32)
            for lo in range(0, len(first), 1 << 16):
                hi = min(lo + (1 << 16), len(first))
                lists = strings(places[ends[lo] : ends[hi]].view(np.uint8), (ends[lo : hi + 1] - ends[lo]) * 4, pa.binary())
                terms = sorted_codes[first[lo:hi]].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(hi - lo, number)), pa.array(terms), pa.array(np.diff(ends[lo : hi + 1]), pa.int32()), lists], ["segment", "term", "n", "places"])
            number += 1

    chosen = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return stage(chosen.mapInArrow(segments, INDEX), "index")


@dataclass
class Windows:
    """Windows of some benchmark items: codes (windows x size, unused slots repeat the first word), length and item of each."""

    codes: np.ndarray
    length: np.ndarray
    item: np.ndarray
    names: list[str]

    @classmethod
    def of(cls, items: list[tuple[str, str]], size: int) -> Windows:
        codes, at = _words(pa.array([t for _, t in items], pa.string()))
        n = np.diff(at)
        count = np.where(n == 0, 0, np.maximum(n - size + 1, 1))
        first, length = gather(at[:-1], count), np.repeat(np.minimum(n, size), count)
        slot = np.where(np.arange(size) < length[:, None], np.arange(size), 0)
        return cls(codes[first[:, None] + slot] if len(first) else np.zeros((0, size), np.uint64), length, np.repeat(np.arange(len(items)), count), [x for x, _ in items])


def match_segment(terms: np.ndarray, lists: list[np.ndarray], docs: np.ndarray, w: Windows, proximity: int | None) -> tuple[np.ndarray, ...]:
    """(document, item, first word, words, near) of every match; docs holds n + 1 word offsets."""
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    if not len(terms) or not len(w.codes):
        return none
    by = np.argsort(terms)
    terms = terms[by]
    sizes = np.array([len(lists[i]) for i in by])
    at = np.concatenate([[0], np.cumsum(sizes)])
    # All lists in one sorted array of (term's number, place).
    keyed = (np.repeat(np.arange(len(by)), sizes) << 32) + np.concatenate([lists[i] for i in by])
    number = np.minimum(np.searchsorted(terms, w.codes), len(terms) - 1)
    alive = np.flatnonzero((terms[number] == w.codes).all(axis=1))
    if not len(alive):
        return none
    number, length = number[alive], w.length[alive]
    width = number.shape[1]
    slot = np.where(np.arange(width) < length[:, None], np.arange(width), 0)
    rare = np.argsort(sizes[number], axis=1, kind="stable")
    number, slot = np.take_along_axis(number, rare, 1), np.take_along_axis(slot, rare, 1)
    # The rarest word's list, moved to where the window would start.
    n = sizes[number[:, 0]]
    win = np.repeat(np.arange(len(alive)), n)
    start = (keyed[gather(at[number[:, 0]], n)] & 0xFFFFFFFF) - np.repeat(slot[:, 0], n)
    rarest = start + slot[win, 0]
    ok = start >= 0
    near_win, near_place = win, rarest
    win, start = win[ok], start[ok]
    for j in range(1, width):
        want = (number[win, j] << 32) + start + slot[win, j]
        found = keyed[np.minimum(np.searchsorted(keyed, want), len(keyed) - 1)] == want
        win, start = win[found], start[found]
    doc = np.searchsorted(docs, start, "right") - 1
    inside = start + length[win] <= docs[doc + 1] if len(win) else np.zeros(0, bool)
    win, start, doc = win[inside], start[inside], doc[inside]
    out = [doc, w.item[alive[win]], start, length[win], np.zeros(len(win), np.int64)]
    if proximity:
        rows = near_matches(keyed, number, near_win, near_place, docs, proximity)
        out = [np.concatenate([x, y]) for x, y in zip(out, (rows[0], w.item[alive[rows[1]]], rows[2], rows[3], np.ones(len(rows[0]), np.int64)))]
    return tuple(out)


def near_matches(keyed: np.ndarray, number: np.ndarray, win: np.ndarray, place: np.ndarray, docs: np.ndarray, proximity: int) -> tuple[np.ndarray, ...]:
    """(document, window, first word, words) of stretches of at most `proximity` words with all words of a window, in any order.

    place: places of each window's rarest word.  The lists of the other words are consulted rarest first, and a place is
    given up as soon as one of them has nothing near it.
    """
    width = number.shape[1]

    def after(k: np.ndarray, i: int, begin: np.ndarray) -> np.ndarray:
        """The first place, from begin on, of the i-th word; far away if there is none."""
        base = (number[win[k], i] << 32) + begin
        found = keyed[np.minimum(np.searchsorted(keyed, base), len(keyed) - 1)]
        return np.where(found >= base, found - (number[win[k], i] << 32), 1 << 40)

    k = np.arange(len(win))
    for i in range(1, width):
        k = k[after(k, i, np.maximum(place[k] - proximity + 1, 0)) < place[k] + proximity]
    # Such a stretch may be taken to begin at one of the window's own words, up to the rarest one.
    rows = []
    for j in range(width):
        lo = np.searchsorted(keyed, (number[win[k], j] << 32) + np.maximum(place[k] - proximity + 1, 0))
        hi = np.searchsorted(keyed, (number[win[k], j] << 32) + place[k], "right")
        of = np.repeat(k, hi - lo)
        begin = keyed[gather(lo, hi - lo)] & 0xFFFFFFFF
        last = np.maximum.reduce([after(of, i, begin) for i in range(width)]) if len(of) else begin
        doc = np.searchsorted(docs, begin, "right") - 1
        ok = (last < begin + proximity) & (last < docs[np.minimum(doc + 1, len(docs) - 1)])
        rows.append((doc[ok], win[of[ok]], begin[ok], last[ok] - begin[ok] + 1))
    return tuple(np.concatenate([r[i] for r in rows]) for i in range(4))


def _item_blocks(items: DataFrame, item_col: str, text_col: str, size: int, block_bytes: int):
    """Items in blocks of bounded size once compiled, each of which is broadcast; a larger benchmark makes more blocks.

    A window costs 8 bytes a word; a text has half as many windows as bytes at most.
    """
    block, held = [], 0
    rows = items.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).orderBy(F.col(f"`{item_col}`"))
    for name, text in rows.toLocalIterator():
        cost = (len(text) // 2 + 1) * 8 * (size + 2)
        if block and held + cost > block_bytes:
            yield block
            block, held = [], 0
        block.append((name, text))
        held += cost
    if block:
        yield block


def _matcher(shared, proximity: int | None):
    def match(table: pa.Table) -> pa.Table:
        w = shared.value
        term = table.column("term").combine_chunks()
        payload = table.column("places")
        head = term.is_null().to_numpy(zero_copy_only=False).nonzero()[0]
        if not len(head):
            raise ValueError("a segment of the index has lost its header")
        _, _, docs = _header(payload[int(head[0])].as_py(), table.column("n")[int(head[0])].as_py())
        rows = [i for i in range(len(term)) if i != head[0]]
        lists = [np.frombuffer(payload[i].as_py(), np.int32).astype(np.int64) for i in rows]
        code = np.asarray(term.fill_null(0), np.int64).view(np.uint64)[rows] if rows else np.zeros(0, np.uint64)
        doc, item, first, words, near = match_segment(code, lists, docs, w, proximity)
        keep = np.unique(np.stack([doc, item, first, words, near]), axis=1) if len(doc) else np.zeros((5, 0), np.int64)
        names = [w.names[i] for i in keep[1]]
        segment = table.column("segment")[0].as_py()
        return pa.table({"segment": pa.array([segment] * len(names), pa.int64()), "doc": keep[0], "item": pa.array(names, pa.string()), "first": keep[2], "words": keep[3], "near": keep[4]})

    return match


def find_matches(index: DataFrame, items: DataFrame, size: int = 10, proximity: int | None = None, item_col: str = "item_id", text_col: str = "text", block_bytes: int = 64 << 20) -> DataFrame:
    """(doc, n_words, n_hit, n_items, items, n_near) of every indexed document.

    items: item ids as text, in the order of their text, comma-joined.  n_near: items of which all words of a window
    stand within `proximity` consecutive words, in any order (null unless asked for).
    """
    spark = index.sparkSession
    matched = None
    for block in _item_blocks(items, item_col, text_col, size, block_bytes):
        windows = Windows.of(block, size)
        shared = spark.sparkContext.broadcast(windows)
        terms = spark.createDataFrame(pa.table({"term": np.unique(windows.codes).view(np.int64)}), "term long")

        lists = index.join(terms, "term", "left_semi").select("segment", "term", "n", "places").union(index.filter("term is null").select("segment", "term", "n", "places"))
        found = lists.groupBy("segment").applyInArrow(_matcher(shared, proximity), "segment long, doc long, item string, first long, words long, near long")
        matched = found if matched is None else matched.union(found)
    if matched is None:
        matched = spark.createDataFrame([], "segment long, doc long, item string, first long, words long, near long")

    def total(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, valid, docs = _header(left.column("places")[0].as_py(), left.column("n")[0].as_py())
        n = len(ids)
        doc, first, words, near = (right.column(c).to_numpy() for c in ("doc", "first", "words", "near"))
        edge = np.zeros(int(docs[-1]) + 1, np.int64)
        exact = near == 0
        np.add.at(edge, first[exact], 1)
        np.subtract.at(edge, first[exact] + words[exact], 1)
        hit = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
        names = pc.unique(right.column("item")).sort()
        item = np.asarray(pc.index_in(right.column("item"), names), np.int64)
        pairs = np.unique((doc * 2 + near) * (len(names) + 1) + item)  # in the order of documents, then of names
        which, item = pairs // (len(names) + 1), pairs % (len(names) + 1)
        n_of = np.bincount(which, minlength=2 * n)
        lists = [""] * n
        text = names.take(pa.array(item)).to_pylist()
        at = np.concatenate([[0], np.cumsum(n_of)])
        for d in np.flatnonzero(n_of[::2]).tolist():
            lists[d] = ",".join(text[at[2 * d] : at[2 * d + 1]])
        return pa.table({
            "doc": pa.array(ids, pa.int64(), mask=~valid),
            "n_words": np.diff(docs),
            "n_hit": hit[docs[1:]] - hit[docs[:-1]],
            "n_items": pa.array(n_of[::2], pa.int64()),
            "items": pa.array(lists, pa.string()),
            "n_near": pa.array(n_of[1::2], pa.int64()) if proximity else pa.nulls(n, pa.int64()),
        })

    heads = index.filter("term is null").select("segment", "n", "places")
    return heads.groupBy("segment").cogroup(matched.groupBy("segment")).applyInArrow(total, "doc long, n_words long, n_hit long, n_items long, items string, n_near long")


def _header(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(data, np.int64)
    return raw[:n], raw[n : 2 * n].astype(bool), raw[2 * n :]


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10, proximity: int | None = None, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", segment_bytes: int = 4 << 20, block_bytes: int = 64 << 20) -> DataFrame:
    """(id, n_words, n_hit, n_items, items, contaminated, n_near) of each document.

    Words: maximal runs of ASCII letters and digits, after A-Z are lower-cased, and of bytes of other characters.  A
    window is `size` consecutive words of an item; an item of fewer words, but not none, is one window.  n_hit: document
    words inside any place of a window; items: those with such places.  Null or empty texts have no words, rows that
    share an id are answered each for itself, and items that share one count as one item, also those without one, which
    are named by an empty text.  A very long text is a segment of its own.  n_near: items of which all words of a window
    stand, in any order, within `proximity` consecutive words of the document; null unless asked for.  Ids are cast to
    long.  An empty table of documents gives no rows, one of items leaves all documents clean.
    """
    out = find_matches(build_index(docs, id_col, text_col, segment_bytes), items, size, proximity, item_col, item_text, block_bytes)
    return out.select(F.col("doc").alias(id_col), "n_words", "n_hit", "n_items", "items", (F.col("n_hit") > 0).alias("contaminated"), "n_near")


__all__ = ["build_index", "decontaminate", "find_matches"]
