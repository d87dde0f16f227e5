"""Which windows of a corpus start earlier somewhere else: the exchange that both span-dedup operators run on.

A corpus is a sequence of symbols (bytes or words) for each document; a window is W consecutive symbols of one
document.  Each window chooses one anchor, the K-gram of least fingerprint in it, so equal windows choose equal anchors
at the same place.  Consecutive starts with one anchor form a *phrase*: the symbols of all their windows.  Phrases tile
the windows, about one phrase for (W - K + 2) / 2 symbols.  Blocks of documents ask an index that is dealt by content:

1. Every block sends each distinct phrase once, by a 96-bit fingerprint and the place of its first copy, to the index part that
   owns the fingerprint, and each distinct anchor once, with the number of its phrases, to the part that owns the anchor.  The
   first part answers where the phrase occurs first, the second whether other phrases have the anchor, and whether so
   many have it that it is *hot*.
2. Phrases that are the first of their kind and share an anchor may hold windows of other phrases.  Each of their
   windows is looked up by its own fingerprint; or, where the operator has a method of its own for the symbols, those of
   an anchor that is not hot meet in the part that owns the anchor.  The first place of any window lies in the first
   copy of its phrase, so this is complete.
3. Every block adds up the answers and its own repeats; each repeated window has the place where it starts first.
4. An operator that parses the text against its sources (reach) gets them: each block asks for the stretches where its repeats start
   first, each distinct stretch is read once in the block that holds it, and a join brings it to all who asked, so a
   passage that everyone asks for is no single task's work.

First means least in (id, block, row of the block, start), null ids before all others; blocks need no order by id.
A block sends an entry for a phrase, a window or an anchor, however often it holds it, so an index part gets one entry a
block of even the commonest passage, and of a line that stands in every document, each time in another context, one
entry of its anchor and the fingerprints of its windows, which are dealt by themselves.  Nothing is collected; no pairs are made.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import gather, grams, in_blocks, mix, pair, stage, text_buffer

_INDEX_BITS = np.uint64(24)
#: Symbols that are fingerprinted at once: arrays of so many stay in a core's cache.
CHUNK = 1 << 15
ANCHORS, PHRASES, WINDOWS, SYMBOLS, SOURCES = range(5)


@dataclass(frozen=True)
class Kind:
    """What a symbol is and how long windows and anchors are.

    code: symbols of a block: (data, offsets) -> (64-bit codes, n + 1 offsets of documents into them).
    span: symbols that a code covers from its own on; gram is at least as many.
    resolve: the operator's own method for the symbols of step 2, which are the block's bytes: see Contexts.
    """

    window: int
    gram: int
    code: Callable
    span: int = 1
    resolve: Callable[[Contexts], np.ndarray] | None = None


@dataclass
class Contexts:
    """Phrases of one index part, in the order of their places in the corpus.

    symbols[bounds[i]:bounds[i + 1]] is phrase i, of length - window + 1 windows.  A method returns one boolean per
    window, phrase by phrase: whether the same symbols start in an earlier phrase.
    """

    symbols: np.ndarray
    bounds: np.ndarray
    window: int


@dataclass
class Phrases:
    """Phrases of a block in order: first and last start, place and fingerprint of the anchor, two of all symbols."""

    first: np.ndarray
    last: np.ndarray
    place: np.ndarray
    anchor: np.ndarray
    whole: np.ndarray
    check: np.ndarray


def window_prints(g: np.ndarray, starts: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints, of 64 and of 32 bits, of the windows at the given starts, from those of all K-grams."""
    steps = [*range(0, window - gram, gram), window - gram]
    one = two = g[starts]
    for s in steps[1:]:
        one, two = pair(one, g[starts + s]), pair(two, g[starts + s], 2)
    return mix(one), mix(two).astype(np.uint32)


def phrases(codes: np.ndarray, docs: np.ndarray, window: int, gram: int, most: int = 1 << 24, span: int = 1) -> Phrases:
    """Of the symbols of a block, whose documents begin at docs (n + 1 offsets).  most: symbols looked at at once."""
    n, none = len(codes), np.zeros(0, np.int64)
    if n < window:
        return Phrases(none, none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(np.uint32))
    if n >= most:
        # Places are kept in 24 bits: longer blocks are looked at in pieces that have W - 1 symbols in common.
        return _pieces(codes, docs, window, gram, most, span)
    g, place = np.empty(n - gram + 1, np.uint64), np.empty(n - window + 1, np.int64)
    for lo in range(0, len(place), CHUNK):
        hi = min(lo + CHUNK, len(place))
        part = grams(codes[lo : hi + window - 1], gram, span)
        g[lo : lo + len(part)] = part
        # Sliding minimum over window - gram + 1 anchors; the place breaks ties, to the left.
        least = ((part >> _INDEX_BITS) << _INDEX_BITS) | np.arange(len(part), dtype=np.uint64)
        width, want = 1, window - gram + 1
        while width * 2 <= want:
            least = np.minimum(least[: len(least) - width], least[width:])
            width *= 2
        if want > width:
            least = np.minimum(least[: len(least) - (want - width)], least[want - width :])
        place[lo:hi] = (least & np.uint64((1 << 24) - 1)).astype(np.int64) + lo
    # Starts whose window lies in one document.
    edge = np.zeros(n + 2, np.int8)
    long = np.flatnonzero(np.diff(docs) >= window)
    edge[docs[long]] += 1
    edge[docs[long + 1] - window + 1] -= 1
    valid = np.cumsum(edge[: len(place)], dtype=np.int8).astype(bool)
    opens = valid.copy()
    opens[1:] &= (place[1:] != place[:-1]) | ~valid[:-1]
    closes = valid.copy()
    closes[:-1] &= (place[1:] != place[:-1]) | ~valid[1:]
    # Adjacent documents: the last start of one and the first of the next are never neighbours, as W > 1.
    first, last = np.flatnonzero(opens), np.flatnonzero(closes)
    at = place[first]
    # A phrase is shorter than two windows, so its first and last one hold all its symbols.
    length = (last - first).astype(np.uint64)
    (a, b), (c, d) = window_prints(g, first, window, gram), window_prints(g, last, window, gram)
    b, d = b.astype(np.uint64), d.astype(np.uint64)
    return Phrases(first, last, at, mix(g[at] ^ np.uint64(0x5851F42D4C957F2D)), mix(pair(a, c) + length), mix(pair(b, d, 2) ^ length).astype(np.uint32))


def _pieces(codes: np.ndarray, docs: np.ndarray, window: int, gram: int, most: int, span: int) -> Phrases:
    n, parts, at = len(codes), [], 0
    step = most - 1
    while at + window <= n:
        to = min(at + step, n)
        inner = docs[(docs > at) & (docs < to)]
        p = phrases(codes[at:to], np.concatenate([[0], inner - at, [to - at]]), window, gram, most, span)
        for name in ("first", "last", "place"):
            setattr(p, name, getattr(p, name) + at)
        parts.append(p)
        if to == n:
            break
        at = to - window + 1
    return Phrases(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("first", "last", "place", "anchor", "whole", "check")))


def key_bounds(keys: np.ndarray, parts: int) -> np.ndarray:
    """n + 1 bounds, by the leading bits, of sorted keys."""
    bucket = keys >> np.uint64(64 - (parts - 1).bit_length()) if parts > 1 else np.zeros(len(keys), np.uint64)
    return np.searchsorted(bucket, np.arange(parts + 1, dtype=np.uint64))


def _heads(*keys: np.ndarray) -> np.ndarray:
    """True where sorted rows differ from the one before."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = False
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return new


@dataclass
class Answers:
    """What the index said: of distinct phrases, and of the windows that were looked up, in the order they were sent."""

    phrases: dict[int, bytes]
    anchors: dict[int, bytes]
    windows: dict[int, bytes]
    symbols: dict[int, bytes]

    @classmethod
    def of(cls, table: pa.Table) -> Answers:
        found: list[dict] = [{}, {}, {}, {}]
        for part, phase, payload in zip(table.column("part").to_pylist(), table.column("phase").to_pylist(), table.column("payload")):
            if phase != SOURCES:
                found[phase][part] = payload.as_py()
        return cls(found[PHRASES], found[ANCHORS], found[WINDOWS], found[SYMBOLS])


@dataclass
class Repeats:
    """For each start whether its window starts earlier in the corpus, and if so the row and start where it is first."""

    starts: np.ndarray
    row: np.ndarray
    start: np.ndarray


def runs(r: Repeats, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last window of each run: consecutive windows of one document whose first places are consecutive too."""
    begins = np.zeros(len(r.starts) + 1, bool)
    begins[docs] = True
    on = np.zeros(len(r.starts), bool)
    on[1:] = r.starts[1:] & r.starts[:-1] & (r.row[1:] == r.row[:-1]) & (r.start[1:] == r.start[:-1] + 1)
    on &= ~begins[:-1]
    ends = r.starts.copy()
    ends[:-1] &= ~on[1:]
    return np.flatnonzero(r.starts & ~on), np.flatnonzero(ends)


def in_order(table: pa.Table) -> pa.Table:
    """A block's rows in the order of the corpus; wholly equal ids and texts may change places, other rows never do."""
    table = table.combine_chunks().sort_by([("doc", "ascending"), ("hash", "ascending"), ("text", "ascending")])
    nulls = table.column("doc").combine_chunks().null_count  # sort_by puts them last; here they come first
    if nulls:
        table = pa.concat_tables([table.slice(len(table) - nulls), table.slice(0, len(table) - nulls)]).combine_chunks()
    return table


class Block:
    """One block's documents, in order, with their distinct phrases and anchors."""

    def __init__(self, table: pa.Table, kind: Kind, parts: int):
        table = in_order(table)
        self.table, self.kind, self.n_parts = table, kind, parts
        self.number = int(table.column("block")[0].as_py()) if len(table) else 0
        self.data, self.offsets = text_buffer(table.column("text"))
        self.codes, self.docs = kind.code(self.data, self.offsets)
        p = self.phrases = phrases(self.codes, self.docs, kind.window, kind.gram, span=kind.span)
        # Distinct phrases in the order of their fingerprints: the first of each, and of every phrase its number.
        by = np.lexsort((p.check, p.whole))  # keeps the order of places among equals
        new = _heads(p.whole[by], p.check[by])
        self.one, self.of = by[new], np.empty(len(by), np.int64)
        self.of[by] = np.cumsum(new) - 1
        self.phrase_parts = key_bounds(p.whole[self.one], parts)
        # Distinct anchors of these, likewise.
        anchor = p.anchor[self.one]
        self.by_anchor = np.argsort(anchor, kind="stable")
        new = _heads(anchor[self.by_anchor])
        self.anchors = anchor[self.by_anchor][new]
        self.first_phrase = self.by_anchor[new]
        self.anchor_of = np.empty(len(anchor), np.int64)
        self.anchor_of[self.by_anchor] = np.cumsum(new) - 1
        self.anchor_parts = key_bounds(self.anchors, parts)
        self.doc_of = np.searchsorted(self.docs, p.first, "right") - 1

    def rows(self, doc: np.ndarray) -> list[np.ndarray]:
        """A table of the documents that entries refer to, and the references."""
        used, ref = np.unique(doc, return_inverse=True)
        ids = self.table.column("doc").combine_chunks().take(pa.array(used))
        return [used.astype(np.uint32), np.asarray(ids.is_valid()).astype(np.uint8), np.asarray(ids.fill_null(0), np.int64), ref.ravel().astype(np.uint32)]

    def send_index(self) -> list[tuple[int, int, bytes]]:
        p, out = self.phrases, []
        n = np.bincount(self.anchor_of, minlength=len(self.anchors)).astype(np.uint32)
        for i in np.flatnonzero(np.diff(self.anchor_parts)).tolist():
            cut = slice(self.anchor_parts[i], self.anchor_parts[i + 1])
            one = self.one[self.first_phrase[cut]]
            out.append((i, ANCHORS, pack(self.anchors[cut], p.whole[one], n[cut])))
        for i in np.flatnonzero(np.diff(self.phrase_parts)).tolist():
            one = self.one[self.phrase_parts[i] : self.phrase_parts[i + 1]]
            doc = self.doc_of[one]
            out.append((i, PHRASES, pack(p.whole[one], p.check[one], (p.first[one] - self.docs[doc]).astype(np.uint32), *self.rows(doc))))
        return out

    def read(self, answers: Answers) -> None:
        """Of distinct phrases: whether they occur earlier, and where; of anchors: 0 single, 1 shared, 2 hot."""
        self.repeated, self.row, self.start = np.zeros(len(self.one), bool), self.number << 24 | self.doc_of[self.one], self.phrases.first[self.one] - self.docs[self.doc_of[self.one]]
        for i, data in answers.phrases.items():
            _hits(data, self.phrase_parts[i], self.phrase_parts[i + 1], self.repeated, self.row, self.start)
        self.sharing = np.zeros(len(self.anchors), np.uint8)
        for i, data in answers.anchors.items():
            self.sharing[self.anchor_parts[i] : self.anchor_parts[i + 1]] = np.frombuffer(data, np.uint8)
        sharing = np.where(self.repeated, 0, self.sharing[self.anchor_of])
        by_symbols = (sharing == 1) if self.kind.resolve else np.zeros(len(sharing), bool)
        self.ask_symbols = self.by_anchor[by_symbols[self.by_anchor]]
        self.ask_windows = np.flatnonzero((sharing > 0) & ~by_symbols)
        self.symbol_parts = key_bounds(self.phrases.anchor[self.one[self.ask_symbols]], self.n_parts)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the windows to be looked up, in the order of their fingerprints, two of those, and bounds by part."""
        p, one = self.phrases, np.sort(self.one[self.ask_windows])
        starts = gather(p.first[one], p.last[one] - p.first[one] + 1)
        prints = [np.zeros(0, np.uint64), np.zeros(0, np.uint32)]
        most = 1 << 23
        for lo in range(0, len(self.codes) if len(starts) else 0, most):
            these = starts[np.searchsorted(starts, lo) : np.searchsorted(starts, lo + most)] - lo
            g = grams(self.codes[lo : lo + most + self.kind.window + self.kind.span], self.kind.gram, self.kind.span)
            prints = [np.concatenate(x) for x in zip(prints, window_prints(g, these, self.kind.window, self.kind.gram))]
        by = np.lexsort((starts, prints[1], prints[0]))
        return starts[by], prints[0][by], prints[1][by], key_bounds(prints[0][by], self.n_parts)

    def send_asked(self) -> list[tuple[int, int, bytes]]:
        p, out = self.phrases, []
        starts, a, b, parts = self.windows()
        doc = np.searchsorted(self.docs, starts, "right") - 1
        for i in np.flatnonzero(np.diff(parts)).tolist():
            cut = slice(parts[i], parts[i + 1])
            out.append((i, WINDOWS, pack(a[cut], b[cut], (starts[cut] - self.docs[doc[cut]]).astype(np.uint32), *self.rows(doc[cut]))))
        for i in np.flatnonzero(np.diff(self.symbol_parts)).tolist():
            one = self.one[self.ask_symbols[self.symbol_parts[i] : self.symbol_parts[i + 1]]]
            length, doc = p.last[one] - p.first[one] + self.kind.window, self.doc_of[one]
            out.append((i, SYMBOLS, pack(self.data[gather(p.first[one], length)], length.astype(np.uint32), (p.first[one] - self.docs[doc]).astype(np.uint32), *self.rows(doc))))
        return out

    def repeats(self, answers: Answers) -> Repeats:
        p, n = self.phrases, len(self.codes)
        found, row, start = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64)
        later = np.flatnonzero(self.repeated[self.of] | (self.one[self.of] != np.arange(len(self.of))))
        length = p.last[later] - p.first[later] + 1
        at = gather(p.first[later], length)
        found[at], row[at] = True, np.repeat(self.row[self.of[later]], length)
        start[at] = np.repeat(self.start[self.of[later]] - p.first[later], length) + at
        starts, _, _, parts = self.windows()
        hit, r, s = np.zeros(len(starts), bool), np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        for i, data in answers.windows.items():
            _hits(data, parts[i], parts[i + 1], hit, r, s)
        found[starts[hit]], row[starts[hit]], start[starts[hit]] = True, r[hit], s[hit]
        for i, data in answers.symbols.items():
            one = self.one[self.ask_symbols[self.symbol_parts[i] : self.symbol_parts[i + 1]]]
            length = p.last[one] - p.first[one] + 1
            bits = np.unpackbits(np.frombuffer(data, np.uint8))[: int(length.sum())].astype(bool)
            found[gather(p.first[one], length)[bits]] = True
        return Repeats(found, row, start)

    def covered(self, starts: np.ndarray) -> np.ndarray:
        """For each symbol whether one of the windows covers it."""
        n, w = len(self.codes), self.kind.window
        edge = np.zeros(n + 1, np.int32)
        at = np.flatnonzero(starts)
        edge[at] += 1
        np.subtract.at(edge, at + w, 1)
        return np.cumsum(edge[:-1]) > 0


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one or more kinds, each after its length in bytes."""
    out = b"".join(np.int64(a.nbytes).tobytes() + np.ascontiguousarray(a).tobytes() for a in arrays)
    return pa.compress(out, codec="zstd", asbytes=True) + np.int64(len(out)).tobytes()


def unpack(data: bytes, *kinds) -> list[np.ndarray]:
    raw = pa.decompress(data[:-8], int(np.frombuffer(data[-8:], np.int64)[0]), codec="zstd", asbytes=True)
    out, at = [], 0
    for kind in kinds:
        n = int(np.frombuffer(raw, np.int64, 1, at)[0])
        out.append(np.frombuffer(raw, kind, n // np.dtype(kind).itemsize, at + 8))
        at += 8 + n
    return out


def _hits(data: bytes, lo: int, hi: int, hit: np.ndarray, row: np.ndarray, start: np.ndarray) -> None:
    """Unpack the answers about entries lo to hi."""
    bits, rows, starts = unpack(data, np.uint8, np.int64, np.uint32)
    these = lo + np.flatnonzero(np.unpackbits(bits)[: hi - lo])
    hit[these], row[these], start[these] = True, rows, starts


_ROWS = (np.uint32, np.uint8, np.int64, np.uint32)


def _order(blocks: np.ndarray, got: list[list[np.ndarray]], starts: int) -> tuple[np.ndarray, np.ndarray]:
    """Of all entries, whose documents are in the last arrays of each payload: place in the corpus as one number, and row."""
    index, valid, ids = (np.concatenate([g[starts + 1 + i] for g in got]) for i in range(3))
    sizes = np.array([len(g[starts + 1]) for g in got])
    block = np.repeat(blocks, sizes)
    by = np.lexsort((index, block, ids, valid))
    rank = np.empty(len(by), np.uint64)
    rank[by] = np.arange(len(by), dtype=np.uint64)
    ref = np.concatenate([g[starts + 4].astype(np.int64) + base for g, base in zip(got, np.cumsum(sizes) - sizes)])
    return (rank[ref] << np.uint64(32)) | np.concatenate([g[starts] for g in got]).astype(np.uint64), (block << 24 | index.astype(np.int64))[ref]


def judge_first(blocks: np.ndarray, payloads: list[bytes]) -> list[bytes]:
    """Of each entry of phrases or windows: whether the same fingerprints stand at an earlier place, and where they are first."""
    got = [unpack(x, np.uint64, np.uint32, np.uint32, *_ROWS) for x in payloads]
    sizes = np.array([len(g[0]) for g in got])
    a, b = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
    place, row = _order(blocks, got, 2)
    by = np.lexsort((place, b, a))
    new = _heads(a[by], b[by])
    first = np.empty(len(by), np.int64)
    first[by] = by[new][np.cumsum(new) - 1]
    later = np.ones(len(by), bool)
    later[by[new]] = False
    start = (place & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    out = []
    for lo, hi in zip(np.cumsum(sizes) - sizes, np.cumsum(sizes)):
        source = first[lo:hi][later[lo:hi]]
        out.append(pack(np.packbits(later[lo:hi]), row[source], start[source]))
    return out


def judge_anchors(hot: int) -> Callable:
    def judge(blocks: np.ndarray, payloads: list[bytes]) -> list[bytes]:
        """Of each entry 0 if no other phrase has the anchor, 2 if more than `hot` may have it, else 1."""
        got = [unpack(x, np.uint64, np.uint64, np.uint32) for x in payloads]
        anchor, whole, n = (np.concatenate([g[i] for g in got]) for i in range(3))
        n = n.astype(np.int64)
        by = np.lexsort((whole, anchor))
        group = np.cumsum(_heads(anchor[by])) - 1
        kinds = np.bincount(group, weights=_heads(anchor[by], whole[by])) if len(by) else np.zeros(0)
        total, most = np.bincount(group, weights=n[by]), np.zeros(len(kinds), np.int64)
        np.maximum.at(most, group, n[by])
        state = np.empty(len(by), np.uint8)
        state[by] = np.where((kinds > 1) | (most > 1), np.where(total > hot, 2, 1), 0)[group]
        sizes = np.array([len(g[0]) for g in got])
        return [state[e - s : e].tobytes() for s, e in zip(sizes, np.cumsum(sizes))]

    return judge


def judge_symbols(kind: Kind) -> Callable:
    def judge(blocks: np.ndarray, payloads: list[bytes]) -> list[bytes]:
        """Bits of the windows of the phrases sent."""
        got = [unpack(x, np.uint8, np.uint32, np.uint32, *_ROWS) for x in payloads]
        sizes = np.array([len(g[1]) for g in got])
        symbols, length = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]).astype(np.int64)
        by = np.argsort(_order(blocks, got, 2)[0], kind="stable")
        bounds = np.concatenate([[0], np.cumsum(length[by])])
        hit = kind.resolve(Contexts(symbols[gather((np.cumsum(length) - length)[by], length[by])], bounds, kind.window))
        # Back to the order in which phrases were sent.
        n = length - kind.window + 1
        begin = np.empty(len(n), np.int64)
        begin[by] = np.cumsum(n[by]) - n[by]
        return [np.packbits(hit[gather(begin[e - s : e], n[e - s : e])]).tobytes() for s, e in zip(sizes, np.cumsum(sizes))]

    return judge


def _sources(table: pa.Table) -> dict[tuple[int, int, int], bytes]:
    of = [table.column(c).to_pylist() for c in ("phase", "part", "start", "n")]
    return {(row, start, n): payload.as_py() for phase, row, start, n, payload in zip(*of, table.column("payload")) if phase == SOURCES}


def repeated_windows(docs: DataFrame, kind: Kind, finish: Callable[[Block, Repeats], dict[str, pa.Array]], schema: str, extra: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 3 << 20, part_bytes: int = 24 << 20, hot: int = 100_000, reach: int | None = None, spans: Callable | None = None) -> DataFrame:
    """finish(block, repeats) of every block, as columns of the given schema.

    extra: columns of docs that come along, whatever they hold.  block_bytes: text held by a task at once.  part_bytes:
    text whose phrases an index part owns; the number of parts, a power of two, follows the input, so what a task holds
    does not grow with it.  hot: phrases of one anchor that may meet in one part.  reach: finish also gets the texts at the runs' first
    places, {(row, start, n): text of n symbols or fewer}, each `reach` symbols longer than its run; spans: (data, offsets) ->
    (starts, ends, n + 1 offsets) of the symbols in a block's bytes.
    """
    blocks, n_blocks = in_blocks(docs, id_col, text_col, extra or [], block_bytes)
    n_parts = 1 << int(np.ceil(np.log2(max(1, n_blocks * block_bytes / part_bytes))))
    message = "block long, part long, phase int, payload binary"
    kinds = {"block": pa.int64(), "part": pa.int64(), "phase": pa.int32(), "payload": pa.binary()}
    carried = [f for f in blocks.schema.fields if f.name not in ("block", "hash", "text")]
    bare = blocks.select("block", "doc", "hash", "text")
    judges = {ANCHORS: judge_anchors(hot), PHRASES: judge_first, WINDOWS: judge_first, SYMBOLS: judge_symbols(kind)}

    def rows(block, sent: list[tuple[int, int, bytes]]) -> pa.Table:
        part, phase, payload = ([x[i] for x in sent] for i in range(3))
        return pa.table({k: pa.array(v, kinds[k]) for k, v in (("block", [block] * len(sent)), ("part", part), ("phase", phase), ("payload", payload))})

    def send_index(table: pa.Table) -> pa.Table:
        return rows(table.column("block")[0].as_py(), Block(table, kind, n_parts).send_index())

    def judge(table: pa.Table) -> pa.Table:
        numbers, payload = table.column("block").to_numpy(), table.column("payload")
        phase = table.column("phase")[0].as_py()
        return table.set_column(table.schema.get_field_index("payload"), "payload", pa.array(judges[phase](numbers, [x.as_py() for x in payload]), pa.binary()))

    def send_asked(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return rows(0, [])
        b = Block(left, kind, n_parts)
        b.read(Answers.of(right))
        return rows(b.number, b.send_asked())

    def end(left: pa.Table, right: pa.Table) -> pa.Table:
        b, answers = Block(left, kind, n_parts), Answers.of(right)
        b.read(answers)
        more = () if reach is None else (_sources(right),)
        made = {f: b.table.column(f) for f in names} | finish(b, b.repeats(answers), *more)
        return pa.table({f: made[f] for f in out.names})

    names = [f.name for f in carried]
    sent = bare.groupBy("block").applyInArrow(send_index, message)
    first = stage(sent.groupBy("phase", "part").applyInArrow(judge, message), "phrases")
    asked = bare.groupBy("block").cogroup(first.groupBy("block")).applyInArrow(send_asked, message)
    second = stage(asked.groupBy("phase", "part").applyInArrow(judge, message), "windows")
    answers = first.union(second)

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        """Each stretch of another place that the block's runs start from, once."""
        places = np.zeros((3, 0), np.int64)
        if len(left):
            b, found = Block(left, kind, n_parts), Answers.of(right)
            b.read(found)
            r = b.repeats(found)
            at, last = runs(r, b.docs)
            places = np.unique(np.stack([r.row[at], r.start[at], last - at + kind.window + reach]), axis=1)
        return pa.table({"source": places[0] >> 24, "row": places[0], "start": places[1], "n": places[2], "block": np.full(places.shape[1], b.number if len(left) else 0)})

    def tell(left: pa.Table, right: pa.Table) -> pa.Table:
        texts, where = [], right.select(["row", "start", "n"])
        if len(left) and len(right):
            data, offsets = text_buffer(in_order(left).column("text"))
            s, e, docs = spans(data, offsets)
            row, start, n = (where.column(c).to_numpy() for c in ("row", "start", "n"))
            lo = docs[row & 0xFFFFFF] + start
            hi = np.minimum(lo + n, docs[(row & 0xFFFFFF) + 1])
            texts = [data[a:z].tobytes() for a, z in zip(s[lo].tolist(), e[hi - 1].tolist())]
        return where.slice(0, len(texts)).append_column("payload", pa.array(texts, pa.binary()))

    if reach is not None:
        asked = stage(bare.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(ask, "source long, row long, start long, n long, block long"), "asked")
        told = bare.groupBy("block").cogroup(asked.drop("block").distinct().groupBy("source")).applyInArrow(tell, "row long, start long, n long, payload binary")
        given = asked.join(told, ["row", "start", "n"]).select("block", F.col("row").alias("part"), F.lit(SOURCES).alias("phase"), "payload", "start", "n")
        answers = answers.unionByName(given, allowMissingColumns=True)
    out = T.StructType([*carried, *T.StructType.fromDDL(schema).fields])
    ended = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(end, out)
    return ended.toDF(id_col, *(extra or []), *[f.name for f in out.fields[len(carried) :]])
