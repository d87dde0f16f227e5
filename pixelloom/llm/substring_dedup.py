"""Substring dedup by relative Lempel-Ziv parsing.

The corpus itself, cut in blocks of documents, is the reference.  All blocks are indexed by content (see repeats): the
index tells, for every window of `window` words, the first place in the corpus where its words start, and the words at those
places come to the block that asks.  A document is then parsed greedily: at a word whose window has an earlier source the
factor runs on for as long as the words there and here are the same, word by word; other words are literals.  A factor
of at least `window` words is a duplicate span; a source that turns out to be shorter gives none.  At a factor's end only the
windows that straddle it are looked at again: the first of them with a source opens the next factor, which overlaps the one
before, so a repeat that greedy factoring would cut in two is still found.  Spans are what the factors cover: exactly
the words covered by windows that start earlier in the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SPACED, gather, strings, word_codes, word_spans
from .repeats import Block, Kind, Repeats, repeated_windows, runs

#: Words that a factor may run on beyond the place where first places change; there the next one opens with a source of its own.
REACH = 64


def factors(codes: np.ndarray, docs: np.ndarray, r: Repeats, sources: dict[tuple[int, int, int], bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each greedy factor of the documents, which begin at docs (n + 1 offsets).

    r: windows that have sources, and where; sources: the words at the first place of each run of such windows.
    """
    first, last = runs(r, docs)
    keys = list(zip(r.row[first].tolist(), r.start[first].tolist(), (last - first + window + REACH).tolist()))
    used = {k: i for i, k in enumerate(dict.fromkeys(k for k in keys if k in sources))}
    data = np.frombuffer(b"".join(sources[k] for k in used), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(sources[k]) for k in used], dtype=np.int64)])
    s, e, at = word_spans(data, offsets, SPACED)
    there = word_codes(data, s, e)
    ends = docs[np.searchsorted(docs, first, "right")]  # of the document of each run
    starts, stops, done, at = [], [], -1, at.tolist()
    for i, z, key, end in zip(first.tolist(), last.tolist(), keys, ends.tolist()):
        number = used.get(key)
        if number is None:
            continue
        # Windows that start before `done` lie in the factor before, if that is of this document.
        here = max(i, done)
        while here <= z:
            source = there[at[number] + here - i : at[number + 1]]
            n = min(len(source), end - here)
            same = source[:n] == codes[here : here + n]
            length = n if same.all() else int(np.argmin(same))
            if length >= window:
                starts.append(here)
                stops.append(here + length)
                done = here = here + length - window + 1
            else:
                here += 1
    return np.array(starts, np.int64), np.array(stops, np.int64)


def factored(block: Block, r: Repeats, sources: dict) -> tuple[np.ndarray, np.ndarray]:
    """Whether each word lies in a factor, and the number of factors of each document."""
    first, stop = factors(block.codes, block.docs, r, sources, block.kind.window)
    edge = np.zeros(len(block.codes) + 1, np.int32)
    np.add.at(edge, first, 1)
    np.subtract.at(edge, stop, 1)
    return np.cumsum(edge[:-1]) > 0, np.diff(np.searchsorted(first, block.docs))


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, docs = word_spans(data, offsets, SPACED)
    return word_codes(data, starts, ends), docs


def _runs(flag: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of flagged symbols within documents: first, one past the last, and n + 1 offsets by document."""
    before = np.zeros(len(flag), bool)
    before[1:] = flag[:-1]
    after = np.zeros(len(flag), bool)
    after[:-1] = flag[1:]
    cut = docs[:-1][np.diff(docs) > 0]
    before[cut] = False
    after[cut[1:] - 1] = False
    first, last = np.flatnonzero(flag & ~before), np.flatnonzero(flag & ~after) + 1
    return first, last, np.searchsorted(first, docs)


def span_lists(flag: np.ndarray, docs: np.ndarray) -> pa.Array:
    """Of each document its spans, counted from its own start, ends exclusive."""
    first, last, at = _runs(flag, docs)
    base = np.repeat(docs[:-1], np.diff(at))
    pairs = pa.StructArray.from_arrays([pa.array(first - base), pa.array(last - base)], ["first", "last"])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pairs)


def per_document(flag: np.ndarray, docs: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flag)])
    return total[docs[1:]] - total[docs[:-1]]


def _layout(block: Block, gone: np.ndarray) -> pa.Array:
    """The texts without the removed words and the white space that follows them; what stays, stays as it was."""
    s, e, docs = word_spans(block.data, block.offsets, SPACED)
    until = np.append(s[1:], len(block.data))
    last = docs[1:][np.diff(docs) > 0] - 1
    until[last] = e[last]  # the white space at a text's end stays
    edge = np.zeros(len(block.data) + 1, np.int8)
    edge[s[gone]] += 1
    np.subtract.at(edge, until[gone], 1)
    cut = np.cumsum(edge[:-1], dtype=np.int8) > 0
    return strings(block.data[~cut], block.offsets - np.concatenate([[0], np.cumsum(cut)])[block.offsets])


def _finish(block: Block, r: Repeats, sources: dict, layout: bool = False) -> dict[str, pa.Array]:
    gone, n_factors = factored(block, r, sources)
    data = np.append(block.data, np.uint8(32))
    s, e, docs = word_spans(block.data, block.offsets, SPACED)
    keep = np.flatnonzero(~gone)
    length = e[keep] - s[keep] + 1
    out = data[gather(s[keep], length)]
    ends = np.cumsum(length)
    out[ends - 1] = 32
    kept_at = np.searchsorted(keep, docs)
    at = np.concatenate([[0], ends])[kept_at]
    # The space after a document's last word is not part of it.
    drop = at[1:][np.diff(kept_at) > 0] - 1
    out = np.delete(out, drop)
    at = at - np.concatenate([[0], np.cumsum(np.diff(kept_at) > 0)])
    return {"n_words": pa.array(np.diff(docs), pa.int64()), "n_removed": pa.array(per_document(gone, docs), pa.int64()), "kept": _layout(block, gone) if layout else strings(out, at), "spans": span_lists(gone, docs), "n_factors": pa.array(n_factors, pa.int64())}


def _finish_layout(block: Block, r: Repeats, sources: dict) -> dict[str, pa.Array]:
    return _finish(block, r, sources, True)


def _spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return word_spans(data, offsets, SPACED)


def substring_dedup(docs: DataFrame, window: int = 20, layout: bool = False, with_factors: bool = False, id_col: str = "doc_id", text_col: str = "text", extra: list[str] | None = None, **sizes: int) -> DataFrame:
    """(id, extra columns, n_words, n_removed, kept, spans[, n_factors]) of each document.

    Words are maximal runs of bytes other than space and \\x09-\\x0D.  kept: the words outside duplicate spans, joined by
    one space, or with layout=True the text itself without the others; spans: the duplicate spans as word numbers from 0,
    ends exclusive; n_factors: the factors that they come from.  Earlier means a smaller id, or the same document and an
    earlier start; rows that share an id have a fixed order that their texts decide, and one of wholly equal rows keeps
    its words.  Null or empty text: no words, kept is empty.  Null ids come before all others; ids are cast to long.
    Words are compared by 64-bit and windows by 96-bit fingerprints, which mix after every step.
    """
    kind = Kind(window, max(1, min(8, window // 2)), _words)
    schema = "n_words long, n_removed long, kept string, spans array<struct<first:long,last:long>>" + (", n_factors long" if with_factors else "")
    return repeated_windows(docs, kind, _finish_layout if layout else _finish, schema, extra, id_col, text_col, reach=REACH, spans=_spans, **sizes)
