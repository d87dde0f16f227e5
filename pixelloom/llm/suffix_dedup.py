"""Suffix-array dedup: bytes covered by a window of 100 bytes that starts earlier, found in blockwise sorted suffixes.

The phrases that can hold such windows (see repeats) are dealt to index parts; a part lays them end to end and builds
its suffix order the blockwise way: a difference-cover sample of positions (7 or 8 of every 32) is ranked first; then one
bucket of suffixes with neighbouring first bytes is sorted at a time.  A bucket's suffixes are compared on their first
and last 32 bytes alone.  Ties go to the sample: for any two positions there is a shift below 32 that puts both in the
cover, so one comparison of two ranks settles the bytes between.  Memory: the part's text, the sample's ranks and one
bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import eight, gather, strings
from .repeats import Block, Contexts, Kind, Repeats, repeated_windows
from .substring_dedup import per_document, span_lists

PERIOD = 32


def difference_cover(period: int) -> np.ndarray:
    """Residues such that each difference modulo period is one of two of them, grown greedily."""
    cover = [0, 1]
    left = set(range(period)) - {0, 1, period - 1}
    while left:
        gain = lambda x: len(left & {d for c in cover for d in ((x - c) % period, (c - x) % period)})
        best = max((x for x in range(period) if x not in cover), key=lambda x: (gain(x), -x))
        left -= {d for c in cover for d in ((best - c) % period, (c - best) % period)}
        cover.append(best)
    return np.array(sorted(cover))


def _shifts(period: int, cover: np.ndarray) -> np.ndarray:
    """shift[x, y]: the least d with x + d and y + d both in the cover, modulo period."""
    inside = np.isin(np.arange(period), cover)
    table = np.zeros((period, period), np.int64)
    for x in range(period):
        for y in range(period):
            table[x, y] = next(d for d in range(period) if inside[(x + d) % period] and inside[(y + d) % period])
    return table


COVER = difference_cover(PERIOD)
SHIFT = _shifts(PERIOD, COVER)


def _leading(text: np.ndarray) -> np.ndarray:
    """Of each position the next 8 bytes as a number that orders as they do."""
    n = len(text) - 7
    out = np.zeros(n, np.uint64)
    for i in range(8):
        out |= text[i : i + n].astype(np.uint64) << np.uint64(56 - 8 * i)
    return out


def _dense(order: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
    """True where a sorted row differs from the one before."""
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = False
        for k in keys:
            s = k[order]
            new[1:] |= s[1:] != s[:-1]
    return new


def sample_ranks(lead: np.ndarray, size: int, n: int) -> np.ndarray:
    """Ranks, among the cover's positions up to n, of the stretches of the given size; -1 elsewhere."""
    at = np.flatnonzero(np.isin(np.arange(n) % PERIOD, COVER))
    steps = [*range(0, size - 7, 8)]
    if steps[-1] != size - 8:
        steps.append(size - 8)
    keys = [lead[at + s] for s in steps]
    order = np.lexsort(keys[::-1])
    out = np.full(n, -1, np.int32)
    out[at[order]] = np.cumsum(_dense(order, keys)) - 1
    return out


def sort_buckets(c: Contexts, bucket: int = 1 << 18) -> np.ndarray:
    """Windows of the phrases that start earlier in another phrase."""
    n = np.diff(c.bounds) - c.window + 1
    starts = gather(c.bounds[:-1], n)
    hit = np.zeros(len(starts), bool)
    if not len(starts):
        return hit
    text = np.concatenate([c.symbols, np.zeros(c.window + PERIOD + 8, np.uint8)])
    lead = _leading(text)
    rank = sample_ranks(lead, c.window - PERIOD, len(c.symbols) + PERIOD)
    first_bytes = lead[starts]
    by = np.argsort(first_bytes, kind="stable")
    change = np.flatnonzero(np.diff(first_bytes[by])) + 1  # buckets end where the first 8 bytes change
    lo = 0
    while lo < len(by):
        at = np.searchsorted(change, lo + bucket, "right")
        hi = len(by) if at == len(change) and len(by) - lo <= bucket else int(change[max(at - 1, 0)]) if at and change[at - 1] > lo else int(change[at]) if at < len(change) else len(by)
        these = np.sort(by[lo:hi])
        hit[these] = _sort_bucket(starts[these], lead, rank, c.window)
        lo = hi
    return hit


def _sort_bucket(p: np.ndarray, lead: np.ndarray, rank: np.ndarray, window: int) -> np.ndarray:
    """p in the order of the corpus; true for those whose window an earlier one has too."""
    steps = [*range(0, PERIOD, 8), *range(window - PERIOD, window, 8)]
    keys = [lead[p + s] for s in steps]
    order = np.lexsort(keys[::-1])  # stable: among equals the corpus decides
    q = p[order]
    new = _dense(order, keys)
    hit = np.zeros(len(p), bool)
    group = np.cumsum(new) - 1
    left = np.flatnonzero(np.bincount(group)[group] > 1)  # ties on the bytes compared so far
    while len(left):
        g = group[left]
        head = np.ones(len(left), bool)
        head[1:] = g[1:] != g[:-1]
        rep = left[head][np.cumsum(head) - 1]
        d = SHIFT[q[left] % PERIOD, q[rep] % PERIOD]
        same = rank[q[left] + d] == rank[q[rep] + d]
        hit[order[left[same & ~head]]] = True
        left = left[~same]
    return hit


def _codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return eight(data)[: len(data)].copy(), offsets


def _finish(block: Block, r: Repeats) -> dict[str, pa.Array]:
    gone = block.covered(r.starts)
    spans = span_lists(gone, block.offsets)
    at = block.offsets - np.concatenate([[0], np.cumsum(gone)])[block.offsets]
    return {
        "n_bytes": pa.array(np.diff(block.offsets), pa.int64()),
        "n_removed": pa.array(per_document(gone, block.offsets), pa.int64()),
        "kept": strings(block.data[~gone], at, pa.binary()),
        "spans": spans,
    }


def suffix_dedup(docs: DataFrame, window: int = 100, id_col: str = "doc_id", text_col: str = "text", extra: list[str] | None = None, **sizes: int) -> DataFrame:
    """(id, extra columns, n_bytes, n_removed, kept, spans) of each document, whose text counts as UTF-8 bytes.

    kept: binary, the bytes that no repeated window covers (cuts may fall within a character); spans: the bytes removed,
    from 0, ends exclusive.  Earlier means a smaller id, or the same document and an earlier start; rows that share an id
    have a fixed order that their texts decide.  Null or empty text: no bytes.  Null ids come before all others; ids are cast to long.  window: 64 at least.
    """
    if window < 2 * PERIOD:
        raise ValueError(f"window must be {2 * PERIOD} or more")
    kind = Kind(window, 32, _codes, 8, sort_buckets)
    return repeated_windows(docs, kind, _finish, "n_bytes long, n_removed long, kept binary, spans array<struct<first:long,last:long>>", extra, id_col, text_col, **sizes)
