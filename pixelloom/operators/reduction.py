"""Colour reduction of many small histograms at once: what kernels.quantize_histogram does with one, step by step for all.

Images are independent, so each round cuts one box of every image that still has one to cut.  All sums run in the order of the
one-image kernel, so results are equal to the last bit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .kernels import Options, quantize_histogram

#: Buckets up to which a histogram shares its rounds with others; larger ones fill arrays by themselves.
SMALL = 1 << 12
#: Buckets, or what else is counted, of the images that are worked on together.
SHARED = 1 << 16
#: Places of boxes, padded to one length, that are weighed in one go: the arrays of a go stay in a core's cache.
GO = 1 << 13


def shares(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of images of SHARED buckets at most, or of one image, from the ends of their lists."""
    lo = 0
    while lo < len(ends) - 1:
        hi = max(int(np.searchsorted(ends, ends[lo] + SHARED, "right")) - 1, lo + 1)
        yield lo, hi
        lo = hi


def quantize_histograms(cnt: np.ndarray, sums: np.ndarray, ends: np.ndarray, o: Options) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(palettes (m, 4) on end, entries in each, entry of each bucket) of histograms on end: number i is ends[i] to ends[i + 1]."""
    n, size = len(ends) - 1, np.diff(ends)
    large, parts = set(np.flatnonzero(size > SMALL).tolist()), []
    lo = 0
    while lo < n:
        hi = lo + 1 if lo in large else min((i for i in large if i > lo), default=n)
        cut = slice(ends[lo], ends[hi])
        if lo in large:
            pal, label, _ = quantize_histogram(cnt[cut], sums[cut], o)
            parts.append((pal, [len(pal)], label))
        else:
            parts.append(_shared(cnt[cut], sums[cut], ends[lo : hi + 1] - ends[lo], o))
        lo = hi
    return tuple(np.concatenate(p) for p in zip(*parts))


def _shared(cnt: np.ndarray, sums: np.ndarray, ends: np.ndarray, o: Options) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, size, k = len(ends) - 1, np.diff(ends), o.max_colors
    image = np.repeat(np.arange(n), size)
    label = np.arange(len(cnt)) - ends[image]
    many = np.flatnonzero(size > k)
    if len(many):
        some = size[image] > k
        label[some] = _reduce(cnt[some], sums[some], np.concatenate([[0], np.cumsum(size[many])]), o)
    # Entries as kernels.palette_of makes them; unused ones go, translucent ones lead.
    at = image * k + label
    add = lambda v: np.bincount(at, weights=v, minlength=n * k)
    c, total = add(cnt), np.stack([add(sums[:, t]) for t in range(4)], axis=1)
    a = np.clip(np.floor(total[:, 3] / np.maximum(c, 1) + 0.5), 0, 255)
    rgb = np.clip(np.floor(total[:, :3] / np.maximum(total[:, 3:], 1) + 0.5), 0, 255)
    pal = np.concatenate([a[:, None], rgb], axis=1)
    pal[(a == 0) | (total[:, 3] <= 0)] = 0
    used = np.bincount(at, minlength=n * k) > 0
    rank = np.where(used, pal[:, 0] == 255, 2).reshape(n, k)
    order = np.argsort(rank, axis=1, kind="stable")
    place = np.empty((n, k), np.int64)
    np.put_along_axis(place, order, np.arange(k)[None, :], 1)
    entries = used.reshape(n, k).sum(axis=1)
    kept = (order + np.arange(n)[:, None] * k)[np.arange(k) < entries[:, None]]
    return pal[kept].astype(np.int64), entries, place.ravel()[at]


def _reduce(cnt: np.ndarray, sums: np.ndarray, ends: np.ndarray, o: Options) -> np.ndarray:
    """kernels.reduce_colors of histograms that do not fit the palette: the entry of each bucket."""
    n, size, w = len(ends) - 1, np.diff(ends), cnt.astype(float)
    image = np.repeat(np.arange(n), size)
    p = (sums / w[:, None]).T.copy()
    p[:3] /= 255
    mass = np.concatenate([w[None], w * p])
    # The first clear bucket of an image has entry 0 to itself.
    first = np.zeros(n, np.int64)
    inner = np.ones(len(w), bool)
    if o.max_colors > 1:
        clear = np.flatnonzero(p[3] == 0)
        clear = clear[np.unique(image[clear], return_index=True)[1]]
        first[image[clear]], inner[clear] = 1, False
    # A box is a run of places, which hold its buckets in their order.
    held = np.flatnonzero(inner)
    limit = np.minimum(o.max_colors - first, size - first)
    width = int(limit.max())
    start, length = np.zeros((n, width), np.int64), np.zeros((n, width), np.int64)
    gain = np.full((n, width), -1.0)
    length[:, 0] = size - first
    start[:, 0] = np.cumsum(length[:, 0]) - length[:, 0]
    boxes, left = np.ones(n, np.int64), np.zeros(len(held), bool)

    def weigh(images, which):
        gain[images, which] = _best_cuts(p, mass, held, start[images, which], length[images, which], left)

    weigh(np.arange(n), np.zeros(n, np.int64))
    while True:
        pick = gain.argmax(axis=1)
        cut = np.flatnonzero((boxes < limit) & (gain[np.arange(n), pick] > 0))
        if not len(cut):
            break
        pick, new = pick[cut], boxes[cut]
        s, m = start[cut, pick], length[cut, pick]
        begin = np.cumsum(m) - m
        at = np.arange(int(m.sum())) + np.repeat(s - begin, m)
        goes, members = left[at], held[at]
        before = np.cumsum(goes) - goes
        lefts = np.add.reduceat(goes.astype(np.int64), begin)
        before -= np.repeat(before[begin], m)
        inside = at - np.repeat(s, m)
        held[np.repeat(s, m) + np.where(goes, before, np.repeat(lefts, m) + inside - before)] = members
        length[cut, pick], start[cut, new], length[cut, new] = lefts, s + lefts, m - lefts
        boxes[cut] += 1
        more = boxes[cut] < limit[cut]
        weigh(np.concatenate([cut[more], cut[more]]), np.concatenate([pick[more], new[more]]))
    label = np.zeros(len(w), np.int64)
    real = np.arange(width) < boxes[:, None]
    by = np.argsort(start[real], kind="stable")
    label[held] = np.repeat((np.nonzero(real)[1] + np.repeat(first, boxes))[by], length[real][by])

    k = width + 1
    centres = np.zeros((4, n * k))
    centres = _means(mass, image * k + label, centres)
    outside = (np.arange(k) >= (boxes + first)[:, None]).ravel()
    for _ in range(o.kmeans):
        moved = _assign(p, np.where(outside, np.inf, centres), first, label, image, k)
        if np.array_equal(moved, label):
            return label
        label = moved
        centres = _means(mass, image * k + label, centres)
    return _assign(p, np.where(outside, np.inf, centres), first, label, image, k) if o.kmeans else label


def _best_cuts(p: np.ndarray, mass: np.ndarray, held: np.ndarray, start: np.ndarray, length: np.ndarray, left: np.ndarray) -> np.ndarray:
    """kernels.best_cut of boxes: their gains; who goes left is set at the places of those that have one."""
    out = np.zeros(len(start))
    order = np.argsort(length, kind="stable")
    at = int(np.searchsorted(length[order], 2))
    while at < len(order):
        # Boxes of like length together, padded to the longest of them.
        low = int(length[order[at]])
        end = int(np.searchsorted(length[order], low + low // 4, "right"))
        end = min(end, at + max(GO // (low + low // 4), 1))
        some = order[at:end]
        out[some] = _go(p, mass, held, start[some], length[some], left)
        at = end
    return out


def _go(p, mass, held, start, length, left):
    b, n = len(start), int(length.max())
    inside = np.arange(n) < length[:, None]
    places = start[:, None] + np.where(inside, np.arange(n), 0)
    member = held[places]
    point = p.take(member, axis=1)
    low, high = point.min(axis=2, keepdims=True), point.max(axis=2, keepdims=True)
    point -= low
    point *= 255 / np.where(high > low, high - low, 1)
    bins = np.minimum(point, 255, out=point).astype(np.int32)
    # Bin and place in one number: a stable order by bin; what pads a box comes last.
    keys = np.sort(np.where(inside, bins * SMALL + np.arange(n, dtype=np.int32), np.int32(1 << 30)), axis=2)
    by, sorted_bins = keys & SMALL - 1, keys // SMALL
    by += (np.arange(b, dtype=np.int32) * n)[:, None]
    sums = mass.take(member.take(by), axis=1)
    np.cumsum(sums, axis=3, out=sums)
    total = np.cumsum(mass.take(member, axis=1), axis=2)[:, np.arange(b), length - 1][:, None, :, None]
    wl, wr = sums[0], total[0] - sums[0]
    ok = np.zeros(wl.shape, bool)
    np.not_equal(sorted_bins[..., 1:], sorted_bins[..., :-1], out=ok[..., :-1])
    ok[..., :-1] &= inside[:, 1:]
    ok &= (wl > 0) & (wr > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        apart = total[1:] - sums[1:]
        apart /= wr
        np.subtract(np.divide(sums[1:], wl, out=sums[1:]), apart, out=apart)
        apart *= apart
        gain = apart[0]
        for more in apart[1:]:
            gain += more
        gain *= wl * wr / total[0]
    ranked = np.round(gain, 6)
    ranked[~ok] = -1.0
    rows = np.arange(b)
    cuts = ranked.argmax(axis=2)
    axis = np.take_along_axis(ranked, cuts[..., None], 2)[..., 0].argmax(axis=0)
    cut = cuts[axis, rows]
    best = np.where(ok[axis, rows, cut], gain[axis, rows, cut], 0.0)
    left[places[inside]] = (bins[axis, rows] <= sorted_bins[axis, rows, cut][:, None])[inside]
    return np.where(best > 0, best, 0.0)


def _means(mass: np.ndarray, at: np.ndarray, centres: np.ndarray) -> np.ndarray:
    add = lambda v: np.bincount(at, weights=v, minlength=centres.shape[1])
    w = add(mass[0])
    return np.where(w > 0, np.stack([add(v) for v in mass[1:]]) / np.where(w > 0, w, 1), centres)


def _assign(p: np.ndarray, centres: np.ndarray, first: np.ndarray, label: np.ndarray, image: np.ndarray, k: int) -> np.ndarray:
    """kernels.assign against all of an image's centres, one number after the other: the nearest, the lowest among equals."""
    out, least = label.copy(), np.full(len(label), np.inf)
    led = first[image] == 1
    free = ~(led & (p[3] == 0))
    centres = centres.reshape(4, -1, k).transpose(2, 0, 1).copy()
    for i in range(k):
        d = centres[i].take(image, axis=1)
        np.subtract(p, d, out=d)
        d *= d
        far = d[0] + d[1] + d[2] + d[3]
        nearer = far < least
        nearer &= free
        if i == 0:
            nearer &= ~led
        np.copyto(least, far, where=nearer)
        np.copyto(out, i, where=nearer)
    return out
