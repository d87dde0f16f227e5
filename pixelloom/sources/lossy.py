"""JPEG and GIF files written from rasters with NumPy, so that executors need no image library."""

from __future__ import annotations

import heapq
import struct

import numpy as np

#: The example quantisation tables of ITU T.81, annex K, for luminance and colour difference.
LUMA = [
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
]
CHROMA = [
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
]
#: Rows of the 8-point cosine transform, and the order of coefficients along the diagonals, in turns.
_K = np.arange(8)
COSINE = np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16) * np.where(_K[:, None] == 0, np.sqrt(1 / 8), 0.5)
ZIGZAG = np.array(sorted(range(64), key=lambda p: (p // 8 + p % 8, p // 8 if (p // 8 + p % 8) % 2 else p % 8)))


def on_white(raster: np.ndarray) -> np.ndarray:
    """(h, w, 3) of a raster (h, w, 4: a, r, g, b) over white."""
    a = raster[..., :1] / 255.0
    return np.floor(raster[..., 1:] * a + 255 * (1 - a) + 0.5)


def code_lengths(counts: np.ndarray) -> dict[int, int]:
    """Lengths of a Huffman code of at most 16 bits for the symbols that occur, none of whose codes is all ones."""
    used = np.flatnonzero(counts)
    heap = [(int(counts[s]), int(s), (int(s),)) for s in used] + [(0, 256, (256,))]  # the rarest one keeps the last code free
    heapq.heapify(heap)
    depth = dict.fromkeys([*used.tolist(), 256], 0)
    if len(heap) == 2:
        return {int(used[0]): 1}
    while len(heap) > 1:
        (n, s, a), (m, t, b) = heapq.heappop(heap), heapq.heappop(heap)
        for x in a + b:
            depth[x] += 1
        heapq.heappush(heap, (n + m, max(s, t), a + b))
    order = sorted(depth, key=lambda x: (depth[x], x == 256, -int(counts[x]) if x < 256 else 0))
    have = np.bincount([depth[x] for x in order], minlength=40)
    for i in range(len(have) - 1, 16, -1):  # two of the longest make room beside a shorter one
        while have[i]:
            j = next(k for k in range(i - 2, 0, -1) if have[k])
            have[i] -= 2
            have[i - 1] += 1
            have[j + 1] += 2
            have[j] -= 1
    lengths = np.repeat(np.arange(len(have)), have)
    return {x: int(n) for x, n in zip(order, lengths) if x != 256}


def _codes(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Code and length by symbol, and the table as a file holds it."""
    symbols = sorted(lengths, key=lambda s: (lengths[s], s))
    code, size, at, last = np.zeros(256, np.int64), np.zeros(256, np.int64), 0, 0
    for s in symbols:
        at <<= lengths[s] - last
        last = lengths[s]
        code[s], size[s] = at, last
        at += 1
    return code, size, bytes(np.bincount(list(lengths.values()), minlength=17)[1:17].tolist()) + bytes(symbols)


def pack_bits(value: np.ndarray, size: np.ndarray, fill: int) -> bytes:
    """The lowest size[i] bits of each value, high bits first, the last byte filled up."""
    ends = np.cumsum(size)
    place = np.repeat(ends, size) - 1 - np.arange(int(ends[-1]) if len(ends) else 0)
    bits = ((np.repeat(value, size) >> place) & 1).astype(np.uint8)
    return np.packbits(np.concatenate([bits, np.full(-len(bits) % 8, fill, np.uint8)])).tobytes()


def _category(v: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(np.abs(v) + 1)).astype(np.int64)


def write_jpeg(raster: np.ndarray, quality: float = 0.75) -> bytes:
    """A baseline JPEG, colours at full resolution, flattened on white; quality 0 to 1.  Its code tables fit the image."""
    h, w, _ = raster.shape
    if not (0 < w < 1 << 16 and 0 < h < 1 << 16):
        raise ValueError(f"too large for JPEG: {w}x{h}")
    percent = min(max(round(quality * 100), 1), 100)
    factor = 5000 / percent if percent < 50 else 200 - 2 * percent
    tables = [np.clip(np.floor((np.array(t) * factor + 50) / 100), 1, 255).astype(np.int64) for t in (LUMA, CHROMA)]
    r, g, b = np.moveaxis(np.pad(on_white(raster), ((0, -h % 8), (0, -w % 8), (0, 0)), "edge"), 2, 0)
    luma = 0.299 * r + 0.587 * g + 0.114 * b
    planes = [luma - 128, (b - luma) / 1.772, (r - luma) / 1.402]
    blocks = np.stack([p.reshape(p.shape[0] // 8, 8, -1, 8).swapaxes(1, 2).reshape(-1, 8, 8) for p in planes], axis=1)
    spectrum = (COSINE @ blocks @ COSINE.T).reshape(-1, 3, 64)
    c = np.stack([np.rint(spectrum[:, k] / tables[min(k, 1)]) for k in range(3)], axis=1).astype(np.int64)[..., ZIGZAG]
    steps = np.diff(c[..., 0], axis=0, prepend=0)  # constant parts as steps from block to block
    c, kind = c.reshape(-1, 64), np.minimum(np.arange(c.shape[0] * 3) % 3, 1)
    steps = steps.reshape(-1)
    # Entries (place, table, symbol, value, bits): constant parts, runs of zeros, values after a run, ends of blocks.
    row, k = np.nonzero(c[:, 1:])
    k = k + 1
    before = np.where(np.concatenate([[True], row[1:] != row[:-1]])[: len(row)], 0, np.concatenate([[0], k[:-1]])[: len(k)])
    run, value = k - before - 1, c[row, k]
    far = np.repeat(np.arange(len(row)), run // 16)
    last = np.zeros(len(c), np.int64)
    np.maximum.at(last, row, k)
    short = np.flatnonzero(last < 63)
    zero = lambda n: np.zeros(n, np.int64)
    place = np.concatenate([np.arange(len(c)) * 256, row[far] * 256 + k[far] * 2, row * 256 + k * 2 + 1, short * 256 + 255])
    table = np.concatenate([kind * 2, kind[row[far]] * 2 + 1, kind[row] * 2 + 1, kind[short] * 2 + 1])
    symbol = np.concatenate([_category(steps), zero(len(far)) + 0xF0, run % 16 << 4 | _category(value), zero(len(short))])
    extra = np.concatenate([steps, zero(len(far)), value, zero(len(short))])
    bits = np.concatenate([_category(steps), zero(len(far)), _category(value), zero(len(short))])
    by = np.argsort(place, kind="stable")
    table, symbol, extra, bits = table[by], symbol[by], extra[by], bits[by]
    extra = np.where(extra < 0, extra + (1 << bits) - 1, extra)
    made = [_codes(code_lengths(np.bincount(symbol[table == t], minlength=257))) for t in range(4)]
    code, size = np.stack([m[0] for m in made])[table, symbol], np.stack([m[1] for m in made])[table, symbol]
    data = pack_bits(code << bits | extra, size + bits, 1).replace(b"\xff", b"\xff\0")
    segment = lambda marker, body: struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body
    return b"".join([
        b"\xff\xd8", segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"), *[segment(0xDB, bytes([i]) + bytes(t[ZIGZAG].tolist())) for i, t in enumerate(tables)],
        segment(0xC0, struct.pack(">BHHB", 8, h, w, 3) + b"\1\x11\0\2\x11\1\3\x11\1"), *[segment(0xC4, bytes([t % 2 << 4 | t // 2]) + m[2]) for t, m in enumerate(made)],
        segment(0xDA, b"\3\1\0\2\x11\3\x11\0\x3f\0"), data, b"\xff\xd9",
    ])


def _lzw(index: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of a sequence of palette numbers and the bits of each."""
    clear = 1 << width
    codes, sizes, known, size = [clear], [width + 1], {}, width + 1
    at = None
    for v in index.tolist():
        longer = known.get((at, v)) if at is not None else v
        if longer is not None:
            at = longer
            continue
        codes.append(at)
        sizes.append(size)
        number = clear + 2 + len(known)
        if number < 4096:
            known[at, v] = number
            size += number == 1 << size
        else:
            codes.append(clear)
            sizes.append(size)
            known, size = {}, width + 1
        at = v
    if at is not None:
        codes.append(at)
        sizes.append(size)
        size += clear + 2 + len(known) == 1 << size and size < 12
    return np.array([*codes, clear + 1]), np.array([*sizes, size])


def write_gif(raster: np.ndarray) -> bytes:
    """A GIF of one picture with at most 256 colours, reduced to that if there are more; alpha below 128 is transparent."""
    from pixelloom.operators.kernels import Options, quantize_histogram

    h, w, _ = raster.shape
    if not (0 < w < 1 << 16 and 0 < h < 1 << 16):
        raise ValueError(f"too large for GIF: {w}x{h}")
    opaque = raster[..., 0] >= 128
    flat = np.where(opaque[..., None], raster[..., 1:], 0).astype(np.int64)
    key = np.where(opaque, (1 << 24) | flat[..., 0] << 16 | flat[..., 1] << 8 | flat[..., 2], 0).ravel()
    colors, first, of, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort(first, kind="stable")
    alpha = np.where(colors > 0, 255, 0)
    sums = np.stack([(colors >> s & 255) * alpha for s in (16, 8, 0)] + [alpha], axis=1) * count[:, None]
    pal, label, _ = quantize_histogram(count[order], sums[order].astype(float), Options(importance=0))
    entry = np.empty(len(colors), np.int64)
    entry[order] = label
    index = entry[of.ravel()]
    width = max(2, (len(pal) - 1).bit_length())
    table = np.zeros((1 << width, 3), np.uint8)
    table[: len(pal)] = pal[:, 1:]
    clear = np.flatnonzero(pal[:, 0] < 128)
    codes, sizes = _lzw(index, width)
    # GIF packs from the low bit: bits and bytes are mirrored.
    ends = np.cumsum(sizes)
    bits = ((np.repeat(codes, sizes) >> (np.arange(ends[-1]) - np.repeat(ends - sizes, sizes))) & 1).astype(np.uint8)
    data = np.packbits(bits, bitorder="little").tobytes()
    parts = b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255))
    control = b"!\xf9\4" + struct.pack("<BHB", 1, 0, clear[0]) + b"\0" if len(clear) else b""
    return b"GIF89a" + struct.pack("<HHBBB", w, h, 0x80 | 0x70 | width - 1, 0, 0) + table.tobytes() + control + b"," + struct.pack("<HHHHB", 0, 0, w, h, 0) + bytes([width]) + parts + b"\0;"
