"""PNG, written and read with zlib and NumPy."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Inflated profiles beyond this are taken for decompression bombs.
PROFILE_LIMIT = 1 << 23
#: Scanline bytes deflated as one segment at least.
SEGMENT = 1 << 20


def chunk(kind: bytes, data: bytes = b"") -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def chunks(content: bytes | None) -> Iterator[tuple[int, str, int, bytes]]:
    """(position, type, length, data) of the chunks that are whole; nothing for other bytes."""
    if not content or content[:8] != SIGNATURE:
        return
    at = 8
    while at + 12 <= len(content):
        (size,) = struct.unpack_from(">I", content, at)
        if at + 12 + size > len(content):
            return
        yield at, content[at + 4 : at + 8].decode("latin-1"), size, content[at + 8 : at + 8 + size]
        at += 12 + size


def depth(entries: int) -> int:
    return next(d for d in (1, 2, 4, 8) if entries <= 1 << d)


def _header(width: int, height: int, bits: int, kind: int) -> bytes:
    return chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, bits, kind, 0, 0, 0))


def _srgb() -> bytes:
    """sRGB with the perceptual intent, and the gamma that goes with it."""
    return chunk(b"sRGB", b"\0") + chunk(b"gAMA", struct.pack(">I", 45455))


def indexed(index: np.ndarray, palette: np.ndarray, level: int = 2) -> bytes:
    """A palette PNG of an index plane (h, w) and entries (n, 4: a, r, g, b), translucent ones first."""
    h, w = index.shape
    bits = depth(len(palette))
    per_byte = 8 // bits
    wide = np.zeros((h, -(-w // per_byte) * per_byte), np.uint8)
    wide[:, :w] = index
    packed = np.zeros((h, wide.shape[1] // per_byte), np.uint8)
    for i in range(per_byte):
        packed |= wide[:, i::per_byte] << np.uint8(8 - bits * (i + 1))
    lines = np.concatenate([np.zeros((h, 1), np.uint8), packed], axis=1)
    clear = np.flatnonzero(palette[:, 0] != 255)
    alpha = palette[: clear[-1] + 1, 0].astype(np.uint8).tobytes() if len(clear) else b""
    return SIGNATURE + _header(w, h, bits, 3) + _srgb() + chunk(b"PLTE", palette[:, 1:].astype(np.uint8).tobytes()) + (chunk(b"tRNS", alpha) if alpha else b"") + chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + chunk(b"IEND")


def _samples(raster: np.ndarray, alpha: bool) -> np.ndarray:
    """(h, w * bytes) scanlines of a raster (h, w, 4: a, r, g, b)."""
    order = [1, 2, 3, 0] if alpha else [1, 2, 3]
    return raster[..., order].astype(np.uint8).reshape(raster.shape[0], -1)


def filter_rows(lines: np.ndarray, bpp: int) -> np.ndarray:
    """Scanlines with the row filter of least cost, the first among equals, in front of each."""
    v = lines.astype(np.int16)
    left = np.zeros_like(v)
    left[:, bpp:] = v[:, :-bpp]
    up = np.zeros_like(v)
    up[1:] = v[:-1]
    corner = np.zeros_like(v)
    corner[1:] = left[:-1]
    p = left + up - corner
    dl, du, dc = abs(p - left), abs(p - up), abs(p - corner)
    paeth = np.where((dl <= du) & (dl <= dc), left, np.where(du <= dc, up, corner))
    tries = np.stack([v, v - left, v - up, v - (left + up) // 2, v - paeth]).astype(np.uint8)
    cost = np.minimum(tries, 256 - tries.astype(np.int32)).sum(axis=2)
    pick = cost.argmin(axis=0)
    rows = tries[pick, np.arange(len(v))]
    return np.concatenate([pick[:, None].astype(np.uint8), rows], axis=1)


def truecolor(index: np.ndarray, palette: np.ndarray, level: int = 2) -> bytes:
    """A true-colour PNG of palette entries; rows are filtered or not, whichever deflates smaller."""
    alpha = bool((palette[:, 0] != 255).any())
    lines = _samples(palette[index], alpha)
    plain = zlib.compress(np.concatenate([np.zeros((len(lines), 1), np.uint8), lines], axis=1).tobytes(), level)
    best = min(zlib.compress(filter_rows(lines, 4 if alpha else 3).tobytes(), level), plain, key=len)
    return SIGNATURE + _header(index.shape[1], index.shape[0], 8, 6 if alpha else 2) + _srgb() + chunk(b"IDAT", best) + chunk(b"IEND")


def segmented(raw: bytes, level: int, parts: int) -> bytes:
    """A zlib stream whose parts are deflated apart, all but the last ended by a sync flush."""
    cuts = [len(raw) * i // parts for i in range(parts + 1)]
    out = [b"\x78\x01"]
    for i in range(parts):
        c = zlib.compressobj(level, zlib.DEFLATED, -15)
        out += [c.compress(raw[cuts[i] : cuts[i + 1]]), c.flush(zlib.Z_FINISH if i == parts - 1 else zlib.Z_SYNC_FLUSH)]
    return b"".join(out) + struct.pack(">I", zlib.adler32(raw))


def fast(raster: np.ndarray, alpha: bool = True, level: int = 2) -> bytes:
    """A true-colour PNG of the pixels as they are, every row under the Up filter, deflated in segments."""
    lines = _samples(raster, alpha)
    up = lines.copy()
    up[1:] -= lines[:-1]
    raw = np.concatenate([np.full((len(up), 1), 2, np.uint8), up], axis=1).tobytes()
    if len(raw) > 2**31 - 9:
        raise ValueError(f"too large for one PNG buffer: {raster.shape[1]}x{raster.shape[0]}")
    return SIGNATURE + _header(raster.shape[1], raster.shape[0], 8, 6 if alpha else 2) + chunk(b"IDAT", segmented(raw, level, min(max(len(raw) // SEGMENT, 1), 8))) + chunk(b"IEND")


def joined_checksum(first: int, second: int, length: int) -> int:
    """Adler-32 of two stretches of bytes from those of each; length: of the second.

    The low half is 1 and the sum of all bytes; the high half sums the low one after each byte, so the first stretch's sum counts
    once more for each byte of the second.
    """
    base = 65521
    low = (first & 0xFFFF) + (second & 0xFFFF) - 1
    high = (first >> 16) + (second >> 16) + ((first & 0xFFFF) - 1) * length
    return high % base << 16 | low % base


def band(lines: np.ndarray, last: bool, level: int = 2) -> tuple[bytes, int, int]:
    """Some scanlines as a part of a deflate stream, with the Adler-32 and the number of the bytes in it.

    The first line is plain and the others are under the Up filter, so a band is read without the one before it.
    """
    up = lines.copy()
    up[1:] -= lines[:-1]
    kinds = np.full((len(up), 1), 2, np.uint8)
    kinds[0] = 0
    raw = np.concatenate([kinds, up], axis=1).tobytes()
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    return c.compress(raw) + c.flush(zlib.Z_FINISH if last else zlib.Z_SYNC_FLUSH), zlib.adler32(raw), len(raw)


def read_band(data: bytes, width: int, bands: int) -> np.ndarray:
    """The scanlines (h, width * bands) of what band() made."""
    raw = np.frombuffer(zlib.decompressobj(-15).decompress(data), np.uint8).reshape(-1, width * bands + 1)
    return np.cumsum(raw[:, 1:], axis=0, dtype=np.uint8)


def band_parts(width: int, height: int, sums: list[tuple[int, int]], alpha: bool = True) -> tuple[bytes, bytes]:
    """What comes before and after the IDAT chunks of the bands in their file; sums: checksum and length of each, in order."""
    total = 1
    for checksum, length in sums:
        total = joined_checksum(total, checksum, length)
    return SIGNATURE + _header(width, height, 8, 6 if alpha else 2) + chunk(b"IDAT", b"\x78\x01"), chunk(b"IDAT", struct.pack(">I", total)) + chunk(b"IEND")


def from_bands(width: int, height: int, bands: list[tuple[bytes, int, int]], alpha: bool = True) -> bytes:
    """One file of all bands of an image, in order; each is an IDAT chunk of its own."""
    total = 1
    for _, checksum, length in bands:
        total = joined_checksum(total, checksum, length)
    data = [d for d, _, _ in bands]
    data[0] = b"\x78\x01" + data[0]
    data[-1] += struct.pack(">I", total)
    return SIGNATURE + _header(width, height, 8, 6 if alpha else 2) + b"".join(chunk(b"IDAT", d) for d in data) + chunk(b"IEND")


#: Fixed values of the PNG format: first column and row, and steps, of the seven passes of interlaced images.
ADAM7 = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


class _Inflated:
    """Bytes of a zlib stream in parts, inflated as they are asked for."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.inflate, self.held = iter(parts), zlib.decompressobj(), bytearray()

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            data = self.inflate.unconsumed_tail or next(self.parts, None)
            if data is None:
                raise ValueError("too few pixels")
            self.held += self.inflate.decompress(data, max(n, 1 << 16))
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def _values(line: np.ndarray, n: int, bits: int, bands: int, shift: bool) -> np.ndarray:
    """Samples (n, bands) of a scanline, as 8 bits; palette numbers (bits below 8 and shift None) as they are."""
    if bits == 16:
        return line.reshape(n, bands, 2)[..., 0]
    if bits == 8:
        return line.reshape(n, bands)
    flat = np.unpackbits(line).reshape(-1, bits)
    value = (flat * (1 << np.arange(bits - 1, -1, -1))).sum(axis=1)[: n * bands].reshape(n, bands)
    return value if shift is None else value << (8 - bits) if shift else value * 255 // ((1 << bits) - 1)


def decode(content: bytes, step: int = 1, shift: bool = False) -> np.ndarray:
    """(h, w, 4: a, r, g, b) of a PNG, interlaced or not; 16-bit samples are cut to 8, smaller ones scaled, or shifted if asked for.

    step: every step-th pixel of every step-th row.  Scanlines are inflated one by one and the others are let go, so a
    thumbnail of a large image holds no more than itself and two scanlines.
    """
    found = list(chunks(content))
    if not found or found[0][1] != "IHDR":
        raise ValueError("not a PNG")
    w, h, bits, kind, _, _, interlace = struct.unpack(">IIBBBBB", found[0][3])
    bands = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    bpp = max(1, bands * bits // 8)
    data = _Inflated([d for _, t, _, d in found if t == "IDAT"])
    if w * h * bands * bits > 8 * 1040 * len(content):  # deflate makes 1,032 bytes of one at most
        raise ValueError("fewer pixels than the header says")
    samples = np.zeros((-(-h // step), -(-w // step), bands), np.uint8)
    for x0, y0, dx, dy in ADAM7 if interlace else ((0, 0, 1, 1),):
        n, rows = -(-(w - x0) // dx), -(-(h - y0) // dy)
        if n <= 0 or rows <= 0:
            continue
        columns = np.arange(x0, w, dx)
        kept = np.flatnonzero(columns % step == 0)
        stride = (n * bands * bits + 7) // 8
        above = np.zeros(stride + bpp, np.uint8)
        for y in range(y0, h, dy):
            raw = np.frombuffer(data.take(stride + 1), np.uint8)
            above = _unfilter(int(raw[0]), raw[1:], above, bpp)
            if y % step == 0:
                samples[y // step, columns[kept] // step] = _values(above[bpp:], n, bits, bands, None if kind == 3 else shift)[kept]
    return _colors(samples, kind, found)


def _colors(samples: np.ndarray, kind: int, found: list) -> np.ndarray:
    """(..., 4: a, r, g, b) of samples (..., bands) by the file's colour type and palette."""
    out = np.full((*samples.shape[:-1], 4), 255, np.int64)
    by = {t: d for _, t, _, d in found}
    if kind == 3:
        table = np.frombuffer(by["PLTE"], np.uint8).reshape(-1, 3)
        alpha = np.full(len(table), 255, np.int64)
        alpha[: len(by.get("tRNS", b""))] = np.frombuffer(by.get("tRNS", b""), np.uint8)
        out[..., 1:], out[..., 0] = table[samples[..., 0]], alpha[samples[..., 0]]
    else:
        out[..., 1:] = samples[..., :3] if kind in (2, 6) else samples[..., :1]
        if kind in (4, 6):
            out[..., 0] = samples[..., -1]
    return out


def scanlines(content: bytes) -> tuple[int, int, Iterator[np.ndarray]]:
    """Width, height and the rows (w, 4: a, r, g, b) of a PNG one after another; of an interlaced file they come from all its pixels."""
    found = list(chunks(content))
    if not found or found[0][1] != "IHDR":
        raise ValueError("not a PNG")
    w, h, bits, kind, _, _, interlace = struct.unpack(">IIBBBBB", found[0][3])
    bands = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    if w * h * bands * bits > 8 * 1040 * len(content):
        raise ValueError("fewer pixels than the header says")

    def rows():
        if interlace:
            yield from decode(content)
            return
        data, bpp, stride = _Inflated([d for _, t, _, d in found if t == "IDAT"]), max(1, bands * bits // 8), (w * bands * bits + 7) // 8
        above = np.zeros(stride + bpp, np.uint8)
        for _ in range(h):
            raw = np.frombuffer(data.take(stride + 1), np.uint8)
            above = _unfilter(int(raw[0]), raw[1:], above, bpp)
            yield _colors(_values(above[bpp:], w, bits, bands, None if kind == 3 else False), kind, found)

    return w, h, rows()


def _unfilter(kind: int, row: np.ndarray, above: np.ndarray, bpp: int) -> np.ndarray:
    out = np.zeros(len(row) + bpp, np.uint8)
    if kind in (0, 2):
        out[bpp:] = row if kind == 0 else row + above[bpp:]
        return out
    if kind == 1:
        for c in range(bpp):
            out[bpp + c :: bpp] = np.cumsum(row[c::bpp], dtype=np.uint8)
        return out
    o, r, a = out.tolist(), row.tolist(), above.tolist()
    for i in range(len(r)):
        left, up, corner = o[i], a[i + bpp], a[i]
        if kind == 3:
            guess = (left + up) // 2
        else:
            p = left + up - corner
            guess = min((left, up, corner), key=lambda v: abs(p - v))
        o[i + bpp] = (r[i] + guess) & 255
    return np.array(o, np.uint8)


def profile(content: bytes | None) -> bytes | None:
    """The ICC profile before the pixels, inflated; null if there is none, it is broken, or it is a bomb."""
    for _, kind, _, data in chunks(content):
        if kind == "IDAT":
            return None
        if kind == "iCCP":
            name, _, rest = data.partition(b"\0")
            if len(name) == len(data) or len(rest) < 2:
                return None
            try:
                d = zlib.decompressobj()
                out = d.decompress(rest[1:], PROFILE_LIMIT + 1)
            except zlib.error:
                return None
            return out if d.eof and len(out) <= PROFILE_LIMIT else None
    return None


def with_profile(content: bytes | None, icc: bytes | None) -> bytes | None:
    """The PNG with an ICC profile after its header; unchanged without one, null if it is no PNG."""
    head = next(iter(chunks(content)), None)
    if head is None or not icc:
        return content if head else None
    at = head[0] + 12 + head[2]
    return content[:at] + chunk(b"iCCP", b"profile\0\0" + zlib.compress(icc)) + content[at:]


def read_text(content: bytes | None) -> dict[str, str]:
    """Text entries by keyword, the last one of a keyword; empty for other bytes."""
    out = {}
    for _, kind, _, data in chunks(content):
        if kind not in ("tEXt", "zTXt", "iTXt"):
            continue
        key, _, rest = data.partition(b"\0")
        try:
            if kind == "tEXt":
                value = rest.decode("latin-1")
            elif kind == "zTXt":
                value = zlib.decompressobj().decompress(rest[1:], PROFILE_LIMIT).decode("latin-1")
            else:
                packed, body = rest[0], rest[2:].split(b"\0", 2)[2]
                value = (zlib.decompressobj().decompress(body, PROFILE_LIMIT) if packed else body).decode("utf-8")
        except (zlib.error, IndexError, UnicodeDecodeError):
            continue
        out[key.decode("latin-1")] = value
    return out


def write_text(content: bytes | None, entries: dict[str, str]) -> bytes | None:
    """The PNG with text entries added before its end; null if it is no PNG."""
    end = next((at for at, kind, _, _ in chunks(content) if kind == "IEND"), None)
    if end is None:
        return None
    added = []
    for key, value in entries.items():
        try:
            added.append(chunk(b"tEXt", key.encode("latin-1") + b"\0" + value.encode("latin-1")))
        except UnicodeEncodeError:
            added.append(chunk(b"iTXt", key.encode("latin-1", "replace") + b"\0\0\0\0\0" + value.encode()))
    return content[:end] + b"".join(added) + content[end:]
