"""JPEG, GIF and BMP bytes to rasters with NumPy, so that executors decode files held in a column.

JPEG files are decoded at 1, 1/2, 1/4 or 1/8 of their size from the start: of each 8x8 block only the coefficients that the reduced
transform needs are kept, one row of blocks at a time, so that a thumbnail takes the memory of a thumbnail.
"""

from __future__ import annotations

import struct

import numpy as np

from .formats import FRAME, Broken, jpeg_segments
from .lossy import ZIGZAG

# ---------------------------------------------------------------- JPEG


def cosines(n: int) -> np.ndarray:
    """Rows of the orthonormal n-point cosine transform."""
    k = np.arange(n)
    return np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / (2 * n)) * np.where(k[:, None] == 0, np.sqrt(1 / n), np.sqrt(2 / n))


def _lookup(counts: bytes, symbols: bytes) -> list[int]:
    """Of each 16 bits the code that they start with: its symbol << 8 | its bits; 0 where there is none."""
    out, at, i = [0] * (1 << 16), 0, 0
    for size, n in enumerate(counts, 1):
        for _ in range(n):
            room = 1 << 16 - size
            if at + room > 1 << 16 or i >= len(symbols):
                raise ValueError("broken code table")
            out[at : at + room] = [symbols[i] << 8 | size] * room
            at, i = at + room, i + 1
    return out


class _Part:
    """A component: how it is sampled, its tables, and the plane that is filled from its blocks."""

    def __init__(self, name: int, across: int, down: int, table: int):
        self.name, self.across, self.down, self.table = name, across, down, table


class Jpeg:
    """Headers of a baseline or extended sequential file of 8-bit samples with Huffman codes; others raise ValueError."""

    def __init__(self, b: bytes):
        if b[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG")
        self.steps, self.codes, self.parts, self.restart, self.adobe = {}, {}, [], 0, None
        end = 2
        try:
            for marker, at, size in jpeg_segments(b):
                body, end = b[at : at + size], at + size
                if marker == 0xDB:
                    self._steps(body)
                elif marker == 0xC4:
                    self._codes(body)
                elif marker in FRAME:
                    if marker not in (0xC0, 0xC1) or body[0] != 8:
                        raise ValueError("only sequential JPEG files of 8-bit samples are decoded")
                    self.height, self.width, n = struct.unpack_from(">HHB", body, 1)
                    self.parts = [_Part(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
                elif marker == 0xDD:
                    self.restart = int.from_bytes(body[:2], "big")
                elif marker == 0xEE and body[:5] == b"Adobe" and size > 11:
                    self.adobe = body[11]
        except (Broken, IndexError, struct.error):
            raise ValueError("broken JPEG") from None
        start = b.find(b"\xff\xda", end)
        if start < 0 or len(self.parts) not in (1, 3) or not self.width or not self.height:
            raise ValueError("no picture of one or three components")
        head = b[start + 4 : start + 2 + int.from_bytes(b[start + 2 : start + 4], "big")]
        if len(head) < 1 + 2 * len(self.parts) or head[0] != len(self.parts):
            raise ValueError("only one scan of all components is decoded")
        for i, p in enumerate(self.parts):
            p.coding = head[2 + 2 * i]
            if head[1 + 2 * i] != p.name or not 1 <= p.across <= 4 or not 1 <= p.down <= 4:
                raise ValueError("broken scan")
        if len(self.parts) == 1:
            self.parts[0].across = self.parts[0].down = 1
        self.data = b[start + 2 + int.from_bytes(b[start + 2 : start + 4], "big") :]

    def _steps(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            wide, number = body[at] >> 4, body[at] & 15
            values = np.frombuffer(body, ">u2" if wide else np.uint8, 64, at + 1).astype(np.int64)
            table = np.empty(64, np.int64)
            table[ZIGZAG] = values
            self.steps[number] = table
            at += 129 if wide else 65

    def _codes(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            counts = body[at + 1 : at + 17]
            self.codes[body[at]] = _lookup(counts, body[at + 17 : at + 17 + sum(counts)])
            at += 17 + sum(counts)

    def intervals(self) -> list[bytes]:
        """The coded data between restart marks, without stuffed bytes."""
        out, at, start = [], 0, 0
        data = self.data
        while True:
            at = data.find(b"\xff", at)
            if at < 0 or at + 1 >= len(data):
                at = len(data)
                break
            if data[at + 1] == 0 or data[at + 1] == 0xFF:
                at += 2 if data[at + 1] == 0 else 1
            elif 0xD0 <= data[at + 1] <= 0xD7:
                out.append(data[start:at])
                at = start = at + 2
            else:
                break
        return [x.replace(b"\xff\0", b"\xff") for x in [*out, data[start:at]]]

    def decode(self, step: int = 1) -> np.ndarray:
        """(h, w, 3) at 1 / step of the size, rounded up; step is 1, 2, 4 or 8.

        Components with fewer samples get a larger transform where that brings them to size, else each sample is repeated.
        """
        n = 8 // step
        most_across, most_down = max(p.across for p in self.parts), max(p.down for p in self.parts)
        columns, rows = -(-self.width // (8 * most_across)), -(-self.height // (8 * most_down))
        if columns * rows > 4 * len(self.data):  # a block takes two bits at least
            raise ValueError("the picture breaks off")
        for p in self.parts:
            p.n = min(8, n * min(most_across // p.across, most_down // p.down))
            p.steps_kept = self.steps[p.table].reshape(8, 8)[: p.n, : p.n] * (p.n / 8)
            p.plane = np.empty((rows * p.down * p.n, columns * p.across * p.n), np.float32)
            p.basis, p.constant = cosines(p.n), 0
            where = np.full(64, -1)
            inside = (ZIGZAG // 8 < p.n) & (ZIGZAG % 8 < p.n)
            where[inside] = ZIGZAG[inside] // 8 * p.n + ZIGZAG[inside] % 8
            p.where = where.tolist()
        bits = _Bits(self.intervals())
        left = self.restart
        for row in range(rows):
            for p in self.parts:
                p.at, p.value = [], []
            for column in range(columns):
                if self.restart and not left:
                    bits.next_interval()
                    left = self.restart
                    for p in self.parts:
                        p.constant = 0
                left -= 1
                for p in self.parts:
                    for k in range(p.across * p.down):
                        block = k // p.across * columns * p.across + column * p.across + k % p.across
                        p.constant = bits.block(self.codes[p.coding >> 4], self.codes[16 | p.coding & 15], p, block * p.n * p.n)
            for p in self.parts:
                c = np.zeros(p.down * columns * p.across * p.n * p.n)
                c[p.at] = p.value
                blocks = c.reshape(-1, p.n, p.n) * p.steps_kept
                out = (p.basis.T @ blocks @ p.basis + 128).reshape(p.down, columns * p.across, p.n, p.n).swapaxes(1, 2)
                p.plane[row * p.down * p.n : (row + 1) * p.down * p.n] = out.reshape(p.down * p.n, -1)
        h, w = -(-self.height // step), -(-self.width // step)
        planes = []
        for p in self.parts:
            up, over = most_down * n // (p.down * p.n), most_across * n // (p.across * p.n)
            plane = p.plane if up == over == 1 else np.repeat(np.repeat(p.plane, up, 0), over, 1)
            planes.append(plane[:h, :w])
        return self._colors(planes)

    def _colors(self, planes: list[np.ndarray]) -> np.ndarray:
        if len(planes) == 1:
            out = np.repeat(planes[0][..., None], 3, 2)
        elif self.adobe == 0 or self.adobe is None and bytes(p.name for p in self.parts) == b"RGB":
            out = np.stack(planes, 2)
        else:
            y, b, r = planes[0], planes[1] - 128, planes[2] - 128
            out = np.stack([y + 1.402 * r, y - 0.344136 * b - 0.714136 * r, y + 1.772 * b], 2)
        return np.clip(np.floor(out + 0.5), 0, 255).astype(np.int64)


class _Bits:
    """Reads codes and the bits that follow them, high bits first; beyond the end there are zeros."""

    def __init__(self, intervals: list[bytes]):
        self.rest = intervals[::-1]
        self.next_interval()

    def next_interval(self) -> None:
        if not self.rest:
            raise ValueError("fewer restarts than the header says")
        self.data, self.at = self.rest.pop() + bytes(8), 0

    def block(self, first: list[int], others: list[int], p: _Part, base: int) -> int:
        """Read a block: its constant part comes back, values that are kept go to p.at and p.value."""
        data, at, where = self.data, self.at, p.where
        read = int.from_bytes
        k, constant = 0, p.constant
        while k < 64:
            byte = at >> 3
            window = read(data[byte : byte + 8], "big") << (at & 7) & 0xFFFFFFFFFFFFFFFF
            if byte + 8 > len(data):
                raise ValueError("the picture breaks off")
            code = (others if k else first)[window >> 48]
            size, symbol = code & 255, code >> 8
            if not size:
                raise ValueError("no such code")
            n = symbol & 15
            at += size + n
            value = 0
            if n:
                value = window >> 64 - size - n & (1 << n) - 1
                if not value >> n - 1:
                    value -= (1 << n) - 1
            if k == 0:
                constant += value
                value, n = constant, 1
            elif not n and symbol != 0xF0:
                break
            else:
                k += symbol >> 4
            if n and k < 64 and where[k] >= 0:
                p.at.append(base + where[k])
                p.value.append(value)
            k += 1
        self.at = at
        return constant


def read_jpeg(b: bytes, step: int = 1) -> np.ndarray:
    """(h, w, 4: a, r, g, b), decimated by a power of two: up to 8 by the transform, beyond by leaving pixels out."""
    inner = min(step, 8)
    rgb = Jpeg(b).decode(inner)[:: step // inner, :: step // inner]
    return np.concatenate([np.full((*rgb.shape[:2], 1), 255, np.int64), rgb], 2)


# ---------------------------------------------------------------- GIF


def _unlzw(data: bytes, width: int, most: int) -> bytes:
    """The palette numbers that LZW codes stand for, `most` of them at most."""
    clear, end = 1 << width, (1 << width) + 1
    fresh = [bytes([i]) for i in range(clear)] + [b"", b""]
    table, size, out, length, last = [*fresh], width + 1, [], 0, None
    window = bits = at = 0
    while length < most:
        while bits < size and at < len(data):
            window |= data[at] << bits
            bits, at = bits + 8, at + 1
        if bits < size:
            break
        code = window & (1 << size) - 1
        window, bits = window >> size, bits - size
        if code == clear:
            table, size, last = [*fresh], width + 1, None
            continue
        if code == end:
            break
        if code < len(table):
            entry = table[code]
        elif last is not None and code == len(table):
            entry = last + last[:1]
        else:
            raise ValueError("no such code")
        if last is not None and len(table) < 4096:
            table.append(last + entry[:1])
            size += len(table) == 1 << size and size < 12
        out.append(entry)
        length += len(entry)
        last = entry
    return b"".join(out)[:most]


def read_gif(b: bytes) -> np.ndarray:
    """(h, w, 4: a, r, g, b) of a GIF's first picture; its transparent colour is clear zero, and so is what the data leave out."""
    if b[:6] not in (b"GIF87a", b"GIF89a") or len(b) < 13:
        raise ValueError("not a GIF")
    palette = lambda at, flags: np.frombuffer(b, np.uint8, 3 << (flags & 7) + 1, at).reshape(-1, 3)
    colors, at, clear = None, 13, -1
    if b[10] & 0x80:
        colors = palette(13, b[10])
        at += colors.size

    def blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while at < len(b) and b[at]:
            parts.append(b[at + 1 : at + 1 + b[at]])
            at += 1 + b[at]
        return b"".join(parts), at + 1

    while at < len(b) and b[at] == 0x21:
        data, after = blocks(at + 2)
        if b[at + 1] == 0xF9 and len(data) >= 4:
            clear = data[3] if data[0] & 1 else -1
        at = after
    if at >= len(b) or b[at] != 0x2C:
        raise ValueError("no picture")
    _, _, w, h, flags = struct.unpack_from("<HHHHB", b, at + 1)
    at += 10
    if flags & 0x80:
        colors = palette(at, flags)
        at += colors.size
    if colors is None or not w or not h or not 1 <= b[at] <= 11 or w * h > 12_000 * len(b):  # a code stands for 4,096 pixels at most
        raise ValueError("broken picture")
    index = np.frombuffer(_unlzw(blocks(at + 1)[0], b[at], w * h), np.uint8).astype(np.int64)
    given = len(index)
    index = np.pad(index, (0, w * h - given))
    out = np.zeros((h * w, 4), np.int64)
    seen = (index < len(colors)) & (index != clear) & (np.arange(h * w) < given)
    out[seen, 0] = 255
    out[seen, 1:] = colors[index[seen]]
    out = out.reshape(h, w, 4)
    if flags & 0x40:  # rows come in four passes
        order = np.concatenate([np.arange(start, h, step) for start, step in ((0, 8), (4, 8), (2, 4), (1, 2))])
        whole = np.empty_like(out)
        whole[order] = out
        out = whole
    return out


# ---------------------------------------------------------------- BMP


def read_bmp(b: bytes, step: int = 1) -> np.ndarray:
    """(h, w, 4: a, r, g, b) of an uncompressed BMP of 1, 4, 8, 24 or 32 bits a pixel, opaque; every step-th pixel of its rows."""
    if b[:2] != b"BM" or len(b) < 54:
        raise ValueError("not a BMP")
    at, info, w, h, _, bits, packing, _, _, _, used = struct.unpack_from("<IIiiHHIIiiI", b, 10)
    if info < 40 or packing or w <= 0 or not h or bits not in (1, 4, 8, 24, 32):
        raise ValueError("a kind of BMP that is not read")
    line = -(-w * bits // 32) * 4
    if at + line * abs(h) > len(b):
        raise ValueError("the picture breaks off")
    rows = np.frombuffer(b, np.uint8, line * abs(h), at).reshape(abs(h), line)
    rows = (rows if h < 0 else rows[::-1])[::step]
    if bits >= 24:
        rgb = rows[:, : w * bits // 8].reshape(len(rows), w, bits // 8)[:, ::step, 2::-1]
    else:
        colors = np.frombuffer(b, np.uint8, 4 * min(used or 1 << bits, 1 << bits), 14 + info).reshape(-1, 4)[:, 2::-1]
        index = np.unpackbits(rows, axis=1).reshape(len(rows), -1, bits)[:, :w:step]
        index = (index << np.arange(bits - 1, -1, -1)).sum(2)
        if index.max(initial=0) >= len(colors):
            raise ValueError("no such colour")
        rgb = colors[index]
    out = np.full((*rgb.shape[:2], 4), 255, np.int64)
    out[..., 1:] = rgb
    return out
