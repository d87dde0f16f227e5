"""Header sizes, JPEG marker repair, BMP and TIFF writers, ICC conversion: byte-level functions on one file."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np

from . import png

IMAGE_TYPES = ("JPG", "PNG", "GIF", "BMP", "TIFF")


def resolve_type(name: str) -> str | None:
    """The image type of this name in any case, null if there is none."""
    return name.upper() if name.upper() in IMAGE_TYPES else None


def alpha_supported(name: str) -> bool:
    return name.lower() in ("png", "gif", "tiff")


# ---------------------------------------------------------------- JPEG markers

#: Fixed values of the JPEG format (ITU T.81, table B.1): marker codes by what follows them.
ALONE = {0x01, *range(0xD0, 0xD9)}
STOP = {0xD9, 0xDA}
FRAME = {*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}
_MARKER = re.compile(rb"\xff+([^\xff])", re.DOTALL)


class Broken(ValueError):
    """The bytes are not what the format says."""


def jpeg_segments(b: bytes) -> Iterator[tuple[int, int, int]]:
    """(marker, start of its data, length of it) of the segments before the scan; raises Broken where the bytes break off.

    The last segment may reach past the end: callers decide what of it they need.
    """
    at = 2
    while len(b) - at >= 4:
        found = _MARKER.match(b, at)
        if not found:
            raise Broken
        marker, at = found[1][0], found.end()
        if marker in STOP:
            return
        if marker not in ALONE:
            length = int.from_bytes(b[at : at + 2], "big") if at + 2 <= len(b) else 0
            if length < 2:
                raise Broken
            yield marker, at + 2, length - 2
            at += length


def _jpeg_size(b: bytes):
    if b[:2] != b"\xff\xd8":
        return None
    try:
        start = next((at for marker, at, _ in jpeg_segments(b) if marker in FRAME), len(b))
    except Broken:
        return None
    return struct.unpack_from(">HH", b, start + 1)[::-1] if start + 5 <= len(b) else None


def _png_size(b: bytes):
    return struct.unpack_from(">ii", b, 16) if len(b) >= 24 and b[:4] == b"\x89PNG" and b[12:16] == b"IHDR" else None


def _gif_size(b: bytes):
    return struct.unpack_from("<HH", b, 6) if b[:3] == b"GIF" else None


#: The fields of a BMP file that a size needs: name and struct format, by offset.
_BMP = {2: ("file_bytes", "<i"), 10: ("pixels_at", "<i"), 14: ("info_bytes", "<i"), 18: ("width", "<i"), 22: ("height", "<i")}


def _bmp_size(b: bytes):
    if b[:2] != b"BM" or len(b) < 26:
        return None
    f = {name: struct.unpack_from(kind, b, at)[0] for at, (name, kind) in _BMP.items()}
    whole = f["file_bytes"] in (0, len(b))
    room = f["info_bytes"] >= 40 and f["pixels_at"] in range(14 + f["info_bytes"], len(b) + 1)
    return (f["width"], abs(f["height"])) if whole and room else None


def image_size(b: bytes | None) -> tuple[int, int] | None:
    """(width, height) from the header alone, null for other or broken bytes; never raises."""
    if b is None or len(b) < 16:
        return None
    size = next((s for read in (_png_size, _jpeg_size, _gif_size, _bmp_size) if (s := read(b)) and s[0] > 0 and s[1] > 0), None)
    return (int(size[0]), int(size[1])) if size else None


def reconcile_jpeg(b: bytes | None) -> bytes | None:
    """The JPEG with its Adobe transform flag set, if JFIF and three components not named R, G, B contradict a flag of 0.

    Other bytes, broken ones too, come back as they are.
    """
    if not b or b[:2] != b"\xff\xd8":
        return b
    last: dict[str, int] = {}  # where the data of the last segment of each kind begins
    try:
        for marker, at, size in jpeg_segments(b):
            if at + size > len(b):
                return b
            head = b[at : at + min(size, 5)]
            kind = "jfif" if marker == 0xE0 and head == b"JFIF\0" else "adobe" if marker == 0xEE and head == b"Adobe" and size > 11 else "frame" if marker in FRAME and size >= 6 else None
            if kind:
                last[kind] = at
    except Broken:
        return b
    if last.keys() < {"jfif", "adobe", "frame"}:
        return b
    flag, frame = last["adobe"] + 11, last["frame"]
    names = b[frame + 6 : frame + 15 : 3]
    wrong = b[flag] == 0 and b[frame + 5] == 3 and names != b"RGB"
    return b[:flag] + b"\1" + b[flag + 1 :] if wrong else b


# ---------------------------------------------------------------- text in JPEG, GIF and PNG files


def _gif_blocks(b: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(place, label, data) of the extensions before the first picture; the last has label -1 and the picture's place."""
    at = 13 + (3 << (b[10] & 7) + 1 if len(b) > 10 and b[10] & 0x80 else 0)
    while at + 1 < len(b) and b[at] == 0x21:
        start, label, data = at, b[at + 1], b""
        at += 2
        while at < len(b) and b[at]:
            data += b[at + 1 : at + 1 + b[at]]
            at += 1 + b[at]
        at += 1
        yield start, label, data
    yield at, -1, b""


def read_text(b: bytes | None) -> dict[str, str]:
    """Text entries of a PNG by keyword; the last comment of a JPEG or GIF as `comment`; empty for other bytes."""
    if not b:
        return {}
    found: list[bytes] = []
    try:
        if b[:2] == b"\xff\xd8":
            found = [b[at : at + size] for marker, at, size in jpeg_segments(b) if marker == 0xFE]
        elif b[:3] == b"GIF":
            found = [data for _, label, data in _gif_blocks(b) if label == 0xFE]
        else:
            return png.read_text(b)
    except Broken:
        return {}
    return {"comment": found[-1].decode("latin-1")} if found else {}


def write_text(b: bytes | None, entries: dict[str, str]) -> bytes | None:
    """The file with text entries added; JPEG and GIF hold comments, so keywords are lost there; null for other
    bytes, and broken JPEG files come back as they are."""
    if not b:
        return None
    values = [v.encode("latin-1", "replace") for v in entries.values()]
    if b[:2] == b"\xff\xd8":
        try:
            at = max([2, *(at + size for marker, at, size in jpeg_segments(b) if marker in {*range(0xE0, 0xF0), 0xFE})])
        except Broken:
            return b
        return b[:at] + b"".join(struct.pack(">BBH", 0xFF, 0xFE, len(v) + 2) + v for v in (v[:65533] for v in values)) + b[at:]
    if b[:3] == b"GIF":
        at = next(place for place, label, _ in _gif_blocks(b) if label < 0)
        parts = lambda v: b"".join(bytes([len(v[i : i + 255])]) + v[i : i + 255] for i in range(0, len(v), 255))
        return b[:at] + b"".join(b"!\xfe" + parts(v) + b"\0" for v in values) + b[at:]
    return png.write_text(b, entries)


# ---------------------------------------------------------------- BMP and TIFF


def write_bmp(raster: np.ndarray) -> bytes:
    """24-bit BMP; alpha is flattened on white, as BMP has none."""
    h, w, _ = raster.shape
    a = raster[..., :1] / 255.0
    rgb = np.floor(raster[..., 1:] * a + 255 * (1 - a) + 0.5).astype(np.uint8)
    lines = np.zeros((h, -(-w * 3 // 4) * 4), np.uint8)
    lines[:, : w * 3] = rgb[::-1, :, ::-1].reshape(h, -1)
    size = 54 + lines.nbytes
    return b"BM" + struct.pack("<IHHI", size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, lines.nbytes, 2835, 2835, 0, 0) + lines.tobytes()


def write_tiff(raster: np.ndarray, level: int = 6) -> bytes:
    """Little-endian TIFF, one deflated strip, RGB or RGBA with unassociated alpha."""
    h, w, _ = raster.shape
    alpha = bool((raster[..., 0] != 255).any())
    order = [1, 2, 3, 0] if alpha else [1, 2, 3]
    data = zlib.compress(raster[..., order].astype(np.uint8).tobytes(), level)
    n = len(order)
    tags = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, n, None), (259, 3, 1, 8), (262, 3, 1, 2), (273, 4, 1, None), (277, 3, 1, n), (278, 4, 1, h), (279, 4, 1, len(data)), (284, 3, 1, 1), *([(338, 3, 1, 2)] if alpha else [])]
    bits_at = 8 + 2 + 12 * len(tags) + 4
    data_at = bits_at + 2 * n
    out = struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<H", len(tags))
    for tag, kind, count, value in tags:
        value = bits_at if tag == 258 else data_at if tag == 273 else value
        out += struct.pack("<HHI", tag, kind, count) + (struct.pack("<HH", value, 0) if kind == 3 and tag != 258 else struct.pack("<I", value))
    return out + struct.pack("<I", 0) + struct.pack("<H", 8) * n + data


def read_tiff(b: bytes) -> np.ndarray:
    """(h, w, 4: a, r, g, b) of a TIFF of 8-bit RGB or RGBA strips, deflated or plain; others raise ValueError."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(b[:4])
    if order is None:
        raise ValueError("not a TIFF")
    (at,) = struct.unpack_from(order + "I", b, 4)
    tags = {}
    for i in range(struct.unpack_from(order + "H", b, at)[0]):
        tag, kind, count = struct.unpack_from(order + "HHI", b, at + 2 + 12 * i)
        one = {1: "B", 3: "H", 4: "I"}.get(kind)
        if one:
            where = at + 10 + 12 * i
            if struct.calcsize(one) * count > 4:
                (where,) = struct.unpack_from(order + "I", b, where)
            tags[tag] = struct.unpack_from(f"{order}{count}{one}", b, where)
    w, h, bands = tags[256][0], tags[257][0], tags[277][0]
    if set(tags[258]) != {8} or tags[262][0] != 2 or bands not in (3, 4) or tags[259][0] not in (1, 8, 32946):
        raise ValueError("a kind of TIFF that is not read")
    strips = [b[o : o + n] for o, n in zip(tags[273], tags[279])]
    data = b"".join(s if tags[259][0] == 1 else zlib.decompress(s) for s in strips)
    samples = np.frombuffer(data, np.uint8)[: h * w * bands].reshape(h, w, bands)
    out = np.full((h, w, 4), 255, np.int64)
    out[..., 1:] = samples[..., :3]
    if bands == 4:
        out[..., 0] = samples[..., 3]
    return out


# ---------------------------------------------------------------- ICC


def _curve(data: bytes):
    """The tone curve of a curv or para tag as a function on 0..1, null if it is of another kind."""
    kind = data[:4]
    if kind == b"curv":
        (n,) = struct.unpack_from(">I", data, 8)
        if n == 0:
            return lambda x: x
        if n == 1:
            gamma = struct.unpack_from(">H", data, 12)[0] / 256
            return lambda x: x**gamma
        table = np.frombuffer(data, ">u2", n, 12) / 65535
        return lambda x: np.interp(x, np.linspace(0, 1, n), table)
    if kind == b"para":
        form = struct.unpack_from(">H", data, 8)[0]
        count = {0: 1, 1: 3, 2: 4, 3: 5, 4: 7}.get(form)
        if count is None:
            return None
        g, a, b, c, d, e, f = (list(v / 65536 for v in struct.unpack_from(f">{count}i", data, 12)) + [0.0] * 7)[:7]
        if form == 0:
            return lambda x: x**g
        power = lambda x: np.maximum(a * x + b, 0) ** g
        if form == 1:
            return lambda x: np.where(x >= -b / a, power(x), 0)
        if form == 2:
            return lambda x: np.where(x >= -b / a, power(x) + c, c)
        return lambda x: np.where(x >= d, power(x) + e, c * x + f)
    return None


def lattice(grid: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Values (n, m) of a cubic lattice (g, g, g, m) at points (n, 3) in 0..1, by tetrahedra.

    A point's cell is cut into six tetrahedra that share the diagonal from its least to its greatest corner; which one holds the point
    is told by the order of its three fractions.  From the least corner on, each step goes along the next largest fraction.
    """
    g = grid.shape[0]
    scaled = np.clip(at, 0, 1) * (g - 1)
    corner = np.minimum(scaled.astype(np.int64), max(g - 2, 0))
    part = scaled - corner
    order = np.argsort(-part, axis=1, kind="stable")
    n = np.arange(len(at))
    here = grid[corner[:, 0], corner[:, 1], corner[:, 2]]
    out = here.copy()
    for step in range(3):
        axis = order[:, step]
        corner[n, axis] = np.minimum(corner[n, axis] + 1, g - 1)
        there = grid[corner[:, 0], corner[:, 1], corner[:, 2]]
        out += (there - here) * part[n, axis][:, None]
        here = there
    return out


def _table_profile(data: bytes, pcs: bytes):
    """The XYZ (D50) of colours (n, 3) in 0..1 by an A2B0 tag of 8 or 16 bits, null if it is of another kind."""
    wide = {b"mft1": 1, b"mft2": 2}.get(data[:4])
    if not wide or pcs not in (b"XYZ ", b"Lab "):
        return None
    n_in, n_out, g = data[8:11]
    if (n_in, n_out) != (3, 3) or g < 2:
        return None
    in_size, out_size = struct.unpack_from(">HH", data, 48) if wide == 2 else (256, 256)
    numbers = np.frombuffer(data, ">u2" if wide == 2 else np.uint8, 3 * in_size + 3 * g**3 + 3 * out_size, 52 if wide == 2 else 48) / (65535 if wide == 2 else 255)
    first = numbers[: 3 * in_size].reshape(3, in_size)
    grid = numbers[3 * in_size : 3 * in_size + 3 * g**3].reshape(g, g, g, 3)
    last = numbers[3 * in_size + 3 * g**3 :].reshape(3, out_size)
    bend = lambda v, tables: np.stack([np.interp(v[:, c], np.linspace(0, 1, tables.shape[1]), tables[c]) for c in range(3)], axis=1)

    def convert(rgb: np.ndarray) -> np.ndarray:
        v = bend(lattice(grid, bend(rgb, first)), last)
        if pcs == b"XYZ ":
            return v * (1 + 32767 / 32768)
        # 16-bit tables put 100 at 0xFF00 and 0 of a and b at 0x8000; 8-bit ones at 255 and 128.
        full = 65280 / 65535 if wide == 2 else 1.0
        light, a, b = v[:, 0] / full * 100, v[:, 1] / full * 255 - 128, v[:, 2] / full * 255 - 128
        y = (light + 16) / 116
        f = np.stack([y + a / 500, y, y - b / 200], axis=1)
        return np.where(f > 6 / 29, f**3, (f - 4 / 29) * 3 * (6 / 29) ** 2) * WHITE_D50

    return convert


def to_srgb(raster: np.ndarray, icc: bytes | None) -> tuple[np.ndarray, bool]:
    """(raster in sRGB, whether it was converted): table, matrix and grey profiles; with any other the pixels stay as they are.

    Tables (A2B0 of 8 or 16 bits to XYZ or Lab) come first where a profile has both.
    """
    try:
        if not icc or icc[36:40] != b"acsp":
            return raster, False
        (n,) = struct.unpack_from(">I", icc, 128)
        tags = {icc[132 + 12 * i : 136 + 12 * i]: struct.unpack_from(">II", icc, 136 + 12 * i) for i in range(n)}
        part = lambda t: icc[tags[t][0] : tags[t][0] + tags[t][1]]
        unit = raster[..., 1:] / 255.0
        if icc[16:20] == b"GRAY":
            curve = _curve(part(b"kTRC"))
            linear = np.repeat(curve(unit[..., :1]), 3, axis=2)
        elif icc[16:20] == b"RGB " and b"A2B0" in tags and (table := _table_profile(part(b"A2B0"), icc[20:24])):
            linear = (table(unit.reshape(-1, 3)) @ np.linalg.inv(SRGB_D50).T).reshape(unit.shape)
        elif icc[16:20] == b"RGB ":
            curves = [_curve(part(t)) for t in (b"rTRC", b"gTRC", b"bTRC")]
            columns = np.array([[v / 65536 for v in struct.unpack_from(">3i", part(t), 8)] for t in (b"rXYZ", b"gXYZ", b"bXYZ")]).T
            xyz = np.stack([c(unit[..., i]) for i, c in enumerate(curves)], axis=2) @ columns.T
            linear = xyz @ np.linalg.inv(SRGB_D50).T
        else:
            return raster, False
        linear = np.clip(linear, 0, 1)
        coded = np.where(linear <= 0.0031308, 12.92 * linear, 1.055 * linear ** (1 / 2.4) - 0.055)
        out = raster.copy()
        out[..., 1:] = np.floor(coded * 255 + 0.5)
        return out, True
    except (KeyError, struct.error, TypeError, ValueError, ZeroDivisionError):
        return raster, False


#: The white of the profile connection space (ICC.1).
WHITE_D50 = np.array([0.9642, 1.0, 0.8249])
#: sRGB primaries adapted to D50, columns r, g, b.
SRGB_D50 = np.array([[0.4360747, 0.3850649, 0.1430804], [0.2225045, 0.7168786, 0.0606169], [0.0139322, 0.0971045, 0.7141733]])
