"""JPEG, GIF and BMP decoding against the JVM's readers, reduced transforms against a whole decode, and broken bytes."""

import random
import struct
import tracemalloc

import numpy as np
import pytest

from pixelloom.operators.grouped import pack
from pixelloom.sources import decode, formats, images, lossy


def photo(w, h, alpha=False):
    x, y = np.meshgrid(np.arange(w), np.arange(h))
    return np.stack([(x + y) % 256 if alpha else np.full((h, w), 255), x * 255 // max(1, w - 1), y * 255 // max(1, h - 1), ((x >> 2) + (y >> 2)) & 255], 2)


def boxes(r, step):
    h, w = r.shape[:2]
    p = np.pad(r, ((0, -h % step), (0, -w % step), (0, 0)), "edge")
    return p.reshape(p.shape[0] // step, step, -1, step, r.shape[2]).mean((1, 3))


@pytest.mark.parametrize("size", [(8, 8), (1, 1), (37, 19), (160, 90)])
def test_own_jpeg_files(size):
    r = photo(*size)
    got = decode.read_jpeg(lossy.write_jpeg(r, 1.0))
    assert got.shape == r.shape and np.abs(got - r).max() <= 4 and np.abs(got - r).mean() < 1.2


@pytest.mark.parametrize("step", [2, 4, 8])
def test_reduced_transform_is_near_the_mean_of_a_whole_decode(step):
    """Stated error: means of the photo fixture within 1 on average and 8 at most."""
    r = photo(320, 200)
    b = lossy.write_jpeg(r, 0.9)
    whole, small = decode.read_jpeg(b), decode.read_jpeg(b, step)
    assert small.shape == (-(-200 // step), -(-320 // step), 4)
    error = np.abs(small - boxes(whole, step))[..., 1:]
    assert error.mean() < 1 and error.max() <= 8


@pytest.mark.parametrize("size,quality", [((64, 48), 0.9), ((37, 21), 0.75), ((200, 100), 0.3)])
def test_jpeg_files_of_the_jvm(spark, tmp_path, size, quality):
    """The JVM samples colours at half resolution and smooths them between samples, so colours differ a little."""
    r = photo(*size)
    b = images.write_with_jvm(spark, r, "jpg", quality)
    (tmp_path / "a.jpg").write_bytes(b)
    row = images.read_images(spark, str(tmp_path)).first()
    want = np.array(row.argb).reshape(row.height, row.width)
    got = decode.read_jpeg(b)
    for shift, c, most in ((16, 1, 6), (8, 2, 4), (0, 3, 6)):
        assert np.abs(got[..., c] - (want >> shift & 255)).mean() < most
    luma = lambda a, b, c: 0.299 * a + 0.587 * b + 0.114 * c
    assert np.abs(luma(*np.moveaxis(got[..., 1:], 2, 0)) - luma(want >> 16 & 255, want >> 8 & 255, want & 255)).mean() < 1.5
    gray = np.repeat(r[..., 1:2], 4, 2)
    gray[..., 0] = 255
    half = decode.read_jpeg(b, 2)
    assert np.abs(half[..., 1:] - boxes(got, 2)[..., 1:]).mean() < 6


def restarts(b, every):
    """The file with a restart mark after each `every` blocks of a grey picture: coded by hand, a byte of padding each time."""
    at = b.index(b"\xff\xda")
    return b[:at] + b"\xff\xdd\0\4" + struct.pack(">H", every) + b[at:]


def test_restart_intervals_and_grey():
    # Grey picture of two blocks, DC only, one code: symbol 0 (no bits) as 0, end of block as 0.
    head = b"\xff\xd8" + b"\xff\xdb\0\x43\0" + bytes([8] * 64) + b"\xff\xc0\0\x0b\x08" + struct.pack(">HH", 8, 16) + b"\1\1\x11\0"
    codes = b"\xff\xc4\0\x15\0\1\1" + bytes(14) + b"\3\0" + b"\xff\xc4\0\x14\x10\1" + bytes(15) + b"\0"
    scan = b"\xff\xda\0\x08\1\1\0\0\x3f\0"
    # First block: code 0 (three bits follow), value 101b = 5; end 0 -> 0 101 0 111 = 0x57.  Second likewise after a restart: 5 again.
    plain = head + codes + scan + b"\x57\xff\xd0\x57\xff\xd9"
    got = decode.read_jpeg(restarts(plain, 1))
    assert got.shape == (8, 16, 4) and set(got[..., 1:].ravel().tolist()) == {128 + 5 * 8 // 8}
    with pytest.raises(ValueError):
        decode.read_jpeg(restarts(head + codes + scan + b"\x57\xff\xd9", 1))


def test_names_and_flags_choose_the_colours():
    r = photo(16, 16)
    b = lossy.write_jpeg(r, 1.0)
    frame = b.index(b"\xff\xc0")
    scan = b.index(b"\xff\xda")
    named = bytearray(b)
    for k, c in enumerate(b"RGB"):
        named[frame + 10 + 3 * k] = named[scan + 5 + 2 * k] = c
    raw = decode.read_jpeg(bytes(named))[..., 1:]
    assert np.abs(raw[..., 0] - (0.299 * r[..., 1] + 0.587 * r[..., 2] + 0.114 * r[..., 3])).max() <= 3
    adobe = b[:2] + b"\xff\xee\0\x0eAdobe\0\x64\0\0\0\0\0" + b[2:]
    assert np.array_equal(decode.read_jpeg(adobe)[..., 1:], raw)


def test_a_thumbnail_takes_the_memory_of_a_thumbnail():
    b = lossy.write_jpeg(np.tile(photo(256, 128), (4, 4, 1)), 0.5)
    peaks = []
    for step in (1, 8):
        tracemalloc.start()
        decode.read_jpeg(b, step)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < peaks[0] / 6


@pytest.mark.parametrize("size", [(1, 1), (17, 9), (64, 64)])
@pytest.mark.parametrize("colors", [2, 5, 200])
def test_gif_round_trip(size, colors):
    rnd = np.random.default_rng(colors)
    pal = rnd.integers(0, 256, (colors, 3))
    r = np.full((size[1], size[0], 4), 255)
    r[..., 1:] = pal[rnd.integers(0, colors, size[::-1])]
    r[rnd.random(size[::-1]) < 0.2] = 0
    assert np.array_equal(decode.read_gif(lossy.write_gif(r)), r)


def test_gif_with_a_full_code_table(spark, tmp_path):
    rnd = np.random.default_rng(3)
    r = np.full((120, 150, 4), 255)
    r[..., 1:] = (rnd.integers(0, 6, (120, 150, 3)) * 51)
    b = images.write_with_jvm(spark, r, "gif")
    assert np.array_equal(decode.read_gif(b), r) and np.array_equal(decode.read_gif(lossy.write_gif(r)), r)


def test_interlaced_gif():
    r = photo(16, 21)
    r = r // 64 * 64
    r[..., 0] = 255
    order = [*range(0, 21, 8), *range(4, 21, 8), *range(2, 21, 4), *range(1, 21, 2)]
    b = bytearray(lossy.write_gif(r[order]))
    at = b.index(b",", 13 + 3 * (2 << (b[10] & 7)))
    b[at + 9] |= 0x40
    assert np.array_equal(decode.read_gif(bytes(b)), r)


def bmp(bits, w, h, rows, palette=b""):
    line = -(-w * bits // 32) * 4
    body = b"".join(x.ljust(line, b"\0") for x in rows)
    at = 54 + len(palette)
    return b"BM" + struct.pack("<IHHI", at + len(body), 0, 0, at) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, bits, 0, len(body), 0, 0, len(palette) // 4, 0) + palette + body


def test_bmp_kinds():
    r = photo(13, 7)
    assert np.array_equal(decode.read_bmp(formats.write_bmp(r)), r) and np.array_equal(decode.read_bmp(formats.write_bmp(r), 3), r[::3, ::3])
    pal = b"\0\0\0\0\xff\0\0\0\0\xff\0\0\0\0\xff\0"  # black, blue, green, red
    colors = np.array([[0, 0, 0], [0, 0, 255], [0, 255, 0], [255, 0, 0]])
    index = np.arange(10).reshape(2, 5) % 4
    four = [bytes([r[0] << 4 | r[1], r[2] << 4 | r[3], r[4] << 4]) for r in index.tolist()]
    assert np.array_equal(decode.read_bmp(bmp(4, 5, -2, four, pal))[..., 1:], colors[index])
    assert np.array_equal(decode.read_bmp(bmp(8, 5, 2, [bytes(r) for r in index.tolist()], pal))[..., 1:], colors[index[::-1]])
    assert np.array_equal(decode.read_bmp(bmp(1, 5, 1, [b"\x50"], pal[:8]))[0, :, 3], [0, 255, 0, 255, 0])
    with pytest.raises(ValueError):
        decode.read_bmp(bmp(8, 5, 2, [bytes([9] * 5)] * 2, pal))


def test_broken_files_are_left_out(spark):
    rnd = random.Random(8)
    r = photo(24, 16)
    whole = [lossy.write_jpeg(r), lossy.write_gif(r), formats.write_bmp(r), formats.write_tiff(r), images.file_writer("PNG")[0](r)]
    bad = [None, b"", b"no picture", bytes(rnd.randrange(256) for _ in range(400))]
    for b in whole:
        for _ in range(60):
            x = bytearray(b[: rnd.randrange(len(b))] if rnd.random() < 0.5 else b)
            for _ in range(rnd.randrange(4)):
                if x:
                    x[rnd.randrange(len(x))] = rnd.randrange(256)
            bad.append(bytes(x))
    files = spark.createDataFrame([*((i, bytearray(b)) for i, b in enumerate(whole)), *((100 + i, None if b is None else bytearray(b)) for i, b in enumerate(bad))], "image_id long, content binary")
    rows = {row.image_id: row for row in images.decode_files(files).collect()}
    assert {0, 1, 2, 3, 4} <= rows.keys() and all(len(x.argb) == x.width * x.height for x in rows.values())
    assert all(i >= 104 for i in rows if i > 4)
    assert [rows[i].argb for i in (2, 3, 4)] == [pack(r).tolist()] * 3
    small = {row.image_id: (row.width, row.height) for row in images.decode_files(files.filter("image_id < 5"), step_to=(6, 4)).collect()}
    assert set(small.values()) == {(12, 8)}


def test_progressive_files_are_refused(spark):
    b = bytearray(lossy.write_jpeg(photo(8, 8)))
    b[b.index(b"\xff\xc0") + 1] = 0xC2
    with pytest.raises(ValueError):
        decode.read_jpeg(bytes(b))


@pytest.mark.parametrize("size,target", [((37, 21), (5, 4)), ((64, 64), (64, 3)), ((9, 100), (20, 2)), ((5, 5), (5, 5)), ((3, 2), (9, 7)), ((200, 150), (1, 1))])
def test_rows_resample_as_a_raster_does(size, target):
    from pixelloom.operators.kernels import resize_raster, resize_rows
    from pixelloom.sources import png

    r = photo(*size, alpha=True)
    w, h, rows = png.scanlines(png.fast(r))
    assert (w, h) == size and np.array_equal(resize_rows(rows, w, h, *target), resize_raster(r, *target))
    few = r // 128 * 128
    few[..., 0] = 255
    colors, index = np.unique(few.reshape(-1, 4), axis=0, return_inverse=True)
    w, h, rows = png.scanlines(png.indexed(index.reshape(size[1], size[0]), colors))
    assert np.array_equal(np.stack([*rows]), few)


def test_a_streamed_thumbnail_holds_some_rows(spark):
    from pixelloom.operators.kernels import resize_rows
    from pixelloom.sources import png

    b = png.fast(photo(600, 800, alpha=True))
    tracemalloc.start()
    w, h, rows = png.scanlines(b)
    small = resize_rows(rows, w, h, 30, 40)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert small.shape == (40, 30, 4) and peak < 600 * 800 * 4 / 2 + len(b)
    files = spark.createDataFrame([(1, bytearray(b)), (2, bytearray(b"none")), (3, None), (4, bytearray(lossy.write_jpeg(photo(40, 30)))), (5, bytearray(b[:900]))], "image_id long, content binary")
    got = {x.image_id: (x.width, x.height) for x in images.thumbnails(files, 8, 6).collect()}
    assert got == {1: (8, 6), 4: (8, 6)}
