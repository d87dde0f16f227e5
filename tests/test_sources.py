"""Codecs against independent decoders, fuzz, and files through Spark's sources."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.operators.grouped import pack
from pixelloom.sources import formats, images, lossy, png


def raster(w, h, seed=1, alpha=True):
    r = np.random.default_rng(seed).integers(0, 256, (h, w, 4))
    if not alpha:
        r[..., 0] = 255
    return r


def files(w=13, h=7):
    r = raster(w, h, alpha=False)
    few = np.random.default_rng(2).integers(0, 5, (h, w))
    pal = np.array([[255, 10 * i, 20, 255 - i] for i in range(5)])
    return r, few, pal


@pytest.mark.parametrize("n,bits", [(2, 1), (4, 2), (16, 4), (17, 8), (200, 8)])
def test_depths_read_back(n, bits):
    pal = np.array([[255 if i else 7, i, 255 - i, i * 3 % 256] for i in range(n)])
    index = np.arange(9 * 31).reshape(9, 31) % n
    data = png.indexed(index, pal)
    assert dict((k, d) for _, k, _, d in png.chunks(data))["IHDR"][8] == bits
    assert (png.decode(data) == pal[index]).all()


def test_true_color_reads_back():
    r, few, pal = files()
    for alpha in (True, False):
        x = raster(300, 7, alpha=alpha)
        assert (png.decode(png.fast(x, alpha, 6)) == x).all()
    assert (png.decode(png.truecolor(few, pal)) == pal[few]).all()
    pal[2, 0] = 9
    assert (png.decode(png.truecolor(few, pal)) == pal[few]).all()


def test_segments_are_one_stream():
    raw = random.Random(1).randbytes(5000) * 3
    for parts in (1, 2, 7):
        assert zlib.decompress(png.segmented(raw, 3, parts)) == raw


def test_the_built_in_image_source_agrees(spark, tmp_path):
    r, few, pal = files()
    made = {"a.png": png.fast(r, False), "b.png": png.indexed(few, pal), "c.png": png.truecolor(few, pal), "d.bmp": formats.write_bmp(r), "e.tif": formats.write_tiff(r), "f.png": png.fast(raster(13, 7), True), "g.tif": formats.write_tiff(raster(13, 7))}
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "broken.png").write_bytes(b"not an image at all")
    want = {"a.png": r, "b.png": pal[few], "c.png": pal[few], "d.bmp": r, "e.tif": r, "f.png": raster(13, 7), "g.tif": raster(13, 7)}
    got = {x.path.rsplit("/", 1)[1]: x for x in images.read_images(spark, str(tmp_path)).collect()}
    assert set(got) == set(want)
    for name, x in want.items():
        assert (got[name].width, got[name].height) == (13, 7) and got[name].argb == pack(x).tolist(), name
    sized = images.read_files(spark, str(tmp_path)).select("path", images.image_size("content").alias("k"), images.native_size(F.col("content")).alias("n")).collect()
    for x in sized:
        name = x.path.rsplit("/", 1)[1]
        size = (13, 7) if name.endswith(("png", "bmp")) and name != "broken.png" else (None, None)
        assert (x.k.width, x.k.height) == size and (x.n is None if size[0] is None else tuple(x.n) == size)


def test_jvm_writers(spark, tmp_path):
    r = raster(40, 24)
    for kind, quality in (("jpeg", 0.9), ("gif", -1), ("png", -1)):
        data = images.write_with_jvm(spark, r, kind, quality)
        assert formats.image_size(data) == (40, 24)
    with pytest.raises(ValueError):
        images.write_with_jvm(spark, r, "webp")


def segment(marker, data):
    return bytes([0xFF, marker]) + struct.pack(">H", len(data) + 2) + data


def jpeg(transform=0, jfif=True, ids=b"\1\2\3", adobe=True):
    frame = b"\x08" + struct.pack(">HH", 32, 48) + b"\3" + b"".join(bytes([i]) + b"\x11\0" for i in ids)
    return b"\xff\xd8" + (segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") if jfif else b"") + (segment(0xEE, b"Adobe\0\x64\0\0\0\0" + bytes([transform])) if adobe else b"") + segment(0xC0, frame) + segment(0xDA, b"\0" * 10) + b"\x55" * 20 + b"\xff\xd9"


def test_jpeg_repair():
    good = jpeg()
    fixed = formats.reconcile_jpeg(good)
    assert fixed != good and fixed == jpeg(transform=1)
    for same in (jpeg(1), jpeg(2), jpeg(jfif=False), jpeg(ids=b"RGB"), jpeg(adobe=False), b"", b"\xff\xd8", None, good[:30], png.SIGNATURE):
        assert formats.reconcile_jpeg(same) == same
    assert formats.image_size(good) == (48, 32) and formats.image_size(b"\xff\xd8\xff" + good[2:]) == (48, 32)


def test_sizes_never_raise():
    r, few, pal = files()
    bmp = formats.write_bmp(r)
    base = [png.indexed(few, pal), jpeg(), bmp, b"GIF89a\x05\x00\x06\x00" + b"\0" * 10, bmp[:22] + struct.pack("<i", -7) + bmp[26:]]
    assert [formats.image_size(b) for b in base] == [(13, 7), (48, 32), (13, 7), (5, 6), (13, 7)]
    rnd = random.Random(9)
    for b in base:
        for n in range(0, len(b), 3):
            size = formats.image_size(b[:n])
            assert size is None or min(size) > 0
            formats.reconcile_jpeg(b[:n])
        for _ in range(300):
            x = bytearray(b)
            x[rnd.randrange(len(x))] = rnd.randrange(256)
            formats.image_size(bytes(x)), formats.reconcile_jpeg(bytes(x)), png.profile(bytes(x)), png.read_text(bytes(x))
    for _ in range(5000):
        formats.image_size(rnd.randbytes(rnd.randrange(60)))
    assert [formats.image_size(x) for x in (None, b"", b"plain text, long enough", b"%PDF-1.4 and so on....", b"BM" + b"\0" * 60)] == [None] * 5


def with_profile(data, profile):
    body = b"name\0\0" + zlib.compress(profile)
    return data[:33] + png.chunk(b"iCCP", body) + data[33:]


def test_profiles():
    _, few, pal = files()
    data = png.indexed(few, pal)
    assert png.profile(with_profile(data, b"profile")) == b"profile" and png.profile(data) is None and png.profile(None) is None
    assert png.profile(with_profile(data, b"\0" * (1 << 24))) is None  # a bomb
    assert png.profile(data[:33] + png.chunk(b"iCCP", b"name\0\0broken") + data[33:]) is None


def icc(gamma):
    curve = b"curv\0\0\0\0" + struct.pack(">IH", 1, int(gamma * 256)) + b"\0\0"
    columns = [b"XYZ \0\0\0\0" + struct.pack(">3i", *(int(round(v * 65536)) for v in formats.SRGB_D50[:, i])) for i in range(3)]
    tags, body, at = [], b"", 132 + 12 * 6
    for name, data in zip((b"rXYZ", b"gXYZ", b"bXYZ", b"rTRC", b"gTRC", b"bTRC"), [*columns, curve, curve, curve]):
        tags.append(name + struct.pack(">II", at + len(body), len(data)))
        body += data
    head = bytearray(128)
    head[16:20], head[36:40] = b"RGB ", b"acsp"
    return bytes(head) + struct.pack(">I", 6) + b"".join(tags) + body


def test_conversion_to_srgb():
    r = np.full((1, 3, 4), 255)
    r[0, :, 1:] = [[0, 0, 0], [128, 128, 128], [255, 255, 255]]
    out, done = formats.to_srgb(r, icc(1.0))
    assert done and out[0, 0, 1:].tolist() == [0, 0, 0] and out[0, 2, 1:].tolist() == [255, 255, 255] and abs(out[0, 1, 1] - 188) <= 1
    for bad in (None, b"", b"x" * 200, icc(1.0)[:150]):
        same, done = formats.to_srgb(r, bad)
        assert not done and same is r


def test_text(spark):
    _, few, pal = files()
    data = png.write_text(png.indexed(few, pal), {"Title": "blue", "Späť": "ž"})
    assert png.read_text(data)["Title"] == "blue" and "ž" in png.read_text(data).values() and (png.decode(data) == pal[few]).all()
    assert png.write_text(b"no", {}) is None and png.read_text(b"no") == {}
    again = png.write_text(data, {"Title": "red"})
    assert png.read_text(again)["Title"] == "red"


def test_decode_with_a_target_size(spark):
    big = raster(64, 48, alpha=False)
    df = spark.createDataFrame([(1, bytearray(png.fast(big, False))), (2, bytearray(b"broken"))], "image_id long, content binary")
    rows = images.decode_png(df, step_to=(8, 6)).collect()
    assert [(x.image_id, x.width, x.height) for x in rows] == [(1, 16, 12)] and rows[0].argb == pack(big[::4, ::4]).tolist()


def test_stream_of_files(spark, tmp_path):
    from pixelloom.streaming.ingest import stream_files, stream_sizes

    _, few, pal = files()
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.png").write_bytes(png.indexed(few, pal))
    q = stream_sizes(stream_files(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("sizes").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    (tmp_path / "in/b.png").write_bytes(png.indexed(few.T, pal))
    q.processAllAvailable()
    q.stop()
    assert {(r.width, r.height) for r in spark.sql("SELECT * FROM sizes").collect()} == {(13, 7), (7, 13)}


def smooth(w, h):
    y, x = np.mgrid[0:h, 0:w]
    return np.stack([np.full(x.shape, 255), x * 255 // max(w - 1, 1), y * 255 // max(h - 1, 1), (x + y) % 256], axis=2)


@pytest.mark.parametrize("kind", ["JPG", "GIF", "PNG", "BMP"])
def test_files_made_on_executors_are_read_by_the_built_in_source(spark, tmp_path, kind):
    rasters = {1: smooth(83, 61), 2: smooth(1, 1), 3: np.where((np.indices((40, 40)).sum(axis=0) // 8 % 2)[..., None], 255, raster(40, 40, alpha=False) // 64 * 64)}
    rasters[3][..., 0] = 255
    df = spark.createDataFrame([(i, r.shape[1], r.shape[0], pack(r).tolist()) for i, r in rasters.items()], "image_id long, width int, height int, argb array<bigint>")
    folder = str(tmp_path / "out")
    assert images.write_files(images.encode_files(df, kind, 0.9), folder, kind.lower()) == 3
    for row in images.read_images(spark, folder).collect():
        want = rasters[int(row.path.rsplit("/", 1)[1].split(".")[0])]
        c = np.array(row.argb)
        got = np.stack([c >> 16 & 255, c >> 8 & 255, c & 255], axis=1).reshape(row.height, row.width, 3)
        assert got.shape[:2] == want.shape[:2]
        assert np.abs(got - want[..., 1:]).mean() < {"JPG": 12, "GIF": 6}.get(kind, 0.01)


def test_jpeg_quality_and_clear_pixels():
    r = smooth(64, 64)
    sizes = [len(lossy.write_jpeg(r, q)) for q in (0.1, 0.5, 0.9)]
    assert sizes == sorted(sizes) and formats.image_size(lossy.write_jpeg(r)) == (64, 64)
    r[:8, :8, 0] = 0
    assert formats.image_size(lossy.write_gif(r)) == (64, 64) and b"!\xf9" in lossy.write_gif(r)
    lengths = lossy.code_lengths(np.array([int(1.6**k) + 1 for k in range(40)] + [0] * 217))
    assert max(lengths.values()) <= 16 and sum(2.0**-n for n in lengths.values()) < 1
    with pytest.raises(ValueError):
        lossy.write_jpeg(np.zeros((1, 1 << 16, 4), int))


def interlaced(r):
    h, w, _ = r.shape
    raw = b""
    for x0, y0, dx, dy in png.ADAM7:
        part = r[y0::dy, x0::dx, 1:].astype(np.uint8)
        if part.size:
            raw += b"".join(b"\0" + line.tobytes() for line in part)
    return png.SIGNATURE + png.chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 1)) + png.chunk(b"IDAT", zlib.compress(raw)) + png.chunk(b"IEND")


@pytest.mark.parametrize("w,h", [(1, 1), (3, 5), (13, 7), (32, 17)])
def test_interlaced_and_stepped(w, h):
    r = raster(w, h, alpha=False)
    for data in (interlaced(r), png.fast(r, False)):
        for step in (1, 2, 4):
            assert (png.decode(data, step) == r[::step, ::step]).all()
    with pytest.raises(ValueError):
        png.decode(png.SIGNATURE + png.chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 4, 8, 2, 0, 0, 0)) + png.chunk(b"IDAT", zlib.compress(b"\0" * 9)) + png.chunk(b"IEND"))


def test_low_depths_are_scaled_or_shifted():
    data = png.SIGNATURE + png.chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 1, 2, 0, 0, 0, 0)) + png.chunk(b"IDAT", zlib.compress(b"\0\x1b")) + png.chunk(b"IEND")
    assert png.decode(data)[0, :, 1].tolist() == [0, 85, 170, 255] and png.decode(data, shift=True)[0, :, 1].tolist() == [0, 64, 128, 192]


def test_tiff_reads_back_and_refuses_others():
    for alpha in (True, False):
        r = raster(9, 5, alpha=alpha)
        assert (formats.read_tiff(formats.write_tiff(r)) == r).all()
    with pytest.raises(ValueError):
        formats.read_tiff(b"II*\1" + bytes(20))


def test_comments_of_jpeg_and_gif(spark, tmp_path):
    r = smooth(30, 20)
    for name, data in (("a.jpg", lossy.write_jpeg(r)), ("b.gif", lossy.write_gif(r))):
        assert formats.read_text(data) == {}
        tagged = formats.write_text(formats.write_text(data, {"Title": "one"}), {"Title": "two " * 100})
        assert formats.read_text(tagged) == {"comment": "two " * 100}
        assert formats.image_size(tagged) == (30, 20)
        (tmp_path / name).write_bytes(tagged)
    assert {(x.width, x.height) for x in images.read_images(spark, str(tmp_path)).collect()} == {(30, 20)} and images.read_images(spark, str(tmp_path)).count() == 2
    assert formats.read_text(b"no image at all, but long enough") == {} and formats.write_text(b"no", {}) is None and formats.read_text(b"\xff\xd8\xff\xe0\0\1") == {}


def test_counts_of_a_stream(spark, tmp_path):
    from pixelloom.streaming.ingest import size_counts, stream_files

    (tmp_path / "in").mkdir()
    for i in range(5):
        (tmp_path / f"in/{i}.png").write_bytes(png.fast(raster(4 + i, 3)))
    (tmp_path / "in/none.png").write_bytes(b"no image")
    q = size_counts(stream_files(spark, str(tmp_path / "in")), window="36500 days").writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    rows = spark.sql("SELECT sum(images) AS n, sum(bytes) AS b FROM counts").collect()
    assert [(x.n, x.b) for x in rows] == [(5, sum(f.stat().st_size for f in (tmp_path / "in").iterdir()))]


def test_the_image_source_with_a_target_size(spark, tmp_path):
    big = smooth(64, 48)
    (tmp_path / "a.jpg").write_bytes(lossy.write_jpeg(big, 0.95))
    (tmp_path / "b.png").write_bytes(png.fast(big, False))
    (tmp_path / "c.png").write_bytes(png.SIGNATURE + png.chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 2, 8, 0, 0, 0, 0)) + png.chunk(b"IDAT", zlib.compress(b"\0\1\2\3\4" * 2)) + png.chunk(b"IEND"))
    rows = {r.path.rsplit("/", 1)[1]: r for r in images.read_images(spark, str(tmp_path), step_to=(8, 6)).collect()}
    assert {k: (r.width, r.height) for k, r in rows.items()} == {"a.jpg": (16, 12), "b.png": (16, 12), "c.png": (4, 2)}
    assert rows["b.png"].argb == pack(big[::4, ::4]).tolist() and [x & 255 for x in rows["c.png"].argb] == [1, 2, 3, 4] * 2


def test_lattice_by_tetrahedra():
    """Linear tables are kept exactly; of others the corners are, and a cell's diagonal is straight."""
    rnd = np.random.default_rng(4)
    points = rnd.random((500, 3))
    axes = np.stack(np.meshgrid(*[np.linspace(0, 1, 5)] * 3, indexing="ij"), axis=-1)
    turn = rnd.random((3, 3))
    assert np.allclose(formats.lattice(axes @ turn, points), points @ turn)
    grid = rnd.random((4, 4, 4, 3))
    for i, j, k in ((0, 0, 0), (3, 3, 3), (1, 2, 3), (3, 0, 1)):
        assert np.allclose(formats.lattice(grid, np.array([[i, j, k]]) / 3), grid[i, j, k])
    assert np.allclose(formats.lattice(grid, np.array([[0.5, 0.5, 0.5]])), (grid[1, 1, 1] + grid[2, 2, 2]) / 2)
    # Six tetrahedra: of three fractions in order, weights are the differences.
    r, g, b = 0.9 / 3, 0.5 / 3, 0.2 / 3
    want = 0.1 * grid[0, 0, 0] + 0.4 * grid[1, 0, 0] + 0.3 * grid[1, 1, 0] + 0.2 * grid[1, 1, 1]
    assert np.allclose(formats.lattice(grid, np.array([[r, g, b]])), want)


def test_table_profiles_to_lab():
    """A table of 8 bits that says Lab for grey levels: its lightness curve is what comes out."""
    from pixelloom.plans.catalogue import _profile

    ramp = bytes(range(256))
    corners = bytes([c for r in (0, 1) for g in (0, 1) for b in (0, 1) for c in (255 * g, 128, 128)])
    icc = _profile(b"RGB ", [(b"A2B0", b"mft1" + bytes(4) + bytes([3, 3, 2, 0]) + bytes(36) + ramp * 3 + corners + ramp * 3)], b"Lab ")
    raster = np.full((1, 256, 4), 255)
    raster[0, :, 1:] = np.arange(256)[:, None]
    out, done = formats.to_srgb(raster, icc)
    light = np.arange(256) / 255 * 100
    y = np.where(light > 8, ((light + 16) / 116) ** 3, light / 903.2963)
    want = np.where(y <= 0.0031308, 12.92 * y, 1.055 * y ** (1 / 2.4) - 0.055) * 255
    assert done and np.abs(out[0, :, 1:] - want[:, None]).max() <= 1
    for broken in (icc[:200], icc.replace(b"mft1", b"mABx"), icc[:132] + b"A2B0" + b"\xff" * 8 + icc[144:]):
        same, done = formats.to_srgb(raster, broken)
        assert not done and same is raster
