"""The source of sizes reads headers only and takes filters; the sink leaves the files of one attempt, or none."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.operators.grouped import pack
from pixelloom.sources import datasource, formats, images, lossy


def photo(w, h):
    x, y = np.meshgrid(np.arange(w), np.arange(h))
    return np.stack([np.full((h, w), 255), x * 7 % 256, y * 5 % 256, (x + y) % 256], 2)


@pytest.fixture
def folder(spark, tmp_path):
    datasource.register(spark)
    r = photo(90, 60)
    (tmp_path / "deep").mkdir()
    jpg = lossy.write_jpeg(r)
    files = {"a.png": images.file_writer("PNG")[0](r), "b.gif": lossy.write_gif(r[:30]), "c.bmp": formats.write_bmp(r), "deep/d.jpg": jpg[:2] + b"\xff\xe1\xff\xff" + bytes(65533) + jpg[2:], "e.txt": b"text", "f.png": b"\x89PNG....", "_skip.png": b"", ".skip": b"", "g.bin": b""}
    for name, b in files.items():
        (tmp_path / name).write_bytes(b)
    return tmp_path


def test_sizes(spark, folder):
    rows = {r.path.rsplit("/", 1)[1]: r for r in spark.read.format("image_sizes").option("filesPerTask", 2).load(str(folder)).collect()}
    assert {n: (r.kind, r.width, r.height) for n, r in rows.items()} == {"a.png": ("PNG", 90, 60), "b.gif": ("GIF", 90, 30), "c.bmp": ("BMP", 90, 60), "d.jpg": ("JPG", 90, 60), "e.txt": (None, None, None), "f.png": ("PNG", None, None), "g.bin": (None, None, None)}
    for n, r in rows.items():
        content = next(folder.rglob(n)).read_bytes()
        assert r.length == len(content) and (r.width is None or formats.image_size(content) == (r.width, r.height))
        assert r.bytes_read <= (32 + 60 + 10 if n == "d.jpg" else 32)


def test_headers_agree_with_whole_files():
    """Prefixes and changed bytes of files: the same size as from all bytes, or none where only the rest would tell."""
    import random

    rnd = random.Random(3)
    files = [images.file_writer(k)[0](photo(20, 11)) for k in ("PNG", "GIF", "BMP", "JPG")]
    for _ in range(4000):
        b = bytearray(rnd.choice(files))
        for _ in range(rnd.randrange(3)):
            b[rnd.randrange(60)] = rnd.choice([0, 255, 0xD8, rnd.randrange(256)])
        b = bytes(b[: rnd.randrange(16, len(b) + 1)])
        _, w, h = datasource.header(lambda at, n: b[at : at + n], len(b))  # noqa: B023
        assert ((w, h) if w else None) == formats.image_size(b)


def test_filters_are_pushed(spark, folder, monkeypatch):
    df = spark.read.format("image_sizes").load(str(folder))
    found = df.filter("width > 50 and height < 60 and kind = 'GIF'").select("kind", "height")
    assert [tuple(r) for r in found.collect()] == [("GIF", 30)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan and "\nFilter" not in plan
    assert df.filter("length > 100").filter(F.col("path").endswith("png")).count() == 1
    assert df.filter("kind is null").count() == 2 and df.filter("width is null or width > 80").count() == 7
    # Files that the list rules out are not opened.
    reader = datasource.SizesReader(df.schema, {"path": str(folder)})
    assert [*reader.pushFilters([datasource.D.LessThan(("length",), 10)])] == []
    assert sorted(p.rsplit("/", 1)[1] for part in reader.partitions() for p, _ in part.files) == ["e.txt", "f.png", "g.bin"]


def test_two_columns_open_no_file(spark, folder):
    (folder / "a.png").chmod(0)
    df = spark.read.format("image_sizes").schema("path string, length long").load(str(folder))
    assert df.count() == 7 and spark.read.format("image_sizes").load(str(folder / "deep")).count() == 1
    (folder / "new").mkdir()
    assert spark.read.format("image_sizes").load(str(folder / "new")).count() == 0


def rasters(spark, n, parts=4):
    rows = [(i, 5, 3, pack(photo(5, 3) * (i % 2)).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "image_id long, width int, height int, argb array<long>").repartition(parts)


@pytest.mark.parametrize("kind", ["PNG", "JPG", "GIF", "BMP", "TIFF"])
def test_sink(spark, folder, kind):
    out = folder / "out"
    df = rasters(spark, 6).unionByName(rasters(spark, 1)).unionByName(rasters(spark, 1).withColumn("image_id", F.lit(None).cast("long")))
    df.write.format("image_files").option("kind", kind).mode("append").save(str(out))
    assert sorted(p.name for p in out.iterdir()) == [f"{i}.{kind.lower()}" for i in range(6)]
    files = spark.createDataFrame([(int(p.stem), bytearray(p.read_bytes())) for p in out.iterdir()], "image_id long, content binary")
    assert images.decode_files(files).count() == 6
    rasters(spark, 2).write.format("image_files").option("kind", kind).mode("overwrite").save(str(out))
    assert len([*out.iterdir()]) == 2


def test_a_failed_job_leaves_nothing(spark, folder):
    out = folder / "out"
    rasters(spark, 3).write.format("image_files").mode("append").save(str(out))
    broken = rasters(spark, 40, 8).withColumn("width", F.when(F.col("image_id") == 39, 1000).otherwise(F.col("width")))
    with pytest.raises(Exception):
        broken.write.format("image_files").mode("append").save(str(out))
    assert sorted(p.name for p in out.iterdir()) == ["0.png", "1.png", "2.png"]
    with pytest.raises(Exception):
        rasters(spark, 3).drop("argb").write.format("image_files").mode("append").save(str(out))
    with pytest.raises(Exception):
        rasters(spark, 3).write.format("image_files").option("kind", "XYZ").mode("append").save(str(out))


def test_of_two_attempts_one_counts(tmp_path):
    """A task that ran twice: only the attempt whose message reaches commit is moved; the other one's files go."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"image_id": [7], "width": [5], "height": [3], "argb": [pack(photo(5, 3)).tolist()]})
    writer = datasource.FilesWriter({"path": str(tmp_path)}, False)
    lost, kept = writer.write(iter([batch])), writer.write(iter([batch]))
    assert lost.folder != kept.folder and not [*tmp_path.glob("*.png")]
    writer.commit([kept])
    assert [p.name for p in tmp_path.rglob("*")] == ["7.png"]
    again = datasource.FilesWriter({"path": str(tmp_path)}, False)
    again.write(iter([batch]))
    again.abort([])
    assert [p.name for p in tmp_path.rglob("*")] == ["7.png"]


def test_folders_of_tasks_keep_names_from_the_driver(spark, folder):
    """A commit moves a folder for each task, and a folder's files are listed by the task that reads them."""
    out = folder / "out"
    rasters(spark, 40).write.format("image_files").option("folders", True).mode("append").save(str(out))
    assert all(p.is_dir() and p.name.startswith("part-") for p in out.iterdir()) and len([*out.glob("*/*.png")]) == 40
    df = spark.read.format("image_sizes").load(str(folder))
    reader = datasource.SizesReader(df.schema, {"path": str(folder)})
    assert not [p for part in reader.partitions() for p, _ in part.files if "/out/" in p]
    assert df.filter(F.col("path").contains("/out/") & (F.col("width") == 5)).count() == 40
    assert spark.read.format("image_sizes").load(str(folder)).count() == 47
    rasters(spark, 3).write.format("image_files").option("folders", True).mode("overwrite").save(str(out))
    assert len([*out.glob("*/*.png")]) == 3
