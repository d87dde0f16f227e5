"""Image folders as Spark data sources: `image_sizes` reads headers only, `image_files` writes rasters with a committed job.

    images.register(spark)
    spark.read.format("image_sizes").load("/pictures").filter("length > 1000 and width >= 640")
    rasters.write.format("image_files").option("kind", "PNG").mode("append").save("/thumbnails")

Folders are local or remote ones that pyarrow's file systems reach from the driver and all executors.
"""

from __future__ import annotations

import fnmatch
import os
import struct
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import datasource as D
from pyspark.sql.types import StructType

from .formats import ALONE, FRAME, STOP

#: Bytes that are read of any file: enough for the header of all but JPEG files.
HEAD = 32
#: Files of a task.
FILES = 1000


def _open(path: str):
    """The file system of a path, the path inside it, and what makes it a path again."""
    from pyarrow import fs

    if "://" in path:
        store, inner = fs.FileSystem.from_uri(path)
        return store, inner, path[: len(path) - len(inner)] if path.endswith(inner) else path.split("://")[0] + "://"
    path = path.removeprefix("file:")
    return fs.LocalFileSystem(), os.path.abspath(path), ""


def header(read, length: int) -> tuple[str | None, int | None, int | None]:
    """(kind, width, height) of a file of `length` bytes.  read(at, n): its bytes, fewer at the end; of a JPEG only marks are read.

    The kind of a broken file is told if its first bytes are right, the size then is null, and so are all of other files.
    """
    b = read(0, HEAD)
    kind, size = None, (0, 0)
    if b[:4] == b"\x89PNG":
        kind = "PNG"
        if len(b) >= 24 and b[12:16] == b"IHDR":
            size = struct.unpack_from(">ii", b, 16)
    elif b[:3] == b"GIF":
        kind = "GIF"
        if length >= 16:
            size = struct.unpack_from("<HH", b, 6)
    elif b[:2] == b"BM":
        kind = "BMP"
        if len(b) >= 26:
            declared, _, start, info, w, h = struct.unpack_from("<iiiiii", b, 2)
            if declared in (0, length) and info >= 40 and 14 + info <= start <= length:
                size = w, abs(h)
    elif b[:2] == b"\xff\xd8":
        kind, at = "JPG", 2
        while True:
            mark = read(at, 10)
            lead = len(mark) - len(mark.lstrip(b"\xff"))
            if not lead or lead + 3 > len(mark):
                if lead == len(mark) == 10:  # fill bytes without end
                    at += lead - 1
                    continue
                break
            code, data = mark[lead], at + lead + 1
            if code in STOP:
                break
            if code in ALONE:
                at = data
                continue
            if code in FRAME:
                field = read(data, 7)
                if len(field) == 7:
                    size = struct.unpack_from(">HH", field, 3)[::-1]
                break
            n = int.from_bytes(mark[lead + 1 : lead + 3], "big")
            if n < 2:
                break
            at = data + n
    w, h = size
    return (kind, w, h) if kind and w > 0 and h > 0 else (kind, None, None)


#: First letters of the folders that tasks of image_files leave with the option folders.
PART = "part-"


class _Files(D.InputPartition):
    """Files by path and length, or a folder whose files its task lists."""

    def __init__(self, files: list[tuple[str, int]], folder: str | None = None):
        self.files, self.folder = files, folder


#: What pushed filters compare with, by their classes.
_TESTS = {
    D.EqualTo: lambda a, b: a == b, D.GreaterThan: lambda a, b: a > b, D.GreaterThanOrEqual: lambda a, b: a >= b, D.LessThan: lambda a, b: a < b, D.LessThanOrEqual: lambda a, b: a <= b,
    D.In: lambda a, b: a in b, D.StringStartsWith: lambda a, b: a.startswith(b), D.StringEndsWith: lambda a, b: a.endswith(b), D.StringContains: lambda a, b: b in a, D.IsNotNull: lambda a, _: True,
}


class SizesReader(D.DataSourceReader):
    """Lists files on the driver, drops those that a pushed filter on path or length rules out unread, and reads headers in tasks."""

    def __init__(self, schema: StructType, options: dict):
        self.names = schema.fieldNames()
        self.path, self.glob, self.files = options["path"], options.get("pathGlobFilter"), int(options.get("filesPerTask", FILES))
        self.listed: list[tuple[str, type, object]] = []
        self.inside: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[D.Filter]):
        for f in filters:
            name, known = ".".join(getattr(f, "attribute", ())), type(f) in _TESTS
            if not known or name not in ("path", "length", "kind", "width", "height"):
                yield f
                continue
            test = (name, type(f), getattr(f, "value", None))
            (self.listed if name in ("path", "length") else self.inside).append(test)

    @staticmethod
    def _passes(tests, row: dict) -> bool:
        """As in SQL: no comparison with null holds."""
        return all(row[name] is not None and value is not None and _TESTS[kind](row[name], value) or kind is D.IsNotNull and row[name] is not None for name, kind, value in tests)

    def _list(self, folder: str) -> tuple[list[tuple[str, int]], list[str]]:
        """Files below a folder that the filters pass, and the folders that tasks list themselves."""
        from pyarrow import fs

        store, base, lead = _open(folder)
        info = store.get_file_info(base)
        found = store.get_file_info(fs.FileSelector(base)) if info.type == fs.FileType.Directory else [info]
        files, parts = [], []
        for f in found:
            if f.type == fs.FileType.Directory and f.base_name.startswith(PART):
                parts.append(lead + f.path)
            elif f.type == fs.FileType.Directory:
                more = self._list(lead + f.path)
                files, parts = files + more[0], parts + more[1]
            elif f.type == fs.FileType.File and not f.base_name.startswith((".", "_")) and (not self.glob or fnmatch.fnmatch(f.base_name, self.glob)):
                files.append((lead + f.path, f.size))
        return sorted(f for f in files if self._passes(self.listed, {"path": f[0], "length": f[1]})), sorted(parts)

    def partitions(self):
        files, parts = self._list(self.path)
        files.sort()
        return [_Files(files[i : i + self.files]) for i in range(0, len(files), self.files)] + [_Files([], p) for p in parts] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        files, folders = partition.files, [partition.folder] if partition.folder else []
        while folders:
            more = self._list(folders.pop())
            files, folders = files + more[0], folders + more[1]
        rows = []
        needs = {"kind", "width", "height", "bytes_read"} & {*self.names, *(t[0] for t in self.inside)}
        for path, length in files:
            row = {"path": path, "length": length, "kind": None, "width": None, "height": None, "bytes_read": 0}
            if needs:
                store, inner, _ = _open(path)
                with store.open_input_file(inner) as file:

                    def read(at: int, n: int, file=file, row=row) -> bytes:
                        got = file.read_at(n, at) if at < length else b""  # noqa: B023
                        row["bytes_read"] += len(got)
                        return got

                    row["kind"], row["width"], row["height"] = header(read, length)
            if self._passes(self.inside, row):
                rows.append(tuple(row[n] for n in self.names))
        yield from rows


class ImageSizes(D.DataSource):
    """path, length, kind, width, height and bytes_read of the image files in a folder and below, from their headers.

    Options: pathGlobFilter, filesPerTask.  A schema of fewer columns reads no file if path and length are all of them.  Files whose
    names begin with a dot or an underscore are left out.  Filters on path and length are applied to the list, those on kind, width and
    height in the tasks (folders named part-... are listed by tasks, all others by the driver; with spark.sql.python.filterPushdown.enabled; Spark applies them itself without it).
    """

    @classmethod
    def name(cls) -> str:
        return "image_sizes"

    def schema(self) -> str:
        return "path string, length long, kind string, width int, height int, bytes_read long"

    def reader(self, schema: StructType) -> SizesReader:
        return SizesReader(schema, self.options)


class _Written(D.WriterCommitMessage):
    def __init__(self, folder: str, names: list[str]):
        self.folder, self.names = folder, names


class FilesWriter(D.DataSourceArrowWriter):
    """Each attempt of a task writes into a folder of its own below _temporary; only commit moves files into place.

    So a task that is run again leaves the files of one attempt, and a job that fails leaves none.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.kind, self.quality = options["path"], options.get("kind", "PNG"), float(options.get("quality", -1))
        self.overwrite, self.job, self.folders = overwrite, uuid.uuid4().hex, str(options.get("folders", "false")).lower() == "true"
        self.temporary = f"_temporary/{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        from pixelloom.operators.grouped import unpack

        from .images import file_writer

        encode, suffix = file_writer(self.kind, self.quality)
        store, base, _ = _open(self.path)
        folder = f"{base}/{self.temporary}/{uuid.uuid4().hex}"
        store.create_dir(folder)
        names = []
        for batch in iterator:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i, (image, w, h) in enumerate(zip(*(column[c].to_pylist() for c in ("image_id", "width", "height")))):
                if image is None or not column["argb"][i].is_valid:
                    continue
                name = f"{image}.{suffix}"
                with store.open_output_stream(f"{folder}/{name}") as out:
                    out.write(encode(unpack(column["argb"][i].values.to_numpy(), w, h)))
                names.append(name)
        return _Written(folder, [] if self.folders else [*dict.fromkeys(names)])

    def commit(self, messages) -> None:
        from pyarrow import fs

        store, base, _ = _open(self.path)
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(base)):
                if f.type == fs.FileType.File:
                    store.delete_file(f.path)
                elif f.base_name != "_temporary":
                    store.delete_dir(f.path)
        if self.folders:
            moves = [(m.folder, f"{base}/{PART}{m.folder.rsplit('/', 1)[1]}") for m in messages if m]
        else:
            moves = [(f"{m.folder}/{n}", f"{base}/{n}") for m in messages if m for n in m.names]
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda m: store.move(*m), moves))
        self._clear(store, base)

    def abort(self, messages) -> None:
        store, base, _ = _open(self.path)
        self._clear(store, base)

    def _clear(self, store, base: str) -> None:
        from pyarrow import fs

        if store.get_file_info(f"{base}/{self.temporary}").type == fs.FileType.Directory:
            store.delete_dir(f"{base}/{self.temporary}")
        top = f"{base}/_temporary"
        if store.get_file_info(top).type == fs.FileType.Directory and not store.get_file_info(fs.FileSelector(top)):
            store.delete_dir(top)


class ImageFiles(D.DataSource):
    """Writes rasters (image_id, width, height, argb) as path/image_id.suffix.

    Options: kind (PNG, JPG, GIF, BMP, TIFF; PNG), quality of JPG from 0 to 1.  Mode append replaces files of the same names, overwrite
    all that was there, both when the job commits.  folders: true leaves the files of each task in a folder part-... of its own, which is
    moved whole, so that the driver sees no names of files; append then replaces none, and repeated ids of two tasks both stay.  Rows without id or pixels are left out; of repeated ids one file stays.
    """

    @classmethod
    def name(cls) -> str:
        return "image_files"

    def schema(self) -> str:
        return "image_id bigint, width int, height int, argb array<bigint>"

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        missing = {"image_id", "width", "height", "argb"} - {*schema.fieldNames()}
        if missing:
            raise ValueError(f"rasters lack {', '.join(sorted(missing))}")
        return FilesWriter(self.options, overwrite)


def register(spark) -> None:
    """Make both formats known to a session, and let filters reach the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ImageSizes)
    spark.dataSource.register(ImageFiles)
