"""Documents of pages from files, as a Spark data source. A file that can't be read gives one row that says why, and a page that can't be read is skipped with a warning; nothing else fails.

A file is either text with its pages parted by form feeds, or a zip archive with an entry a page, in the order of their names. Files are dealt in groups of GROUP paths, a partition each, and read where they are dealt to; a task holds one file.

    spark.dataSource.register(PageFiles)
    spark.read.format("page_files").option("paths", json.dumps([...])).load()      # or .load(folder)
"""

from __future__ import annotations

import io
import json
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quire.runtime import ship

GROUP = 64
#: state is 'page', 'skipped' (a page with its warning) or 'failed' (a file, with problem and message).
SCHEMA = "path string, state string, page_no int, html string, problem string, message string"
Row = tuple[str, str, int | None, str | None, str | None, str | None]


def _failed(path: str, problem: str, message: str) -> Row:
    return path, "failed", None, None, problem, message


def _zipped(path: str, raw: bytes, password: str | None) -> Iterator[Row]:
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        entries = sorted((i for i in archive.infolist() if not i.is_dir()), key=lambda i: i.filename)
        key = password.encode() if password else None
        if any(i.flag_bits & 1 for i in entries):
            if key is None:
                yield _failed(path, "locked", "a password is needed")
                return
            try:
                next(archive.open(i, pwd=key) for i in entries if i.flag_bits & 1).close()
            except RuntimeError:
                yield _failed(path, "locked", "the password is wrong")
                return
        for n, entry in enumerate(entries, 1):
            try:
                yield path, "page", n, archive.read(entry, pwd=key if entry.flag_bits & 1 else None).decode("utf-8"), None, None
            except (zipfile.BadZipFile, zlib.error, UnicodeDecodeError, RuntimeError, EOFError) as error:
                yield path, "skipped", n, None, "page", f"page {n} could not be read and has been skipped: {type(error).__name__}"


def read_document(path: str, password: str | None = None) -> Iterator[Row]:
    """The rows of one file."""
    if not path.strip():
        yield _failed(path, "no file", "no file was given")
        return
    try:
        fs, name = pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)
        with fs.open_input_stream(name, compression=None) as source:
            raw = source.read()
    except FileNotFoundError:
        yield _failed(path, "missing", "the file could not be found")
        return
    except PermissionError:
        yield _failed(path, "no permission", "the file could not be opened")
        return
    except (OSError, ValueError) as error:
        yield _failed(path, "unreadable", type(error).__name__)
        return
    try:
        if raw[:2] == b"PK":
            yield from _zipped(path, raw, password)
            return
        pages = raw.decode("utf-8").split("\f")
        if not any("<" in p for p in pages):
            yield _failed(path, "malformed", "there is no markup")
            return
        for n, page in enumerate(pages, 1):
            if page.strip():
                yield path, "page", n, page, None, None
            else:
                yield path, "skipped", n, None, "page", f"page {n} is empty and has been skipped"
    except (zipfile.BadZipFile, UnicodeDecodeError) as error:
        yield _failed(path, "malformed", type(error).__name__)


@dataclass
class Group(InputPartition):
    paths: tuple[str, ...]


class PageFilesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        if "paths" in self.options:
            paths = json.loads(self.options["paths"])
        else:
            root = self.options["path"]
            fs, base = pyarrow.fs.FileSystem.from_uri(root) if "://" in root else (pyarrow.fs.LocalFileSystem(), root)
            head = root[: len(root) - len(base)] if root.endswith(base) else ""
            paths = sorted(head + f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(base, recursive=True)) if f.type == pyarrow.fs.FileType.File)
        size = int(self.options.get("group", GROUP))
        return [Group(tuple(paths[i : i + size])) for i in range(0, len(paths), size)] or [Group(())]

    def read(self, partition: Group) -> Iterator[Row]:
        for path in partition.paths:
            yield from read_document(path, self.options.get("password"))


class PageFiles(DataSource):
    """Format page_files. Options: path (a folder) or paths (a JSON list), group (paths a partition), password."""

    @classmethod
    def name(cls) -> str:
        return "page_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PageFilesReader(dict(self.options))


def load_files(spark: SparkSession, paths: list[str] | str, password: str | None = None, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """Pages (path, page_no, html), and what couldn't be read (path, page_no, problem, message; page_no null for whole files). paths: a list, or a folder."""
    ship(spark)
    spark.dataSource.register(PageFiles)
    source = spark.read.format("page_files").option("group", str(group))
    source = source.option("password", password) if password else source
    rows = source.load(paths) if isinstance(paths, str) else source.option("paths", json.dumps(paths)).load()
    return rows.filter("state = 'page'").select("path", "page_no", "html"), rows.filter("state <> 'page'").select("path", "page_no", "problem", "message")


def damaged(raw: bytes) -> bytes:
    """A zip archive with one byte of its first entry's content turned, for tests."""
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        first = min(archive.infolist(), key=lambda i: i.filename)
    at = first.header_offset + 30 + int.from_bytes(raw[first.header_offset + 26 : first.header_offset + 28], "little") + int.from_bytes(raw[first.header_offset + 28 : first.header_offset + 30], "little")
    return raw[:at] + bytes([raw[at] ^ 255]) + raw[at + 1 :]


def zipped(pages: list[str], locked: bool = False) -> bytes:
    """An archive of pages; ``locked`` sets the mark of encryption on its entries."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
        for n, page in enumerate(pages, 1):
            archive.writestr(zipfile.ZipInfo(f"{n:06d}.html", (2020, 1, 1, 0, 0, 0)), page)
    raw = bytearray(out.getvalue())
    if locked:
        for mark, flags in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):
            at = raw.find(mark)
            while at >= 0:
                raw[at + flags] |= 1
                at = raw.find(mark, at + 4)
    return bytes(raw)
