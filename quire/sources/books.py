"""EPUB books as a data source, read and written: ``spark.read.format("epub")``, ``df.write.format("epub")``, after ``register(spark)``.

Reading gives (book, member, media_type, properties, spine, body), a row a file of a book, with what the book's package document says of it. Small books are read several a
task; one larger than ``splitBytes`` (64 MB) is cut by its central directory, so that many tasks read it. Writing takes (book, member, body): ``as=files`` (the default)
lays out a book's files in a folder, ``as=archive`` makes book.epub. Tasks write under ``_temporary``, and only the commit moves whole books to
their places; a killed task, a repeated one or an aborted job leaves no half book.

Paths are those of pyarrow's file systems (local, hdfs://, s3://, gs://), the same on every machine.
"""

from __future__ import annotations

import posixpath
import urllib.parse
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "book string, member string, media_type string, properties string, spine int, body binary"
SPLIT = 64 << 20
BATCH = 8 << 20
DOCUMENT = "application/xhtml+xml"
CONTAINER = "META-INF/container.xml"


def file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def manifest(z: zipfile.ZipFile) -> dict[str, tuple[str | None, str | None, int | None]]:
    """(media type, properties, place in the spine) by member; empty if the book has no package document that can be read."""
    try:
        rootfile = next(e.get("full-path") for e in ElementTree.fromstring(z.read(CONTAINER)).iter() if _local(e.tag) == "rootfile")
        package = ElementTree.fromstring(z.read(rootfile))
    except (KeyError, StopIteration, TypeError, ElementTree.ParseError):
        return {}
    folder = posixpath.dirname(rootfile)
    spine: dict[str | None, int] = {}
    for e in package.iter():
        if _local(e.tag) == "itemref":
            spine.setdefault(e.get("idref"), len(spine))
    out = {}
    for e in package.iter():
        if _local(e.tag) == "item" and e.get("href"):
            member = posixpath.normpath(posixpath.join(folder, urllib.parse.unquote(e.get("href").split("#", 1)[0])))
            out.setdefault(member, (e.get("media-type"), e.get("properties"), spine.get(e.get("id"))))
    return out


@dataclass
class Share(InputPartition):
    """Books of one task: (path, members); None for all of a book's."""

    books: list[tuple[str, list[str] | None]]


class Reader(DataSourceReader):
    def __init__(self, path: str, split: int) -> None:
        self.path, self.split = path, split

    def partitions(self) -> list[InputPartition]:
        """The driver lists names and sizes; it opens only what is cut, and of that the central directory alone."""
        fs, root = file_system(self.path)
        info = fs.get_file_info(root)
        if info.type == pyarrow.fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.is_file else fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True))
        shares: list[InputPartition] = []
        small: list[tuple[str, list[str] | None]] = []
        room = self.split
        for f in sorted((f for f in files if f.is_file and f.path.lower().endswith(".epub") and "/_temporary/" not in f.path), key=lambda f: f.path):
            if f.size > self.split:
                shares += [Share([(f.path, names)]) for names in self.cut(fs, f.path)]
                continue
            if f.size > room and small:
                shares.append(Share(small))
                small, room = [], self.split
            small.append((f.path, None))
            room -= f.size
        return [*shares, *([Share(small)] if small else [])] or [Share([])]

    def cut(self, fs: pyarrow.fs.FileSystem, path: str) -> list[list[str]]:
        out: list[list[str]] = [[]]
        room = self.split
        with fs.open_input_file(path) as f, zipfile.ZipFile(f) as z:
            for m in z.infolist():
                if m.is_dir():
                    continue
                if m.file_size > room and out[-1]:
                    out.append([])
                    room = self.split
                out[-1].append(m.filename)
                room -= m.file_size
        return out

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(self.path)
        names = ["book", "member", "media_type", "properties", "spine", "body"]
        types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.binary()]
        for path, members in partition.books:
            with fs.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                said = manifest(z)
                rows, held = [], 0
                for name in sorted({m.filename for m in z.infolist() if not m.is_dir()} if members is None else members):
                    body = z.read(name)
                    rows.append((path, name, *said.get(name, (None, None, None)), body))
                    held += len(body)
                    if held >= BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: its folder, and the books (files: their members) in it."""

    folder: str = ""
    books: dict[str, list[str]] = field(default_factory=dict)


def safe(name: str | None, what: str) -> str:
    """A relative path that stays in its folder; a name that doesn't fails the task."""
    clean = posixpath.normpath(name or "")
    if not name or clean.startswith(("/", "..")) or clean == "." or "\\" in clean:
        raise ValueError(f"{what} {name!r} is no place in a folder")
    return clean


def put(fs: pyarrow.fs.FileSystem, source: str, target: str) -> None:
    """Moves a file to its place; one that is there goes."""
    fs.create_dir(posixpath.dirname(target), recursive=True)
    if fs.get_file_info(target).is_file:
        fs.delete_file(target)
    fs.move(source, target)


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, archive: bool, overwrite: bool) -> None:
        self.path, self.archive, self.overwrite = path, archive, overwrite
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = file_system(self.path)
        done = Written(f"{root}/_temporary/{self.job}/{uuid.uuid4().hex}")
        book, out, z = None, None, None
        for batch in iterator:
            for i in range(batch.num_rows):
                name, member = (safe(batch.column(c)[i].as_py(), c) for c in ("book", "member"))
                body = batch.column("body")[i].as_py() or b""
                if not self.archive:
                    fs.create_dir(posixpath.dirname(f"{done.folder}/{name}/{member}"), recursive=True)
                    with fs.open_output_stream(f"{done.folder}/{name}/{member}") as f:
                        f.write(body)
                    done.books.setdefault(name, []).append(member)
                    continue
                if name != book:
                    if z is not None:
                        z.close(), out.close()
                    if name in done.books:
                        raise ValueError(f"the rows of {name!r} are not together: use write_archives")
                    book, done.books[name] = name, []
                    fs.create_dir(posixpath.dirname(f"{done.folder}/{name}.epub"), recursive=True)
                    out = fs.open_output_stream(f"{done.folder}/{name}.epub")
                    z = zipfile.ZipFile(out, "w")
                    if member != "mimetype":
                        z.writestr(zipfile.ZipInfo("mimetype"), b"application/epub+zip", zipfile.ZIP_STORED)
                z.writestr(zipfile.ZipInfo(member), body, zipfile.ZIP_STORED if member == "mimetype" else zipfile.ZIP_DEFLATED)
        if z is not None:
            z.close(), out.close()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = file_system(self.path)
        told = [m for m in messages if m is not None]
        taken: set[str] = set()
        for m in told:
            for book, members in m.books.items():
                target = f"{root}/{book}"
                if self.archive:
                    put(fs, f"{m.folder}/{book}.epub", f"{target}.epub")
                    continue
                if self.overwrite and book not in taken and fs.get_file_info(target).type == pyarrow.fs.FileType.Directory:
                    fs.delete_dir(target)
                taken.add(book)
                for member in sorted(set(members)):
                    put(fs, f"{m.folder}/{book}/{member}", f"{target}/{member}")
        self.clean()

    def abort(self, messages: list[Written | None]) -> None:
        self.clean()

    def clean(self) -> None:
        fs, root = file_system(self.path)
        own = f"{root}/_temporary/{self.job}"
        if fs.get_file_info(own).type == pyarrow.fs.FileType.Directory:
            fs.delete_dir(own)
        if fs.get_file_info(f"{root}/_temporary").type == pyarrow.fs.FileType.Directory and not fs.get_file_info(pyarrow.fs.FileSelector(f"{root}/_temporary")):
            fs.delete_dir(f"{root}/_temporary")


class Epub(DataSource):
    @classmethod
    def name(cls) -> str:
        return "epub"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], int(self.options.get("splitBytes", SPLIT)))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], self.options.get("as", "files") == "archive", overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Epub)


def members(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """All files (``SCHEMA``) of all books under a path, ``book`` being the path of the archive. A folder without books has no rows, an archive that can't be read is an error."""
    register(spark)
    return spark.read.format("epub").option("splitBytes", split).load(path)


def documents(files: DataFrame) -> DataFrame:
    """The files that a book's manifest declares as documents, navigation included; what the manifest doesn't name, or names otherwise, isn't one."""
    return files.where(F.col("media_type") == DOCUMENT)


def write_files(files: DataFrame, path: str) -> None:
    """(book, member, body) as files, path/book/member; a book that is there already is replaced whole, other books stay. Rows of one name: one of them. Null bodies are empty files."""
    register(files.sparkSession)
    files.select("book", "member", "body").write.format("epub").mode("overwrite").save(path)


def write_archives(files: DataFrame, path: str) -> None:
    """(book, member, body) as path/book.epub, the mimetype first and stored. A task holds one member of a book at a time; a book is written by one task."""
    register(files.sparkSession)
    one = files.select("book", "member", "body").repartition("book").sortWithinPartitions("book", F.col("member") != "mimetype", "member")
    one.write.format("epub").option("as", "archive").mode("overwrite").save(path)
