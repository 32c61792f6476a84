"""Archives as a data source: spark.read.format("archives").load(folder) gives (archive, name, content), a row for each file inside.

Partitions are archives; large zip files are cut into ranges of their members, which tasks read on their own, by seeking.
Tar files are read as a stream, from front to end. No archive is held as a whole, neither by the driver nor by a task; a
batch of rows is some megabytes, or one member.

An archive with links, devices, names that lead out of it, too many members or too many bytes ends the reading with an
error. Of a zip file its directory is checked first: the sizes that it declares must keep to the limit, and no member may
give more than it declares, so all ranges together keep to it. Of a tar file bytes are counted as they come. Folders are no
rows; empty archives give none. Folders are listed and files opened by pyarrow, which reads local disks and the usual stores.
"""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from basaltine.sources.code import MAX_BYTES, MAX_MEMBERS, safe_member

SCHEMA = "archive string, name string, content binary"
ENDS = (".zip", ".tar", ".tgz", ".tar.gz")
#: Bytes of a zip file's packed members that a task reads; bytes of rows that make a batch full.
RANGE_BYTES, BATCH_BYTES = 64 << 20, 4 << 20
SMALL = 1 << 17


def refused(archive: str, name: str, why: str) -> ValueError:
    return ValueError(f"{archive}: member {name!r} {why}")


@dataclass
class Part(InputPartition):
    """Members first to end of an archive; a tar file is one part."""

    archive: str
    first: int = 0
    end: int | None = None


def _located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _seekable(store: fs.FileSystem, path: str):
    """A zip file to read from; a small one as a whole, since pyarrow's files complain of seeks before their start in a way that zipfile doesn't expect."""
    f = store.open_input_file(path)
    return io.BytesIO(f.read()) if f.size() < SMALL else f


def _directory(archive: str, packed: zipfile.ZipFile, members: int, most: int) -> list[zipfile.ZipInfo]:
    """The members of a zip file, all of them allowed."""
    found = packed.infolist()
    if len(found) > members:
        raise refused(archive, found[members].filename, f"is beyond the limit of {members}")
    size = 0
    for m in found:
        kind = (m.external_attr >> 16) & 0o170000
        if kind not in (0, 0o100000, 0o040000) or not safe_member(m.filename):
            raise refused(archive, m.filename, "is not allowed")
        size += m.file_size
        if size > most:
            raise refused(archive, m.filename, f"leads beyond {most} bytes")
    return found


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.members = int(options.get("maxmembers", MAX_MEMBERS))
        self.most = int(options.get("maxbytes", MAX_BYTES))
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[Part]:
        store, root = _located(self.path)
        there = store.get_file_info(root)
        infos = [there] if there.is_file else store.get_file_info(fs.FileSelector(root, recursive=True))
        parts = []
        for info in sorted((i for i in infos if i.is_file and i.path.lower().endswith(ENDS)), key=lambda i: i.path):
            if info.path.lower().endswith(".zip") and info.size > self.range_bytes:
                with _seekable(store, info.path) as f, zipfile.ZipFile(f) as packed:
                    parts += self._ranges(info.path, _directory(info.path, packed, self.members, self.most))
            else:
                parts.append(Part(info.path))
        return parts

    def _ranges(self, archive: str, members: list[zipfile.ZipInfo]) -> Iterator[Part]:
        first = size = 0
        for k, m in enumerate(members):
            if size and size + m.compress_size > self.range_bytes:
                yield Part(archive, first, k)
                first, size = k, 0
            size += m.compress_size
        yield Part(archive, first, len(members))

    def _zip(self, store: fs.FileSystem, part: Part) -> Iterator[tuple[str, bytes]]:
        with _seekable(store, part.archive) as f, zipfile.ZipFile(f) as packed:
            for m in _directory(part.archive, packed, self.members, self.most)[part.first : part.end]:
                if not m.is_dir():
                    with packed.open(m) as body:
                        raw = body.read(m.file_size + 1)
                    if len(raw) > m.file_size:
                        raise refused(part.archive, m.filename, "has more bytes than it declares")
                    yield m.filename, raw

    def _tar(self, store: fs.FileSystem, part: Part) -> Iterator[tuple[str, bytes]]:
        n = size = 0
        with store.open_input_stream(part.archive, compression=None) as f, tarfile.open(fileobj=f, mode="r|*") as packed:
            for m in packed:
                n += 1
                if n > self.members:
                    raise refused(part.archive, m.name, f"is beyond the limit of {self.members}")
                if not (m.isfile() or m.isdir()) or not safe_member(m.name):
                    raise refused(part.archive, m.name, "is not allowed")
                if m.isfile():
                    raw = packed.extractfile(m).read(self.most - size + 1)
                    size += len(raw)
                    if size > self.most:
                        raise refused(part.archive, m.name, f"leads beyond {self.most} bytes")
                    yield m.name, raw

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        store = _located(self.path)[0]
        opened = self._zip if partition.archive.lower().endswith(".zip") else self._tar
        rows: list[tuple[str, bytes]] = []
        size = 0

        def batch() -> pa.RecordBatch:
            columns = [pa.array([partition.archive] * len(rows)), pa.array([n for n, _ in rows], pa.string()), pa.array([b for _, b in rows], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["archive", "name", "content"])

        for name, raw in opened(store, partition):
            rows.append((name, raw))
            size += len(raw)
            if size >= BATCH_BYTES:
                yield batch()
                rows, size = [], 0
        if rows:
            yield batch()


class ArchiveSource(DataSource):
    """Options: maxMembers and maxBytes of an archive, rangeBytes of a task."""

    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader({k.lower(): v for k, v in self.options.items()})


def read_archives(spark: SparkSession, path: str, **options: int) -> DataFrame:
    """(archive, name, content) of an archive, or of all archives under a folder."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archives").options(**options).load(path)
