"""Data sources of markdown: folders, dealt by folder, and archives, dealt by members.

Executors list and open files themselves, by pyarrow's file systems (local or mounted paths, file:, s3:, gs:, hdfs: and
others that it knows). So names that Spark's own readers hide (with _ or . in front) are there, and nothing passes through
the driver but the names of folders and of zip members.
"""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import posixpath
import stat
import tarfile
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Characters that a name ends with, by archive members and files.
MARKDOWN = (".md", ".markdown")


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def _clean(path: str) -> str:
    return posixpath.normpath(path)


@dataclass
class Folder(InputPartition):
    """The *.md files of a folder (or one file), with what their paths are relative to."""

    uri: str
    path: str
    base: str
    single: bool = False


class FolderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.roots = options["roots"].split("\n")
        self.excluded = [_clean(opened(e)[1]) for e in options.get("exclude", "").split("\n") if e]

    def _outside(self, path: str) -> bool:
        return not any(path == e or path.startswith(e + "/") for e in self.excluded)

    def partitions(self) -> list[Folder]:
        out, seen = [], set()
        for root in self.roots:
            system, at = opened(root)
            at = _clean(at)
            found = system.get_file_info(at)
            if found.type == pafs.FileType.File and at.endswith(".md") and not {at, posixpath.dirname(at)} & seen and self._outside(at):
                seen.add(at)
                out.append(Folder(root, at, posixpath.dirname(at), True))
            todo = [at] if found.type == pafs.FileType.Directory else []
            while todo:
                folder = todo.pop()
                if folder in seen or not self._outside(folder):
                    continue
                seen.add(folder)
                out.append(Folder(root, folder, at))
                todo += [_clean(i.path) for i in system.get_file_info(pafs.FileSelector(folder)) if i.type == pafs.FileType.Directory]
        return out or [Folder("", "", "")]

    def read(self, part: Folder) -> Iterator[tuple]:
        if not part.path:
            return
        system, _ = opened(part.uri)
        named = {_clean(opened(r)[1]) for r in self.roots}
        listed = [system.get_file_info(part.path)] if part.single else system.get_file_info(pafs.FileSelector(part.path))
        for info in sorted(listed, key=lambda i: i.path):
            path = _clean(info.path)
            if info.type != pafs.FileType.File or not path.endswith(".md") or not self._outside(path):
                continue
            if not part.single and path in named and self._earlier(path, part.path):
                continue
            try:
                with system.open_input_stream(info.path) as f:
                    content, error = f.read(), None
            except OSError as e:
                content, error = None, repr(e)
            yield (posixpath.relpath(path, part.base), content, info.mtime.timestamp() if info.mtime else None, error)

    def _earlier(self, path: str, folder: str) -> bool:
        """Whether a file is named itself before a root that holds its folder."""
        for root in self.roots:
            at = _clean(opened(root)[1])
            if at == path:
                return True
            if folder == at or folder.startswith(at + "/"):
                return False
        return False


class FolderSource(DataSource):
    """spark.read.format("markdown_folders").option("roots", "one\\ntwo").load(): (path, content, mtime, error)."""

    @classmethod
    def name(cls) -> str:
        return "markdown_folders"

    def schema(self) -> str:
        return "path string, content binary, mtime double, error string"

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(self.options)


@dataclass
class Members(InputPartition):
    """Members of a zip archive, as (place in its directory, name to give, size); none for a whole tar archive."""

    archive: str
    members: list[tuple[int, str, int]] | None = None


def member_name(name: str) -> str | None:
    """The path that a member gets: .md for markdown, none for others. Raises for paths that lead out of the archive."""
    path = name.replace("\\", "/")
    parts = path.split("/")
    if path.startswith("/") or ".." in parts or ":" in parts[0]:
        raise ValueError(f"unsafe member {name!r}")
    stem, suffix = posixpath.splitext(path)
    return posixpath.normpath(stem + ".md") if suffix.lower() in MARKDOWN else None


class _Limited:
    """Counts what is taken out of a stream, and raises beyond a limit."""

    def __init__(self, stream, most: int):
        self.stream, self.left = stream, most

    def read(self, n: int = -1) -> bytes:
        data = self.stream.read(min(n, self.left + 1) if n >= 0 else self.left + 1)
        self.left -= len(data)
        if self.left < 0:
            raise ValueError("the archive exceeds its limits")
        return data


_PACKED = {b"\x1f\x8b": gzip.open, b"BZh": bz2.open, b"\xfd7zXZ\x00": lzma.open}


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = options["paths"].split("\n")
        self.entries = int(options.get("entries", 5000))
        self.file_bytes = int(options.get("fileBytes", 5 << 20))
        self.total_bytes = int(options.get("totalBytes", 200 << 20))
        self.part_bytes = int(options.get("partitionBytes", 16 << 20))

    def _open(self, path: str):
        system, at = opened(path)
        return system.open_input_file(at)

    def size(self, part: Members) -> int:
        if part.members is not None:
            return sum(m[2] for m in part.members)
        system, at = opened(part.archive)
        return system.get_file_info(at).size or 0

    def partitions(self) -> list[Members]:
        return [p for path in self.paths for p in self._plan(path)] or [Members("", [])]

    def _plan(self, path: str) -> list[Members]:
        with self._open(path) as f:
            if not zipfile.is_zipfile(f):
                return [Members(path)]  # a tar archive is read from its beginning
            f.seek(0)
            listed = zipfile.ZipFile(f).infolist()
        files = [(i, m) for i, m in enumerate(listed) if not m.is_dir()]
        if len(files) > self.entries:
            raise ValueError("the archive has too many members")
        out, held, size, names, total = [], [], 0, set(), 0
        for i, m in files:
            kind = stat.S_IFMT(m.external_attr >> 16)
            if kind not in (0, stat.S_IFREG):
                raise ValueError(f"link or special file {m.filename!r}")
            name = member_name(m.filename)
            if name is None:
                continue
            total += m.file_size
            if m.file_size > self.file_bytes or total > self.total_bytes:
                raise ValueError("the archive exceeds its limits")
            if name in names:
                raise ValueError(f"two members become {name!r}")
            names.add(name)
            held.append((i, name, m.file_size))
            size += m.file_size
            if size >= self.part_bytes:
                out.append(Members(path, held))
                held, size = [], 0
        return [*out, Members(path, held)] if held else out

    def read(self, part: Members) -> Iterator[tuple]:
        if part.archive:
            yield from self._tar(part.archive) if part.members is None else self._zip(part)

    def _zip(self, part: Members) -> Iterator[tuple]:
        with self._open(part.archive) as f, zipfile.ZipFile(f) as z:
            listed = z.infolist()
            for place, name, size in part.members:
                with z.open(listed[place]) as member:
                    yield part.archive, name, _Limited(member, size).read()  # no more than it has declared

    def _tar(self, path: str) -> Iterator[tuple]:
        with self._open(path) as f:
            head = f.read(6)
            f.seek(0)
            unpack = next((o for magic, o in _PACKED.items() if head.startswith(magic)), None)
            raw = io.BufferedReader(f) if unpack is None else unpack(f)
            names = set()
            # all that is unpacked counts, also what isn't markdown; headers take some more
            with tarfile.open(fileobj=_Limited(raw, self.total_bytes + 1024 * (self.entries + 20)), mode="r|") as t:
                for i, m in enumerate(t):
                    name = member_name(m.name)
                    if i >= self.entries:
                        raise ValueError("the archive has too many members")
                    if m.isdir():
                        continue
                    if not m.isfile():
                        raise ValueError(f"link or special file {m.name!r}")
                    if name is None:
                        continue
                    if m.size > self.file_bytes:
                        raise ValueError("the archive exceeds its limits")
                    if name in names:
                        raise ValueError(f"two members become {name!r}")
                    names.add(name)
                    yield path, name, t.extractfile(m).read()


#: What planned() makes of an archive: the parts of it that a task reads.
PIECES = "archive string, members array<struct<place: int, name: string, size: long>>, bytes long"


def planned(batches: Iterator[pa.RecordBatch], options: dict[str, str]) -> Iterator[pa.RecordBatch]:
    """(path) -> PIECES: several of a zip archive that holds much, one of a tar archive, with its own size."""
    reader, kind = ArchiveReader({**options, "paths": ""}), pa.struct([("place", pa.int32()), ("name", pa.string()), ("size", pa.int64())])
    for batch in batches:
        parts = [m for path in batch.column("path").to_pylist() for m in reader._plan(path)]
        lists = [None if m.members is None else [dict(zip(("place", "name", "size"), x, strict=True)) for x in m.members] for m in parts]
        sizes = [reader.size(m) for m in parts]
        yield pa.RecordBatch.from_arrays([pa.array([m.archive for m in parts], pa.string()), pa.array(lists, pa.list_(kind)), pa.array(sizes, pa.int64())], names=["archive", "members", "bytes"])


def unpacked(batches: Iterator[pa.RecordBatch], options: dict[str, str], most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """PIECES -> (archive, path, content), in batches of so many bytes and a member more."""
    reader = ArchiveReader({**options, "paths": ""})
    held, size = [], 0

    def out() -> pa.RecordBatch:
        columns = zip(*held, strict=True) if held else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.binary()), strict=True)], names=["archive", "path", "content"])

    for batch in batches:
        for path, members in zip(batch.column("archive").to_pylist(), batch.column("members").to_pylist(), strict=True):
            for row in reader.read(Members(path, members and [(m["place"], m["name"], m["size"]) for m in members])):
                held.append(row)
                size += len(row[2])
                if size >= most:
                    yield out()
                    held, size = [], 0
    yield out()


class ArchiveSource(DataSource):
    """spark.read.format("markdown_archives").option("paths", "a.zip\\nb.tgz").load(): (archive, path, content). Options
    entries, fileBytes and totalBytes bound an archive, partitionBytes what a task reads of a zip archive."""

    @classmethod
    def name(cls) -> str:
        return "markdown_archives"

    def schema(self) -> str:
        return "archive string, path string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options)
