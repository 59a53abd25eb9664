"""`spark.read.format("docx")`: word-processor files as a data source of Spark, in batches and as a stream, and as a sink.

Rows have path, doc_name, doc_hash and what the parser finds (`PARSED`). A schema
that is given with `.schema(...)` prunes: files are parsed only for columns of the
parser, and not even read for path and doc_name alone; fields of items and the
like may be left out too (`items array<struct<text:string>>`). A column of another
type than the parser's fails the tasks. `pathGlobFilter` leaves files out by name,
before tasks are made (`*.docx`, whatever the case). Filters are not pushed into
the source: Spark 4.1 keeps what a source planned for one query's filters and uses
it again for the next query of the same DataFrame if that pushes none.

The driver lists the folder, and files below it, through Arrow's file systems
(local, hdfs, s3, gs), in sorted order, and deals them to partitions of at most
`partitionBytes` or `partitionFiles`, so many small files are one task and a large
one is a task by itself. It holds the files of one folder at a time, and of the
partitions their paths, packed to some bytes each. A damaged file gives a row with `error`; one that can't be
fetched fails its task, which Spark tries again.

A stream's offset is the modification time and path of the last file that was
taken. Files are taken once they are `settleSeconds` old (2), so files must get
their final content and time within that: write them elsewhere and move them in.
A file that is written again is read again. Between two offsets are the same files
when a batch is repeated, unless files were deleted or changed since.

The sink takes doc_name and content. A task writes under a passing name and the
commit of the whole job moves the files into place, so a task that is run twice
does no harm and a job that fails leaves nothing. `overwrite` replaces files of
the same name only. The commit goes through the files a folder of a task's at a
time, of at most 10,000, and keeps 8 bytes of each to find names that two tasks
have written. With `taskFolders` these folders are moved into place as they are,
below the given one, so that the driver sees no file at all; a name is then unique
in its task only, nothing is overwritten, and the file system must be one that
moves folders (not s3).

No files: no rows. A folder that is not there is an error. Names that occur in two
folders below are two rows.
"""

from __future__ import annotations

import fnmatch
import hashlib
import time
import uuid
import zlib
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamReader,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quire.sources.docx import BATCH_BYTES, BATCH_ITEMS, PARSED, parse

SCHEMA = f"path string, doc_name string, doc_hash string, {PARSED}"
COLUMNS = ("path", "doc_name", "doc_hash", "items", "styles", "levels", "pstyles", "error")

#: Files that a commit moves at the same time, and files of a task's folder.
MOVERS, FOLDER_FILES = 16, 10_000


@dataclass(order=True, frozen=True)
class Found:
    """A file in the order of streams."""

    mtime: int
    path: str
    size: int


class Files(InputPartition):
    """Paths of a task's files, packed, since the driver has those of all tasks."""

    def __init__(self, paths: list[str]) -> None:
        super().__init__(zlib.compress("\0".join(paths).encode()) if paths else None)

    @property
    def paths(self) -> list[str]:
        return zlib.decompress(self.value).decode().split("\0") if self.value else []


@dataclass
class Written(WriterCommitMessage):
    """Folders of a task, numbered from 0, below the passing one."""

    task: str
    folders: int


class _Reading:
    """What batches and streams have in common."""

    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.uri, self.schema = options["path"], schema
        self.most_bytes, self.most_files = int(options.get("partitionBytes", 128 << 20)), int(options.get("partitionFiles", 1000))
        self.names = options.get("pathGlobFilter", "*.docx").lower()
        self.settle = float(options.get("settleSeconds", 2))

    def listed(self) -> Iterator[Found]:
        """Files below the folder in the order of their paths, listed folder by folder; hidden names are left out."""
        files, top = fs.FileSystem.from_uri(self.uri)

        def below(folder: str) -> Iterator[Found]:
            seen = [(i.path + "/" * (i.type == fs.FileType.Directory), i.base_name, i.mtime_ns or 0, i.size or 0) for i in files.get_file_info(fs.FileSelector(folder)) if not i.base_name.startswith((".", "_"))]
            for path, name, mtime, size in sorted(seen):
                if path.endswith("/"):
                    yield from below(path[:-1])
                elif fnmatch.fnmatchcase(name.lower(), self.names):
                    yield Found(mtime, path, size)

        return below(top)

    def dealt(self, found: Iterable[Found]) -> list[Files]:
        """Files in the order in which they come, as many to a partition as its bounds allow."""
        out, paths, left = [], [], self.most_bytes
        for f in found:
            if paths and (f.size > left or len(paths) >= self.most_files):
                out.append(Files(paths))
                paths, left = [], self.most_bytes
            paths.append(f.path)
            left -= f.size
        return [*out, Files(paths)] if paths else out

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        """Batches of parsed files, bounded by their items and bytes; a large file is a batch by itself."""
        files, _ = fs.FileSystem.from_uri(self.uri)
        kinds, names = to_arrow_schema(self.schema), set(self.schema.names)
        rows, items, size = [], 0, 0
        for path in partition.paths if partition else ():  # none if there are no files
            row = {"path": path, "doc_name": path.rsplit("/", 1)[-1]}
            if names - {"path", "doc_name"}:
                with files.open_input_stream(path) as stream:
                    content = stream.read()
                size += len(content)
                if "doc_hash" in names:
                    row["doc_hash"] = hashlib.sha256(content).hexdigest()
                if names - {"path", "doc_name", "doc_hash"}:
                    row |= parse(content)
                    items += len(row["items"])
            rows.append(row)
            if items >= BATCH_ITEMS or size >= BATCH_BYTES:
                yield self._batch(rows, kinds)
                rows, items, size = [], 0, 0
        if rows:
            yield self._batch(rows, kinds)

    @staticmethod
    def _batch(rows: list[dict], kinds: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k.name] for r in rows], k.type) for k in kinds], schema=kinds)


class DocxReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Files]:
        return self.dealt(self.listed())


class DocxStreamReader(_Reading, DataSourceStreamReader):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        super().__init__(options, schema)
        self.last = self.initialOffset()

    def initialOffset(self) -> dict:
        return {"mtime": -1, "path": ""}

    def latestOffset(self) -> dict:
        """The last file that has settled; never before an earlier answer, should files be deleted."""
        until = time.time_ns() - int(self.settle * 1e9)
        settled = [(f.mtime, f.path) for f in self.listed() if f.mtime <= until]
        mtime, path = max([*settled, (self.last["mtime"], self.last["path"])])
        self.last = {"mtime": mtime, "path": path}
        return self.last

    def partitions(self, start: dict, end: dict) -> list[Files]:
        after, upto = ((o["mtime"], o["path"]) for o in (start, end))
        return self.dealt(f for f in self.listed() if after < (f.mtime, f.path) <= upto)


def _hashed(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest())


class DocxWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.uri, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex
        self.whole = options.get("taskFolders", "false").lower() == "true"
        if self.whole and overwrite:
            raise ValueError("taskFolders overwrites nothing: use append")

    def _passing(self, folder: str) -> str:
        return f"{folder}/.passing-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, folder = fs.FileSystem.from_uri(self.uri)
        task, names = uuid.uuid4().hex, set()
        for batch in iterator:
            for name, content in zip(batch["doc_name"].to_pylist(), batch["content"], strict=True):
                if not name or "/" in name or not content.is_valid:
                    raise ValueError("a file needs a name without folders, and content")
                if name in names:
                    raise FileExistsError(f"names that are taken or occur twice, {name} among them")
                passing = f"{self._passing(folder)}/{task}/{len(names) // FOLDER_FILES}"
                if len(names) % FOLDER_FILES == 0:
                    files.create_dir(passing, recursive=True)
                names.add(name)
                with files.open_output_stream(f"{passing}/{name}") as out:
                    out.write(content.as_buffer())
        return Written(task, -(-len(names) // FOLDER_FILES))

    def commit(self, messages: list[Written | None]) -> None:
        files, folder = fs.FileSystem.from_uri(self.uri)
        written = [(f"{self._passing(folder)}/{x.task}/{k}", f"part-{self.job}-{x.task}-{k}") for x in messages if x is not None for k in range(x.folders)]
        if self.whole:
            for passing, name in written:
                files.move(passing, f"{folder}/{name}")
        else:
            if taken := self._taken(files, folder, [passing for passing, _ in written]):
                self.abort(messages)
                raise FileExistsError(f"names that are taken or occur twice, {taken} among them")
            with ThreadPoolExecutor(MOVERS) as movers:  # a move waits for the file system, not for the driver
                for passing, _ in written:
                    names = self._names(files, passing)
                    for _ in movers.map(files.move, [f"{passing}/{n}" for n in names], [f"{folder}/{n}" for n in names]):
                        pass
        self.abort(messages)

    @staticmethod
    def _names(files: fs.FileSystem, folder: str) -> list[str]:
        return sorted(i.base_name for i in files.get_file_info(fs.FileSelector(folder)))

    def _taken(self, files: fs.FileSystem, folder: str, written: list[str]) -> str | None:
        """A name that the folder has, if that counts, or that two tasks have written."""
        hashes = []
        for passing in written:
            names = self._names(files, passing)
            if not self.overwrite:
                for i in files.get_file_info([f"{folder}/{n}" for n in names]):
                    if i.type != fs.FileType.NotFound:
                        return i.base_name
            hashes.append(np.array([_hashed(n) for n in names], np.uint64))
        if not hashes:
            return None
        ordered = np.sort(np.concatenate(hashes))
        twice, seen = set(ordered[1:][ordered[1:] == ordered[:-1]].tolist()), set()
        for passing in written if twice else ():  # names alone tell whether these are equal
            for n in self._names(files, passing):
                if _hashed(n) in twice:
                    if n in seen:
                        return n
                    seen.add(n)
        return None

    def abort(self, messages: list[Written | None]) -> None:
        """Delete what is not in its place."""
        files, folder = fs.FileSystem.from_uri(self.uri)
        if files.get_file_info(self._passing(folder)).type == fs.FileType.Directory:
            files.delete_dir(self._passing(folder))


class DocxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "docx"

    def schema(self) -> str:
        return SCHEMA

    def _known(self, schema: StructType) -> StructType:
        if wrong := [n for n in schema.names if n not in COLUMNS]:
            raise ValueError(f"no such column: {', '.join(wrong)}")
        return schema

    def reader(self, schema: StructType) -> DocxReader:
        return DocxReader(self.options, self._known(schema))

    def streamReader(self, schema: StructType) -> DocxStreamReader:
        return DocxStreamReader(self.options, self._known(schema))

    def writer(self, schema: StructType, overwrite: bool) -> DocxWriter:
        return DocxWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DocxSource)
