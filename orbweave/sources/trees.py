"""Trees of whole files, as other programs read and write them.

A row is a file: ``folder``, its path from the tree's root on, ``name`` and ``content``.  A tree is listed level by level, each
folder by a task, and its files are dealt out by bytes.  Tasks write under a folder of their attempt; only when all
have ended are the files of the attempts that count moved to their places, by tasks too, so that a task which is
killed or runs twice leaves none of its own that a reader sees.  What a task writes that is killed after its
job was given up stays in a folder that no reader looks into.  No list of files passes through the driver.

Millions of small files take a block of disk each, and one more for their folders.  A packed tree has the same files inside archives
``.tar.zst``, many of them in each; ``tar --zstd -xf`` of all archives gives the plain tree."""

from __future__ import annotations

import contextlib
import fnmatch
import os
import tarfile
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "folder string, name string, content binary"
#: Entries of a folder; the size of a folder is null.
LISTED = "folder string, name string, size bigint"
#: Bytes of the files of a task; a file counts as OPEN bytes more.
PART_BYTES, OPEN = 32 << 20, 1 << 13
#: Bytes of a batch of files.
BATCH_BYTES = 8 << 20
#: Files that are listed, or moved to their places, at once.
STEP = 4096
#: Names of an attempt's lists of places, and of a job's list of attempts.
PLACES, COUNTED = "places-{}", "counted"

#: Ending of archives, and bytes of one, compressed and before.
PACKED, PACKED_BYTES, UNPACKED_BYTES = ".tar.zst", 4 << 20, 128 << 20

_ARROW = pa.schema([("folder", pa.string()), ("name", pa.string()), ("content", pa.binary())])


def _store(path: str):
    from pyarrow import fs

    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


@dataclass
class _Files(InputPartition):
    files: list[tuple[str, str]]


class _Reader(DataSourceReader):
    """Lists a tree by itself, for those who load the format; read_tree() lists it in tasks."""

    def __init__(self, path: str, pattern: str):
        self.path, self.pattern = path, pattern

    def partitions(self) -> list[_Files]:
        from pyarrow import fs

        store, root = _store(self.path)
        found = []
        for info in store.get_file_info(fs.FileSelector(root, recursive=True)):
            below = info.path[len(root.rstrip("/")) + 1 :]
            if info.type == fs.FileType.File and fnmatch.fnmatchcase(info.base_name, self.pattern) and not any(p.startswith(("_", ".")) for p in below.split("/")):
                found.append((below, info.size + OPEN))
        out: list[_Files] = []
        total = PART_BYTES
        for below, size in sorted(found):
            if total + size > PART_BYTES:
                out.append(_Files([]))
                total = 0
            folder, _, name = below.rpartition("/")
            out[-1].files.append((folder, name))
            total += size
        return out or [_Files([])]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        return _contents(self.path, partition.files)


def _contents(path: str, files: Iterable[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
    store, root = _store(path)
    rows, size = [], 0
    for folder, name in files:
        with store.open_input_stream(f"{root}/{folder}/{name}" if folder else f"{root}/{name}", compression=None) as stream:
            content = stream.read()
        rows.append((folder, name, content))
        size += len(content)
        if size > BATCH_BYTES or len(rows) == STEP:
            yield _batch(rows)
            rows, size = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


@dataclass
class _Written(WriterCommitMessage):
    #: The attempt's folder, from the root on, and how many lists it has of the places where its files belong.
    attempt: str
    lists: int


def _place(store, root: str, attempt: str, k: int) -> int:
    """Moves the files of an attempt's list to their places; those that are there already, by a first try, stay."""
    from pyarrow import fs

    with store.open_input_stream(f"{root}/{attempt}/{PLACES.format(k)}", compression=None) as stream:
        places = stream.read().decode().split("\0")
    for folder in {place.rpartition("/")[0] for place in places}:
        store.create_dir(f"{root}/{folder}", recursive=True)
    for number, place in enumerate(places, k * STEP):
        try:
            store.move(f"{root}/{attempt}/{number}", f"{root}/{place}")
        except OSError:
            kinds = [info.type for info in store.get_file_info([f"{root}/{attempt}/{number}", f"{root}/{place}"])]
            if kinds != [fs.FileType.NotFound, fs.FileType.File]:
                raise
    return len(places)


class _Writer(DataSourceArrowWriter):
    """``job`` is the folder of a job whose files the caller moves, by the list of attempts that commit() leaves there; without
    it commit() moves them."""

    def __init__(self, path: str, overwrite: bool, job: str | None = None):
        self.path, self.overwrite, self.later = path.rstrip("/"), overwrite, job is not None
        self.job = job or _job()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, root = _store(self.path)
        attempt, places, lists, n = f"{self.job}/{uuid.uuid4().hex}", [], 0, 0
        store.create_dir(f"{root}/{attempt}", recursive=True)

        def keep(name: str, content: bytes) -> None:
            with store.open_output_stream(f"{root}/{attempt}/{name}", compression=None) as stream:
                stream.write(content)

        try:
            for batch in iterator:
                for folder, name, content in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in _ARROW.names), strict=True):
                    keep(str(n), content or b"")
                    places.append(f"{folder}/{name}" if folder else name)
                    n += 1
                    if len(places) == STEP:
                        keep(PLACES.format(lists), "\0".join(places).encode())
                        places, lists = [], lists + 1
            if places:
                keep(PLACES.format(lists), "\0".join(places).encode())
                lists += 1
        except BaseException:
            with contextlib.suppress(OSError):
                store.delete_dir(f"{root}/{attempt}")
            raise
        return _Written(attempt, lists)

    def commit(self, messages: list[_Written | None]) -> None:
        from pyarrow import fs

        store, root = _store(self.path)
        if self.overwrite:
            for info in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if not info.base_name.startswith("_writing-"):
                    (store.delete_dir if info.type == fs.FileType.Directory else store.delete_file)(info.path)
        counted = [(m.attempt, m.lists) for m in messages if m]
        if self.later:
            store.create_dir(f"{root}/{self.job}", recursive=True)
            with store.open_output_stream(f"{root}/{self.job}/{COUNTED}", compression=None) as stream:
                stream.write("\n".join(f"{attempt} {lists}" for attempt, lists in counted).encode())
            return
        for attempt, lists in counted:
            for k in range(lists):
                _place(store, root, attempt, k)
        _clean(self.path, self.job)

    def abort(self, messages: list[_Written | None]) -> None:
        _clean(self.path, self.job)


def _job() -> str:
    return f"_writing-{uuid.uuid4().hex}"


def _clean(path: str, job: str) -> None:
    from pyarrow import fs

    store, root = _store(path)
    if store.get_file_info(f"{root}/{job}").type == fs.FileType.Directory:
        store.delete_dir(f"{root}/{job}")


class FileTree(DataSource):
    """Options: ``path``, the tree's root, ``pattern`` of the names that are read, and ``job``, see _Writer."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"], self.options.get("pattern", "*"))

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], overwrite, self.options.get("job"))


def _children(store, folder: str) -> Iterator[tuple[str, int | None]]:
    """Names in a folder with their size, None of folders.  Large local folders are not held whole."""
    from pyarrow import fs

    if store.type_name == "local":
        with os.scandir(folder) as entries:
            for e in entries:
                if e.is_dir() or e.is_file():
                    yield e.name, None if e.is_dir() else e.stat().st_size
        return
    for info in store.get_file_info(fs.FileSelector(folder)):
        if info.type in (fs.FileType.Directory, fs.FileType.File):
            yield info.base_name, None if info.type == fs.FileType.Directory else info.size


def list_tree(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``folder, name, size`` of all files that read_tree() reads.  Each level of folders is listed by tasks, and written to the
    shared folder, so that each folder is listed once."""
    from orbweave.sources.files import shared_path

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(path.rstrip("/"))
        rows = []
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                for name, size in _children(store, f"{root}/{folder}" if folder else root):
                    if not name.startswith(("_", ".")) and (size is None or fnmatch.fnmatchcase(name, pattern)):
                        rows.append((folder, name, size))
                    if len(rows) == STEP:
                        yield _listed(rows)
                        rows = []
        if rows:
            yield _listed(rows)

    n, staged, levels = int(spark.conf.get("spark.sql.shuffle.partitions")), shared_path(spark, "listing"), []
    level = spark.range(1).select(F.lit("").alias("folder")).coalesce(1)
    while level is not None:
        own = f"{staged}/{len(levels)}"
        level.mapInArrow(entries, LISTED).write.parquet(own)
        levels.append(spark.read.schema(LISTED).parquet(own))
        below = levels[-1].filter("size IS NULL")
        level = None if below.isEmpty() else below.select(F.concat_ws("/", F.nullif("folder", F.lit("")), "name").alias("folder")).repartition(n, "folder")
    return reduce(DataFrame.unionAll, levels).filter("size IS NOT NULL")


def _listed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], names=["folder", "name", "size"])


def read_tree(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``folder, name, content`` of all files under a folder, at any depth, whose names match; names and
    folders that begin with a dot or an underscore are left out.  The tree is listed when this is called."""
    files = list_tree(spark, path, pattern)
    total = files.agg(F.coalesce(F.sum(F.col("size") + OPEN), F.lit(0))).first()[0]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _contents(path.rstrip("/"), (pair for batch in batches for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)))

    return files.select("folder", "name").repartition(n, "folder", "name").mapInArrow(contents, SCHEMA)


def write_tree(files: DataFrame, path: str, overwrite: bool = False) -> None:
    """Writes a file for each row ``folder, name, content``; one that is there already is replaced, and with
    ``overwrite`` all others go."""
    spark, path, job = files.sparkSession, path.rstrip("/"), _job()
    spark.dataSource.register(FileTree)
    files.select("folder", "name", "content").write.format("file_tree").option("job", job).mode("overwrite" if overwrite else "append").save(path)

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(path)
        for batch in batches:
            moved = [_place(store, root, attempt, k) for attempt, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(moved, pa.int64())], names=["n"])

    try:
        store, root = _store(path)
        with store.open_input_stream(f"{root}/{job}/{COUNTED}", compression=None) as stream:
            counted = [(attempt, int(lists)) for attempt, lists in map(str.split, stream.read().decode().splitlines())]  # a line for each task
        lists = spark.createDataFrame(counted, "attempt string, lists int").filter("lists > 0").select("attempt", F.explode(F.expr("sequence(0, lists - 1)")).alias("k"))
        lists.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "attempt", "k").mapInArrow(move, "n bigint").agg(F.sum("n")).collect()
    finally:
        _clean(path, job)


class _Archive:
    """Files as one compressed tar archive, in memory."""

    def __init__(self):
        self.size, self.sink = 0, pa.BufferOutputStream()
        self.stream = pa.CompressedOutputStream(self.sink, "zstd")

    def add(self, place: str, content: bytes) -> None:
        info = tarfile.TarInfo(place)
        info.size = len(content)
        self.stream.write(b"".join((info.tobuf(tarfile.PAX_FORMAT), content, bytes(-len(content) % tarfile.BLOCKSIZE))))
        self.size += tarfile.BLOCKSIZE + len(content)

    def full(self) -> bool:
        return self.size > UNPACKED_BYTES or self.sink.tell() > PACKED_BYTES

    def end(self) -> pa.RecordBatch:
        self.stream.write(bytes(2 * tarfile.BLOCKSIZE))
        self.stream.close()  # which closes the sink
        return _batch([("", f"{uuid.uuid4().hex}{PACKED}", self.sink.getvalue().to_pybytes())])


def write_packed(files: DataFrame, path: str, overwrite: bool = False) -> None:
    """Writes the files of rows ``folder, name, content`` into archives, each task into its own.  Archives of other jobs stay unless
    ``overwrite`` is given; of files of one place all are read."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            for folder, name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = own or _Archive()
                own.add(f"{folder}/{name}" if folder else name, content or b"")
                if own.full():
                    yield own.end()
                    own = None
        if own:
            yield own.end()

    write_tree(files.select("folder", "name", "content").mapInArrow(pack, SCHEMA), path, overwrite)


def read_packed(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """As read_tree(), the files inside the archives of a packed tree."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(2):
                yield from _unpacked(content.as_buffer(), pattern)

    return read_tree(spark, path, f"*{PACKED}").mapInArrow(unpack, SCHEMA)


def _unpacked(content: pa.Buffer, pattern: str) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    with pa.CompressedInputStream(pa.BufferReader(content), "zstd") as stream, tarfile.open(fileobj=stream, mode="r|") as archive:
        for info in archive:
            folder, _, name = info.name.rpartition("/")
            if info.isfile() and fnmatch.fnmatchcase(name, pattern):
                rows.append((folder, name, archive.extractfile(info).read()))
                size += info.size
            if size > BATCH_BYTES or len(rows) == STEP:
                yield _batch(rows)
                rows, size = [], 0
            archive.members = []  # only those ahead are needed
    if rows:
        yield _batch(rows)
