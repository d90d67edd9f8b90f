"""Helpers that the corpus operators share: word splitting and hashing over Arrow
columns, staging in the cluster's shared folder, and table reading.

Words are runs of bytes other than space and ``\\x09-\\x0D``.  They are split and
hashed for a whole Arrow column at once: the column's own buffer is scanned with numpy,
so that no Python object is made per word.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
import os
import tempfile
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy pass takes; its arrays then stay in the processor's cache.
CHUNK_BYTES = 1 << 21
#: Most bytes of one Arrow batch between Spark and Python, so that long texts come in small batches.
ARROW_BYTES = 8 << 20

#: Most bytes of remote files that an executor keeps copies of.
CACHE_BYTES = 16 << 30

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (splitmix64), elementwise."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def unmix(x: np.ndarray) -> np.ndarray:
    """The number whose mix() is x; mix() is a permutation of the 64-bit numbers."""
    x = x ^ (x >> _U(31)) ^ (x >> _U(62))
    x = x * _U(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = x ^ (x >> _U(27)) ^ (x >> _U(54))
    x = x * _U(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return x ^ (x >> _U(30)) ^ (x >> _U(60))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random odd 64-bit multipliers."""
    x = (np.arange(1, n + 1, dtype=_U) + _U(seed) * _U(1 << 32)) * _U(0x9E3779B97F4A7C15)
    return mix(x) | _U(1)


_BYTE_MULT = odd_numbers(1 << 12, 1)


def byte_mult(n: int) -> np.ndarray:
    """Multipliers of the first n bytes of a string that is hashed."""
    global _BYTE_MULT
    if n > len(_BYTE_MULT):
        _BYTE_MULT = odd_numbers(1 << (n - 1).bit_length(), 1)
    return _BYTE_MULT


@dataclass
class Words:
    """The words of some consecutive texts."""

    data: np.ndarray  #: bytes of the texts, one after another, unchanged
    text_at: np.ndarray  #: where each text starts in data, and the end
    starts: np.ndarray  #: where each word starts in data
    ends: np.ndarray
    offs: np.ndarray  #: index of each text's first word, and the number of words
    hashes: np.ndarray  #: 64-bit hash of each word

    def counts(self) -> np.ndarray:
        return np.diff(self.offs)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offs) - 1), np.diff(self.offs))

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and where each text starts; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    at = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def split_words(column: pa.Array, lower: bool = False, space: np.ndarray = _SPACE) -> Words:
    """Splits and hashes all words of a column of texts.

    With ``lower``, the hashes are those of words with A-Z in lower case.  ``space`` marks
    the bytes that are no part of a word.
    """
    data, at = text_buffer(column)
    solid = ~space[data]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    first = at[:-1][at[:-1] < at[1:]]  # a text's first byte starts a word even if the last text ended in one
    begin[first] = solid[first]
    starts = np.flatnonzero(begin)
    final = solid.copy()
    final[:-1] &= ~solid[1:] | begin[1:]
    ends = np.flatnonzero(final) + 1
    offs = np.searchsorted(starts, at)
    if not len(starts):
        return Words(data, at, starts, ends, offs, np.zeros(0, _U))
    sizes = ends - starts
    chars = (_LOWER[data] if lower else data)[solid].astype(_U)
    first_char = np.cumsum(sizes) - sizes
    inside = np.arange(len(chars)) - np.repeat(first_char, sizes)
    chars += _U(1)
    chars *= byte_mult(int(sizes.max()))[inside]
    sums = np.add.reduceat(chars, first_char)
    return Words(data, at, starts, ends, offs, mix(sums + sizes.astype(_U) * _U(0x9E3779B97F4A7C15)))


def ngram_hashes(words: np.ndarray, n: int, seed: int = 2) -> np.ndarray:
    """Hash of each run of n words; runs across texts are left for the caller to drop."""
    if len(words) < n:
        return np.zeros(0, _U)
    mult = odd_numbers(n, seed)
    size = len(words) - n + 1
    total = words[:size] * mult[0]
    for i in range(1, n):
        total += words[i : i + size] * mult[i]
    return mix(total)


def hashes_at(words: np.ndarray, at: np.ndarray, n: int, seed: int) -> np.ndarray:
    """What ngram_hashes() has at some places."""
    total = np.zeros(len(at), _U)
    for i, m in enumerate(odd_numbers(n, seed)):
        total += words[at + i] * m
    return mix(total)


def within(words: Words, n: int) -> np.ndarray:
    """True for each position at which n words of one text start; as long as ngram_hashes()."""
    size = max(0, len(words.hashes) - n + 1)
    ok = np.ones(size, bool)
    for end in words.offs[1:-1]:
        ok[max(0, end - n + 1) : end] = False
    return ok


def slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about CHUNK_BYTES of text, each of one row at least."""
    column = batch.column(batch.schema.get_field_index(text))
    size = np.diff(text_buffer(column)[1])
    total, start = 0, 0
    for i, n in enumerate(size.tolist()):
        if i > start and total + n > CHUNK_BYTES:
            yield batch.slice(start, i - start)
            total, start = 0, i
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def release() -> None:
    """Gives freed memory back to the system, for the tasks that come after in this worker."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def tune(spark: SparkSession) -> None:
    """Bounds the Arrow batches that Python workers get, where the session sets no bound of
    its own.  Spark reads the setting when a result is asked for, so it stays set."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(ARROW_BYTES))


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Jobs that are built and run inside give their shuffle files back when they end; what
    they leave is in files of the shared folder.  The session's own setting comes back after."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors see, which spark.checkpoint.dir names.

    Only a local session, as in tests, may leave that unset and gets a temporary folder of this
    machine; on a cluster it raises."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or "cluster" in master:
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = getattr(shared_dir, "own", None) or "file://" + tempfile.mkdtemp(prefix="orbweave-")
        shared_dir.own = base
    return base.rstrip("/") + "/orbweave"


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: it is computed once, and its
    lineage is cut, so that a lost executor costs only a reread."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_path(uri: str) -> str | None:
    """The path of a file: URI, or None for a store that only a file-system client opens."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if uri.startswith("/") else None


def store(uri: str):
    """File system and path of a URI in the shared folder, for a worker."""
    from pyarrow import fs

    if local := local_path(uri):
        return fs.LocalFileSystem(), local
    return fs.FileSystem.from_uri(uri)


def write_arrays(folder: str, arrays: dict[str, np.ndarray]) -> list[tuple[str, str, str, int]]:
    """Writes arrays as raw files under names of their own; a task that is run again
    writes other files, and only those of the attempt that counts are named in its rows."""
    out = []
    for name, array in arrays.items():
        uri = f"{folder}/{name}-{uuid.uuid4().hex}"
        files, path = store(uri)
        files.create_dir(os.path.dirname(path), recursive=True)
        with files.open_output_stream(path, compression=None) as stream:
            stream.write(array.tobytes())
        out.append((name, uri, array.dtype.str, len(array)))
    return out


def remove_files(spark: SparkSession, uris: list[str]) -> None:
    """Removes files of the shared folder that no later step reads, a task for many."""

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                files, path = store(uri)
                with contextlib.suppress(FileNotFoundError):  # a task that is run again
                    files.delete_file(path)
            yield batch.slice(0, 0)

    if uris:
        spark.createDataFrame([(u,) for u in uris], "uri string").mapInArrow(remove, "uri string").collect()


def bucket_bits(texts: DataFrame, text_col: str, bucket_bytes: int) -> int:
    """Bits that number buckets of about ``bucket_bytes`` of text each, at least as many as
    shuffle partitions."""
    size = texts.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(2, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // bucket_bytes))
    return (buckets - 1).bit_length()


def mapped(uri: str, dtype: str, n: int) -> np.ndarray:
    """The array in a file, mapped into memory.  Of a store without local paths, an executor's
    workers share a copy; see ``_Copies``."""
    if not n:
        return np.zeros(0, dtype)
    return _mapped_file(uri, dtype, n) if local_path(uri) else _COPIES.mapped(uri, dtype, n)


@lru_cache(maxsize=100_000)
def _mapped_file(uri: str, dtype: str, n: int) -> np.ndarray:
    return np.memmap(local_path(uri), dtype, "r", shape=(n,))


class _Copies:
    """Copies of remote files in a folder that the workers of an executor share, inside the
    executor's own Spark folder, which Spark removes when the executor ends.

    A copy appears under its name only when it is whole.  The folder holds at most CACHE_BYTES,
    or the one file in use where that is larger: the copies used longest ago go first.  A worker
    keeps at most as much mapped."""

    def __init__(self) -> None:
        self.open: OrderedDict[str, np.ndarray] = OrderedDict()

    def mapped(self, uri: str, dtype: str, n: int) -> np.ndarray:
        if uri in self.open:
            self.open.move_to_end(uri)
            return self.open[uri]
        size = n * np.dtype(dtype).itemsize
        while self.open and sum(a.nbytes for a in self.open.values()) + size > CACHE_BYTES:
            self.open.popitem(last=False)
        folder = os.path.join(os.environ.get("SPARK_LOCAL_DIRS", tempfile.gettempdir()).split(",")[0], "orbweave-copies")
        path = os.path.join(folder, hashlib.sha1(uri.encode()).hexdigest())
        while uri not in self.open:
            try:
                os.utime(path)
                self.open[uri] = np.memmap(path, dtype, "r", shape=(n,))
            except FileNotFoundError:  # no copy yet, or another worker has just removed it
                os.makedirs(folder, exist_ok=True)
                self._make_room(folder, size)
                files, remote = store(uri)
                with tempfile.NamedTemporaryFile(dir=folder, delete=False) as copy, files.open_input_stream(remote, compression=None) as source:
                    while part := source.read(1 << 22):
                        copy.write(part)
                os.replace(copy.name, path)
        return self.open[uri]

    @staticmethod
    def _make_room(folder: str, size: int) -> None:
        found = []
        for entry in os.scandir(folder):
            with contextlib.suppress(FileNotFoundError):
                found.append((entry.stat().st_mtime, entry.stat().st_size, entry.path))
        total = sum(n for _, n, _ in found) + size
        for _, n, path in sorted(found):
            if total <= CACHE_BYTES:
                break
            with contextlib.suppress(FileNotFoundError):
                os.unlink(path)
            total -= n


_COPIES = _Copies()


def runs(sorted_values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Each distinct value, and where its run begins and ends."""
    if not len(sorted_values):
        return
    cuts = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))
    for low, high in zip(cuts, np.append(cuts[1:], len(sorted_values)), strict=True):
        yield int(sorted_values[low]), int(low), int(high)


@dataclass
class HashFiles:
    """A set of 64-bit hashes in sorted files of the shared folder, by their top bits."""

    bits: int
    files: dict[int, tuple[str, str, int]]

    def has(self, hashes: np.ndarray) -> np.ndarray:
        some, inverse = np.unique(hashes, return_inverse=True)
        found = np.zeros(len(some), bool)
        for b, low, high in runs((some >> _U(64 - self.bits)).astype(np.int64)):
            if b in self.files and len(known := mapped(*self.files[b])):
                at = np.minimum(np.searchsorted(known, some[low:high]), len(known) - 1)
                found[low:high] = known[at] == some[low:high]
        return found[inverse]


def hash_files(df: DataFrame, name: str) -> HashFiles:
    """Writes the distinct values of df's one bigint column, taken as hashes."""
    spark = df.sparkSession
    folder, column = fresh_dir(spark, name), df.columns[0]
    bits = max(1, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        (_, uri, dtype, n), = write_arrays(folder, {"hashes": np.unique(rows[column].to_numpy().view(np.uint64))})
        return pd.DataFrame({"bucket": rows.bucket.iloc[:1], "uri": [uri], "dtype": [dtype], "n": [n]})

    rows = df.select(column, F.shiftrightunsigned(column, 64 - bits).alias("bucket")).groupBy("bucket").applyInPandas(write, "bucket bigint, uri string, dtype string, n bigint")
    return HashFiles(bits, {r["bucket"]: (r["uri"], r["dtype"], r["n"]) for r in rows.collect()})


def without_ids(df: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """The rows whose id is not among ``ids`` (one column); rows with a null id stay.

    Ids are compared by their 64-bit xxhash64 in mapped files, so that the texts are not
    shuffled.  That hash is a permutation of 64-bit numbers, so integer ids are told apart
    exactly; of n rows with ids of another type, against m ids, n * m / 2**64 are expected to go
    by chance."""
    kind = df.schema[id_col].dataType
    chosen = hash_files(ids.select(F.xxhash64(F.col(ids.columns[0]).cast(kind)).alias("h")), "ids")
    names = df.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, known = batch.column(batch.num_columns - 1), np.array(batch.column(batch.num_columns - 2))
            gone = chosen.has(own.to_numpy().view(np.uint64)) & known
            yield pa.RecordBatch.from_arrays(batch.columns[:-2], names=names).filter(pa.array(~gone))

    marked = df.select(*(F.col(f"`{c}`") for c in names), F.col(id_col).isNotNull().alias("has id"), F.xxhash64(id_col).alias("hash of id"))
    return marked.mapInArrow(keep, df.schema)
