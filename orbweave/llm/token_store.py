"""Token ids in binary files, found by a minimal perfect hash index.

Documents are put in order in ranges of their keys; each range is a shard, two files of the
shared folder: the ids of its documents one after another, in 16 bits where the vocabulary
fits, and the place at which each document ends.  The index deals the distinct keys
out into buckets by a hash.  A bucket's function gives each of its n keys another number
from 0 to n - 1: level for level, the keys that fall on a bit alone take it, the others go on to
the next level; a key's number is how many bits stand before its own.  Under that number
stand the key's fingerprint and its first and last place in the shards, so that a look-up
takes a few steps whatever the number of documents, and reads no other key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbweave.llm.bpe import word_codec
from orbweave.llm.common import fresh_dir, mapped, mix, odd_numbers, release, staged, store, tune, write_arrays

#: Keys of a bucket of the index, about.
BUCKET_KEYS = 1 << 18
#: Bits of a level for each key that is left.
GAMMA = 1.5

_U = np.uint64
_ODD = odd_numbers(64, 11)


class PerfectHash:
    """Numbers the keys of a set, given as two 64-bit hashes each, from 0 without gaps."""

    def __init__(self, sizes: list[int], bits: np.ndarray, before: np.ndarray):
        self.sizes, self.bits, self.before = sizes, bits, before

    @classmethod
    def of(cls, one: np.ndarray, two: np.ndarray) -> PerfectHash:
        sizes, words = [], []
        while len(one):
            if len(sizes) == len(_ODD):
                raise ValueError("two keys have the same hashes")
            n = -(-int(GAMMA * len(one)) // 64) * 64 + 64
            at = cls._places(one, two, len(sizes), n)
            alone = np.bincount(at, minlength=n) == 1
            words.append(np.packbits(alone, bitorder="little").view(_U))
            sizes.append(n)
            left = ~alone[at]
            one, two = one[left], two[left]
        bits = np.concatenate([np.zeros(0, _U), *words])
        return cls(sizes, bits, (np.cumsum(np.bitwise_count(bits)) - np.bitwise_count(bits)).astype(np.uint32))

    @staticmethod
    def _places(one: np.ndarray, two: np.ndarray, level: int, n: int) -> np.ndarray:
        return (mix(one * _ODD[level] + two) % _U(n)).astype(np.int64)

    def numbers(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Each key's number; -1, or that of another key, for one that is not in the set."""
        out, left, first = np.full(len(one), -1, np.int64), np.arange(len(one)), 0
        for level, n in enumerate(self.sizes):
            at = self._places(one[left], two[left], level, n) + first
            word, bit = self.bits[at >> 6], (at & 63).astype(_U)
            here = (word >> bit & _U(1)).astype(bool)
            below = np.bitwise_count(word & ((_U(1) << bit) - _U(1)))
            out[left[here]] = (self.before[at >> 6] + below)[here]
            left, first = left[~here], first + n
        return out


def fingerprints(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return mix(one ^ mix(two)) >> _U(32)


@dataclass
class TokenStore:
    """``shards``: ``shard, uri, n_docs, n_ids, first_id``; ``index``: ``bucket``, its files and the sizes
    of its levels.  Both are tables in the shared folder, as is all that they name."""

    key: str  #: name and type of the keys
    kind: str
    width: int  #: bytes of an id
    bits: int  #: that number the index's buckets
    shards: DataFrame
    index: DataFrame


def _hashes(key: str) -> list:
    own = F.col(f"`{key}`")
    return [F.xxhash64(own.isNull(), own).alias("one"), F.xxhash64(F.lit(7), own, own.isNull()).alias("two")]


def write_store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, path: str, end_id: int | None = None) -> TokenStore:
    """Encodes every whole text with the word BPE of ``path`` and writes the ids, with ``end_id`` behind
    each document's, in ascending order of id, a null id first.

    A null text counts as empty.  Rows of one id follow each other in the order of their
    text's hash, over several shards if need be, and share one entry of the index.
    Other columns are not read; an empty table gives a store without shards."""
    spark = df.sparkSession
    tune(spark)
    folder, kind = fresh_dir(spark, "token-ids"), df.schema[id_col].dataType.simpleString()
    width = 2 if max(word_codec(path).tokens) < 1 << 16 and (end_id or 0) < 1 << 16 else 4
    order = [F.col("key").asc_nulls_first(), F.xxhash64("text")]
    docs = df.select(F.col(f"`{id_col}`").alias("key"), F.col(f"`{text_col}`").alias("text"))
    dealt = docs.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, ends, uri, stream = word_codec(path), [np.zeros(1, np.int64)], "", None
        for batch in batches:
            if not batch.num_rows:
                continue
            if stream is None:
                ((_, uri, _, _),) = write_arrays(folder, {"ids": np.zeros(0, np.uint8)})
                files, at = store(uri)
                stream = files.open_output_stream(at, compression=None)
            ids = codec.encode_array(batch.column(1))
            flat, offsets = np.asarray(ids.flatten()), np.asarray(ids.offsets)
            sizes = np.diff(offsets)
            if end_id is not None:
                flat, sizes = np.insert(flat, offsets[1:], end_id), sizes + 1
            stream.write(flat.astype(f"<u{width}").tobytes())
            place = sum(map(len, ends)) - 1
            ends.append(ends[-1][-1] + np.cumsum(sizes, dtype=np.int64))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.repeat(uri, n), pa.array(np.arange(place, place + n)), pa.array(sizes, pa.int64())], names=["key", "shard", "uri", "place", "n"])
        if stream is not None:
            stream.close()
            files, at = store(uri + ".ends")
            with files.open_output_stream(at, compression=None) as out:
                out.write(np.concatenate(ends).tobytes())
        release()

    rows = dealt.select("key", "text", F.spark_partition_id().alias("shard")).mapInArrow(write, f"key {kind}, shard int, uri string, place bigint, n bigint")
    places = staged(rows, "token-places")
    shards = places.groupBy("shard", "uri").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_ids"))
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))  # a row for each shard
    shards = staged(shards.withColumn("first_id", F.coalesce(before, F.lit(0))), "token-shards")
    bits, index = _build_index(places, folder)
    return TokenStore(id_col, kind, width, bits, shards, index)


def _build_index(places: DataFrame, folder: str) -> tuple[int, DataFrame]:
    """Keys' entries: fingerprint and first shard, last shard and first place, last place."""
    at = F.struct("shard", "place")
    entries = places.groupBy("key").agg(F.min(at).alias("first"), F.max(at).alias("last"))
    buckets = max(int(places.sparkSession.conf.get("spark.sql.shuffle.partitions")), places.count() // BUCKET_KEYS)
    bits = max(1, (buckets - 1).bit_length())
    keyed = entries.select(*_hashes("key"), F.col("first.shard").alias("a"), F.col("first.place").alias("b"), F.col("last.shard").alias("c"), F.col("last.place").alias("d"))

    def build(rows: pa.Table) -> pa.Table:
        column = lambda name: rows[name].to_numpy().astype(np.int64).view(_U)
        one, two = column("one"), column("two")
        own = PerfectHash.of(one, two)
        table = np.empty((len(one), 3), _U)
        shift = _U(32)
        table[own.numbers(one, two)] = np.stack([fingerprints(one, two) << shift | column("a"), column("c") << shift | column("b"), column("d")], 1)
        made = write_arrays(folder, {"bits": own.bits, "ranks": own.before, "entries": table.ravel()})
        return pa.table({"bucket": rows["bucket"][:1], "uris": pa.array([[uri for _, uri, _, _ in made]]), "sizes": pa.array([own.sizes], pa.list_(pa.int64())), "n": pa.array([len(one)], pa.int64())})

    index = keyed.withColumn("bucket", F.shiftrightunsigned("one", 64 - bits)).groupBy("bucket").applyInArrow(build, "bucket bigint, uris array<string>, sizes array<bigint>, n bigint")
    return bits, staged(index, "token-index")


def look_up(own: TokenStore, keys: DataFrame) -> DataFrame:
    """``key, shard, place, last_shard, last_place`` of the distinct keys (one column) that the store has.

    Keys go to their bucket of the index, and a task opens its own buckets only.  A key that the store
    does not have is taken for another with a probability of 2**-32, by its fingerprint."""
    wanted = keys.select(F.col(f"`{keys.columns[0]}`").cast(own.kind).alias("key")).distinct()
    wanted = wanted.select("key", *_hashes("key"))
    wanted = wanted.withColumn("bucket", F.shiftrightunsigned("one", 64 - own.bits))
    schema = f"key {own.kind}, shard int, place bigint, last_shard int, last_place bigint"

    def find(rows: pa.Table, index: pa.Table) -> pa.Table:
        found = np.zeros((0, 3), _U)
        if rows.num_rows and index.num_rows:
            (bits, ranks, entries), sizes, n = index["uris"][0].as_py(), index["sizes"][0].as_py(), index["n"][0].as_py()
            words = sum(sizes) // 64
            one, two = (rows[c].to_numpy().astype(np.int64).view(_U) for c in ("one", "two"))
            numbers = PerfectHash(sizes, mapped(bits, "<u8", words), mapped(ranks, "<u4", words)).numbers(one, two)
            found = mapped(entries, "<u8", 3 * n).reshape(n, 3)[np.maximum(numbers, 0)]
            known = (numbers >= 0) & (found[:, 0] >> _U(32) == fingerprints(one, two))
            rows, found = rows.filter(pa.array(known)), found[known]
        else:
            rows = rows.slice(0, 0)
        low = _U(0xFFFFFFFF)
        numbers = [found[:, 0] & low, found[:, 1] & low, found[:, 1] >> _U(32), found[:, 2]]
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64())
        return pa.table([rows["key"], *(pa.array(x.astype(np.int64)).cast(k) for x, k in zip(numbers, kinds, strict=True))], names=["key", "shard", "place", "last_shard", "last_place"])

    return wanted.groupBy("bucket").cogroup(own.index.groupBy("bucket")).applyInArrow(find, schema)


def read_documents(own: TokenStore, keys: DataFrame) -> DataFrame:
    """``key, start, n_tokens, ids`` of the documents with some keys (one column), a row for each document
    of a key; ``ids`` are its ids as unsigned 32-bit integers, little end first, and ``start`` the number of ids
    before it in the store.  Each shard is read by one task, which gets the places wanted of it."""
    found = look_up(own, keys)
    parts = found.select("key", "place", "last_place", F.col("shard").alias("first"), F.col("last_shard").alias("last"), F.explode(F.sequence("shard", "last_shard")).alias("shard"))
    low = F.when(F.col("shard") == F.col("first"), F.col("place")).otherwise(0)
    high = F.when(F.col("shard") == F.col("last"), F.col("last_place") + 1).otherwise(F.col("n_docs"))
    parts = parts.join(own.shards, "shard").select("key", "shard", "uri", "n_docs", "n_ids", "first_id", low.alias("low"), high.alias("high"))
    width, key, n = own.width, own.key, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = np.asarray(batch.column(1))
            cuts = np.flatnonzero(np.diff(shard)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shard)], strict=True):
                if b > a:
                    yield from read_shard(batch.slice(a, b - a))
        release()

    def read_shard(wanted: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        uri, n_docs, n_ids, first_id = (wanted.column(k)[0].as_py() for k in (2, 3, 4, 5))
        ids, ends = mapped(uri, f"<u{width}", n_ids), mapped(uri + ".ends", "<i8", n_docs + 1)
        low, high = np.asarray(wanted.column(6)), np.asarray(wanted.column(7))
        size = high - low
        row = np.repeat(np.arange(len(low)), size)
        place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + low[row]
        begin, end = ends[place], ends[place + 1]
        total, at = np.cumsum(end - begin), 0
        while at < len(row):  # about a million ids, or one document
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + (1 << 20), "right")))
            whole = np.concatenate([ids[i:j] for i, j in zip(begin[at:to].tolist(), end[at:to].tolist(), strict=True)]).astype("<u4")
            offsets = np.concatenate([[0], np.cumsum(end[at:to] - begin[at:to])]) * 4
            payload = pa.LargeBinaryArray.from_buffers(pa.large_binary(), to - at, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(whole)])
            columns = [wanted.column(0).take(pa.array(row[at:to])), pa.array(first_id + begin[at:to]), pa.array(end[at:to] - begin[at:to]), payload.cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "start", "n_tokens", "ids"])
            at = to

    dealt = parts.repartition(n, "shard").sortWithinPartitions("shard", "low")
    return dealt.mapInArrow(read, f"`{key}` {own.kind}, start bigint, n_tokens bigint, ids binary")


def as_numbers(documents: DataFrame) -> DataFrame:
    """The documents with ``ids`` as an array of numbers."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index("ids")
            column = batch.column(k).cast(pa.large_binary())
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in column.to_pylist()])]).astype(np.int32)
            values = np.frombuffer(b"".join(column.to_pylist()), "<u4").astype(np.int32)
            columns = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)) if i == k else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return documents.mapInArrow(unpack, ", ".join(f"`{c}` {'array<int>' if c == 'ids' else t}" for c, t in documents.dtypes))
