"""Interpolated modified Kneser-Ney n-gram model.

Words and n-grams are counted in Spark, in buckets of their hashes, so that the n-grams of a
frequent word spread over all buckets.  The counts are stored as sorted hash arrays in files of
the shared folder; a word's place in the order is its number.  A pair's hash is a permutation of
its two numbers, so no two pairs share one; longer n-grams have 64-bit hashes.  Workers map the
files into memory and score whole texts by binary search.

The highest order uses counts, every lower one the number of different words before an n-gram.
A table of k-grams holds both what they count as n-grams of order k and what follows them as
contexts of order k + 1; it is summed, in one shuffle, from the table of order k + 1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm.common import bucket_bits, fresh_dir, mapped, mix, remove_files, runs, shuffles_removed, slices, split_words, tune, unmix, write_arrays

#: Tokens that a task gathers before it sends their counts on.
FLUSH_TOKENS = 4_000_000
#: Text bytes for each bucket; there are at least as many buckets as shuffle partitions.
BUCKET_BYTES = 256 << 20
_END = np.uint64(0xE4D0000000000001)  # stands for the end of a text among the word hashes
_STEP = np.uint64(0x9E3779B97F4A7C15)

#: What a context needs of the n-grams that it begins: the sum of their counts, and how many count 1, 2 and more.
_CONTEXT = ("total", "ones", "twos", "more")


@dataclass
class Discounts:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more."""

    values: tuple[float, float, float]

    @classmethod
    def estimate(cls, n1: float, n2: float, n3: float, n4: float) -> Discounts:
        """From how many counts are 1, 2, 3 and 4; where one is missing, a plain discount."""
        if min(n1, n2, n3) <= 0:
            return cls((0.5, 0.5, 0.5))
        y = n1 / (n1 + 2 * n2)
        raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
        return cls(tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1)))

    def of(self, counts: np.ndarray) -> np.ndarray:
        return np.array([0.0, *self.values])[np.minimum(counts, 3)]


def gram_hashes(columns: list[np.ndarray]) -> np.ndarray:
    """Hashes of n-grams given by two or more columns of word numbers."""
    first, second, *rest = (c.astype(np.uint64) for c in columns)
    out = mix(first << np.uint64(32) | second)
    for c in rest:
        out = mix(out + (c + np.uint64(1)) * _STEP)
    return out


def _ids(keys: np.ndarray) -> np.ndarray:
    """Sort keys: hashes of words and pairs and numbers of words are their own, longer n-grams
    are rows of numbers."""
    return keys if keys.ndim == 1 else gram_hashes(list(keys.T))


@dataclass
class Model:
    """Where the arrays are, and the totals.

    Words and n-grams of bucket b have hashes whose top bits are b; number ``i`` is in range
    ``i // width`` of the per-word arrays.  ``name`` of order k is stored as ``name`` + k."""

    order: int
    bits: int
    width: int
    vocabulary: int  #: distinct tokens, the end included; also the number of the start of a text
    tokens: int  #: all training tokens
    first: np.ndarray  #: number of the first word of each bucket
    files: dict[str, dict[int, tuple[str, str, int]]] = field(default_factory=dict)
    types: dict[int, int] = field(default_factory=dict)  #: distinct n-grams of each order
    discounts: dict[int, Discounts] = field(default_factory=dict)
    low_mass: float = 1.0

    def add(self, rows) -> None:
        for r in rows:
            self.files.setdefault(r["name"], {})[r["bucket"]] = (r["uri"], r["dtype"], r["n"])

    def array(self, name: str, bucket: int) -> np.ndarray:
        spec = self.files.get(name, {}).get(bucket)
        return mapped(*spec) if spec else np.zeros(0, np.int64)

    def bucket(self, ids: np.ndarray, order: int) -> np.ndarray:
        """Bucket of n-grams; words, by their numbers, have ranges."""
        return ids.astype(np.int64) // self.width if order == 1 else (ids >> np.uint64(64 - self.bits)).astype(np.int64)

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and count of each word, -1 and 0 for one that training did not see; hashes are sorted."""
        number, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        for b, low, high in runs((hashes >> np.uint64(64 - self.bits)).astype(np.int64)):
            known = self.array("hash", b)
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes[low:high]), len(known) - 1)
                found = known[at] == hashes[low:high]
                number[low:high] = np.where(found, at + self.first[b], -1)
                count[low:high] = np.where(found, self.array("count", b)[at], 0)
        return number, count

    def values(self, names: tuple[str, ...], columns: list[np.ndarray]) -> list[np.ndarray]:
        """Values of n-grams, given by columns of numbers; 0 for unseen ones."""
        order = len(columns)
        ids, inverse = distinct(columns[0] if order == 1 else gram_hashes(columns))
        out = [np.zeros(len(ids), np.int64) for _ in names]
        for b, low, high in runs(self.bucket(ids, order)):
            known = None if order == 1 else self.array(f"key{order}", b)
            for o, name in zip(out, names, strict=True):
                values = self.array(f"{name}{order}", b)
                if not len(values):
                    continue
                if known is None:
                    o[low:high] = values[ids[low:high] - b * self.width]
                else:
                    at = np.minimum(np.searchsorted(known, ids[low:high]), len(known) - 1)
                    o[low:high] = np.where(known[at] == ids[low:high], values[at], 0)
        return [o[inverse] for o in out]

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: tokens, known tokens, base score and model score (log10)."""
        offs, *columns = self.token_scores(texts)
        return np.diff(offs), *(np.add.reduceat(c, offs[:-1]) for c in columns)

    def token_scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where each text's tokens begin, and of each token whether it is known, its base score
        and its model score (log10); a text's last token is its end."""
        stream, offs = token_stream(texts)
        hashes, inverse = distinct(stream)
        number, count = (v[inverse] for v in self.words(hashes))
        base = np.log10((count + 1) / (self.tokens + self.vocabulary + 1))
        share = np.full(len(stream), 1.0 / (self.vocabulary + 1))
        if self.types.get(2):
            known = np.flatnonzero(number >= 0)
            share *= self.low_mass
            before, = self.values(("count",), [number[known]])
            share[known] += (before - self.discounts[1].of(before)) / self.types[2]
        columns = gram_columns(number, offs, self.order, self.vocabulary)
        for k in range(2, self.order + 1):
            if not self.types.get(k):
                break
            context = columns[-k:-1]
            at = np.flatnonzero(np.all([c >= 0 for c in context], 0))
            total, *few = self.values(_CONTEXT, [c[at] for c in context])
            at, total, few = at[total > 0], total[total > 0], [v[total > 0] for v in few]
            c, both = np.zeros(len(at), np.int64), number[at] >= 0
            c[both], = self.values(("count",), [column[at[both]] for column in columns[-k:]])
            left = sum(d * v for d, v in zip(self.discounts[k].values, few, strict=True))
            share[at] = (c - self.discounts[k].of(c) + left * share[at]) / total
        return offs, (count > 0).astype(np.int64), base, np.log10(share)


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and which of them each one is; only the distinct ones are sorted."""
    codes, found = pd.factorize(values)
    order = np.argsort(found)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return found[order], place[codes]


def gram_columns(number: np.ndarray, offs: np.ndarray, order: int, start: int) -> list[np.ndarray]:
    """For each token the numbers of the order - 1 tokens before it, the start of its text where
    there are fewer, and its own."""
    columns = [number]
    for _ in range(order - 1):
        before = np.empty_like(number)
        before[1:] = columns[0][:-1]
        before[offs[:-1]] = start
        columns.insert(0, before)
    return columns


def smallest(values: np.ndarray) -> np.ndarray:
    """Non-negative values in the narrowest type that holds them."""
    return values.astype(np.min_scalar_type(int(values.max()) if len(values) else 0))


def token_stream(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, each followed by the end token, and where each begins."""
    words = split_words(texts, lower=True)
    stream = np.insert(words.hashes, words.offs[1:], _END)
    return stream, words.offs + np.arange(len(words.offs))


def _merged(keys: list[np.ndarray], values: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys in the order of their ids, these, and the sums of their values."""
    key, ids = np.concatenate(keys), np.concatenate([_ids(k) for k in keys])
    order = np.argsort(ids)
    ids = ids[order]
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
    sums = [np.concatenate(v).astype(np.int64)[order] for v in zip(*values, strict=True)]
    return key[order[first]], ids[first], [np.add.reduceat(v, first) if len(first) else v for v in sums]


def _packed(bucket: np.ndarray, keys: np.ndarray, values: list[np.ndarray]) -> pa.RecordBatch:
    """A row for each bucket of sorted keys; values take as many bytes as the largest needs."""
    rows = [(b, keys[low:high].tobytes(), [smallest(v[low:high]).tobytes() for v in values]) for b, low, high in runs(bucket)]
    b, k, v = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.binary()), pa.array(v, pa.list_(pa.binary()))], names=["bucket", "keys", "values"])


def _unpacked(rows: pd.DataFrame, order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The merged content of rows of one bucket; ``order`` is that of their n-grams."""
    keys = [np.frombuffer(k, np.uint64) if order < 3 else np.frombuffer(k, np.uint32).reshape(-1, order) for k in rows["keys"]]
    return _merged(keys, [[np.frombuffer(v, f"u{len(v) // len(k)}") for v in vs] for k, vs in zip(keys, rows["values"], strict=True)])


_SUMMARY = "name string, bucket int, uri string, dtype string, n bigint, sums array<bigint>"
_ROWS = "bucket int, keys binary, values array<binary>"


def _summary(bucket: int, files: list[tuple[str, str, str, int]], sums: list[int]) -> pd.DataFrame:
    return pd.DataFrame([(name, bucket, uri, dtype, n, [int(x) for x in sums]) for name, uri, dtype, n in files], columns=["name", "bucket", "uri", "dtype", "n", "sums"])


def _times(counts: np.ndarray) -> list[int]:
    """How many counts are above 0, and are 1, 2, 3 and 4."""
    return [np.count_nonzero(counts), *np.bincount(np.minimum(counts, 5), minlength=6)[1:5].tolist()]


def _gathered(batches: Iterator[pa.RecordBatch], keys_of: Callable, bucket_of: Callable) -> Iterator[pa.RecordBatch]:
    """Counts of what keys_of finds in texts, summed over some millions of tokens at a time."""
    keys, values, size = [], [], 0
    for batch in batches:
        for part in slices(batch, "text"):
            found = keys_of(part.column(0))
            if found.ndim == 1:
                key, *value = np.unique(found, return_counts=True)
            else:
                key, _, value = _merged([found], [[np.ones(len(found), np.int64)]])
            keys.append(key), values.append(value)
            size += len(key)
            if size > FLUSH_TOKENS:
                key, ids, value = _merged(keys, values)
                if len(key) > FLUSH_TOKENS // 2:
                    yield _packed(bucket_of(ids), key, value)
                    keys, values, size = [], [], 0
                else:
                    keys, values, size = [key], [value], len(key)
    if keys:
        key, ids, value = _merged(keys, values)
        yield _packed(bucket_of(ids), key, value)


def _lower(model: Model, order: int, bucket: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """What a bucket of n-grams says of those of one order less: as ends of longer ones, in how
    many they are, and as contexts the four sums."""
    count = model.array(f"count{order}", bucket).astype(np.int64)
    some = np.flatnonzero(count)
    count = count[some]
    if order == 2:
        pair = unmix(np.asarray(model.array("key2", bucket))[some].astype(np.uint64))
        numbers = np.stack([pair >> np.uint64(32), pair & np.uint64(0xFFFFFFFF)], 1)
    else:
        numbers = np.asarray(model.array(f"numbers{order}", bucket)).reshape(-1, order)[some]
    keys = lambda n: n if order > 3 else gram_hashes(list(n.T)) if order == 3 else n[:, 0]
    one, none = np.ones(len(some), np.int64), np.zeros(len(some), np.int64)
    contexts = [none, count, *(few.astype(np.int64) for few in (count == 1, count == 2, count > 2))]
    return _merged([keys(numbers[:, 1:]), keys(numbers[:, :-1])], [[one, none, none, none, none], contexts])


def fit(docs: DataFrame, text_col: str = "text", folder: str | None = None, order: int = 2, bucket_bytes: int = BUCKET_BYTES) -> Model:
    """Counts the whole texts and writes the model's arrays.

    Words are in lower case (A-Z); every text, a null or empty one too, ends in one end token,
    and order - 1 starts stand before it.  A bucket is what about ``bucket_bytes`` of text hold.
    Only a row for each file and bucket comes to the driver.  Words are numbered in 32 bits;
    more different ones raise.  Shuffle files go when the arrays made of them are written."""
    if order < 2:
        raise ValueError("the order has to be 2 or more")
    with shuffles_removed(docs.sparkSession):
        return _fit(docs.select(F.col(text_col).alias("text")), folder, order, bucket_bytes)


def _fit(texts: DataFrame, folder: str | None, order: int, bucket_bytes: int) -> Model:
    spark = texts.sparkSession
    tune(spark)
    folder = folder or fresh_dir(spark, "lm")
    bits = bucket_bits(texts, "text", bucket_bytes)

    def count_words(batches):
        yield from _gathered(batches, lambda t: token_stream(t)[0], lambda ids: (ids >> np.uint64(64 - bits)).astype(np.int64))

    def merge_words(rows: pd.DataFrame) -> pd.DataFrame:
        key, _, (count,) = _unpacked(rows, 1)
        return _summary(int(rows.bucket.iloc[0]), write_arrays(folder, {"hash": key, "count": smallest(count)}), [count.sum()])

    words = texts.mapInArrow(count_words, _ROWS).groupBy("bucket").applyInPandas(merge_words, _SUMMARY).collect()
    sizes = np.zeros((1 << bits) + 1, np.int64)
    for r in words:
        if r["name"] == "hash":
            sizes[r["bucket"] + 1] = r["n"]
    first = np.cumsum(sizes)
    if first[-1] >= 1 << 32:
        raise ValueError("words are numbered in 32 bits: the training texts have more different ones")
    vocabulary, tokens = int(first[-1]), sum(r["sums"][0] for r in words if r["name"] == "hash")
    model = Model(order, bits, -(-(vocabulary + 1) // (1 << bits)), vocabulary, tokens, first)
    model.add(words)

    def grams(texts: pa.Array) -> np.ndarray:
        stream, offs = token_stream(texts)
        hashes, inverse = distinct(stream)
        columns = gram_columns(model.words(hashes)[0][inverse], offs, order, vocabulary)
        return gram_hashes(columns) if order == 2 else np.stack(columns, 1).astype(np.uint32)

    def count_grams(batches):
        yield from _gathered(batches, grams, lambda ids: model.bucket(ids, order))

    rows = texts.mapInArrow(count_grams, _ROWS)
    for k in range(order, 0, -1):
        found = rows.groupBy("bucket").applyInPandas(_table_writer(model, folder, k), _SUMMARY).collect()
        if k + 1 in model.types and f"numbers{k + 1}" in model.files:
            remove_files(spark, [uri for uri, _, _ in model.files.pop(f"numbers{k + 1}").values()])
        model.add(found)
        model.types[k], *times = np.sum([r["sums"] for r in found if r["name"] == f"count{k}"] or [[0] * 5], 0).tolist()
        model.discounts[k] = Discounts.estimate(*times)
        if k > 1:
            rows = spark.range(0, 1 << bits, 1, 1 << bits).mapInArrow(_table_reader(model, k), _ROWS)
    more = vocabulary - times[0] - times[1]
    model.low_mass = float(np.dot(model.discounts[1].values, (*times[:2], more))) / model.types[2] if model.types[2] else 1.0
    return model


def _table_writer(model: Model, folder: str, k: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Writes the arrays of one bucket of k-grams."""
    names = ("count",) if k == model.order else ("count", *_CONTEXT)
    width, keep_numbers = model.width, k > 2

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        bucket = int(rows.bucket.iloc[0])
        key, ids, values = _unpacked(rows, k)
        arrays = {f"{n}{k}": smallest(v) for n, v in zip(names, values, strict=True)}
        if k == 1:  # an array of the whole range, as numbers are places
            at = ids.astype(np.int64) - bucket * width
            arrays = {n: _placed(v, at, width) for n, v in arrays.items()}
        else:
            arrays[f"key{k}"] = ids
        if keep_numbers:
            arrays[f"numbers{k}"] = key.ravel()
        return _summary(bucket, write_arrays(folder, arrays), _times(values[0]))

    return write


def _placed(values: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros(width, values.dtype)
    out[at] = values
    return out


def _table_reader(model: Model, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows for the table of order k - 1 from each bucket of k-grams."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column(0).to_pylist():
                key, ids, values = _lower(model, k, b)
                yield _packed(model.bucket(ids, k - 1), key, values)

    return read


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_tokens, n_known, base_score, score`` of every whole text, a row for each
    input row; a null text counts as empty, and an empty text is one end token."""
    tune(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, model.score(part.column(1)))], names=[id_col, "n_tokens", "n_known", "base_score", "score"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, n_known bigint, base_score double, score double")


def perplexity(score_column, tokens_column):
    """Perplexity of a text from its score."""
    return F.pow(F.lit(10.0), -score_column / tokens_column)


def held_out_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 2) -> DataFrame:
    """Scores all documents with a model of those whose crc32 of the id, as text, modulo 7
    is not 2; a row with a null id trains.

    Returns ``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score``: beside
    the model's log10 probability, that of add-one unigrams.  Without training rows every
    token has probability 1.  An empty table gives no rows."""
    fold = lambda: F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 == 2, F.lit(False))
    model = fit(docs.filter(~fold()), text_col, order=order)
    out = score(docs, model, id_col, text_col)
    return out.select(id_col, fold().alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
