"""Repeated passages by relative Lempel-Ziv parsing.

The reference is all earlier text.  It is indexed by anchors: word sequences of a bit over
half a window that are smallest, by hash, in some window, so that equal windows have equal
anchors.  The index holds, in blocks by the anchors' hashes, the first place of each anchor that
occurs twice.  Each document is parsed against every block: neighbouring anchors whose
first places continue one another form a factor, a copy of earlier text, and all windows in a
factor of a window's length or more repeat.  The windows that cross factor boundaries are
checked one by one against the first places of such windows.  The result is exact, up to word
sequences that agree in two 64-bit hashes: a window that is the first of its kind is in no
factor, so the boundary check finds it.

The table is written once, in chunks of some megabytes of text.  A chunk sends its anchors to
the blocks, and each block sends back what it knows of these alone: no worker reads the whole
index, and neither texts nor lists of files pass through a shuffle or the driver.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
import pyarrow.ipc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from orbweave.llm.common import Words, bucket_bits, fresh_dir, hashes_at, mix, ngram_hashes, release, runs, shuffles_removed, slices, split_words, staged, store, tune, within

#: Text bytes for each bucket of the index.
BUCKET_BYTES = 256 << 20
#: Text bytes of a chunk, which has one document at least.
CHUNK_TEXT = 16 << 20
#: Most partitions that chunks are dealt out to; beyond, a task takes several in turn.
MOST_PARTS = 100_000
_NULL_ID = np.iinfo(np.int64).min


def sliding(op, values: np.ndarray, size: int) -> np.ndarray:
    """op over each run of ``size`` values."""
    if len(values) < size:
        return values[:0]
    reach = 1
    while 2 * reach <= size:
        values = op(values[:-reach], values[reach:])
        reach *= 2
    rest = size - reach
    return op(values[: len(values) - rest], values[rest:]) if rest else values


@dataclass
class Keys:
    """Word sequences by two independent 64-bit hashes; both have to agree."""

    one: np.ndarray
    two: np.ndarray

    def __len__(self) -> int:
        return len(self.one)


@dataclass
class Index:
    """First place (document, word) of keys that occur at least twice, in the order of the keys' hashes."""

    key: np.ndarray
    check: np.ndarray
    doc: np.ndarray
    word: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table) -> Index:
        """Of a chunk's answers, each from another block."""
        own = [np.frombuffer(b"".join(rows.column(c).to_pylist()), kind) for c, kind in _ANSWER.items()]
        order = np.lexsort((own[1], own[0]))
        return cls(*(x[order] for x in own))

    def first(self, keys: Keys) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each key occurs twice, and its first document and word."""
        found, doc, word = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        if not len(self.key):
            return found, doc, word
        at = np.searchsorted(self.key, keys.one)
        some = np.arange(len(keys))
        while len(some):  # twice, but where several keys share their first hash
            some = some[at[some] < len(self.key)]
            some = some[self.key[at[some]] == keys.one[some]]
            hit = self.check[at[some]] == keys.two[some]
            place = some[hit]
            found[place], doc[place], word[place] = True, self.doc[at[place]], self.word[at[place]]
            some = some[~hit]
            at[some] += 1
        return found, doc, word


def _order(keys, checks, docs, words) -> tuple[np.ndarray, np.ndarray]:
    """The order of places by key, then place, and where in it each key begins."""
    order = np.lexsort((words, docs, checks, keys))
    keys, checks = keys[order], checks[order]
    return order, np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1])])) if len(keys) else np.zeros(0, np.int64)


def _firsts(keys, checks, docs, words, many) -> tuple[np.ndarray, ...]:
    """Each key once, with its first place and how often it occurs (2 stands for more)."""
    order, start = _order(keys, checks, docs, words)
    total = np.minimum(np.add.reduceat(many[order], start), 2) if len(keys) else many
    first = order[start]
    return keys[first], checks[first], docs[first], words[first], total


_ANSWER = {"keys": np.uint64, "checks": np.uint64, "docs": np.int64, "words": np.uint32}
_QUESTION = _ANSWER | {"many": np.uint8}
_ASKED = "bucket int, chunk string, " + ", ".join(f"{c} binary" for c in _QUESTION)
_ANSWERED = "chunk string, " + ", ".join(f"{c} binary" for c in _ANSWER)


def _questions(chunk: str, gathered: list[tuple[np.ndarray, ...]], bits: int) -> pa.Table:
    """A row for each block that a chunk asks: its keys of that block, once each, with their first places."""
    own = _firsts(*(np.concatenate(x) for x in zip(*gathered, strict=True)))
    own = [x.astype(kind, copy=False) for x, kind in zip(own, _QUESTION.values(), strict=True)]
    rows = [(b, chunk, *(x[i:j].tobytes() for x in own)) for b, i, j in runs((own[0] >> np.uint64(64 - bits)).astype(np.int64))]
    columns = list(zip(*rows, strict=True)) if rows else [()] * 7
    return pa.table([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.string()), *(pa.array(c, pa.binary()) for c in columns[2:])], names=["bucket", "chunk", *_QUESTION])


def answer(rows: pd.DataFrame) -> pd.DataFrame:
    """What one block of the index sends back: to each chunk those of its keys that occur twice
    anywhere, with their first places."""
    keys, checks, docs, words, many = (np.concatenate([np.frombuffer(x, kind) for x in rows[column]]) for column, kind in _QUESTION.items())
    order, start = _order(keys, checks, docs, words)
    twice = np.add.reduceat(many[order].astype(np.int64), start) > 1
    group = np.empty(len(order), np.int64)
    group[order] = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(order))))
    first, out, high = order[start], [], 0
    for chunk, size in zip(rows["chunk"], rows["keys"].map(len) // 8, strict=True):
        low, high = high, high + size
        own = group[low:high]
        place = first[own[twice[own]]]
        if len(place):
            out.append((chunk, *(x[place].tobytes() for x in (keys, checks, docs, words))))
    return pd.DataFrame(out, columns=["chunk", *_ANSWER])


@dataclass
class Parse:
    """Windows of some texts: which repeat by a factor, and which are to be checked."""

    words: Words
    copied: np.ndarray  #: for each place in the word sequence, whether a window in a factor starts there
    check: np.ndarray  #: places of the windows to be checked
    keys: Keys  #: those windows
    doc: np.ndarray  #: text of each place
    inside: np.ndarray  #: number of the place in its text


class Parser:
    """Parses texts for windows of ``size`` words."""

    def __init__(self, size: int):
        self.size = size
        self.anchor = size // 2 + 1
        self.span = size - self.anchor + 1  #: anchors that a window can have; not over the anchor's length, so neighbours leave no gap

    def anchors(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places and keys of the anchors, the places of all windows and the key of each one's anchor."""
        windows = within(words, self.size)
        grams = ngram_hashes(words.hashes, self.anchor, 5)
        if not windows.any():
            return np.zeros(0, np.int64), grams[:0], np.zeros(0, np.int64), grams[:0]
        low = sliding(np.minimum, grams, self.span)[: len(windows)]
        low_or_0 = np.where(windows, low, np.uint64(0))
        pad = np.zeros(self.span - 1, np.uint64)
        best = sliding(np.maximum, np.concatenate([pad, low_or_0, pad]), self.span)
        at = np.flatnonzero((best == grams[: len(best)]) & (best > 0))
        start = np.flatnonzero(windows)
        return at, mix(grams[at] + np.uint64(1)), start, mix(low[start] + np.uint64(1))

    def places(self, ids: np.ndarray, texts: pa.Array) -> tuple[Keys, np.ndarray, np.ndarray]:
        """Every anchor: key, document and word."""
        words = split_words(texts)
        at, keys, _, _ = self.anchors(words)
        doc = words.doc_of_word()[at]
        return Keys(keys, hashes_at(words.hashes, at, self.anchor, 7)), ids[doc], at - words.offs[doc]

    def parse(self, ids: np.ndarray, texts: pa.Array, index: Index) -> Parse:
        words = split_words(texts)
        doc = words.doc_of_word()
        inside = np.arange(len(doc)) - words.offs[doc]
        at, keys, start, own_key = self.anchors(words)
        twice, first_doc, first_word = index.first(Keys(keys, hashes_at(words.hashes, at, self.anchor, 7)))
        copy = twice & ~((first_doc == ids[doc[at]]) & (first_word == inside[at]))
        # A factor goes on while the next anchor's first place is as far behind.
        onward = np.zeros(len(at), bool)
        if len(at) > 1:
            onward[1:] = copy[1:] & copy[:-1] & (doc[at[1:]] == doc[at[:-1]]) & (first_doc[1:] == first_doc[:-1]) & (first_word[1:] - inside[at[1:]] == first_word[:-1] - inside[at[:-1]])
        begins = np.flatnonzero(copy & ~onward)
        ends = np.flatnonzero(copy & ~np.append(onward[1:], False)) if len(at) else begins
        low, high = at[begins], at[ends] + self.anchor - self.size + 1
        long = high > low
        step = np.zeros(len(doc) + 1, np.int64)
        np.add.at(step, low[long], 1)
        np.add.at(step, high[long], -1)
        copied = np.cumsum(step[:-1]) > 0
        shared = keys[twice]
        check = start[~copied[start] & np.isin(own_key, shared)] if len(start) else start
        return Parse(words, copied, check, Keys(hashes_at(words.hashes, check, self.size, 6), hashes_at(words.hashes, check, self.size, 8)), doc, inside)

    def open_windows(self, index: Index):
        def places(ids: np.ndarray, texts: pa.Array) -> tuple[Keys, np.ndarray, np.ndarray]:
            parse = self.parse(ids, texts, index)
            return parse.keys, ids[parse.doc[parse.check]], parse.inside[parse.check]

        return places

    def removed(self, ids: np.ndarray, texts: pa.Array, index: Index, windows: Index) -> tuple[Words, np.ndarray]:
        """The words, and which of them a repeated window covers."""
        parse = self.parse(ids, texts, index)
        twice, doc, word = windows.first(parse.keys)
        repeat = parse.copied.copy()
        repeat[parse.check] |= twice & ~((doc == ids[parse.doc[parse.check]]) & (word == parse.inside[parse.check]))
        at = np.flatnonzero(repeat)
        step = np.zeros(len(repeat) + 1, np.int64)
        step[at] += 1
        step[at + self.size] -= 1
        return parse.words, np.cumsum(step[:-1]) > 0


def write_chunks(rows: DataFrame, folder: str) -> DataFrame:
    """Writes the rows, whose last two columns are text and id, in chunks of about CHUNK_TEXT bytes
    of text; a table of the chunks' names, written too: only chunks of attempts that count are in it."""
    most, kind = CHUNK_TEXT, "chunk string, bytes bigint"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (part for batch in batches for part in slices(batch.rename_columns([str(i) for i in range(batch.num_columns)]), str(batch.num_columns - 2)))
        part = next(parts, None)
        while part is not None:
            name, size = uuid.uuid4().hex, 0
            files, path = store(f"{folder}/{name}")
            files.create_dir(os.path.dirname(path), recursive=True)
            with files.open_output_stream(path, compression=None) as sink, pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                while part is not None and (not size or size + part.nbytes <= most):
                    out.write_batch(part)
                    size += part.nbytes
                    part = next(parts, None)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64())], names=["chunk", "bytes"])

    return staged(rows.mapInArrow(write, kind), "chunks")


def read_chunk(folder: str, name: str) -> Iterator[pa.RecordBatch]:
    """A chunk's rows, some megabytes at a time."""
    files, path = store(f"{folder}/{name}")
    with files.open_input_stream(path, compression=None) as source, pa.ipc.open_stream(source) as parts:
        yield from parts


@dataclass
class Duplicates:
    """The table in chunks, and for each chunk the anchors and windows in it that occur twice."""

    parser: Parser
    folder: str
    chunks: DataFrame
    parts: int  #: partitions that the chunks are dealt out to
    answers: list[DataFrame]

    def each(self, work: Callable[[str, list[Index]], pa.Table], schema: str | StructType) -> DataFrame:
        """What work makes of each chunk, given its name and its answers."""
        rows = self.chunks.select("chunk", F.lit(-1).alias("step"), *(F.lit(None).cast("binary").alias(c) for c in _ANSWER))
        for step, own in enumerate(self.answers):
            rows = rows.union(own.select("chunk", F.lit(step).alias("step"), *_ANSWER))
        steps = range(len(self.answers))

        def run(group: pa.Table) -> pa.Table:
            out = work(group.column("chunk")[0].as_py(), [Index.of(group.filter(pa.compute.equal(group.column("step"), s))) for s in steps])
            release()
            return out

        # a number of its own, as the answers' bytes say nothing about the texts'
        return rows.repartition(self.parts, "chunk").groupBy("chunk").applyInArrow(run, schema)

    def parsed(self, make: Callable[[pa.RecordBatch, Words, np.ndarray], list[pa.Array]], schema: StructType) -> DataFrame:
        """Columns that ``make`` has of some rows, their words and which of these a repeated window covers."""
        parser, folder = self.parser, self.folder
        names = schema.names

        def work(chunk: str, found: list[Index]) -> pa.Table:
            batches = []
            for part in read_chunk(folder, chunk):
                *_, text, ids = part.columns
                batches.append(pa.RecordBatch.from_arrays(make(part, *parser.removed(ids.fill_null(_NULL_ID).to_numpy(), text, *found)), names=names))
            return pa.Table.from_batches(batches)

        return self.each(work, schema)


def find_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_words: int = 50) -> Duplicates:
    """Writes the table in chunks and asks the blocks of the index, one for about BUCKET_BYTES of
    text and at least as many as shuffle partitions, for the anchors of each chunk, then for the
    windows that are open after its parse.

    Each step is a table in the cluster's shared folder, so a lost executor costs only the tasks
    that it ran; only the number of chunks and bytes comes to the driver."""
    spark = df.sparkSession
    tune(spark)
    if min_words < 2:
        raise ValueError("min_words has to be 2 or more")
    folder, parser = fresh_dir(spark, "passages"), Parser(min_words)
    bits = bucket_bits(df, text_col, BUCKET_BYTES)
    chunks = write_chunks(df.select(*(F.col(f"`{c}`") for c in df.columns), F.col(text_col).alias("its text"), F.col(id_col).cast("bigint").alias("its id")), folder)
    found = Duplicates(parser, folder, chunks, min(max(1, 2 * chunks.count()), MOST_PARTS), [])

    def ask(chunk: str, answers: list[Index]) -> pa.Table:
        places, held = parser.open_windows(*answers) if answers else parser.places, []
        for part in read_chunk(folder, chunk):
            keys, ids, words = places(part.column(part.num_columns - 1).fill_null(_NULL_ID).to_numpy(), part.column(part.num_columns - 2))
            held.append((keys.one, keys.two, ids, words, np.ones(len(keys), np.int64)))
        return _questions(chunk, held, bits)

    with shuffles_removed(spark):  # the questions of a step go when its answers are written
        for name in ("anchors", "windows"):
            found.answers.append(staged(found.each(ask, _ASKED).groupBy("bucket").applyInPandas(answer, _ANSWERED), name))
    return found


def duplicate_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_words: int = 50) -> DataFrame:
    """Removes each word that a window of ``min_words`` words covers whose sequence also starts
    earlier: in a document of a smaller id, or earlier in the same one.

    Words are runs of bytes other than white space, unchanged; windows are judged on the
    input.  Returns ``id_col, n_words, n_removed, kept_sha256`` (of the words that are kept,
    joined by a blank), a row for each input row.  A null text has no words.  Ids are whole
    numbers; a null id counts as the smallest, and rows that repeat an id as copies of one
    document, none earlier than the other at the same word.  Other columns are not read; an
    empty table gives no rows.
    """
    def digest(part: pa.RecordBatch, words: Words, gone: np.ndarray) -> list[pa.Array]:
        total = np.concatenate([[0], np.cumsum(gone)])
        removed = total[words.offs[1:]] - total[words.offs[:-1]]
        raw, at, offs, sha = words.data.tobytes(), words.text_at.tolist(), words.offs.tolist(), []
        for i, n in enumerate(removed.tolist()):
            own = raw[at[i] : at[i + 1]].split()
            if n:
                own = [w for w, out in zip(own, gone[offs[i] : offs[i + 1]].tolist(), strict=True) if not out]
            sha.append(hashlib.sha256(b" ".join(own)).hexdigest())
        return [part.column(0), pa.array(words.counts(), pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())]

    found = find_duplicates(df.select(id_col, text_col), id_col, text_col, min_words=min_words)
    return found.parsed(digest, StructType([df.schema[id_col], *(StructField(n, t) for n, t in (("n_words", LongType()), ("n_removed", LongType()), ("kept_sha256", StringType())))]))


def without_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_words: int = 50) -> DataFrame:
    """The table with repeated passages cut out of its texts, each together with the white
    space behind it.  All rows and columns stay; texts without a repeat are unchanged."""
    place_text = df.columns.index(text_col)

    def cut(part: pa.RecordBatch, words: Words, gone: np.ndarray) -> list[pa.Array]:
        out, raw, at, offs = part.column(place_text).to_pylist(), words.data.tobytes(), words.text_at.tolist(), words.offs
        for i in np.unique(words.doc_of_word()[gone]).tolist():
            own = np.arange(offs[i], offs[i + 1])
            kept = own[~gone[own]]
            until = np.append(words.starts[own][1:], at[i + 1])[~gone[own]]
            out[i] = b"".join([raw[at[i] : words.starts[own[0]]], *(raw[a:b] for a, b in zip(words.starts[kept].tolist(), until.tolist(), strict=True))]).decode()
        return [pa.array(out, pa.string()) if k == place_text else c for k, c in enumerate(part.columns[:-2])]

    return find_duplicates(df, id_col, text_col, min_words=min_words).parsed(cut, df.schema)
