"""Alignment of two tokenizers: which tokens of one meet which of the other, and how often.

Texts are cut before blanks into units that both tokenizers treat by themselves; a unit's tokens, the groups of
tokens that end together and the linked pairs in them are found once for each worker.  Pairs are
counted over the corpus by external spilling:

* A task writes runs.  A run holds some millions of records (pair, document), sorted by the pair with
  side A first, in zstd frames of the shared folder; its directory, each pair once with its number of
  documents, goes out in frames by radix of the A id.  So a frequent pair is one entry of a run,
  however many documents hold it.
* A radix merges the directories of all runs through a heap of their next frames.  As the pairs of an A id
  follow each other, its highest count is known when its last pair is; the counts, and which of them are
  highest, then stream back to the frames that they came from.
* Each run puts its counts beside its records and sums them by document.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm.bpe import byte_letters
from orbweave.llm.common import byte_mult, fresh_dir, mix, release, staged, store, text_buffer, tune

#: Records of a run, about.
RUN_RECORDS = 4_000_000
#: Pairs of a frame.
FRAME = 1 << 14
#: Units whose alignment a worker remembers.
CACHE_UNITS = 500_000
#: Most records that a merge holds before it adds up those of one pair.
HELD = 1 << 20

_B_BITS = 20
_U = np.uint64
_WIDE_SPACES = np.array([0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])  # of the library's \s


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length in a zstd frame."""
    return zstandard.ZstdCompressor(level=1).compress(np.concatenate([np.array([len(arrays[0])], np.int64).view(np.uint8), *(np.ascontiguousarray(a).view(np.uint8) for a in arrays)]).tobytes())


def unpack(frame: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(frame)
    n, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    for kind in kinds:
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def cut_units(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the texts; where each unit begins and ends in them; and the text of each unit.

    A unit is a blank, which stands for itself or, at a text's start, is put before it, and all up to
    the next blank that no white space precedes.  Its first blank is not among its bytes."""
    data, at = text_buffer(texts)
    cut = data == 32
    if len(data):
        before = np.zeros(len(data), np.uint8)
        before[1:] = data[:-1]
        cut &= (before != 32) & ((before < 9) | (before > 13))
        wide = np.flatnonzero(cut & (before >= 0x80))
        if len(wide):
            last = data[wide - 1].astype(np.int64) & 0x3F
            second = data[wide - 2].astype(np.int64)
            third = data[np.maximum(wide - 3, 0)].astype(np.int64)
            point = np.where(second >= 0xC0, (second & 0x1F) << 6 | last, np.where(third >= 0xE0, (third & 0x0F) << 12 | (second & 0x3F) << 6 | last, 0))
            cut[wide[np.isin(point, _WIDE_SPACES)]] = False
    first = at[:-1][at[:-1] < at[1:]]
    cut[first] = False
    inner = np.flatnonzero(cut)
    starts = np.sort(np.concatenate([first, inner + 1]))  # a blank at the very end leaves a unit without bytes
    edges = np.sort(np.concatenate([inner, at[1:][at[:-1] < at[1:]]]))
    owner = np.searchsorted(at, edges, "left") - 1
    return data, starts, edges, owner


def hash_units(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sizes = ends - starts
    out = sizes.astype(_U) * _U(0x9E3779B97F4A7C15)
    some = np.flatnonzero(sizes)
    if len(some):
        own = sizes[some]
        first = np.cumsum(own) - own
        inside = np.arange(own.sum()) - np.repeat(first, own)
        chars = data[np.repeat(starts[some], own) + inside].astype(_U) + _U(1)
        out[some] += np.add.reduceat(chars * byte_mult(int(own.max()))[inside], first)
    return mix(out)


class Aligner:
    """Two tokenizers: A a byte-level BPE of the tokenizers library, read with a blank before the text, B
    a sentencepiece BPE with byte fallback, which puts one there itself."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        vocab = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("pieces of B have a blank behind other characters, so texts can't be cut before blanks")
        self.blank = self.b.piece_to_id("▁")
        self.a_size, self.b_size = (np.array([len(t) for t in own], np.int64) for own in (self.a_bytes, self.b_bytes))
        self.clear()

    def clear(self) -> None:
        self.known: dict[int, int] = {}
        self.shown: list[str] = []
        self.stats = np.zeros((0, 5), np.int64)  # numbers of A, B, groups, links; 1 where the bytes agree
        self.pair_at, self.pairs, self.times = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def units(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each unit among those that are remembered."""
        hashes, first, inverse = np.unique(hash_units(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) > CACHE_UNITS:
            self.clear()
        keys = hashes.tolist()
        numbers = [self.known.get(k, -1) for k in keys]
        new = [i for i, n in enumerate(numbers) if n < 0]
        added = []
        for low in range(0, len(new), 20_000):
            own = new[low : low + 20_000]
            where = first[own]
            added.append(self._align([data[s:e].tobytes() for s, e in zip(starts[where].tolist(), ends[where].tolist(), strict=True)]))
        if added:
            total = len(self.shown)
            for k, i in enumerate(new):
                numbers[i] = self.known[keys[i]] = total + k
            for shown, *_ in added:
                self.shown += shown
            self.stats = np.concatenate([self.stats, *(x[1] for x in added)])
            self.pair_at = np.concatenate([self.pair_at, self.pair_at[-1] + np.cumsum(np.concatenate([x[2] for x in added]))])
            self.pairs = np.concatenate([self.pairs, *(x[3] for x in added)])
            self.times = np.concatenate([self.times, *(x[4] for x in added)])
        return np.array(numbers, np.int64)[inverse]

    def _align(self, units: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of new units: groups as text, stats, number of distinct pairs, the pairs, and how often each is linked."""
        texts = [u.decode() for u in units]
        a_ids = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        b_ids = [ids if t else [self.blank] for ids, t in zip(self.b.encode(texts, num_threads=1), texts, strict=True)]
        a_of, b_of = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        good = [b"".join(map(a_of, x)) == (whole := b" " + u) and b"".join(map(b_of, y)) == whole for u, x, y in zip(units, a_ids, b_ids, strict=True)]
        for k, ok in enumerate(good):
            if not ok:
                a_ids[k] = b_ids[k] = []
        a, b = (np.array([i for ids in own for i in ids], np.int64) for own in (a_ids, b_ids))
        n_a, n_b = (np.array([len(ids) for ids in own], np.int64) for own in (a_ids, b_ids))
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        cuts = np.intersect1d(a_end, b_end, assume_unique=True)
        a_group, b_group = np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end)
        in_a, in_b = np.bincount(a_group, minlength=len(cuts)), np.bincount(b_group, minlength=len(cuts))
        unit_of = np.zeros(len(cuts), np.int64)
        unit_of[a_group] = np.repeat(np.arange(len(units)), n_a)
        stats = np.stack([n_a, n_b, *(np.bincount(unit_of, w, len(units)).astype(np.int64) for w in (None, in_a * in_b)), np.array(good, np.int64)], 1)
        # Pairs: each distinct A id of a group with each distinct B id of it.
        (ag, ai, at), (bg, bi, bt) = (self._distinct(group, ids) for group, ids in ((a_group, a), (b_group, b)))
        few_b = np.bincount(bg, minlength=len(cuts))
        first_b = np.cumsum(few_b) - few_b
        many = few_b[ag]
        left = np.repeat(np.arange(len(ag)), many)
        right = np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many) + first_b[ag[left]]
        key, times = ai[left] << _B_BITS | bi[right], at[left] * bt[right]
        unit = unit_of[ag[left]]
        order = np.lexsort((key, unit))
        key, times, unit = key[order], times[order], unit[order]
        head = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (unit[1:] != unit[:-1])])) if len(key) else np.zeros(0, np.int64)
        times = np.add.reduceat(times, head) if len(key) else times
        return self._shown(a, b, in_a, in_b, stats[:, 2]), stats, np.bincount(unit[head], minlength=len(units)), key[head], times

    @staticmethod
    def _distinct(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, times = np.unique(group << _B_BITS | ids, return_counts=True)
        return keys >> _B_BITS, keys & ((1 << _B_BITS) - 1), times

    @staticmethod
    def _shown(a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, groups: np.ndarray) -> list[str]:
        a_text, b_text = list(map(str, a.tolist())), list(map(str, b.tolist()))
        out, i, j = [], 0, 0
        for x, y in zip(in_a.tolist(), in_b.tolist(), strict=True):
            out.append(f"{a_text[i]}|{b_text[j]}" if x == y == 1 else f"{','.join(a_text[i:i + x])}|{','.join(b_text[j:j + y])}")
            i, j = i + x, j + y
        ends = np.cumsum(groups).tolist()
        return [";".join(out[e - n : e]) for e, n in zip(ends, groups.tolist(), strict=True)]

    def documents(self, texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of each text its numbers of A and B tokens, groups and links, and the groups' hash; then the
        records: text, pair, and how often the text links it."""
        data, starts, ends, owner = cut_units(texts)
        unit = self.units(data, starts, ends)
        bad = np.zeros(len(texts), bool)
        bad[owner[self.stats[unit, 4] == 0]] = True
        unit, owner = unit[~bad[owner]], owner[~bad[owner]]
        stats = np.zeros((len(texts), 4), np.int64)
        for k in range(4):
            stats[:, k] = np.bincount(owner, self.stats[unit, k], len(texts))
        edges, numbers, shown, sha = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist(), unit.tolist(), self.shown.__getitem__, hashlib.sha256
        hashes = [sha(";".join(map(shown, numbers[i:j])).encode()).hexdigest() if j > i else "" for i, j in zip(edges[:-1], edges[1:], strict=True)]
        both, often = np.unique(owner * len(self.shown) + unit, return_counts=True)
        doc, unit = np.divmod(both, max(len(self.shown), 1))
        many = self.pair_at[unit + 1] - self.pair_at[unit]
        row = np.repeat(np.arange(len(unit)), many)
        at = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + self.pair_at[unit[row]]
        doc, pair, times = doc[row], self.pairs[at], self.times[at] * often[row]
        return stats, hashes, *_summed(doc, pair, times)


def _summed(doc: np.ndarray, pair: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((doc, pair))
    doc, pair, times = doc[order], pair[order], times[order]
    if not len(doc):
        return doc, pair, times
    head = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])]))
    return doc[head], pair[head], np.add.reduceat(times, head)


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One for each worker process."""
    return Aligner(a_path, b_path)


def radix_of(pairs: np.ndarray, radices: int) -> np.ndarray:
    return (mix((pairs >> _B_BITS).astype(_U)) % _U(radices)).astype(np.int64)


class _Run:
    """Records of consecutive documents, until they are written."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.documents: list[pa.RecordBatch] = []
        self.n_docs = self.n_records = 0

    def add(self, keys: pa.Array, stats: np.ndarray, hashes: list[str], doc: np.ndarray, pair: np.ndarray, times: np.ndarray) -> None:
        self.documents.append(pa.RecordBatch.from_arrays([keys, *(pa.array(stats[:, k]) for k in range(4)), pa.array(hashes, pa.string())], names=["key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]))
        self.parts.append((doc + self.n_docs, pair, times))
        self.n_docs += len(keys)
        self.n_records += len(doc)

    def write(self, folder: str, radices: int) -> pa.RecordBatch:
        """Writes the run and returns its directory, a row for each radix, at least one."""
        doc, pair, times = (np.concatenate([p[k] for p in self.parts]) for k in range(3))
        self.parts = []
        radix = radix_of(pair, radices)
        order = np.lexsort((doc, pair, radix))
        doc, pair, times, radix = doc[order], pair[order], times[order], radix[order]
        head = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
        docs_of = np.diff(np.append(head, len(pair)))
        uri = f"{folder}/run-{uuid.uuid4().hex}"
        files, path = store(uri)
        files.create_dir(path.rsplit("/", 1)[0], recursive=True)
        frames = [pack(doc[k : k + (1 << 20)].astype(np.uint32), times[k : k + (1 << 20)].astype(np.uint32)) for k in range(0, len(doc), 1 << 20)]
        with files.open_output_stream(path, compression=None) as out:
            for frame in [pack(docs_of.astype(np.uint32)), *frames]:
                out.write(np.array([len(frame)], np.int64).tobytes())
                out.write(frame)
        with files.open_output_stream(path + ".docs", compression=None) as out, pa.ipc.new_stream(out, self.documents[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            for batch in self.documents:
                writer.write_batch(batch)
        pair, radix = pair[head], radix[head]
        edges = np.flatnonzero(np.concatenate([[True], radix[1:] != radix[:-1]])).tolist() if len(pair) else [0]
        rows = []
        for low, high in zip(edges, [*edges[1:], len(pair)], strict=True):
            at = range(low, high, FRAME)
            rows.append((uri, int(radix[low]) if len(pair) else 0, pair[list(at)].tolist(), [pack(np.diff(pair[k : min(k + FRAME, high)], prepend=0), docs_of[k : min(k + FRAME, high)].astype(np.uint32)) for k in at]))
        return pa.RecordBatch.from_pylist([dict(zip(("run", "radix", "firsts", "frames"), r, strict=True)) for r in rows], _DIRECTORY)


_DIRECTORY = pa.schema([("run", pa.string()), ("radix", pa.int64()), ("firsts", pa.list_(pa.int64())), ("frames", pa.list_(pa.binary()))])


def read_run(uri: str) -> tuple[np.ndarray, Iterator[list[np.ndarray]]]:
    """Number of documents of each pair of a run, and its records in parts: document and times."""
    files, path = store(uri)
    source = files.open_input_stream(path, compression=None)

    def following() -> bytes:
        size = source.read(8)
        return source.read(int(np.frombuffer(size, np.int64)[0])) if size else b""

    (docs_of,) = unpack(following(), "u4")

    def parts() -> Iterator[list[np.ndarray]]:
        with source:
            while found := following():
                yield unpack(found, "u4", "u4")

    return docs_of, parts()


def merge_runs(runs: list[tuple[list[int], list[bytes]]]) -> Iterator[tuple[int, int, bytes]]:
    """Counts the pairs of the runs of one radix: run, number of the frame, and for each of the
    frame's pairs its count over all runs, negative where it is not the highest of its A id.

    A heap holds the first pair of each run's next frame.  What is under the smallest of them is
    complete; an A id is answered when all its pairs are."""
    heap = [(firsts[0], run, 0) for run, (firsts, _) in enumerate(runs) if firsts]
    heapq.heapify(heap)
    waiting: list[tuple[int, int, int, np.ndarray]] = []  # by last pair: run, frame and its pairs
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    done = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    while heap or waiting:
        if heap:
            _, run, frame = heap[0]
            firsts, frames = runs[run]
            delta, docs = unpack(frames[frame], "i8", "u4")
            pairs = np.cumsum(delta)
            heapq.heappush(waiting, (int(pairs[-1]), run, frame, pairs))
            parts.append((pairs, docs.astype(np.int64)))
            held += len(pairs)
            if frame + 1 < len(firsts):
                heapq.heapreplace(heap, (firsts[frame + 1], run, frame + 1))
            else:
                heapq.heappop(heap)
            if heap and held < HELD:
                continue
        limit = (heap[0][0] >> _B_BITS) << _B_BITS if heap else np.iinfo(np.int64).max  # no pair of this A id or later ones
        pairs, counts = _counted(parts)
        ready = int(np.searchsorted(pairs, limit))
        done = _with_highest(done, pairs[:ready], counts[:ready])
        parts = [(pairs[ready:], counts[ready:])]
        held = len(pairs) - ready
        while waiting and waiting[0][0] < limit:
            _, run, frame, own = heapq.heappop(waiting)
            yield run, frame, pack(done[1][np.searchsorted(done[0], own)])
        low = min((int(w[3][0]) for w in waiting), default=limit)
        kept = int(np.searchsorted(done[0], low))
        done = (done[0][kept:], done[1][kept:])


def _counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    pairs, counts = (np.concatenate([np.zeros(0, np.int64), *(p[k] for p in parts)]) for k in (0, 1))
    order = np.argsort(pairs, kind="stable")
    pairs, counts = pairs[order], counts[order]
    if not len(pairs):
        return pairs, counts
    head = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
    return pairs[head], np.add.reduceat(counts, head)


def _with_highest(done: tuple[np.ndarray, np.ndarray], pairs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(pairs):
        return done
    side = pairs >> _B_BITS
    head = np.flatnonzero(np.concatenate([[True], side[1:] != side[:-1]]))
    highest = np.repeat(np.maximum.reduceat(counts, head), np.diff(np.append(head, len(pairs))))
    return np.concatenate([done[0], pairs]), np.concatenate([done[1], np.where(counts == highest, counts, -counts)])


def align_tokenizers(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, a_path: str, b_path: str, run_records: int = RUN_RECORDS) -> DataFrame:
    """Aligns the tokens that two tokenizers make of every whole text.

    Returns ``id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``, a row for each
    input row: numbers of tokens, of groups of tokens that end together, and of links, the pairs of
    tokens of a group; the links whose pair is in as many documents of the table as any pair of
    its A id; and the sum of those numbers of documents over the links.  The hash is of the groups as
    text, ``a1,a2|b1;a3|b2``.  A null or empty text, and one whose bytes a tokenizer does not give back,
    has zeros and an empty hash.  Rows that repeat an id are documents of their own.  Other columns
    are not read; an empty table gives no rows."""
    spark = df.sparkSession
    tune(spark)
    folder, kind = fresh_dir(spark, "alignment"), df.schema[id_col].dataType.simpleString()
    radices = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def spill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, run = aligner(a_path, b_path), _Run()
        for batch in batches:
            if batch.num_rows:
                run.add(batch.column(0), *own.documents(batch.column(1)))
            if run.n_records >= run_records:
                yield run.write(folder, radices)
                run = _Run()
        if run.n_docs:
            yield run.write(folder, radices)
        release()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["radix"] != now:
                    yield from answers(rows)
                    now, rows = row["radix"], []
                rows.append(row)
        yield from answers(rows)
        release()

    def answers(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        out: list[list[bytes]] = [[b""] * len(r["frames"]) for r in rows]
        for run, frame, found in merge_runs([(r["firsts"], r["frames"]) for r in rows]):
            out[run][frame] = found
        for low in range(0, len(rows), 64):
            own = rows[low : low + 64]
            yield pa.RecordBatch.from_arrays([pa.array([r["run"] for r in own]), pa.array([r["radix"] for r in own], pa.int64()), pa.array(out[low : low + 64], pa.list_(pa.binary()))], names=["run", "radix", "counts"])

    def give_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, frames = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["run"] != now:
                    if now:
                        yield from summed(now, frames)
                    now, frames = row["run"], []
                frames += row["counts"]
        if now:
            yield from summed(now, frames)
        release()

    def summed(uri: str, frames: list[bytes]) -> Iterator[pa.RecordBatch]:
        counts = np.concatenate([np.zeros(0, np.int64), *(unpack(f, "i8")[0] for f in frames)])
        docs_of, parts = read_run(uri)
        files, path = store(uri + ".docs")
        with files.open_input_stream(path, compression=None) as source:
            table = pa.ipc.open_stream(source).read_all()
        best, total, ends, at = np.zeros(len(table), np.int64), np.zeros(len(table), np.int64), np.cumsum(docs_of, dtype=np.int64), 0
        for doc, times in parts:
            count = counts[np.searchsorted(ends, np.arange(at, at + len(doc)), "right")]
            np.add.at(total, doc, times * np.abs(count))
            np.add.at(best, doc, np.where(count > 0, times, 0).astype(np.int64))
            at += len(doc)
        out = table.add_column(5, "n_best", pa.array(best)).add_column(6, "count_sum", pa.array(total)).rename_columns([id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])
        yield from out.to_batches(max_chunksize=10_000)

    texts = df.select(F.col(f"`{id_col}`").alias("key"), F.col(f"`{text_col}`").alias("text"))
    spilled = staged(texts.mapInArrow(spill, "run string, radix bigint, firsts array<bigint>, frames array<binary>"), "directories")
    counted = spilled.repartition(radices, "radix").sortWithinPartitions("radix", "run").mapInArrow(merge, "run string, radix bigint, counts array<binary>")
    dealt = counted.repartition(radices, "run").sortWithinPartitions("run", "radix")
    return dealt.mapInArrow(give_back, f"`{id_col}` {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")
