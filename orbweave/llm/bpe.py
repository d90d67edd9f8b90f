"""Byte-pair encoding and decoding by contiguous rank arrays.

A short word keeps its part boundaries and the ranks of adjacent parts in one small
array.  The array is scanned for its minimum, the boundary behind that part is deleted
and the two ranks beside it are looked up again, until no rank is left.  The arrays of
many words are rows of one matrix, so that each scan, deletion and look-up is a numpy
step over all of them; words that repeat are encoded once.

Letters, digits, white space and lower case are those of the tokenizers library, which a
worker asks once, and not those of Python, whose Unicode version is another one.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from orbweave.llm.common import Words, release, slices, split_words, tune
from orbweave.llm.merges import NEVER, PairTable

#: Words of more bytes are merged one at a time.
LONG = 64
#: Words whose ids a worker remembers.
CACHE_WORDS = 400_000

#: From here on there are neither letters nor digits nor white space (tested).
_NO_LETTERS = 0x33480

#: Classes of code points.
SPACE, LETTER, NUMBER, OTHER, ODD = range(5)


@lru_cache(maxsize=1)
def code_points() -> tuple[np.ndarray, dict[str, str], np.ndarray, np.ndarray]:
    """What the tokenizers library makes of single code points: the class of each; the lower
    case of those for which Python has another; the class once more, ODD where a
    character may change together with its neighbours or into several (such words are
    taken apart as text); and the lower case of all others as code points."""
    import tokenizers

    every = [chr(c) for c in range(_NO_LETTERS) if not 0xD800 <= c < 0xE000]
    text, kind = "".join(every), np.full(0x110000, OTHER, np.uint8)
    for which, name in ((SPACE, r"\s"), (LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
        split = tokenizers.pre_tokenizers.Split(tokenizers.Regex(f"[^{name}]+"), behavior="removed")
        for piece, _ in split.pre_tokenize_str(text):
            kind[[ord(c) for c in piece]] = which
    rest = [c for c in every if kind[ord(c)] != SPACE]
    lowered = tokenizers.normalizers.Lowercase().normalize_str("\n".join(rest)).split("\n")
    lower = {c: low for c, low in zip(rest, lowered, strict=True) if c.lower() != low}
    plain, into = kind.copy(), np.arange(0x110000, dtype=np.int32)
    for c, low in zip(rest, lowered, strict=True):
        if len(low) > 1:
            plain[ord(c)] = ODD
        elif low != c:
            into[ord(c)], plain[ord(c)] = ord(low), kind[ord(low)]
    for c in every:
        pair = unicodedata.decomposition(c)
        if unicodedata.combining(c):
            plain[ord(c)] = ODD
        if pair and pair[0] != "<":  # it composes, or is composed anew, with what stands before
            plain[[int(x, 16) for x in pair.split()[1:]]] = ODD
            if unicodedata.normalize("NFC", c) != c:
                plain[ord(c)] = ODD
    plain[0x1100:0x1200] = ODD  # parts of syllables
    plain[[ord(c) for c in "'<Σ"]] = ODD  # contractions, special tokens
    return kind, lower, plain, into


def _as_class(kind: np.ndarray, which: int) -> str:
    """Code points of a class as the ranges of a pattern."""
    own = np.flatnonzero(kind == which)
    cuts = np.flatnonzero(np.diff(own) > 1)
    return "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in zip(own[np.append(0, cuts + 1)].tolist(), own[np.append(cuts, len(own) - 1)].tolist(), strict=True))


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies:
    printable Latin-1 stands for itself, the other bytes for code points from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in own)
    shown = {b: chr(256 + i) for i, b in enumerate(rest)}
    return [shown.get(b, chr(b)) for b in range(256)]


def lower_each(text: str) -> str:
    """Lower case of each character by itself, as the library has it, without the rule for a
    final sigma."""
    if text.isascii():
        return text.lower()
    own = code_points()[1]
    if own.keys().isdisjoint(text):
        return text.replace("Σ", "σ").lower()
    return "".join([own[c] if c in own else c.lower() for c in text])


class WordCodec:
    """Encoder and decoder of a tokenizers file with a byte-level BPE that marks word
    ends, folds case and drops white space."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"]
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + suffix] for c in letters], np.int64)
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]]
        self.table = PairTable(*zip(*merges, strict=True), range(len(merges)))
        self.tokens = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        pieces = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        kind = code_points()[0]
        #: Characters that are a letter to Python or to the library alone.
        self.unlike = frozenset(chr(c) for c in range(_NO_LETTERS) if chr(c).isalpha() != (kind[c] == LETTER))
        for name, which in ((r"\s", SPACE), (r"\p{L}", LETTER), (r"\p{N}", NUMBER)):
            pieces = pieces.replace(name, _as_class(kind, which))
        self.piece = regex.compile(pieces)
        #: Rank and result of pairs of bytes, within a word and at its end.
        left, right = np.divmod(np.arange(1 << 16), 256)
        self.small = np.dtype(np.uint16 if len(vocab) < (1 << 16) - 1 else np.int32)
        self.last = np.iinfo(self.small).max  # rank of a pair that is never merged
        both = [self.table.lookup(self.inner[left], own[right]) for own in (self.inner, self.final)]
        self.first = [(np.minimum(ranks, self.last).astype(self.small), into.astype(self.small)) for ranks, into in both]
        #: Ids and tokens as text and their number, of each pre-token and of each word by its hash.
        self.shown: dict[str, tuple[str, str, int]] = {}
        self.seen: dict[int, tuple[str, str, int]] = {}

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each pre-token."""
        out: list[list[int]] = [[]] * len(words)
        sizes = np.array([len(w) for w in words], np.int64)
        for low, high in ((0, 8), (8, 16), (16, 32), (32, LONG)):
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            if len(rows):
                for row, ids in zip(rows.tolist(), self._rank_arrays([words[i] for i in rows], sizes[rows]), strict=True):
                    out[row] = ids
        for i in np.flatnonzero(sizes > LONG):
            raw = np.frombuffer(words[i], np.uint8)
            out[i] = self.table.merge_long([*self.inner[raw[:-1]].tolist(), int(self.final[raw[-1]])])
        return out

    def _rank_arrays(self, words: list[bytes], sizes: np.ndarray) -> list[list[int]]:
        n, width = len(words), int(sizes.max())
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        parts = self.inner[raw]
        every = np.arange(n)
        parts[every, sizes - 1] = self.final[raw[every, sizes - 1]]
        columns = np.arange(width)
        left = sizes.copy()
        ranks, into = self.table.lookup(parts[:, :-1], parts[:, 1:])
        ranks = np.where(columns[:-1] + 1 < sizes[:, None], ranks, NEVER)
        ranks = np.concatenate([ranks, np.full((n, 3), NEVER)], 1)  # a margin as wide as that of parts
        into = np.concatenate([into.astype(np.int64), np.zeros((n, 3), np.int64)], 1)
        parts = np.concatenate([parts, np.zeros((n, 2), np.int64)], 1)
        columns = np.arange(parts.shape[1])
        rows, result = every, [None] * n
        while len(rows):
            at = ranks.argmin(1)
            here = np.arange(len(rows))
            live = ranks[here, at] < NEVER
            if not live.all():
                for row, ids, m in zip(rows[~live].tolist(), parts[~live].tolist(), left[~live].tolist(), strict=True):
                    result[row] = ids[:m]
                rows, parts, ranks, into, left, at = rows[live], parts[live], ranks[live], into[live], left[live], at[live]
                here = np.arange(len(rows))
                if not len(rows):
                    break
            new = into[here, at]
            shift = np.minimum(columns + (columns > at[:, None]), len(columns) - 1)
            parts = np.take_along_axis(parts, shift, 1)
            parts[here, at] = new
            left -= 1
            shift = np.minimum(columns + (columns >= at[:, None]), len(columns) - 1)
            ranks, into = np.take_along_axis(ranks, shift, 1), np.take_along_axis(into, shift, 1)
            for p in (at - 1, at):
                ok = (p >= 0) & (p + 1 < left)
                ranks[here[~ok & (p >= 0)], p[~ok & (p >= 0)]] = NEVER
                ranks[here[ok], p[ok]], into[here[ok], p[ok]] = self.table.lookup(parts[here[ok], p[ok]], parts[here[ok], p[ok] + 1])
        return result

    def pieces(self, text: str) -> list[str]:
        """Special tokens and pre-tokens, in order."""
        if "<|" in text:
            out: list[str] = []
            for k, part in enumerate(self.special_at.split(text)):
                out += [part] if k % 2 else self._plain(part)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        text = lower_each(text if text.isascii() else unicodedata.normalize("NFC", text))
        if text.isascii() or self.unlike.isdisjoint(text):
            if text.isalpha():
                return [text]
            if text[:-1].isalpha() and text[-1] in ".,":
                return [text[:-1], text[-1]]
        return self.piece.findall(text)

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        plain = [p for p in pieces if p not in self.special]
        ids = iter(self.encode_words([p.encode() for p in plain]))
        return [[self.special[p]] if p in self.special else next(ids) for p in pieces]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text."""
        pieces = [self.pieces(t) for t in texts]
        words = list({p for own in pieces for p in own})
        ids = dict(zip(words, self.encode_pieces(words), strict=True))
        return [[i for p in own for i in ids[p]] for own in pieces]

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by a blank, as the file names no decoder; special ones stay."""
        return " ".join([self.tokens[i] for i in ids])

    def encode_array(self, texts: pa.Array) -> pa.ListArray:
        """Ids of each text of a column; words that repeat in it are encoded once."""
        words = split_words(texts)
        _, first, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
        flat, sizes = self._distinct(words, first)
        begins = np.cumsum(sizes) - sizes
        many = sizes[inverse]
        total = np.concatenate([[0], np.cumsum(many)])
        at = np.repeat(begins[inverse] - total[:-1], many) + np.arange(total[-1])
        return pa.ListArray.from_arrays(pa.array(total[words.offs], pa.int32()), pa.array(flat[at], pa.int32()))

    def _distinct(self, words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some words, one after another, and how many each has.

        Words of characters that stand for themselves are taken apart by classes of code
        points, all at once; the others as text."""
        plain, into = code_points()[2:]
        starts, sizes = words.starts[which], words.ends[which] - words.starts[which]
        raw = words.data[np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
        points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
        word_of = np.repeat(np.arange(len(which)), sizes)[(raw & 0xC0) != 0x80]
        kind = plain[points]
        odd = np.zeros(len(which), bool)
        odd[word_of[kind == ODD]] = True
        keep = ~odd[word_of] & (kind != SPACE)
        begin = np.ones(len(points), bool)
        begin[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER) | (word_of[1:] != word_of[:-1])
        begin, points, word_of = begin[keep], into[points[keep]], word_of[keep]  # what follows a blank begins anew
        width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        at = np.cumsum(width) - width
        data = np.frombuffer(points.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        piece_at = np.append(at[begin], len(data))
        ids, lengths = self._flat(data, piece_at)
        counts = np.bincount(word_of[begin], lengths, len(which)).astype(np.int64)
        if odd.any():
            others = self.encode([words.word(i).decode() for i in which[odd]])
            counts[odd] = [len(o) for o in others]
            out = np.empty(int(counts.sum()), np.int32)
            theirs = np.repeat(odd, counts)
            out[~theirs], out[theirs] = ids, np.array([i for o in others for i in o], np.int32)
            ids = out
        return ids, counts

    def _flat(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pre-tokens data[at[i]:at[i + 1]], one after another, and each one's number."""
        starts, sizes = at[:-1], np.diff(at)
        out, lengths = np.full(len(data), -1, np.int32), np.ones(len(sizes), np.int64)
        single = starts[sizes == 1]
        out[single] = self.final[data[single]]
        for low, high in ((1, 4), (4, 8), (8, 12), (12, 16), (16, 32), (32, LONG)):
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            for k in range(0, len(rows), 8192):  # the rank arrays of a part stay in the processor's cache
                own = rows[k : k + 8192]
                ids, left = self._merged(data, starts[own], sizes[own])
                lengths[own] = left
                inside = np.arange(ids.shape[1]) < left[:, None]
                out[(starts[own][:, None] + np.arange(ids.shape[1]))[inside]] = ids[inside]
        for i in np.flatnonzero(sizes > LONG):
            raw = data[starts[i] : starts[i] + sizes[i]]
            ids = self.table.merge_long([*self.inner[raw[:-1]].tolist(), int(self.final[raw[-1]])])
            out[starts[i] : starts[i] + len(ids)], lengths[i] = ids, len(ids)
        return out[out >= 0], lengths

    def _merged(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parts of pre-tokens as rows of a matrix, and each row's number of them."""
        n, width, small, last = len(starts), int(sizes.max()), self.small, self.last
        columns, every, end = np.arange(width), np.arange(n), sizes - 1
        raw = data[np.minimum(starts[:, None] + columns, len(data) - 1)]
        parts = np.zeros((n, width + 1), small)  # a margin to shift from
        parts[:, :width] = self.inner.astype(small)[raw]
        parts[every, end] = self.final[raw[every, end]]
        pair = raw[:, :-1].astype(np.int32) << 8 | raw[:, 1:]
        ranks, into = np.full((n, width + 1), last, small), np.zeros((n, width + 1), small)
        (inner_ranks, inner_into), (final_ranks, final_into) = self.first
        ranks[:, : width - 1], into[:, : width - 1] = inner_ranks[pair], inner_into[pair]
        closing = pair[every, end - 1]
        ranks[every, end - 1], into[every, end - 1] = final_ranks[closing], final_into[closing]
        ranks[:, :width][columns >= end[:, None]] = last
        out, left, done, rows = np.empty((n, width), small), sizes.copy(), np.empty(n, np.int64), every
        while True:
            at = ranks.argmin(1)
            here = np.arange(len(rows))
            live = ranks[here, at] < last
            if not live.all():
                out[rows[~live]], done[rows[~live]] = parts[~live, :width], left[~live]
                rows, parts, ranks, into, left, at = rows[live], parts[live], ranks[live], into[live], left[live], at[live]
                here = here[: len(rows)]
            if not len(rows):
                return out, done
            new = into[here, at]
            behind = columns > at[:, None]
            np.copyto(parts[:, :width], parts[:, 1:].copy(), where=behind)
            parts[here, at] = new
            left -= 1
            behind |= columns == at[:, None]
            for own in (ranks, into):
                np.copyto(own[:, :width], own[:, 1:].copy(), where=behind)
            for p in (at - 1, at):
                ok = np.flatnonzero((p >= 0) & (p + 1 < left))
                q = p[ok]
                found, result = self.table.lookup(parts[ok, q], parts[ok, q + 1])
                ranks[ok, q], into[ok, q] = np.minimum(found, last), result
            ended = np.flatnonzero(at + 1 >= left)
            ranks[ended, at[ended]] = last

    def decode_array(self, ids: pa.ListArray) -> pa.Array:
        """decode() of each array of ids; null counts as none."""
        names = pa.array([self.tokens[i] for i in range(max(self.tokens) + 1)])
        if ids.null_count:
            ids = pa.array([i or [] for i in ids.to_pylist()], ids.type)
        values = names.take(ids.flatten())
        offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False))]) if len(ids) else np.zeros(1)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values), " ")

    def digest(self, texts: pa.Array) -> tuple[list[int], list[str], list[str]]:
        """Of each text: number of ids, SHA-256 of the ids and of what they decode to."""
        words = split_words(texts)
        keys, first, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
        if len(self.seen) > CACHE_WORDS:
            self.seen.clear(), self.shown.clear()
        keys = keys.tolist()
        known = [self.seen.get(k) for k in keys]
        new = [i for i, hit in enumerate(known) if hit is None]
        raw, starts, ends = words.data.tobytes(), words.starts[first].tolist(), words.ends[first].tolist()
        pieces = [self.pieces(raw[starts[i] : ends[i]].decode()) for i in new]
        fresh = list({p for own in pieces for p in own if p not in self.shown})
        for p, ids in zip(fresh, self.encode_pieces(fresh), strict=True):
            self.shown[p] = (" ".join(map(str, ids)), self.decode(ids), len(ids))
        for i, own in zip(new, pieces, strict=True):
            parts = [self.shown[p] for p in own]
            known[i] = self.seen[keys[i]] = parts[0] if len(parts) == 1 else (" ".join([p[0] for p in parts]), " ".join([p[1] for p in parts]), sum([p[2] for p in parts]))
        sizes = np.array([k[2] for k in known], np.int64)[inverse] if known else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(sizes)])
        counts = (total[words.offs[1:]] - total[words.offs[:-1]]).tolist()
        inverse, sha = inverse.tolist(), hashlib.sha256
        ids_of, text_of, offs = [k[0] for k in known].__getitem__, [k[1] for k in known].__getitem__, words.offs.tolist()
        empty = {i for i, k in enumerate(known) if not k[2]}
        ids_sha, text_sha = [], []
        for a, b in zip(offs[:-1], offs[1:], strict=True):
            own = inverse[a:b] if not empty else [i for i in inverse[a:b] if i not in empty]
            ids_sha.append(sha(" ".join(map(ids_of, own)).encode()).hexdigest())
            text_sha.append(sha(" ".join(map(text_of, own)).encode()).hexdigest())
        return counts, ids_sha, text_sha


@lru_cache(maxsize=2)
def word_codec(path: str) -> WordCodec:
    """One codec for each worker process."""
    return WordCodec(path)


def encode_column(df: DataFrame, text_col: str = "text", ids_col: str = "token_ids", decoded_col: str | None = None, *, path: str) -> DataFrame:
    """Adds the ids of every whole text as an array, and with ``decoded_col`` the text that they
    decode to; a null or empty text has no ids and decodes to an empty text.

    Columns of those names are replaced; all other columns and all rows stay."""
    from pyspark.sql import types as T

    tune(df.sparkSession)
    df = df.drop(*{ids_col, decoded_col or ids_col} - {text_col})
    added = [T.StructField(ids_col, T.ArrayType(T.IntegerType(), False), False)] + ([T.StructField(decoded_col, T.StringType(), False)] if decoded_col else [])
    schema = T.StructType([*df.schema.fields, *added])
    place = df.columns.index(text_col)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = word_codec(path)
        for batch in batches:
            for part in slices(batch, text_col):
                ids = codec.encode_array(part.column(place))
                yield pa.RecordBatch.from_arrays([*part.columns, ids, *([codec.decode_array(ids)] if decoded_col else [])], names=schema.names)
        release()

    return df.mapInArrow(encode, schema)


def decode_column(df: DataFrame, ids_col: str = "token_ids", text_col: str = "decoded", *, path: str) -> DataFrame:
    """Adds the text that each array of ids decodes to; null decodes to an empty text.

    A column of that name is replaced; all other columns and all rows stay."""
    from pyspark.sql import types as T

    df = df.drop(text_col) if ids_col != text_col else df
    schema = T.StructType([*df.schema.fields, T.StructField(text_col, T.StringType(), False)])
    place = df.columns.index(ids_col)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = word_codec(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, codec.decode_array(batch.column(place))], names=schema.names)

    return df.mapInArrow(decode, schema)


def encode_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, path: str) -> DataFrame:
    """Encodes every whole text, decodes the ids, and returns digests of both.

    Returns ``id_col, n_tokens, ids_sha256, decoded_sha256``, a row for each input row,
    repeated rows and null ids included.  A null text counts as empty: no ids, and the
    digest of nothing.  Other columns are not read; an empty table gives no rows.
    """
    tune(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = word_codec(path)
        for batch in batches:
            for part in slices(batch, text_col):
                n, ids, texts = codec.digest(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(id_col, text_col).mapInArrow(digest, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
