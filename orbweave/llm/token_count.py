"""Token counts by rank-synchronous array merging.

Pre-tokens are held as one ragged numpy array of symbols.  In each round every sequence
applies its own lowest-rank pair, all at the same time, and only the ranks beside the
merges are looked up again; sequences without a further merge leave the array.  What
survives is counted, and characters outside the vocabulary count by their UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from orbweave.llm.common import Words, mix, odd_numbers, slices, split_words, text_buffer, tune
from orbweave.llm.merges import NEVER, PairTable

#: Sequences of more symbols are merged one at a time.
LONG = 2048
#: Words whose counts a worker remembers.
CACHE_WORDS = 1_000_000

#: Symbols, up to the end of a sequence, that are merged in rounds at once.
BLOCK = 1 << 20

_UNKNOWN = 1 << 19
_BLANK = "▁"


class PieceCounter:
    """Counts what a sentencepiece BPE model with byte fallback, a blank put before
    non-empty texts and no other normalization makes of a text."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))]
        pieces = {model.id_to_piece(i): i for i in ids}
        scores = {i: model.get_score(i) for i in ids}
        rank = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.symbol_of = np.full(0x110000, _UNKNOWN, np.int32)
        left, right, merged, ranks, beside = [], [], [], [], set()
        for piece, i in pieces.items():
            if len(piece) == 1:
                self.symbol_of[ord(piece)] = i
            for k in range(1, len(piece)):
                beside.add(ord(piece[k - 1]) << 21 | ord(piece[k]))
                a, b = pieces.get(piece[:k]), pieces.get(piece[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(i), ranks.append(rank[scores[i]])
        self.table = PairTable(left, right, merged, ranks)
        self.beside = np.array(sorted(beside), np.int64)
        #: White space that pieces hold, as a carriage return: texts with it are not cut there.
        self.whole = [b for b in range(9, 14) if any(chr(b) in p for p in pieces)]
        self.seen: dict[int, int] = {}
        self.blank_runs: dict[int, int] = {}

    def count_strings(self, units: list[str]) -> np.ndarray:
        """Tokens of each string, in which blanks are already written out."""
        sizes = np.array([len(u) for u in units], np.int64)
        chars = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        owner = np.repeat(np.arange(len(units)), sizes)
        symbols = self.symbol_of[chars]
        unknown = symbols == _UNKNOWN
        weight = np.where(unknown, 1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000), 1)
        total = np.bincount(owner, weight, len(units)).astype(np.int64)
        if len(chars) < 2:
            return total
        # No piece holds these two characters side by side: nothing merges across this place.
        pair = chars[:-1] << 21 | chars[1:]
        at = np.minimum(np.searchsorted(self.beside, pair), len(self.beside) - 1)
        cut = (self.beside[at] != pair) | (owner[1:] != owner[:-1])
        seq = np.concatenate([[0], np.cumsum(cut)])
        length = np.bincount(seq)
        for s in np.flatnonzero(length > LONG):
            own = np.flatnonzero(seq == s)
            total[owner[own[0]]] -= len(own) - len(self.table.merge_long(symbols[own].tolist()))
        keep = (length[seq] > 1) & (length[seq] <= LONG)
        symbols, seq = symbols[keep].astype(np.int64), seq[keep]
        merges = np.zeros(len(length), np.int64)
        low = 0
        while low < len(seq):  # whole sequences, so that places fit into 22 bits
            high = int(np.searchsorted(seq, seq[min(low + BLOCK, len(seq)) - 1], "right"))
            first, last = seq[low], seq[high - 1] + 1
            merges[first:last] = self._merge_rounds(symbols[low:high], seq[low:high] - first, last - first)
            low = high
        first = np.flatnonzero(np.concatenate([[True], cut]))
        np.subtract.at(total, owner[first], merges)
        return total

    def _merge_rounds(self, symbols: np.ndarray, seq: np.ndarray, n_seq: int) -> np.ndarray:
        """Number of merges that each sequence undergoes; for fewer than 1 << 22 symbols."""
        done = np.zeros(n_seq, np.int64)
        if not len(symbols):
            return done
        rank = np.full(len(symbols), NEVER)
        into = np.zeros(len(symbols), np.int64)
        inner = np.flatnonzero(seq[:-1] == seq[1:])
        rank[inner], into[inner] = self.table.lookup(symbols[inner], symbols[inner + 1])
        while True:
            start = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
            lowest = np.minimum.reduceat(rank << 22 | np.arange(len(rank)), start)
            live = lowest >> 22 < NEVER
            if not live.any():
                return done
            if live.sum() < 0.7 * len(live):  # the others have ended
                keep = np.repeat(live, np.diff(np.append(start, len(seq))))
                symbols, seq, rank, into = symbols[keep], seq[keep], rank[keep], into[keep]
                continue
            at = lowest[live] & ((1 << 22) - 1)
            done[seq[at]] += 1
            symbols[at] = into[at]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            rank[at] = rank[at + 1]  # whether a right neighbour follows; looked up below
            new_at = at - np.arange(len(at))
            symbols, seq, rank, into = symbols[stay], seq[stay], rank[stay], into[stay]
            for p in (new_at - 1, new_at):
                ok = (p >= 0) & (p + 1 < len(seq))
                p = p[ok]
                same = seq[p] == seq[p + 1]
                rank[p[~same]] = NEVER
                p = p[same]
                rank[p], into[p] = self.table.lookup(symbols[p], symbols[p + 1])
            if len(rank):
                rank[-1] = NEVER

    def count_texts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each whole text of a column."""
        words = split_words(texts)
        data, at = words.data, words.text_at
        blank = data == 32
        place = np.arange(len(data))
        last_solid = np.maximum.accumulate(np.where(blank, -1, place)) if len(data) else place
        text_of = words.doc_of_word()
        before = np.where(words.starts > 0, last_solid[words.starts - 1], -1) if len(words.starts) else words.starts
        begins = np.maximum(before + 1, at[text_of])
        blanks = words.starts - begins + (begins == at[text_of])
        total = np.zeros(len(texts), np.int64)
        if len(words.starts):
            keys, first, inverse = np.unique(mix(words.hashes + blanks.astype(np.uint64) * odd_numbers(1, 3)[0]), return_index=True, return_inverse=True)
            total += np.bincount(text_of, self._known(words, keys.tolist(), first, blanks)[inverse], len(texts)).astype(np.int64)
        # Runs of blanks that no word follows, and the other white space, a byte each.
        next_other = np.ones(len(data), bool)
        if len(data):
            next_other[:-1] = (data[1:] >= 9) & (data[1:] <= 13)
            next_other[at[1:][at[1:] > at[:-1]] - 1] = True
        tails = np.flatnonzero(blank & next_other)
        of = np.searchsorted(at, tails, "right") - 1
        begins = np.maximum(last_solid[tails] + 1, at[of]) if len(tails) else tails
        runs = tails - begins + 1 + (begins == at[of])
        other = np.flatnonzero((data >= 9) & (data <= 13))
        opening = np.flatnonzero(at[:-1] < at[1:])
        opening = opening[np.isin(at[opening], other)]  # the blank put before stands alone
        for where, sizes in ((of, runs), (opening, np.ones(len(opening), np.int64))):
            if len(where):
                np.add.at(total, where, np.array([self._run(n) for n in sizes.tolist()]))
        total += np.bincount(np.searchsorted(at, other, "right") - 1, minlength=len(texts))
        return self._literal_blanks(texts, words, total)

    def _literal_blanks(self, texts: pa.Array, words: Words, total: np.ndarray) -> np.ndarray:
        """Texts that hold the blank's own character, or white space that pieces hold,
        are counted as a whole."""
        odd = words.data == 0xE2
        for b in self.whole:
            odd |= words.data == b
        if odd.any():
            for i in np.unique(np.searchsorted(words.text_at, np.flatnonzero(odd), "right") - 1):
                text = texts[int(i)].as_py()
                if _BLANK in text or any(chr(b) in text for b in self.whole):
                    total[i] = self.count_strings([_BLANK + text.replace(" ", _BLANK)])[0]
        return total

    def _run(self, n: int) -> int:
        if n not in self.blank_runs:
            self.blank_runs[n] = int(self.count_strings([_BLANK * n])[0])
        return self.blank_runs[n]

    def _known(self, words: Words, keys: list[int], first: np.ndarray, blanks: np.ndarray) -> np.ndarray:
        if len(self.seen) > CACHE_WORDS:
            self.seen.clear()
        counts = [self.seen.get(k, -1) for k in keys]
        new = [i for i, c in enumerate(counts) if c < 0]
        if new:
            found = self.count_strings([_BLANK * int(blanks[first[i]]) + words.word(first[i]).decode() for i in new]).tolist()
            for i, c in zip(new, found, strict=True):
                counts[i] = self.seen[keys[i]] = c
        return np.array(counts)


@lru_cache(maxsize=2)
def piece_counter(path: str) -> PieceCounter:
    """One counter for each worker process."""
    return PieceCounter(path)


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, model_path: str, limit: int = 4096) -> DataFrame:
    """Counts the tokens of every whole text.

    Returns ``id_col, n_bytes, n_tokens, over_limit`` (``n_tokens > limit``), a row for
    each input row, repeated rows and null ids included.  A null text counts as empty:
    0 bytes, 0 tokens.  Other columns are not read.  An empty table gives no rows.
    ``model_path`` is a sentencepiece BPE model that each worker can open.
    """
    tune(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = piece_counter(model_path)
        for batch in batches:
            for part in slices(batch, text_col):
                texts = part.column(1)
                tokens = counter.count_texts(texts)
                size = np.diff(text_buffer(texts)[1])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(tokens, pa.int64()), pa.array(tokens > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return df.select(id_col, text_col).mapInArrow(count, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
