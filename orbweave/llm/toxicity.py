"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  Each sentence has a logistic score over hashed words
and word beginnings, a document is toxic unless none of its sentences is (noisy-or), and
the weights are trained from document labels alone.  The sentence scores then tell where
the offence is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm.common import Words, mix, odd_numbers, release, slices, split_words, staged, tune

#: Most labelled documents of each class that the model is trained on, chosen by a hash of their id.
TRAIN_PER_CLASS = 6000
#: Most features that get a weight, those that tell the classes apart best.
MAX_FEATURES = 4096
#: A feature has to be this many times as frequent in one class as in the other.
LEAST_ODDS = 2.0
HASH_BITS = 20
#: Lengths in bytes of the word beginnings that are features beside the word.
BEGINNINGS = (4, 5, 6)

_BREAK = np.ones(256, bool)
for _low, _high in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _BREAK[_low:_high] = False
_END = np.zeros(256, bool)
_END[[10, 33, 46, 63]] = True  # sentences end at . ! ? and line ends


@dataclass
class Sentences:
    words: Words
    features: np.ndarray  #: words x features, hashed
    first: np.ndarray  #: index of each sentence's first word
    of_word: np.ndarray  #: sentence of each word
    doc: np.ndarray  #: text of each sentence


def sentences(texts: pa.Array) -> Sentences:
    """Sentences with words, and the features of their words (letters of any script and
    digits, A-Z in lower case)."""
    words = split_words(texts, lower=True, space=_BREAK)
    n = len(words.hashes)
    sizes = words.ends - words.starts
    columns = [words.hashes]
    mult, lower = odd_numbers(max(BEGINNINGS), 21), np.arange(256, dtype=np.uint64)
    lower[65:91] += np.uint64(32)
    partial = np.zeros(n, np.uint64)
    for j in range(max(BEGINNINGS)):
        inside = sizes > j
        at = np.minimum(words.starts + j, max(0, len(words.data) - 1))
        partial = partial + np.where(inside, (lower[words.data[at]] + np.uint64(1)) * mult[j], np.uint64(0)) if n else partial
        if j + 1 in BEGINNINGS:
            columns.append(mix(partial + np.uint64((j + 1) << 40)))
    features = (np.stack(columns, 1) >> np.uint64(64 - HASH_BITS)).astype(np.int32)
    doc = words.doc_of_word()
    breaks = np.cumsum(_END[words.data])[words.starts] if n else np.zeros(0, np.int64)
    new = np.ones(n, bool)
    new[1:] = (breaks[1:] != breaks[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return Sentences(words, features, first, np.cumsum(new) - 1, doc[first])


@dataclass
class Model:
    """Weights of the features that have one, and the bias of every sentence."""

    ids: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        dense = np.zeros(1 << HASH_BITS, np.float32)
        dense[self.ids] = self.weights
        return dense

    def score(self, texts: pa.Array, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray, Sentences]:
        """Scores of the documents and of their sentences; a text without words is one
        sentence without features."""
        own = sentences(texts)
        logit = self.bias + (np.add.reduceat(dense[own.features].sum(1, dtype=np.float64), own.first) if len(own.first) else np.zeros(0))
        clean = np.bincount(own.doc, -_softplus(logit), len(texts))
        clean[np.bincount(own.doc, minlength=len(texts)) == 0] = -_softplus(self.bias)
        return -np.expm1(clean), 1 / (1 + np.exp(-np.clip(logit, -60, 60))), own


def _softplus(x):
    return np.logaddexp(0, x)


def fit_noisy_or(toxic: np.ndarray, plain: np.ndarray, doc: np.ndarray, sentence: np.ndarray, feature: np.ndarray, n_features: int, rounds: int = 300, l2: float = 0.02, weights: tuple[float, float] = (1.0, 1.0)) -> tuple[np.ndarray, float]:
    """Weights and bias that maximise the likelihood of document labels under noisy-or.

    ``doc`` is the document of each sentence that has features, ``sentence`` and ``feature`` the places
    of their features, ``plain`` each document's number of sentences without any.  ``weights`` is
    what a clean and a toxic document count."""
    w, bias = np.zeros(n_features), -6.0
    moment, power = np.zeros(n_features + 1), np.zeros(n_features + 1)
    n = len(toxic)
    weight = np.asarray(weights)[toxic]
    for step in range(1, rounds + 1):
        z = bias + np.bincount(sentence, w[feature], len(doc))
        clean = np.bincount(doc, -_softplus(z), n) - plain * _softplus(bias)
        clean = np.minimum(clean, -1e-9)
        pull = np.where(toxic == 1, -1 / np.expm1(-clean), 1.0) * weight  # of the loss, on each sentence's -log(1 - p)
        dz = pull[doc] / (1 + np.exp(-z))
        dw = np.bincount(feature, dz[sentence], n_features) + l2 * w
        db = dz.sum() + (pull * plain).sum() / (1 + np.exp(-bias))
        grad = np.append(dw, db) / n
        moment = 0.9 * moment + 0.1 * grad
        power = 0.99 * power + 0.01 * grad**2
        move = 0.1 * (moment / (1 - 0.9**step)) / (np.sqrt(power / (1 - 0.99**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return w, float(bias)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *, per_class: int = TRAIN_PER_CLASS, max_features: int = MAX_FEATURES, least_odds: float = LEAST_ODDS) -> Model:
    """Trains on at most ``per_class`` labelled documents of each class, those with the
    smallest hash of their id.  Each counts for as many labelled documents of its class
    as the sample leaves out, so that the shares of the classes are those of all labels.

    At most ``max_features`` features get a weight, those that tell the classes apart best, of
    those at least ``least_odds`` times as frequent in one class as in the other.  Rows with a null id or label do not count, nor do labels
    without a document; of several labels of one id the largest does.
    Without a document of either class, every document is as likely as not to be scored 0.
    The feature counts come from Spark; the weights are fitted in one task, over the few
    features of this bounded sample."""
    tune(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).filter("id IS NOT NULL AND toxic IN (0, 1)").groupBy("id").agg(F.max("toxic").alias("toxic"))
    known = known.join(docs.select(F.col(id_col).alias("id")), "id", "left_semi")
    chosen = [known.filter(F.col("toxic") == c).orderBy(F.xxhash64("id"), "id").limit(per_class) for c in (0, 1)]
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen[0].union(chosen[1])), "id")
    sample = staged(sample.select("toxic", "text"), "toxicity-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << HASH_BITS), np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                own = sentences(part.column(1))
                doc = own.words.doc_of_word()
                pair = np.unique((doc[:, None].astype(np.int64) << HASH_BITS) | own.features)
                label = part.column(0).to_numpy()
                for c in (0, 1):
                    seen[c] += np.bincount(pair[label[pair >> HASH_BITS] == c] & ((1 << HASH_BITS) - 1), minlength=1 << HASH_BITS)
        ids = np.flatnonzero(seen.sum(0))
        release()
        for k in range(0, len(ids), 100_000):
            some = ids[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(seen[0, some]), pa.array(seen[1, some])], names=["id", "clean", "toxic"])

    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return Model(np.zeros(0, np.int64), np.zeros(0), -20.0)
    every = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    weights = tuple(max(1.0, every[c] / per_class) for c in (0, 1))
    seen = sample.mapInArrow(count, "id bigint, clean bigint, toxic bigint").groupBy("id").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    rate = lambda c: (F.col(c) + 0.5) / (totals[int(c == "toxic")] + 1.0)
    odds = F.log(rate("toxic")) - F.log(rate("clean"))
    tells = odds * odds / (1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    telling = seen.filter("clean + toxic >= 4").filter(F.abs(odds) >= np.log(least_odds))
    ids = np.array(sorted(r["id"] for r in telling.select("id", tells.alias("tells")).orderBy(F.desc("tells"), "id").limit(max_features).collect()), np.int64)
    place = np.full(1 << HASH_BITS, -1, np.int32)
    place[ids] = np.arange(len(ids))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                own = sentences(part.column(1))
                local = place[own.features]
                hit = local >= 0
                pair = np.unique(np.repeat(own.of_word, hit.sum(1)).astype(np.int64) << 32 | local[hit])
                bounds = np.searchsorted(own.doc[pair >> 32], np.arange(part.num_rows + 1))
                many = np.bincount(own.doc, minlength=part.num_rows)
                out = [pair[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.maximum(many, 1)), pa.array(out, pa.binary())], names=["toxic", "sentences", "pairs"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, plain, doc, sentence, feature = [], [], [], [], []
        for batch in batches:
            for label, many, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pair = np.frombuffer(raw, np.int64)
                own, inverse = np.unique(pair >> 32, return_inverse=True)
                sentence.append((inverse + len(doc)).astype(np.int32)), feature.append((pair & 0xFFFFFFFF).astype(np.int32))
                doc += [len(toxic)] * len(own)
                toxic.append(label), plain.append(many - len(own))
        if toxic:
            w, bias = fit_noisy_or(np.array(toxic), np.array(plain), np.array(doc, np.int64), np.concatenate(sentence), np.concatenate(feature), len(ids), weights=weights)
            del sentence, feature
            release()
            yield pa.RecordBatch.from_arrays([pa.array([w.tolist()], pa.list_(pa.float64())), pa.array([bias])], names=["w", "bias"])

    bags = sample.mapInArrow(reduce, "toxic int, sentences bigint, pairs binary")
    row = bags.repartition(1).mapInArrow(fit, "w array<double>, bias double").first()
    return Model(ids, np.array(row["w"]), row["bias"])


def score_documents(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score`` of every whole text, a row for each input row; null texts count
    as empty, and an empty text has the score of a sentence without features."""
    tune(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = model.table()
        for batch in batches:
            for part in slices(batch, text_col):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(part.column(1), dense)[0])], names=[id_col, "score"])

    return df.select(id_col, text_col).mapInArrow(score, f"`{id_col}` {kind}, score double")


def clean_documents(df: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows, with all columns, whose text scores under the threshold."""
    tune(df.sparkSession)
    place = df.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = model.table()
        for batch in batches:
            for part in slices(batch, text_col):
                yield part.filter(pa.array(model.score(part.column(place), dense)[0] < threshold))
        release()

    return df.mapInArrow(clean, df.schema)


def offending_sentences(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Sentences with a score of ``threshold`` or more: ``id_col, sentence, score, words``, the
    number of the sentence in its text from 0 and its text from first to last word."""
    tune(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = model.table()
        for batch in batches:
            for part in slices(batch, text_col):
                _, scores, own = model.score(part.column(1), dense)
                hits = np.flatnonzero(scores >= threshold)
                last = np.append(own.first[1:], len(own.of_word)) - 1
                start_of_doc = np.searchsorted(own.doc, np.arange(part.num_rows))
                data, words = own.words.data, own.words
                shown = [data[words.starts[own.first[s]] : words.ends[last[s]]].tobytes().decode() for s in hits]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(own.doc[hits])), pa.array(hits - start_of_doc[own.doc[hits]], pa.int64()), pa.array(scores[hits]), pa.array(shown, pa.string())], names=[id_col, "sentence", "score", "words"])

    return df.select(id_col, text_col).mapInArrow(locate, f"`{id_col}` {kind}, sentence bigint, score double, words string")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, per_class: int = TRAIN_PER_CLASS, max_features: int = MAX_FEATURES, least_odds: float = LEAST_ODDS) -> DataFrame:
    """Scores all documents with a model trained on labels outside the held-out fifth
    (crc32 of the id as text, modulo 5, is 0).

    Returns ``id_col, held_out, score, predicted`` (1 if the score is 0.5 or more), a row for
    each input row; a row with a null id is not held out.  An empty table gives no rows."""
    fold = lambda: F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))
    model = train(docs, labels.filter(~fold()), id_col, text_col, per_class=per_class, max_features=max_features, least_odds=least_odds)
    scored = score_documents(docs, model, id_col, text_col)
    return scored.select(id_col, fold().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
