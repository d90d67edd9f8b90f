"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch holds the k smallest distinct hashes of a text's word shingles.  Sketches of
parts merge into the sketch of the whole, and estimate resemblance, containment and the
number of distinct shingles.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm.common import ngram_hashes, slices, split_words, tune

K = 128
SHINGLE = 5


def sketch_texts(texts: pa.Array, k: int = K, shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sketch of each text: words in lower case (A-Z); a text of fewer words than a
    shingle is one shingle, a text without words has an empty sketch."""
    words = split_words(texts, lower=True)
    grams, offs, out = ngram_hashes(words.hashes, shingle), words.offs.tolist(), []
    for a, b in zip(offs[:-1], offs[1:], strict=True):
        own = grams[a : b - shingle + 1] if b - a >= shingle else ngram_hashes(words.hashes[a:b], b - a) if b > a else grams[:0]
        if len(own) > 8 * k:
            few = np.unique(own[own <= np.partition(own, 4 * k)[4 * k]])
            out.append(few[:k] if len(few) >= k else np.unique(own)[:k])
        else:
            out.append(np.unique(own)[:k])
    return out


def to_string(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype(">u8").tobytes()).decode()


def from_string(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), ">u8").astype(np.uint64)


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """Sketch of both texts' shingles together."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity; exact for sets that fit into their sketches.  Two
    empty sets are alike, an empty and another one are not."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    every = np.sort(np.concatenate([a, b]))
    again = every[1:] == every[:-1]
    first = np.concatenate([[True], ~again])
    distinct = np.cumsum(first)
    return float((again & (distinct[1:] <= k)).sum() / min(k, distinct[-1]))


def distinct_shingles(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too."""
    alike, both = resemblance(a, b, k), distinct_shingles(merge(a, b, k), k)
    return min(1.0, alike * both / max(distinct_shingles(a, k), 1e-9)) if len(a) else 1.0


def ranges_of(df: DataFrame, column: str) -> tuple[list, bool]:
    """The smallest value of each of as many ranges of a column as there are shuffle partitions,
    found by Spark for any type with an order, and whether the column has nulls."""
    values = df.select(F.col(column).alias("value"))
    dealt = values.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col("value").asc_nulls_first())
    found = dealt.groupBy(F.spark_partition_id()).agg(F.min("value").alias("low"), F.max(F.col("value").isNull()).alias("nulls")).collect()
    return sorted(r["low"] for r in found if r["low"] is not None), any(r["nulls"] for r in found)


def in_sequence(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, text, range, tail``: rows in ascending order of id within ranges, each range a
    partition of its own and closed by a copy of the next range's first row (``tail`` 1); the
    last range is closed by the very first row.  Rows of one id are ordered by their
    text's hash, a null id comes first.  Only one id for each range passes through the
    driver; the texts are shuffled once."""
    spark = df.sparkSession
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    lows, nulls = ranges_of(docs, "id")
    bounds, n = lows[1:], max(1, len(lows))

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        missing = ids.isna().to_numpy()
        out = np.zeros(len(ids), np.int32)
        out[~missing] = [bisect.bisect_right(bounds, x) for x in ids[~missing].astype(object)] if not whole else np.searchsorted(np.array(bounds, np.int64), ids[~missing].astype(np.int64), "right")
        return pd.Series(out)

    whole = kind in ("tinyint", "smallint", "int", "bigint")
    firsts = [None if nulls else low for low in lows[:1]] + bounds if lows else [None]
    firsts_df = spark.createDataFrame([(k, first, (k - 1) % n) for k, first in enumerate(firsts)], f"range int, first {kind}, before int")
    marked = docs.withColumn("range", range_of("id"))
    own, tail = F.struct(F.col("range"), F.lit(0).alias("tail")), F.struct(F.col("before").alias("range"), F.lit(1).alias("tail"))
    copies = F.when(F.col("id").eqNullSafe(F.col("first")), F.array(own, tail)).otherwise(F.array(own))
    dealt = marked.join(F.broadcast(firsts_df), "range").select("id", "text", F.explode(copies).alias("to")).select("id", "text", "to.range", "to.tail")
    return dealt.repartitionById(n, "range").sortWithinPartitions("range", "tail", "id", F.xxhash64("text"))


def fingerprint_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Fingerprints each whole text and the text after an edit: its last quarter (floor
    of code points / 4) replaced by the first as many code points of the next document, or
    all of them, in ascending order of id; the last document takes the first one.

    Returns ``id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next``, a row for each input row: the estimated resemblance to the edited text and
    to the next document.  A null text counts as empty; empty texts and texts without words
    have an empty fingerprint, alike (1.0) to another empty one only.  Equal texts have
    equal fingerprints.  Rows that repeat an id follow each other in the order of their
    text's hash; a null id comes first.  Ids may have any type that has an order.  A single row
    is its own next one.  Other columns are not read; an empty table gives no rows.
    """
    tune(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def rows_out(run: list[tuple]) -> pa.RecordBatch:
        texts = [r[1] for r in run]
        edited = [t[: len(t) - len(t) // 4] + after[: len(t) // 4] for t, after in zip(texts[:-1], texts[1:], strict=True)]
        own = sketch_texts(pa.array(texts, pa.string()), k, shingle)
        changed = sketch_texts(pa.array(edited, pa.string()), k, shingle)
        emit = [i for i, r in enumerate(run[:-1]) if not r[3]]
        columns = [
            pa.array([run[i][0] for i in emit]), pa.array([len(texts[i]) for i in emit], pa.int64()), pa.array([hashlib.sha256(edited[i].encode()).hexdigest() for i in emit], pa.string()),
            pa.array([to_string(own[i]) for i in emit], pa.string()), pa.array([to_string(changed[i]) for i in emit], pa.string()),
            pa.array([resemblance(own[i], changed[i], k) for i in emit], pa.float64()), pa.array([resemblance(own[i], own[i + 1], k) for i in emit], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run: list[tuple] = []
        for batch in batches:
            for part in slices(batch, "text"):
                for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if run and run[-1][2] != row[2]:
                        if len(run) > 1:
                            yield rows_out(run)
                        run = []
                    run.append(row)
                if len(run) > 1:
                    yield rows_out(run)
                    run = run[-1:]
        if len(run) > 1:
            yield rows_out(run)

    return in_sequence(df, id_col, text_col).mapInArrow(edits, f"`{id_col}` {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
