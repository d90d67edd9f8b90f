"""Near-duplicate documents by min-max hashing.

Each permutation of a document's shingle hashes gives two signature values, its minimum
and its maximum, so half as many permutations are evaluated for a signature of the same
length.  Bands of the signature are buckets.  Documents of equal sets are one class.  Links
are decided on the full shingle sets: first between each bucket's smallest class and the
others, then, in buckets that this leaves in several components, between the classes outside
the bucket's largest component and the whole bucket, in blocks.  The work follows the sizes of
buckets, whatever chains of buckets they form.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm.common import HashFiles, hash_files, mix, ngram_hashes, odd_numbers, release, slices, split_words, staged, tune
from orbweave.llm.graph import components

#: Shingles in one block of the comparison inside buckets.
BLOCK_SHINGLES = 1 << 18


def shingle_sets(texts: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text: words in lower case, A-Z only; with
    fewer words, the whole sequence is one shingle; without words there is none."""
    words = split_words(texts, lower=True)
    offs = words.offs.tolist()
    grams = ngram_hashes(words.hashes, shingle)
    for a, b in zip(offs[:-1], offs[1:], strict=True):
        if b - a >= shingle:
            yield np.unique(grams[a : b - shingle + 1])
        else:
            yield ngram_hashes(words.hashes[a:b], b - a) if b > a else grams[:0]


def min_max_signature(hashes: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """16 bits of the minimum and of the maximum under each permutation, side by side."""
    low, high = np.full(len(multipliers), ~np.uint64(0)), np.zeros(len(multipliers), np.uint64)
    for k in range(0, len(hashes), 2048):
        turned = hashes[k : k + 2048, None] * multipliers
        np.minimum(low, turned.min(0), out=low)
        np.maximum(high, turned.max(0), out=high)
    return (mix(np.stack([low, high], 1).ravel()) >> np.uint64(48)).astype(np.uint16)


#: A class of documents with equal shingle sets: 126 bits of two sums of the set's hashes.
CLASS = pa.decimal128(38, 0)


def class_numbers(sets: list[np.ndarray]) -> pa.Array:
    halves = [(own.sum(dtype=np.uint64) >> np.uint64(2), np.bitwise_xor.reduce(mix(own))) if len(own) else (0, 0) for own in sets]
    both = np.array([(low, high) for high, low in halves], np.uint64).reshape(-1, 2)
    return pa.Array.from_buffers(CLASS, len(sets), [None, pa.py_buffer(both.tobytes())])


def sketches(df: DataFrame, id_col: str, text_col: str, shingle: int, permutations: int) -> DataFrame:
    """``id, n, node, sig``: a document's set size, its class, its signature."""
    kind = df.schema[id_col].dataType.simpleString()
    multipliers = odd_numbers(permutations, 11)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                sets = list(shingle_sets(part.column(1), shingle))
                sig = pa.array([min_max_signature(own, multipliers).tobytes() for own in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(own) for own in sets], pa.int64()), class_numbers(sets), sig], names=["id", "n", "node", "sig"])
        release()

    return df.select(id_col, text_col).mapInArrow(sketch, f"id {kind}, n bigint, node decimal(38,0), sig binary")


def full_sets(df: DataFrame, id_col: str, text_col: str, shingle: int, chosen: HashFiles) -> DataFrame:
    """``node, hashes``: class and whole shingle set, as sorted 64-bit numbers, of each document whose
    id's xxhash64 is chosen.  The texts are not shuffled for that."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(chosen.has(batch.column(1).to_numpy().view(np.uint64))))
            for part in slices(batch, text_col):
                own = list(shingle_sets(part.column(0), shingle))
                yield pa.RecordBatch.from_arrays([class_numbers(own), pa.array([s.tobytes() for s in own], pa.binary())], names=["node", "hashes"])

    return df.select(text_col, F.xxhash64(id_col).alias("hash of id")).mapInArrow(sets, "node decimal(38,0), hashes binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs ``u, v``, those whose full sets are alike enough."""
    left = sets.select(F.col("node").alias("u"), F.col("hashes").alias("hu"))
    right = sets.select(F.col("node").alias("v"), F.col("hashes").alias("hv"))
    joined = pairs.join(left, "u").join(right, "v")
    joined = joined.filter(100 * F.least(F.octet_length("hu"), F.octet_length("hv")) >= percent * F.greatest(F.octet_length("hu"), F.octet_length("hv")))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return joined.select("u", "v", "hu", "hv").mapInArrow(confirm, "u decimal(38,0), v decimal(38,0)")


def _prefix(counts: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """True for the rarest values of each set, as many as leave so few others that two sets without one of
    these in common are not alike enough; ``counts`` and then the values themselves give the order, the
    sets follow each other."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((np.arange(len(counts)), counts, owner))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return place < np.repeat(sizes - -(-percent * sizes // 100) + 1, sizes)


def _common(own: np.ndarray, values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many values of a set each of n sets has, whose values are sorted together."""
    low, high = np.searchsorted(values, own), np.searchsorted(values, own, "right")
    many = high - low
    at = np.repeat(high - np.cumsum(many), many) + np.arange(many.sum())
    return np.bincount(owner[at], minlength=n)


def _block_links(left: pd.DataFrame, right: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links between two blocks of a bucket, one for each pair of components.  A set is compared only
    if one of its rarest values is among the rarest of a set on the other side."""
    found = []
    if len(left) and len(right):
        sets, others = ([np.frombuffer(h, np.uint64) for h in side.hashes] for side in (left, right))
        sizes, other_sizes = (np.array([len(s) for s in side]) for side in (sets, others))
        flat, other_flat = np.concatenate(sets), np.concatenate(others)
        known, place, count = np.unique(np.concatenate([flat, other_flat]), return_inverse=True, return_counts=True)
        rare = np.zeros(len(known), bool)
        rare[place[: len(flat)][_prefix(count[place[: len(flat)]], sizes, percent)]] = True
        meets = rare[place[len(flat) :]] & _prefix(count[place[len(flat) :]], other_sizes, percent)
        compared = np.flatnonzero(np.bincount(np.repeat(np.arange(len(others)), other_sizes)[meets], minlength=len(others)))
        owner = np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(flat, kind="stable")
        values, owner = flat[order], owner[order]
        comp, other_comp = left.comp.to_numpy(), right.comp.to_numpy()
        for k in compared.tolist():
            both = _common(others[k], values, owner, len(sets))
            for x in np.flatnonzero((100 * both >= percent * (sizes + len(others[k]) - both)) & (comp != other_comp[k])):
                found.append((left.node.iloc[x], right.node.iloc[k], comp[x], other_comp[k]))
    out = pd.DataFrame(found, columns=["u", "v", "cu", "cv"])
    return out.drop_duplicates(["cu", "cv"])[["u", "v"]]


def _bucket_links(buckets: DataFrame, hubs: DataFrame, links: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that the hubs of the buckets left out: classes outside the largest component of
    their bucket against all of the bucket, block by block.  A hub settles a bucket of two;
    of buckets with the same members one is enough.

    Members are dealt into grades of set sizes, each 1 / percent as large as the one before; sets further
    apart than neighbouring grades differ too much in size to be linked, and never meet."""
    larger = hubs.filter("c > 2").groupBy("u", "c", "members").agg(F.min("bucket").alias("bucket")).select("bucket")
    comp = components(links, "linked")
    members = buckets.join(larger, "bucket", "left_semi").join(comp, "node", "left")
    wide = -math.log(percent / 100) * (1 + 1e-9)  # a little wider, so that no rounding tells apart what may be linked
    grade = F.floor(F.log(F.col("n").cast("double")) / wide) if percent < 100 else F.col("n")
    members = staged(members.select("bucket", "node", "n", F.xxhash64(F.coalesce("label", "node")).alias("comp"), grade.cast("long").alias("grade")), "members")
    by_comp = members.groupBy("bucket", "comp").agg(F.count("*").alias("many"))
    main = by_comp.groupBy("bucket").agg(F.max_by("comp", F.struct("many", "comp")).alias("main"), F.count("*").alias("comps")).filter("comps > 1").select("bucket", "main")
    by_grade = members.join(main, "bucket").groupBy("bucket", "grade").agg(F.any_value("main").alias("main"), F.sum("n").alias("size"), F.coalesce(F.sum(F.when(F.col("comp") != F.col("main"), F.col("n"))), F.lit(0)).alias("minor"))
    # A grade's minor members against all of its own and of the neighbouring grades.
    around = by_grade.select("bucket", "size", F.explode(F.array(*(F.col("grade") + d for d in (-1, 0, 1)))).alias("grade")).groupBy("bucket", "grade").agg(F.sum("size").alias("size"))
    parts = lambda size: (F.floor(F.col(size) / BLOCK_SHINGLES) + 1).cast("int")
    of_grade = by_grade.filter("minor > 0").select("bucket", "grade", "main", "minor").join(around, ["bucket", "grade"])
    of_grade = staged(of_grade.select("bucket", "grade", "main", parts("size").alias("all_parts"), parts("minor").alias("parts")), "grades")  # a table of its own, so that a bucket of many members can be split in the join
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys = ["bucket", "grade", "block", "part"]
    minor = members.join(of_grade, ["bucket", "grade"]).filter("comp != main").join(sets, "node").select("bucket", "grade", "node", "comp", "hashes", part("parts").alias("block"), each("all_parts").alias("part"))
    near = members.select("bucket", "node", "comp", F.explode(F.array(*(F.col("grade") + d for d in (-1, 0, 1)))).alias("grade"))
    every = near.join(of_grade, ["bucket", "grade"]).join(sets, "node").select("bucket", "grade", "node", "comp", "hashes", part("all_parts").alias("part"), each("parts").alias("block"))
    every = every.select(*(F.col(c).alias(c) for c in every.columns))  # attributes of its own for the cogroup
    return minor.groupBy(*keys).cogroup(every.groupBy(*keys)).applyInPandas(lambda x, y: _block_links(x, y, percent), "u decimal(38,0), v decimal(38,0)")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5, percent: int = 80, permutations: int = 64, rows: int = 5) -> DataFrame:
    """Groups documents whose shingle sets have a Jaccard similarity of ``percent`` or more.

    Returns ``id_col, n_shingles, component_id, kept``, a row for each input row:
    the size of the shingle set, the smallest id that links reach, and whether that is the
    row's own id.  Null and empty texts, and texts without words, have an empty set, are
    linked with nothing and kept; so are rows with a null id, whose component is null.
    Rows that repeat an id are documents of their own, each linked by its own text, so that
    they can be in several components.  Ids may have any type that has an order.  Other
    columns are not read; an empty table gives no rows.

    With the defaults, a pair at the threshold shares a bucket of 25 bands of 5 values with
    a probability over 0.9998 at 0.8 and 0.9999995 at 0.85; every link that is made is
    checked on the full sets.
    """
    tune(df.sparkSession)
    bands = 2 * permutations // rows
    all_rows = staged(sketches(df, id_col, text_col, shingle, permutations), "sketches")
    classes = staged(all_rows.filter("n > 0 AND id IS NOT NULL").groupBy("node").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig")), "classes")
    band = F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band")
    buckets = classes.select("node", "n", "sig", band).select("node", "n", F.xxhash64("band", F.expr(f"substring(sig, band * {2 * rows} + 1, {2 * rows})")).alias("bucket"))
    hubs = staged(buckets.groupBy("bucket").agg(F.min("node").alias("u"), F.count("*").alias("c"), F.bit_xor(F.xxhash64("node")).alias("members")).filter("c > 1"), "hubs")
    star = staged(buckets.join(hubs, "bucket").filter("node != u").select("u", F.col("node").alias("v")).distinct(), "star")
    nodes = star.select(F.col("u").alias("node")).union(star.select(F.col("v").alias("node"))).distinct()
    chosen = hash_files(classes.join(nodes, "node", "left_semi").select(F.xxhash64("id").alias("h")), "nodes")
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sets = full_sets(docs, "id", "text", shingle, chosen)
    sets = staged(sets.join(nodes, "node", "left_semi").dropDuplicates(["node"]), "sets")
    links = staged(_confirmed(star, sets, percent), "links")
    links = staged(links.union(_bucket_links(buckets, hubs, links, sets, percent)), "all-links")
    label = components(links, "labels")
    label = label.union(label.select(F.col("label").alias("node"), "label").distinct())
    of_class = staged(label.join(classes.select("node", "id"), "node"), "labelled")
    smallest = staged(of_class.groupBy("label").agg(F.min("id").alias("component_id")), "components")
    of_class = of_class.join(smallest, "label").select("node", "component_id")
    out = all_rows.select("id", "n", "node").join(classes.select("node", F.col("id").alias("least")).join(of_class, "node", "left"), "node", "left")
    own = F.when((F.col("n") == 0) | F.col("id").isNull(), F.col("id")).otherwise(F.coalesce("component_id", "least"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(own == F.col("id"), F.lit(True)).alias("kept"))
