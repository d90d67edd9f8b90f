"""Trie of the conversations' common beginnings.

A turn is known by a hash of its role and text, a prefix by two 64-bit sums of its turns' hashes, each
times a power of its place, so that prefixes are found by sums over sorted ranges of turns and no
conversation has to be in one task.  A count-min sketch of the prefixes then screens them: an estimate
of one proves that a prefix is in a single conversation, and so is all that follows, which gives its
nodes where it is.  Only prefixes that may be shared go through a shuffle and are grouped exactly.

What is summed over a subtree needs no walk through the trie.  Each node belongs to its smallest
member; a subtree's nodes are those that belong to members of its top, at the top's depth or
below.  So a running sum within each conversation and one grouping by prefix do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbweave.llm.common import fresh_dir, mapped, mix, odd_numbers, staged, tune, write_arrays

#: Rows of the sketch, cells of a row for each prefix, and the most cells of a row.
ROWS, CELLS, MOST_CELLS = 3, 4, 1 << 30
#: Bits that number the cells of a file of the sketch.
BLOCK_BITS = 23
#: Conversations of a part of a node's list of ends are those that agree but for these last bits.
CHUNK_BITS = 12
#: Bits that number the depths of a block.
BLOCK_OF_DEPTHS = 16

_U = np.uint64
_BASE = odd_numbers(2, 21)
_SEED = odd_numbers(ROWS, 22)
_EMPTY = hashlib.sha256(b"").hexdigest()


def turn_digests(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, turn, said, words``: of each turn the first half of the SHA-256 of ``n:role text``, n the
    role's length, and the number of words of its text; null counts as empty.  Rows without a conversation
    are left out.  Texts go no further than this."""
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role_col, text_col))
    said = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return df.select(F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), said.alias("said"), words.alias("words")).filter("conv_id IS NOT NULL")


def _powers(exponents: np.ndarray) -> np.ndarray:
    """Both bases to some powers, a row each."""
    out, square, left = np.ones((2, len(exponents)), _U), _BASE[:, None].copy(), exponents.astype(np.int64)
    while left.any():
        out = np.where(left & 1, out * square, out)
        square, left = square * square, left >> 1
    return out


def _halves(said: pa.Array) -> np.ndarray:
    """The hashes as two rows of numbers."""
    raw = np.frombuffer(said.buffers()[2], np.uint8)[16 * said.offset : 16 * (said.offset + len(said))] if len(said) else np.zeros(0, np.uint8)
    return raw.view(">u8").astype(_U).reshape(-1, 2).T


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


_PREFIX = "conv_id bigint, depth bigint, p1 bigint, p2 bigint, q1 bigint, q2 bigint, said binary, words bigint, is_end boolean"


def prefixes(turns: DataFrame) -> DataFrame:
    """``conv_id, depth, p1, p2, q1, q2, said, words, is_end`` of each turn of turn_digests(): its place in its
    conversation from 1, by ``turn`` with null first, turns of one number by their hashes; the sums of the
    prefix that it ends and of that before it; and whether it is the last.

    Turns are sorted in ranges, so that the turns of a long conversation may lie in several; a row for each
    range, not each conversation, goes through the driver to add what the ranges before have."""
    spark = turns.sparkSession
    tune(spark)
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("said")]
    dealt = turns.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count, sums = None, 0, np.zeros(2, _U)  # of the conversation that the last batch ended in
        waiting, names = None, [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            conv = np.asarray(batch.column(0))
            if not len(conv):
                continue
            head = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
            size = np.diff(np.append(head, len(conv)))
            goes_on = last == conv[0]
            if waiting:
                waiting[-1][-1] = not goes_on
                yield pa.RecordBatch.from_arrays([*waiting[:-1], pa.array(waiting[-1])], names=names)
            place = np.arange(1, len(conv) + 1) - np.repeat(head, size)
            if goes_on:
                place[: size[0]] += count
            terms = _halves(batch.column(1)) * _powers(place)
            before = np.cumsum(terms, axis=1) - terms
            before -= np.repeat(before[:, head], size, axis=1)
            if goes_on:
                before[:, : size[0]] += sums[:, None]
            after = before + terms
            last, count, sums = conv[-1], int(place[-1]), after[:, -1]
            waiting = [batch.column(0), pa.array(place), *map(_signed, (*after, *before)), batch.column(1), batch.column(2), batch.column(3), np.append(conv[1:] != conv[:-1], True)]
        if waiting:
            yield pa.RecordBatch.from_arrays([*waiting[:-1], pa.array(waiting[-1])], names=names)

    schema = _PREFIX.replace("is_end", "range int, is_end")
    local = staged(dealt.select("conv_id", "said", "words", F.spark_partition_id().alias("range")).mapInArrow(chain, schema), "turns")
    end = F.max_by(F.struct("conv_id", "depth", "p1", "p2"), F.struct("conv_id", "depth"))
    ranges = sorted(local.groupBy("range").agg(F.min("conv_id").alias("first"), end.alias("end")).collect())
    carried: dict[int, tuple[int, int, int, int]] = {}  # by range: its first conversation, and what the ranges before have of it
    opened: set[int] = set()  # ranges whose last conversation goes on
    conv, count, sums = None, 0, np.zeros(2, _U)
    for k, (number, first, end) in enumerate(ranges):
        if k and first == ranges[k - 1]["end"]["conv_id"]:
            opened.add(ranges[k - 1]["range"])
            carried[number] = (first, count, int(sums[0]), int(sums[1]))
        if end["conv_id"] != conv:
            conv, count, sums = end["conv_id"], 0, np.zeros(2, _U)
        own = np.array([end["p1"], end["p2"]], np.int64).view(_U)
        sums = sums + own * _powers(np.array([count]))[:, 0]
        count += end["depth"]
    ends = {r["range"]: (r["end"]["conv_id"], r["end"]["depth"]) for r in ranges}

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv, depth, number, is_end = (np.array(batch.column(k)) for k in (0, 1, 8, 9))
            sums = np.stack([np.array(batch.column(k)).view(_U) for k in (2, 3, 4, 5)])
            for r in np.unique(number).tolist():
                if r in opened:
                    is_end[(number == r) & (conv == ends[r][0]) & (depth == ends[r][1])] = False
                if r in carried:
                    first, count, *more = carried[r]
                    own = np.flatnonzero((number == r) & (conv == first))
                    depth[own] += count
                    sums[:, own] = sums[:, own] * np.tile(_powers(np.array([count])), (2, 1)) + np.array(more * 2, _U)[:, None]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(depth), *map(_signed, sums), batch.column(6), batch.column(7), pa.array(is_end)], names=[c.split()[0] for c in _PREFIX.split(", ")])

    return local.mapInArrow(whole, _PREFIX)


def _cells(p: np.ndarray, width: int) -> np.ndarray:
    """The cell of each prefix in each row of the sketch, the rows one after another."""
    return np.stack([(mix(p[0] * seed + p[1]) % _U(width)).astype(np.int64) + k * width for k, seed in enumerate(_SEED)])


class Sketch:
    """Which cells of the count-min sketch count two prefixes or more, a bit each, in files of the shared
    folder; a prefix with a cell that does not is in one conversation alone."""

    def __init__(self, turns: DataFrame):
        n = turns.count()
        self.width = width = min(max(CELLS * n, 1 << 10), MOST_CELLS)
        folder = fresh_dir(turns.sparkSession, "sketch")

        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = _cells(np.stack([np.array(c).view(_U) for c in batch.columns]), width)
                yield pa.RecordBatch.from_arrays([pa.array(own.ravel())], names=["cell"])

        def write(rows: pa.Table) -> pa.Table:
            bits = np.zeros(1 << BLOCK_BITS, bool)
            bits[rows["cell"].to_numpy() & (1 << BLOCK_BITS) - 1] = True
            ((_, uri, _, _),) = write_arrays(folder, {"cells": np.packbits(bits, bitorder="little")})
            return pa.table({"block": rows["block"][:1], "uri": [uri]})

        counted = turns.select("p1", "p2").mapInArrow(cells, "cell bigint").groupBy("cell").agg(F.count("*").alias("n"))
        shared = counted.filter("n > 1").select(F.shiftright("cell", BLOCK_BITS).alias("block"), "cell")
        #: At most ROWS * MOST_CELLS / 2 ** BLOCK_BITS files, 384.
        self.files = {r["block"]: r["uri"] for r in shared.groupBy("block").applyInArrow(write, "block bigint, uri string").collect()}

    def may_be_shared(self, p: np.ndarray) -> np.ndarray:
        out = np.ones(p.shape[1], bool)
        for cells in _cells(p, self.width):
            left = np.flatnonzero(out)
            block, bit = cells[left] >> BLOCK_BITS, cells[left] & (1 << BLOCK_BITS) - 1
            found = np.zeros(len(left), bool)
            for b in np.unique(block).tolist():
                if b in self.files:
                    own = block == b
                    found[own] = mapped(self.files[b], "u1", 1 << BLOCK_BITS - 3)[bit[own] >> 3] >> (bit[own] & 7).astype(np.uint8) & 1
            out[left] = found
        return out


def screened(turns: DataFrame, sketch: Sketch) -> DataFrame:
    """Adds ``tail``, true for prefixes that the sketch proves to be in one conversation and all that
    follow them, and ``top`` where the prefix before is not known to be such."""

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_before, depth_before, tail_before = None, 0, False
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, depth = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            alone = ~sketch.may_be_shared(np.stack([np.array(batch.column(k)).view(_U) for k in (2, 3)]))
            head = np.concatenate([[True], (conv[1:] != conv[:-1]) | (depth[1:] != depth[:-1] + 1)])
            goes_on = conv_before == conv[0] and depth_before + 1 == depth[0]
            run = np.cumsum(head) - 1
            first = np.flatnonzero(head)
            so_far = np.cumsum(alone)
            tail = so_far - (so_far - alone)[first][run] > 0
            if goes_on and tail_before:
                tail[run == 0] = True
            top = np.concatenate([[not (goes_on and tail_before)], head[1:] | ~tail[:-1]])
            conv_before, depth_before, tail_before = conv[-1], depth[-1], bool(tail[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tail), pa.array(top)], names=[*batch.schema.names, "tail", "top"])

    return turns.mapInArrow(screen, _PREFIX + ", tail boolean, top boolean")


def _ends(rows: DataFrame) -> DataFrame:
    """``p1, p2, ends_sha256`` of the conversations that end with each prefix.  Their ids are sorted in parts of near
    ids; a task that has all parts of a prefix reads them in order and keeps no more than one."""
    parts = rows.groupBy("p1", "p2", F.shiftright("conv_id", CHUNK_BITS).alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for batch in batches:
            out = []
            for p1, p2, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
                if now != (p1, p2):
                    if now:
                        out.append((*now, sha.hexdigest()))
                    now, sha = (p1, p2), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield rows_of(out)
        if now:
            yield rows_of([(*now, sha.hexdigest())])

    def rows_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["p1", "p2", "ends_sha256"])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.repartition(n, "p1", "p2").sortWithinPartitions("p1", "p2", "part").mapInArrow(join, "p1 bigint, p2 bigint, ends_sha256 string")


def prefix_trie(turns: DataFrame, conv_ids: DataFrame | None = None) -> DataFrame:
    """The trie of the conversations whose turns turn_digests() gives, and of those of ``conv_ids`` (one column), which
    may have none.

    Returns ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``, a row for each
    distinct sequence of first turns, from that of no turns on: its smallest member, number of turns, its parent's
    smallest member (null at the root), members, children, childless nodes of its subtree, words that members
    share with a smaller one below (each node's members but one times the words of its last turn), and the hash of
    its members of no further turns, ascending, joined by commas.

    Null roles and texts count as empty, turns without number come first, turns of one number are ordered by
    their hashes; rows without conversation are left out.  Without any conversation there is no row."""
    known = staged(prefixes(turns), "prefixes")
    rows = staged(screened(known, Sketch(known)), "screened")
    lone = rows.filter("tail AND top").select("conv_id", "q1", "q2")
    zero, long = F.lit(0).cast("long"), lambda name: F.col(name).cast("long").alias(name)
    # Each conversation is a member of the root: the empty prefix, with sums of zero.
    every = known.filter("depth = 1").select("conv_id", F.lit(True).alias("has_turns"))
    if conv_ids is not None:
        named = conv_ids.select(F.col(f"`{conv_ids.columns[0]}`").cast("long").alias("conv_id"), F.lit(False)).filter("conv_id IS NOT NULL")
        every = every.unionAll(named).groupBy("conv_id").agg(F.max("has_turns").alias("has_turns"))
    root = every.select("conv_id", zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), *(F.lit(None).cast("long").alias(c) for c in ("q1", "q2")), zero.alias("words"), (~F.col("has_turns")).alias("is_end"))
    shared = staged(root.unionAll(rows.filter("NOT tail").select(root.columns)), "shared")
    nodes = staged(shared.groupBy("p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *(F.any_value(c).alias(c) for c in ("depth", "q1", "q2", "words"))), "nodes")
    parents = nodes.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    below = nodes.select("q1", "q2").unionAll(lone.select("q1", "q2")).filter("q1 IS NOT NULL")
    children = below.groupBy(F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["p1", "p2"], "left").withColumn("n_children", F.coalesce("n_children", zero))
    # What each conversation's own nodes have, then sums of it from each depth on: within blocks of
    # depths first, so that a very long conversation is not one task's.
    own = nodes.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    placed = shared.select("conv_id", "depth", "p1", "p2", F.shiftright("depth", BLOCK_OF_DEPTHS).alias("block")).join(own, ["conv_id", "depth"], "left")
    from_here = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth"))
    behind = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = placed.groupBy("conv_id", "block").agg(F.sum("saved").alias("s"), F.sum("leaf").alias("l"))
    blocks = blocks.select("conv_id", "block", *(F.coalesce(F.sum(c).over(behind), zero).alias(f"{c}_behind") for c in "sl"))
    tails = lone.groupBy("conv_id").agg(F.lit(1).cast("long").alias("in_tail"))
    sums = placed.select("p1", "p2", "conv_id", "block", *(F.coalesce(F.sum(c).over(from_here), zero).alias(c) for c in ("saved", "leaf")))
    sums = sums.join(blocks, ["conv_id", "block"]).join(tails, "conv_id", "left")
    leaf = F.greatest(F.col("leaf") + F.col("l_behind"), F.coalesce("in_tail", zero))  # a conversation is the smallest member of one leaf at most
    sums = sums.groupBy("p1", "p2").agg(F.sum(F.col("saved") + F.col("s_behind")).alias("saved_tokens"), F.sum(leaf).alias("n_leaves"))
    nodes = nodes.join(sums, ["p1", "p2"]).join(_ends(shared.filter("is_end")), ["p1", "p2"], "left").join(parents, ["q1", "q2"], "left")
    parent = F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "conv_id"))  # a parent that is no node here is in a tail of the same conversation
    out = nodes.select("conv_id", "depth", parent.alias("parent_conv_id"), *map(long, ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))
    one = F.lit(1).cast("long")
    ends = F.when(F.col("is_end"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(_EMPTY)
    single = lambda df, above: df.select("conv_id", "depth", above.alias("parent_conv_id"), one.alias("n_convs"), F.when(F.col("is_end"), zero).otherwise(one).alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"), ends.alias("ends_sha256"))
    tops = rows.filter("tail AND top").join(parents, ["q1", "q2"], "left")
    return out.unionAll(single(tops, F.coalesce("parent_conv_id", "conv_id"))).unionAll(single(rows.filter("tail AND NOT top"), F.col("conv_id")))


def with_common_starts(turns: DataFrame, group: int = 20, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt as if branched off others: of conversation c, its first h turns, h the CRC-32 of
    its decimal number mod (most + 1), are those of conversation c - c % group (all if that has fewer, none
    if it is absent); its own turns after the first h follow.  Takes and gives rows of turn_digests(); the second
    result are all conversations, as some have no turn left."""
    placed = staged(prefixes(turns).select("conv_id", "depth", "said", "words"), "placed")
    ids = placed.filter("depth = 1").select("conv_id", (F.crc32(F.col("conv_id").cast("string")) % (most + 1)).alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    first = placed.filter(F.col("depth") <= most).withColumnRenamed("conv_id", "base")
    taken = ids.join(first, "base").filter("depth <= h").select("conv_id", F.col("depth").alias("turn"), "said", "words")
    own = placed.join(ids, "conv_id").filter("depth > h").select("conv_id", F.col("depth").alias("turn"), "said", "words")
    return taken.unionAll(own), ids.select("conv_id")
