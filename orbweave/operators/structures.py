"""Structures ``mol_id, atom, z, x, y, z_c``: records, indices, edges, accepted inputs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbweave.sources.files import shared_path


def fold_structures(atoms: DataFrame) -> DataFrame:
    """One row for each molecule: ``mol_id, numbers, positions``, as structure databases keep them."""
    own = F.array_sort(F.collect_list(F.struct("atom", "z", "x", "y", "z_c")))
    return atoms.groupBy("mol_id").agg(own.alias("a")).select("mol_id", F.transform("a", lambda e: e["z"]).alias("numbers"), F.transform("a", lambda e: F.array(e["x"], e["y"], e["z_c"])).alias("positions"))


def unfold_structures(structures: DataFrame) -> DataFrame:
    """``mol_id, atom, z, x, y, z_c`` of rows with numbers and positions."""
    rows = structures.select("mol_id", F.posexplode(F.arrays_zip("numbers", "positions")).alias("atom", "e"))
    return rows.select("mol_id", "atom", F.col("e.numbers").alias("z"), *(F.col("e.positions")[k].alias(c) for k, c in enumerate(("x", "y", "z_c"))))


def model_records(atoms: DataFrame) -> DataFrame:
    """Records that models read: ``idx, numbers, pos (float32), pbc, cell, nf``."""
    own = fold_structures(atoms)
    zero = F.array(*[F.lit(0.0).cast("float")] * 3)
    return own.select(F.col("mol_id").alias("idx"), "numbers", F.col("positions").cast("array<array<float>>").alias("pos"), F.array(*[F.lit(False)] * 3).alias("pbc"), F.array(zero, zero, zero).alias("cell"), F.lit(0).alias("nf"))


def untransform_types(df: DataFrame, type_map: DataFrame) -> DataFrame:
    """Adds the atomic number of each model type index; an unknown one has null."""
    return df.join(F.broadcast(type_map.select("type_idx", "z")), "type_idx", "left")


def downcast(df: DataFrame) -> DataFrame:
    """All floating columns, arrays of them too, as float32; others as they are."""

    def narrow(kind: T.DataType) -> T.DataType:
        if isinstance(kind, T.DoubleType):
            return T.FloatType()
        return T.ArrayType(narrow(kind.elementType), kind.containsNull) if isinstance(kind, T.ArrayType) else kind

    return df.select(*(F.col(f"`{f.name}`").cast(narrow(f.dataType)).alias(f.name) for f in df.schema.fields))


def _dealt(df: DataFrame, order: Column) -> DataFrame:
    """Rows dealt out by ranges, with the number of their range."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, order).withColumn("range of key", F.spark_partition_id())


def dense_index(df: DataFrame, key: str, name: str = "idx") -> DataFrame:
    """Adds each row's place in the order of a key of any type, from 0; null comes first.
    Rows of one key have places of their own, in no fixed order.

    Rows are dealt out by ranges of the key and written to the shared folder with the number of
    their range, however many files that makes; a range's rows are numbered by themselves and
    shifted by the sizes of the ranges before, so that no task sees more than its range and all of
    them see the same ranges."""
    spark = df.sparkSession
    path, order = shared_path(spark, "ranges"), F.col(f"`{key}`").asc_nulls_first()
    dealt = _dealt(df, order)
    dealt.write.parquet(path)
    marked = spark.read.schema(dealt.schema).parquet(path)
    sizes = marked.groupBy("range of key").agg(F.count("*").alias("n"))
    before = sizes.select("range of key", F.coalesce(F.sum("n").over(Window.orderBy("range of key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("rows before"))
    place = F.row_number().over(Window.partitionBy("range of key").orderBy(order)) - 1
    return marked.join(F.broadcast(before), "range of key").withColumn(name, (place + F.col("rows before")).cast("long")).drop("range of key", "rows before")  # a row for each range


def first_n(df: DataFrame, limit: int | None, index: str = "idx") -> DataFrame:
    """The first rows by dense index: None takes all, 0 none."""
    return df if limit is None else df.filter(F.col(index) < limit)


def split_accepted(smiles: DataFrame, structures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SMILES with a structure, and those without."""
    known = structures.select("mol_id").distinct().hint("shuffle_hash")  # held by each task, so that texts are not sorted
    return smiles.join(known, "mol_id", "left_semi"), smiles.join(known, "mol_id", "left_anti")


def ingest_counts(smiles: DataFrame, structures: DataFrame) -> DataFrame:
    """``status, n`` of accepted and rejected inputs."""
    kept, rejected = split_accepted(smiles, structures)
    return kept.select(F.lit("accepted").alias("status")).unionAll(rejected.select(F.lit("rejected").alias("status"))).groupBy("status").agg(F.count("*").alias("n"))


def cell_pairs(atoms: DataFrame, size: float) -> DataFrame:
    """Ordered pairs of atoms of a molecule that are in one cell of a cubic lattice or in neighbouring ones:
    all that are no further apart than ``size``, the cells' width, and few others."""
    names = ("x", "y", "z_c")
    cells = atoms.select("mol_id", "atom", "z", *names, *(F.floor(F.col(c) / size).alias(f"cell_{c}") for c in names))
    side = lambda s: [F.col(c).alias(f"{c}_{s}") for c in ("atom", "z", *names)]
    step = F.explode(F.array(*(F.struct(*(F.lit(d).alias(c) for c, d in zip(names, (i, j, k), strict=True))) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1))))
    near = cells.withColumn("step", step).select("mol_id", *((F.col(f"cell_{c}") + F.col(f"step.{c}")).alias(f"cell_{c}") for c in names), *side("i"))
    return near.join(cells.select("mol_id", *(f"cell_{c}" for c in names), *side("j")), ["mol_id", *(f"cell_{c}" for c in names)]).filter("atom_i != atom_j").drop(*(f"cell_{c}" for c in names))


def _near(mol: np.ndarray, place: np.ndarray, size: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ordered pairs of rows of one molecule in one cell or in neighbouring ones, cells ``size`` wide, by one of 27 steps at a time."""
    cell = np.floor(place / size).astype(np.int64)
    cell -= cell.min(0, initial=0) - 1
    wide = cell.max(0, initial=0) + 2
    key = ((mol * wide[0] + cell[:, 0]) * wide[1] + cell[:, 1]) * wide[2] + cell[:, 2]
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    for step in np.ndindex(3, 3, 3):
        there = key + ((step[0] - 1) * wide[1] + step[1] - 1) * wide[2] + step[2] - 1
        low, high = np.searchsorted(ordered, there, "left"), np.searchsorted(ordered, there, "right")
        n = high - low
        i = np.repeat(np.arange(len(key)), n)
        j = order[np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
        yield i[i != j], j[i != j]


def radius_edges(atoms: DataFrame, cutoffs: DataFrame, atoms_at_once: int = 20_000) -> DataFrame:
    """``mol_id, atom_i, atom_j, d2`` of atom pairs of a molecule within the cutoff of their
    elements; ``cutoffs(z_i, z_j, cutoff)``.  Only atoms of neighbouring cells, as wide as the largest
    cutoff, meet: work grows with the atoms, not with their square.

    The atoms of a molecule are one row, and its pairs are made in the task that has it, so that nothing but atoms is shuffled."""
    found = {(r.z_i, r.z_j): r.cutoff for r in cutoffs.select("z_i", "z_j", "cutoff").collect()}  # a small table of elements
    most = max((z for pair in found for z in pair), default=0) + 1
    table = np.full((most, most), -1.0)
    for pair, cutoff in found.items():
        table[pair] = cutoff
    widest = float(table.max(initial=-1.0))
    size = widest if widest > 0 else 1.0
    own = atoms.groupBy("mol_id").agg(F.collect_list(F.struct("atom", F.col("z").cast("int").alias("z"), *(F.col(c).cast("double").alias(c) for c in ("x", "y", "z_c")))).alias("a"))

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            many = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            part = (np.cumsum(many) - 1) // atoms_at_once
            for rows in np.split(np.arange(len(many)), np.flatnonzero(np.diff(part)) + 1):
                some = batch.slice(int(rows[0]), len(rows)) if len(rows) else batch.slice(0, 0)
                flat = some.column(1).flatten()
                atom, z, *place = (flat.field(k) for k in range(5))
                mol, z = np.repeat(np.arange(some.num_rows), many[rows]), z.to_numpy(zero_copy_only=False)
                place = np.stack([p.to_numpy(zero_copy_only=False) for p in place], 1)
                for i, j in _near(mol, place, size):
                    known = (z[i] < most) & (z[j] < most)
                    i, j = i[known], j[known]
                    apart, cutoff = place[i] - place[j], table[z[i], z[j]]
                    d2 = apart[:, 0] * apart[:, 0] + apart[:, 1] * apart[:, 1] + apart[:, 2] * apart[:, 2]
                    within = (cutoff >= 0) & (d2 <= cutoff * cutoff)
                    i, j = pa.array(i[within]), pa.array(j[within])
                    yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(mol).take(i)), atom.take(i), atom.take(j), pa.array(d2[within])], names=["mol_id", "atom_i", "atom_j", "d2"])

    kind = {f.name: f.dataType.simpleString() for f in atoms.schema.fields}
    return own.mapInArrow(edges, f"mol_id {kind['mol_id']}, atom_i {kind['atom']}, atom_j {kind['atom']}, d2 double")
