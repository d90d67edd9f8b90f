"""Atomic-orbital layout, basis conventions and permutations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbweave.functions.constants import ELEMENT_BLOCKS, SYMBOLS, convention_rows


def convention(spark: SparkSession, name: str) -> DataFrame:
    """The convention as a dimension table; an unknown name raises."""
    return spark.createDataFrame(convention_rows(name), "name string, z int, shell int, kind string, m int, src int, sign int")


def elements(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(SYMBOLS.items()), "z int, symbol string")


def element_blocks(spark: SparkSession) -> DataFrame:
    """``symbol, pos, idx``: index lists of the elements."""
    rows = [(s, k, i) for s, own in ELEMENT_BLOCKS.items() for k, i in enumerate(own)]
    return spark.createDataFrame(rows, "symbol string, pos int, idx int")


def symbols(atoms: DataFrame) -> DataFrame:
    """Adds each atom's element symbol; an element that is not in the table has null."""
    return atoms.join(F.broadcast(elements(atoms.sparkSession)), "z", "left")


def ao_layout(atoms: DataFrame, name: str) -> DataFrame:
    """``mol_id, pos, atom, shell, kind, m, src, sign``: a row for each atomic orbital.

    Orbitals follow each other by atom, shell and m.  ``pos`` is a running sum within the
    molecule, so molecules share no work and no order beyond their own."""
    rows = atoms.select("mol_id", "atom", "z").join(F.broadcast(convention(atoms.sparkSession, name)), "z")
    place = F.row_number().over(Window.partitionBy("mol_id").orderBy("atom", "shell", "m")) - 1
    return rows.select("mol_id", place.alias("pos"), "atom", "shell", "kind", "m", "src", "sign")


def ao_offsets(atoms: DataFrame, name: str) -> DataFrame:
    """``mol_id, atom, shell, ao_offset, size``: exclusive running sum of shell sizes."""
    sizes = convention(atoms.sparkSession, name).groupBy("z", "shell").agg(F.count("*").alias("size"))
    first = F.coalesce(F.sum("size").over(Window.partitionBy("z").orderBy("shell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shells = sizes.withColumn("first", first)
    rows = atoms.select("mol_id", "atom", "z").join(F.broadcast(sizes.groupBy("z").agg(F.sum("size").alias("all"))), "z")
    before = Window.partitionBy("mol_id").orderBy("atom").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("shift", F.coalesce(F.sum("all").over(before), F.lit(0))).join(F.broadcast(shells), "z")  # a row for each atom is sorted
    return rows.select("mol_id", "atom", "shell", (F.col("shift") + F.col("first")).alias("ao_offset"), "size")


def element_transform_index(atoms: DataFrame) -> DataFrame:
    """``mol_id, place, idx, atom``: element index lists, shifted by what the atoms before take."""
    blocks = element_blocks(atoms.sparkSession).groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("pos", "idx"))).alias("list"), (F.max("idx") + 1).alias("size"))
    own = symbols(atoms).select("mol_id", "atom", "symbol").join(F.broadcast(blocks.select("symbol", "size")), "symbol")
    before = Window.partitionBy("mol_id").orderBy("atom").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("shift", F.coalesce(F.sum("size").over(before), F.lit(0))).join(F.broadcast(blocks.select("symbol", "list")), "symbol")  # sorted without the lists
    return own.select("mol_id", "atom", "shift", F.explode("list").alias("e")).select("mol_id", (F.col("shift") + F.col("e.pos")).alias("place"), (F.col("shift") + F.col("e.idx")).alias("idx"), "atom")


def owners(ao: DataFrame) -> DataFrame:
    """``mol_id, owner``: the atom of each orbital as an array, for the column side."""
    return ao.groupBy("mol_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "atom"))), lambda e: e["atom"]).alias("owner"))


def permutation(ao: DataFrame) -> DataFrame:
    """``mol_id, pos, old_pos, sign``: which old orbital stands at each new place."""
    return ao.select("mol_id", "pos", (F.col("pos") - F.col("m") + F.col("src")).alias("old_pos"), "sign")


def permute_basis(matrix_rows: DataFrame, ao: DataFrame) -> DataFrame:
    """``new[r, c] = old[idx[r], idx[c]] * sign[r] * sign[c]``.

    Both sides of the permutation are arrays of the molecule, which meet its rows in one join on the
    molecule: a row finds its new place in one of them and gathers its entries by the other.  Rows
    that no new place takes are left out."""
    p = permutation(ao)
    ordered = lambda *names: F.array_sort(F.collect_list(F.struct(*names)))
    sides = p.groupBy("mol_id").agg(ordered("pos", "old_pos", "sign").alias("gather"), F.map_from_entries(F.collect_list(F.struct("old_pos", F.struct("pos", "sign").alias("to")))).alias("place"))
    rows = matrix_rows.join(sides, "mol_id").withColumn("to", F.try_element_at("place", F.col("i"))).filter("to IS NOT NULL")
    vals = F.transform("gather", lambda g: F.get(F.col("vals"), g["old_pos"]) * g["sign"] * F.col("to.sign"))
    return rows.select("mol_id", F.col("to.pos").alias("i"), vals.alias("vals"))
