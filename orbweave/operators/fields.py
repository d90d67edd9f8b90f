"""Grid fields by planes ``mol_id, ix, nz, vals``: a row is a plane of a molecule's grid, ``vals`` its values with z
running fastest, ``nz`` of them for each y."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.operators.molecules import afresh, as_arrays, stacked

PLANE = ["mol_id", "ix", "nz"]


def voxel_lattice(atoms: DataFrame, n: int, margin: float) -> DataFrame:
    """``mol_id, ix, x, ys, zs``: the planes of n points along each side of the molecule's box; the points of a
    plane are all pairs of its ``ys`` and ``zs``."""
    names = {"x": "x", "y": "y", "z": "z_c"}
    box = atoms.groupBy("mol_id").agg(*(f(c).alias(f"{k}_{s}") for k, c in names.items() for s, f in (("low", F.min), ("high", F.max))))
    steps = F.sequence(F.lit(0), F.lit(n - 1))
    at = lambda k, i: F.col(f"{k}_low") - margin + i * (F.col(f"{k}_high") - F.col(f"{k}_low") + 2 * margin) / max(1, n - 1)
    side = lambda k: F.transform(steps, lambda i: at(k, i)).alias(f"{k}s")
    box = box.select("mol_id", "x_low", "x_high", side("y"), side("z"))  # once for a molecule, not for each of its planes
    return box.withColumn("ix", F.explode(steps)).select("mol_id", "ix", at("x", F.col("ix")).alias("x"), "ys", "zs")


def voxels(planes: DataFrame) -> DataFrame:
    """A row for each point, ``ix, iy, iz, value``, with the planes' other columns."""
    rows = planes.select(*(c for c in planes.columns if c not in ("ix", "vals")), "ix", F.posexplode("vals").alias("place", "value"))
    return rows.withColumns({"iy": F.expr("CAST(place DIV nz AS INT)"), "iz": F.expr("CAST(place % nz AS INT)")}).drop("place", "nz")


def _kinds(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in names)


def _on_grid(orbitals: DataFrame, ao_planes: DataFrame, slabs: int, schema: str, values) -> DataFrame:
    """A molecule's planes are dealt into ``slabs`` parts, each of which meets the molecule's
    orbitals once; psi of a plane is one matrix product."""

    def product(planes: pa.Table, own: pa.Table) -> pa.Table:
        parts = []
        if planes.num_rows and own.num_rows:
            own = own.sort_by("k")
            c = stacked(own["coef"]).T
            for k in range(planes.num_rows):
                phi = planes["phi"][k].values.to_numpy(zero_copy_only=False)
                plane = planes.select(PLANE).slice(k, 1)
                parts.append(values(plane, own, phi.reshape(-1, len(c)) @ c))
        return pa.concat_tables(parts) if parts else pa.Table.from_batches([], empty)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    empty = to_arrow_schema(StructType.fromDDL(schema))
    own = orbitals.withColumn("slab", F.explode(F.sequence(F.lit(0), F.lit(slabs - 1))))
    dealt = ao_planes.select(*PLANE, "phi", F.pmod("ix", F.lit(slabs)).alias("slab"))
    return dealt.groupBy("mol_id", "slab").cogroup(afresh(own).groupBy("mol_id", "slab")).applyInArrow(product, schema)


def orbital_field(orbitals: DataFrame, ao_planes: DataFrame, slabs: int = 8) -> DataFrame:
    """``mol_id, ix, nz, k, vals``: sum of c_mu phi_mu(r).  phi on the grid is an input table of planes,
    ``mol_id, ix, nz, phi``: all orbitals' values at a point, one point after another."""

    def values(plane: pa.Table, own: pa.Table, psi: np.ndarray) -> pa.Table:
        n = own.num_rows
        return pa.table([*(pa.repeat(plane[c][0], n) for c in PLANE), own["k"].combine_chunks().cast(pa.int32()), as_arrays(psi.T)], names=[*PLANE, "k", "vals"])

    return _on_grid(orbitals.select("mol_id", F.col("k").cast("int").alias("k"), "coef"), ao_planes, slabs, _kinds(ao_planes, PLANE) + ", k int, vals array<double>", values)


def density_field(orbitals: DataFrame, ao_planes: DataFrame, slabs: int = 8) -> DataFrame:
    """``mol_id, ix, nz, vals``: sum of occ psi(r)^2 over the occupied orbitals, zero without any."""

    def values(plane: pa.Table, own: pa.Table, psi: np.ndarray) -> pa.Table:
        return plane.append_column("vals", as_arrays((psi**2 @ own["occ"].to_numpy())[None]))

    return _on_grid(orbitals.filter("occ > 0 OR k = 0").select("mol_id", "k", "occ", "coef"), ao_planes, slabs, _kinds(ao_planes, PLANE) + ", vals array<double>", values)


def difference_field(a: DataFrame, b: DataFrame, align_sign: bool = False) -> DataFrame:
    """a - b on the planes that both have; ``align_sign`` first turns b to a's sign, molecule by molecule.  A
    molecule's planes of both meet once."""

    def subtract(own: pa.Table, other: pa.Table) -> pa.Table:
        own, other = own.sort_by("ix"), other.sort_by("ix")
        _, i, j = np.intersect1d(own["ix"].to_numpy(), other["ix"].to_numpy(), return_indices=True)
        own, other = own.take(pa.array(i)), other.take(pa.array(j))
        if not len(i):
            return own.select([*PLANE, "vals"])
        x, y = stacked(own["vals"]), stacked(other["vals"])
        if align_sign and (x * y).sum() < 0:
            y = -y
        return own.select(PLANE).append_column("vals", as_arrays(x - y))

    own, other = (df.select(*PLANE, "vals") for df in (a, b))
    return own.groupBy("mol_id").cogroup(afresh(other).groupBy("mol_id")).applyInArrow(subtract, _kinds(a, PLANE) + ", vals array<double>")


def iso_select(field: DataFrame, iso: float) -> DataFrame:
    """``mol_id, ix, nz, lobe, places, vals``: of each plane the points of the positive and of the negative lobe, by
    their places in the plane, ``iy * nz + iz``; lobes without points are left out."""

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = np.asarray(batch.column(3).flatten()), np.asarray(batch.column(3).offsets)
            offsets = offsets - offsets[0]
            place = np.arange(len(flat)) - np.repeat(offsets[:-1], np.diff(offsets))
            for lobe, inside in (("pos", flat >= iso), ("neg", (flat <= -iso) & ~(flat >= iso))):
                ends = np.concatenate([[0], np.cumsum(inside)])[offsets]
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(own[inside], kind)) for own, kind in ((place, pa.int32()), (flat, pa.float64()))]
                out = pa.RecordBatch.from_arrays([*batch.columns[:3], pa.repeat(lobe, batch.num_rows), *lists], names=[*PLANE, "lobe", "places", "vals"])
                yield out.filter(pa.array(np.diff(ends) > 0))

    return field.select(*PLANE, "vals").mapInArrow(select, _kinds(field, PLANE) + ", lobe string, places array<int>, vals array<double>")


def iso_lobes(field: DataFrame, iso: float) -> DataFrame:
    """``mol_id, lobe, voxels, integral``."""
    lobes = iso_select(field, iso).select("mol_id", "lobe", F.size("vals").cast("long").alias("n"), F.aggregate("vals", F.lit(0.0), lambda s, x: s + x).alias("sum"))
    return lobes.groupBy("mol_id", "lobe").agg(F.sum("n").alias("voxels"), F.sum("sum").alias("integral"))


def field_extrema(field: DataFrame) -> DataFrame:
    """Minimum and maximum of each molecule with their places; of equal ones the minimum with
    the smallest place and the maximum with the largest."""
    point = lambda v, last: F.struct(v.alias("value"), F.col("ix"), F.expr(f"CAST({last} DIV nz AS INT)").alias("iy"), F.expr(f"CAST({last} % nz AS INT)").alias("iz"))
    planes = field.select("mol_id", "ix", "nz", F.array_min("vals").alias("low"), F.array_max("vals").alias("high"), "vals")
    planes = planes.withColumns({"first": F.array_position("vals", F.col("low")) - 1, "last": F.size("vals") - F.array_position(F.reverse("vals"), F.col("high"))})
    out = planes.groupBy("mol_id").agg(F.min(point(F.col("low"), "first")).alias("low"), F.max(point(F.col("high"), "last")).alias("high"))
    return out.select("mol_id", *(F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ("low", "high") for c in ("value", "ix", "iy", "iz")))
