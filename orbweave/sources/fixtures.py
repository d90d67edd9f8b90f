"""Molecule tables derived from the order tables, for queries and tests: every order is a
molecule, every line item an atom.

All arithmetic is on whole numbers with a last division by a power of two, so sums are exact
in any order.  The formulas are SQL text that Spark and DuckDB both read; those of arrays,
which stand for the matrix files of a run, are also numpy functions, applied in the tasks
that would read those files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbweave.operators.basis import ao_layout, convention
from orbweave.operators.folders import orbital_count
from orbweave.operators.structures import fold_structures

#: Factors of the matrix and orbital formulas, by source.
HAMILTONIAN = {"pred": (31, 17, 13, 7), "ref": (29, 19, 11, 5), "label": (23, 11, 7, 3)}
COEFFICIENT = {"pred": (13, 23, 41), "ref": (17, 29, 37)}
ENERGY = {"pred": (5, 3), "ref": (3, 5)}
VOXEL = {"pred": (7, 11, 13), "ref": (5, 3, 17)}
GRID = 8


def hamiltonian(source: str, i: str = "i", j: str = "j") -> str:
    a, b, c, d = HAMILTONIAN[source]
    return f"CAST((mol_id * {a} + (least({i}, {j}) * {b} + greatest({i}, {j}) * {c}) * {d}) % 257 - 128 AS DOUBLE) / 1024"


def overlap(i: str = "i", j: str = "j") -> str:
    return f"CASE WHEN {i} = {j} THEN CAST(1 AS DOUBLE) ELSE CAST((mol_id * 7 + least({i}, {j}) * 3 + greatest({i}, {j}) * 5) % 9 - 4 AS DOUBLE) / 1024 END"


def coefficient(source: str, i: str = "i", k: str = "k") -> str:
    a, b, c = COEFFICIENT[source]
    return f"CAST((mol_id * {a} + {i} * {b} + {k} * {c}) % 127 - 63 AS DOUBLE) / 64"


def energy(source: str) -> str:
    a, b = ENERGY[source]
    return f"CAST(k * 8 + (mol_id * {a} + k * {b}) % 7 AS DOUBLE) / 64 - 10"


def cross_overlap() -> str:
    return "CAST((mol_id * 3 + mu * 7 + nu * 11) % 33 - 16 AS DOUBLE) / 32"


def dipole_integral(axis: int) -> str:
    return f"CAST((mol_id + least(i, j) * 5 + greatest(i, j) * 3 + {axis * 7}) % 65 - 32 AS DOUBLE) / 64"


def voxel(field: str) -> str:
    a, b, c = VOXEL[field]
    return f"CAST((mol_id + ix * {a} + iy * {b} + iz * {c}) % 41 - 20 AS DOUBLE) / 256"


def ao_value() -> str:
    return "CAST((ix * 3 + iy * 5 + iz * 7 + mu * 11) % 17 - 8 AS DOUBLE) / 16"


# The same formulas for arrays: of a row's columns and the place j in its array.


def _periodic(period: int, middle: int, scale: int) -> Callable:
    """``((x + y) % period - middle) / scale``.  x is one number a molecule, y the same for all molecules of one size, so that the sum of
    their remainders is all that is made for each entry, and its value is looked up."""
    table = (np.arange(2 * period) % period - middle) / scale
    return lambda x, y: np.take(table, x % period + y % period)


def _hamiltonian(source: str) -> Callable:
    a, b, c, d = HAMILTONIAN[source]
    value = _periodic(257, 128, 1024)
    return lambda r, j: value(r["mol_id"] * a, (np.minimum(r["i"], j) * b + np.maximum(r["i"], j) * c) * d)


#: Entries of the overlap by the sum of two remainders, then ones for the diagonal.
_OVERLAP = np.concatenate([(np.arange(18) % 9 - 4) / 1024, np.ones(9)])


def _overlap(r, j):
    place = np.where(r["i"] == j, 18, (np.minimum(r["i"], j) * 3 + np.maximum(r["i"], j) * 5) % 9)
    return np.take(_OVERLAP, r["mol_id"] * 7 % 9 + place)


def _coefficient(source: str) -> Callable:
    a, b, c = COEFFICIENT[source]
    value = _periodic(127, 63, 64)
    return lambda r, j: value(r["mol_id"] * a, j * b + r["k"] * c)


def _dipole_integral(axis: int) -> Callable:
    value = _periodic(65, 32, 64)
    return lambda r, j: value(r["mol_id"], np.minimum(r["i"], j) * 5 + np.maximum(r["i"], j) * 3 + axis * 7)


def _energy(source: str) -> Callable:
    a, b = ENERGY[source]
    return lambda r, j: (r["k"] * 8 + (r["mol_id"] * a + r["k"] * b) % 7) / 64 - 10


def _identity(r, j):
    return (r["i"] == j) * 1.0


def _cross_overlap(r, j):
    return _CROSS(r["mol_id"] * 3, j * 7 + r["nu"] * 11)


_CROSS = _periodic(33, 16, 32)


def _voxel(field: str, n: int) -> Callable:
    a, b, c = VOXEL[field]
    value = _periodic(41, 20, 256)
    return lambda r, j: value(r["mol_id"], r["ix"] * a + j // n * b + j % n * c)


def _ao_value(n: int) -> Callable:
    return lambda r, j: ((r["point"] // (n * n) * 3 + r["point"] // n % n * 5 + r["point"] % n * 7 + j * 11) % 17 - 8) / 16


#: What tasks read from a molecule's folder, by name.
READ = (
    {s: _hamiltonian(s) for s in HAMILTONIAN} | {"overlap": _overlap, "identity": _identity, "cross": _cross_overlap}
    | {f"coef_{s}": _coefficient(s) for s in COEFFICIENT} | {f"eps_{s}": _energy(s) for s in ENERGY}
    | {f"r{c}": _dipole_integral(k) for k, c in enumerate("xyz")} | {f"voxels_{s}": _voxel(s, GRID) for s in VOXEL} | {"phi": _ao_value(GRID)}
)


def reading(**sources: str) -> dict[str, Callable]:
    return {name: READ[source] for name, source in sources.items()}


def read_blocks(mol_id: np.ndarray, places: list[tuple[int, int]]) -> Iterator[tuple[int, int, bool, np.ndarray]]:
    """The blocks of Fixtures.blocks(), of molecules whose atoms' orbitals are at the same places: ``a, b``, whether it hops, and its values."""
    i, j = np.indices((sum(size for _, size in places),) * 2)
    mol = mol_id.astype(np.int64)[:, None, None]
    matrix, image = _hamiltonian("pred")({"mol_id": mol, "i": i}, j), ((mol + i * 3 + j * 5) % 17 - 8) / 1024
    for a, (p, rows) in enumerate(places):
        for b, (q, columns) in enumerate(places[a:], a):
            own, moved = (x[:, p : p + rows, q : q + columns] for x in (matrix, image))
            if a == b:
                yield a, b, False, own - moved - moved.transpose(0, 2, 1)
                yield a, b, True, moved
            else:
                yield a, b, True, own - 2 * moved
                yield a, b, True, moved
                yield a, b, True, moved


#: All Hamiltonians and the overlaps: name, source and kind.
MATRICES = {f"{s}_ham": (s, "ham") for s in HAMILTONIAN} | {"ref_overlap": ("ref", "overlap")}


def reading_matrices() -> dict[str, Callable]:
    return reading(**{name: source if kind == "ham" else kind for name, (source, kind) in MATRICES.items()})


def with_arrays(rows: DataFrame, arrays: dict[str, Callable], rows_at_once: int = 2000) -> DataFrame:
    """The rows with an array of n values for each formula, in place of their column ``n``.  Those that are not asked
    for are not made, and rows that were dealt out by molecule stay so."""
    kept = [c for c in rows.columns if c != "n"]
    used = [c for c in kept if rows.schema[c].dataType.typeName() in ("integer", "long")]

    def array(f: Callable):
        def fill(*columns: pa.Array) -> pa.Array:
            *whole, lengths = (np.asarray(c, np.int64) for c in columns)
            parts = []
            for low in range(0, max(1, len(lengths)), rows_at_once):  # arrays of a part stay in the processor's cache
                n = lengths[low : low + rows_at_once]
                offsets = np.concatenate([[0], np.cumsum(n)])
                j = np.arange(offsets[-1]) - np.repeat(offsets[:-1], n)
                own = {c: np.repeat(x[low : low + rows_at_once], n) for c, x in zip(used, whole, strict=True)}
                parts.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(f(own, j), pa.float64())))
            return pa.concat_arrays(parts)

        return F.arrow_udf(fill, "array<double>")(*used, "n")

    return rows.select(*kept, *(array(f).alias(name) for name, f in arrays.items()))


class Fixtures:
    """The derived tables of one scale factor."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def atoms(self, by_number: bool = False) -> DataFrame:
        """``by_number`` deals them out as many times as there are shuffle partitions, however few they are."""
        order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
        rows = self.table("lineitem").select(F.col("l_orderkey").alias("mol_id"), *order)  # named first, so that the rows are known to be dealt out by molecule
        rows = rows.repartition(self._tasks(), "mol_id") if by_number else rows
        return rows.select(
            "mol_id", (F.row_number().over(Window.partitionBy("mol_id").orderBy(*order)) - 1).alias("atom"), F.expr("element_at(array(1, 1, 6, 8, 7, 9, 3), CAST(l_partkey % 7 AS INT) + 1)").alias("z"),
            F.expr("CAST(l_suppkey % 16 AS DOUBLE) / 4").alias("x"), F.expr("CAST(l_partkey % 16 AS DOUBLE) / 4").alias("y"), F.expr("CAST(l_linenumber * 3 % 16 AS DOUBLE) / 4").alias("z_c"),
        )

    def _tasks(self) -> int:
        return int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def molecules(self) -> DataFrame:
        return self.table("orders").select(F.col("o_orderkey").alias("mol_id"), F.concat(F.lit("C"), F.col("o_orderkey").cast("string")).alias("smile"), F.expr("CAST(o_orderkey % 3 - 1 AS INT)").alias("charge"))

    def ao(self, convention: str = "back2pyscf") -> DataFrame:
        return ao_layout(self.atoms(), convention)

    def sizes(self) -> DataFrame:
        """``mol_id, n`` orbitals; no layout is needed to count them."""
        shells = convention(self.spark, "back2pyscf").groupBy("z").agg(F.count("*").alias("n"))
        z = F.expr("element_at(array(1, 1, 6, 8, 7, 9, 3), CAST(l_partkey % 7 AS INT) + 1)").alias("z")
        rows = self.table("lineitem").select(F.col("l_orderkey").alias("mol_id"), z).repartition(self._tasks(), "mol_id")  # by number: few small rows, much work for each
        return rows.join(F.broadcast(shells), "z").groupBy("mol_id").agg(F.sum("n").cast("int").alias("n"))

    def folders(self) -> DataFrame:
        """``mol_id, n, numbers, positions``: a row for each molecule that has orbitals."""
        own = fold_structures(self.atoms(by_number=True))  # much work for each molecule
        return own.select("mol_id", orbital_count("numbers", "back2pyscf").alias("n"), "numbers", "positions").filter("n > 0")

    def per_orbital(self, name: str) -> DataFrame:
        """``mol_id, n, name``: a row for each of a molecule's n orbitals."""
        return self.sizes().select("mol_id", "n", F.explode(F.expr("sequence(0, n - 1)")).alias(name))

    def ham(self, source: str) -> DataFrame:
        return with_arrays(self.per_orbital("i"), {"vals": _hamiltonian(source)})

    def overlap(self) -> DataFrame:
        return with_arrays(self.per_orbital("i"), {"vals": _overlap})

    def identity(self) -> DataFrame:
        return with_arrays(self.per_orbital("i"), {"vals": _identity})

    def matrix_rows(self) -> DataFrame:
        """All Hamiltonians and the overlaps, as one table."""
        own = [self.ham(s).select("mol_id", F.lit(s).alias("source"), F.lit("ham").alias("kind"), "i", "vals") for s in HAMILTONIAN]
        return own[0].unionByName(own[1]).unionByName(own[2]).unionByName(self.overlap().select("mol_id", F.lit("ref").alias("source"), F.lit("overlap").alias("kind"), "i", "vals"))

    def energies(self, source: str) -> DataFrame:
        """Orbitals without their coefficients, ``mol_id, n, k, eps``."""
        return self.per_orbital("k").select("mol_id", "n", "k", F.expr(energy(source)).alias("eps"))

    def coefficients(self, energies: DataFrame, source: str) -> DataFrame:
        return with_arrays(energies, {"coef": _coefficient(source)})

    def orbitals(self, source: str) -> DataFrame:
        return self.coefficients(self.energies(source), source)

    def cross_overlap(self) -> DataFrame:
        """``mol_id, nu, s``: s over mu."""
        return with_arrays(self.per_orbital("nu"), {"s": _cross_overlap})

    def ao_dipole(self) -> DataFrame:
        """``mol_id, i, rx, ry, rz``: integrals over j."""
        return with_arrays(self.per_orbital("i"), {f"r{c}": _dipole_integral(k) for k, c in enumerate("xyz")})

    def planes(self, n: int) -> DataFrame:
        """``mol_id, n_ao, ix, nz`` of n points along each side."""
        return self.sizes().select("mol_id", F.col("n").alias("n_ao"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("ix"), F.lit(n).alias("nz"))

    def voxels(self, field: str, n: int = GRID) -> DataFrame:
        rows = self.planes(n).select("mol_id", "ix", "nz", F.lit(n * n).alias("n"))
        made = with_arrays(rows, {"vals": _voxel(field, n)}, max(1, 200_000 // (n * n)))
        return made.withColumn("field", F.lit(field))

    def ao_planes(self, n: int = GRID) -> DataFrame:
        """``mol_id, ix, nz, phi``: of each point of a plane the values of all orbitals."""

        def phi(r, j):
            place, mu = j // r["n_ao"], j % r["n_ao"]
            return ((r["ix"] * 3 + place // n * 5 + place % n * 7 + mu * 11) % 17 - 8) / 16

        rows = self.planes(n).withColumn("n", F.lit(n * n) * F.col("n_ao"))
        return with_arrays(rows, {"phi": phi}, max(1, 10_000 // (n * n))).drop("n_ao")

    def esp_logs(self) -> DataFrame:
        low = "concat('Start of run\n The minimum is ', CAST(-abs(c_acctbal) AS STRING), ' at ', c_custkey % 8, ' ', c_custkey % 5, ' ', c_nationkey, ' Bohr\n')"
        high = "concat(' The maximum is ', CAST(abs(c_acctbal) AS STRING), ' at ', c_custkey % 3, ' ', c_custkey % 7, ' ', c_nationkey, ' Bohr\n')"
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows = self.table("customer").select("c_custkey", "c_acctbal", "c_nationkey").repartition(n, "c_custkey")  # small rows, a file for each
        return rows.select("c_custkey", F.expr(f"concat({low}, CASE WHEN c_custkey % 2 = 0 THEN {high} ELSE '' END)").alias("value"))

    def blocks(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The predicted Hamiltonian as on-site blocks, hopping blocks and each atom's offset and size.  A hop between two
        atoms is spread over three lattice images, and each atom hops to an image of its own; together they give
        back the matrix."""
        sizes = self.ao().groupBy("mol_id", "atom").agg(F.min("pos").alias("at"), F.count("*").cast("int").alias("size"))
        molecules = sizes.groupBy("mol_id").agg(F.array_sort(F.collect_list(F.struct("atom", "at", "size"))).alias("atoms"))
        value = _hamiltonian("pred")

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for mol, atoms in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    n = sum(x["size"] for x in atoms)
                    i, j = np.indices((n, n))
                    matrix, image = value({"mol_id": mol, "i": i}, j), ((mol + i * 3 + j * 5) % 17 - 8) / 1024
                    rows = []
                    for p in atoms:
                        for q in atoms[p["atom"] :]:
                            at = np.s_[p["at"] : p["at"] + p["size"], q["at"] : q["at"] + q["size"]]
                            if p is q:
                                rows.append((p["atom"], q["atom"], 0, 0, 0, matrix[at] - image[at] - image[at].T))
                                rows.append((p["atom"], q["atom"], 1, 0, 0, image[at]))
                            else:
                                rows += [(p["atom"], q["atom"], x, y, z, block) for x, y, z, block in ((0, 0, 0, matrix[at] - 2 * image[at]), (1, 0, 0, image[at]), (0, -1, 2, image[at]))]
                    columns = [pa.array([r[k] for r in rows], pa.int32()) for k in range(5)]
                    yield pa.RecordBatch.from_arrays([pa.array([mol] * len(rows), pa.int64()), *columns, pa.array([r[5].ravel() for r in rows], pa.list_(pa.float64()))], names=["mol_id", "a", "b", "rx", "ry", "rz", "vals"])

        blocks = molecules.mapInArrow(cut, "mol_id bigint, a int, b int, rx int, ry int, rz int, vals array<double>")
        home = "a = b AND rx = 0 AND ry = 0 AND rz = 0"
        return blocks.filter(home).select("mol_id", F.col("a").alias("atom"), "vals"), blocks.filter(f"NOT ({home})"), sizes
