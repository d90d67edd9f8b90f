"""Figures of whole molecules: all rows of a molecule's matrices and orbitals meet in one group,
which numpy turns into any number of metrics, so that each source is shuffled once.

Rows of several sources are one table, ``mol_id, tag, i, eps, occ, vals``: ``tag`` names the source
that a row comes from, ``i`` is the row of a matrix or the number of an orbital."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.functions.constants import BOHR_PER_ANGSTROM, DEBYE, HARTREE_EV

ERRORS = ("mae", "diag_mae", "non_diag_mae", "delta", "shifted_mae", "shifted_diag_mae", "shifted_non_diag_mae")


def stacked(column: pa.ChunkedArray) -> np.ndarray:
    """Arrays of one length as the rows of a matrix."""
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def as_arrays(matrix: np.ndarray) -> pa.Array:
    n, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(np.ascontiguousarray(matrix).ravel(), pa.float64()))


def tagged(df: DataFrame, tag: str, i: str = "i", vals: str = "vals") -> DataFrame:
    """Rows of one source in the common form; matrices have no ``eps`` and ``occ``."""
    more = [F.col(c).cast("double").alias(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in ("eps", "occ")]
    return df.select("mol_id", F.lit(tag).alias("tag"), F.col(i).cast("int").alias("i"), *more, F.col(vals).alias("vals"))


def together(**sources: DataFrame) -> DataFrame:
    """Rows of several sources, tagged by their names."""
    return reduce(DataFrame.unionAll, [tagged(df, tag) for tag, df in sources.items()])


def afresh(df: DataFrame) -> DataFrame:
    """The same with columns of its own, so that it may be grouped together with another table that
    comes from the same source."""
    return df.select(*(F.col(f"`{c}`").alias(c) for c in df.columns))


def of_table(table: DataFrame, **sources: tuple[str, str]) -> DataFrame:
    """The same of some (source, kind) of one table of matrix rows.  It is read once and not united, so
    that a table which write_matrix_table() dealt out by molecule is not shuffled again."""
    own = {tag: (F.col("source") == source) & (F.col("kind") == kind) for tag, (source, kind) in sources.items()}
    tag, none = reduce(lambda out, x: out.when(own[x], x), own, F), F.lit(None).cast("double")
    return table.filter(reduce(lambda a, b: a | b, own.values())).select("mol_id", tag.alias("tag"), "i", none.alias("eps"), none.alias("occ"), "vals")


class Rows:
    """One source's rows of a molecule, in order of i."""

    def __init__(self, rows: pa.Table, which: np.ndarray | None = None, lists: tuple[np.ndarray, np.ndarray] | None = None):
        flat, size = _lists(rows) if lists is None else lists
        i = rows["i"].to_numpy()
        which = np.arange(len(i)) if which is None else which
        if (np.diff(i[which]) < 0).any():
            which = which[np.argsort(i[which], kind="stable")]
        self.i, self.table, self.which = i[which], rows, which
        if not len(which):
            self.vals = np.zeros((0, 0))
        elif (size == size[0]).all():
            self.vals = flat.reshape(len(size), -1)[which]
        else:
            ends = np.cumsum(size)
            self.vals = np.stack([flat[e - n : e] for e, n in zip(ends[which].tolist(), size[which].tolist(), strict=True)])

    def column(self, name: str) -> np.ndarray:
        return self.table[name].to_numpy()[self.which]


def _lists(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All values of the rows' arrays, and how many each row has."""
    lists = rows["vals"].combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(zero_copy_only=False)


def by_tag(rows: pa.Table) -> dict[str, Rows]:
    tags, lists = rows["tag"].to_numpy(zero_copy_only=False), _lists(rows)
    return {tag: Rows(rows, np.flatnonzero(tags == tag), lists) for tag in dict.fromkeys(tags.tolist())}


def same_rows(*own: Rows) -> tuple[np.ndarray, list[np.ndarray]]:
    """The numbers that all have, and each one's rows of them."""
    i = reduce(lambda x, y: np.intersect1d(x, y, assume_unique=True), (o.i for o in own))
    return i, [o.vals[np.searchsorted(o.i, i)] for o in own]


def block_means(difference: np.ndarray, i: np.ndarray, owner: np.ndarray) -> tuple[float | None, float | None]:
    """Unweighted means of the means of atom-pair blocks, on the diagonal and off it.

    Entries are summed over the runs of one owner within each row, then rows over runs; no more than
    atoms squared sums are left.  Orbitals that ``owner`` does not reach are left out; of a molecule of
    one atom the second is None."""
    known = i < len(owner)
    width = min(difference.shape[1], len(owner))
    if not known.any() or not width:
        return None, None
    rows, columns = owner[i[known]], owner[:width]
    heads = [np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]])) for o in (rows, columns)]
    sums = np.add.reduceat(np.add.reduceat(difference[known][:, :width], heads[1], axis=1), heads[0], axis=0)
    sizes = [np.diff(np.append(h, len(o))) for h, o in zip(heads, (rows, columns), strict=True)]
    atoms, at = np.unique(np.concatenate([rows[heads[0]], columns[heads[1]]]), return_inverse=True)
    at = at[: len(heads[0])], at[len(heads[0]) :]
    total, count = np.zeros((len(atoms),) * 2), np.zeros((len(atoms),) * 2)
    np.add.at(total, np.ix_(*at), sums)
    np.add.at(count, np.ix_(*at), np.outer(*sizes))
    some = count > 0
    mean, diagonal = total / np.where(some, count, 1), np.eye(len(atoms), dtype=bool)
    of = lambda which: float(mean[which].mean()) if which.any() else None
    return of(some & diagonal), of(some & ~diagonal)


def _errors(a: Rows, b: Rows, s: Rows | None, owner: np.ndarray | None) -> dict[str, float | None]:
    """ERRORS of two matrices; the shifted ones move b by delta * S, delta the mean of the diagonal of a - b."""
    out: dict[str, float | None] = dict.fromkeys(ERRORS)
    i, (x, y) = same_rows(a, b)
    if not len(i):
        return out
    shifts = [("", i, x, y)]
    inside = i < x.shape[1]
    if inside.any():
        diagonal = np.flatnonzero(inside), i[inside]
        out["delta"] = float((x[diagonal] - y[diagonal]).mean())
        if s is not None:
            j, (x, y, z) = same_rows(a, b, s)
            if len(j):
                shifts.append(("shifted_", j, x, y + out["delta"] * z))
    for name, rows, p, q in shifts:
        difference = np.abs(p - q)
        out[f"{name}mae"] = float(difference.mean())
        if owner is not None:
            out[f"{name}diag_mae"], out[f"{name}non_diag_mae"] = block_means(difference, rows, owner)
    return out


def _grouped(rows: DataFrame, owner: DataFrame | None, make: Callable, schema: str) -> DataFrame:
    """``make(rows, owner)`` of each molecule that has rows."""
    if owner is None:
        return rows.groupBy("mol_id").applyInArrow(lambda own: make(own, None), schema)

    def both(own: pa.Table, small: pa.Table) -> pa.Table:
        return make(own, small if small.num_rows else None)

    return rows.groupBy("mol_id").cogroup(afresh(owner).groupBy("mol_id")).applyInArrow(both, schema)


def _owner(small: pa.Table | None) -> np.ndarray | None:
    return None if small is None else small["owner"].combine_chunks().flatten().to_numpy(zero_copy_only=False)


def matrix_errors(rows: DataFrame, owner: DataFrame | None = None) -> DataFrame:
    """``mol_id`` and ERRORS of the matrices ``a`` and ``b``, and of b moved along the overlap ``s`` where the rows have it.

    ``owner`` has each molecule's atom of every orbital as an array; without it block figures are null.
    Molecules without a row that both matrices have are left out."""
    kind = rows.schema["mol_id"].dataType.simpleString()
    names = ["mol_id", *ERRORS]

    def make(own: pa.Table, small: pa.Table | None) -> pa.Table:
        found = by_tag(own) if own.num_rows else {}
        if not {"a", "b"} <= found.keys():
            return pa.table({n: pa.array([], own.schema.field("mol_id").type if n == "mol_id" else pa.float64()) for n in names})
        errors = _errors(found["a"], found["b"], found.get("s"), _owner(small))
        keep = errors["mae"] is not None
        return pa.table([own["mol_id"][:1] if keep else own["mol_id"][:0], *(pa.array([errors[n]] if keep else [], pa.float64()) for n in ERRORS)], names=names)

    return _grouped(rows, owner, make, f"mol_id {kind}, " + ", ".join(f"{n} double" for n in ERRORS))


def aligned_rows(rows: DataFrame) -> DataFrame:
    """``mol_id, i, a, b``: the rows that both matrices have."""
    kind = rows.schema["mol_id"].dataType.simpleString()

    def make(own: pa.Table, _) -> pa.Table:
        found = by_tag(own)
        i, both = same_rows(found["a"], found["b"]) if {"a", "b"} <= found.keys() else (np.zeros(0, np.int32), [np.zeros((0, 0))] * 2)
        return pa.table([pa.repeat(own["mol_id"][0], len(i)), pa.array(i, pa.int32()), *map(as_arrays, both)], names=["mol_id", "i", "a", "b"])

    return _grouped(rows, None, make, f"mol_id {kind}, i int, a array<double>, b array<double>")


def shifted_rows(rows: DataFrame) -> DataFrame:
    """``mol_id, i, vals``: ``b + delta * s`` with delta the mean of the diagonal of a - b."""
    kind = rows.schema["mol_id"].dataType.simpleString()

    def make(own: pa.Table, _) -> pa.Table:
        found = by_tag(own)
        i, out = np.zeros(0, np.int32), np.zeros((0, 0))
        if {"a", "b", "s"} <= found.keys() and (delta := _errors(found["a"], found["b"], None, None)["delta"]) is not None:
            i, (_, b, s) = same_rows(found["a"], found["b"], found["s"])
            out = b + delta * s
        return pa.table([pa.repeat(own["mol_id"][0], len(i)), pa.array(i, pa.int32()), as_arrays(out)], names=["mol_id", "i", "vals"])

    return _grouped(rows, None, make, f"mol_id {kind}, i int, vals array<double>")


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Absolute cosines of the rows of two matrices; NaN with a zero vector."""
    norm = np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1))
    return np.abs((x * y).sum(1)) / np.where(norm > 0, norm, np.nan)


def _density(own: Rows) -> np.ndarray:
    return (own.vals * own.column("occ")[:, None]).T @ own.vals


def _metrics(own: dict[str, Rows], small: dict) -> dict[str, float | None]:
    """The metrics that a molecule has; None where it has no value."""
    owner = None if small["owner"] is None else np.array(small["owner"])
    found = _errors(own["a"], own["b"], own.get("s"), owner)
    out = {f"hamiltonian_{c}": found[c] for c in ("mae", "diag_mae", "non_diag_mae")} | {c: found[c] for c in ERRORS if c.startswith("shifted")}
    if {"s", "t"} <= own.keys():
        out["overlap_mae"] = _errors(own["t"], own["s"], None, None)["mae"]
    if not {"u", "v"} <= own.keys():
        return out
    a, b, last = own["u"], own["v"], small["homo_idx"]
    dense = [_density(o) for o in (a, b)]
    out["density_mae"] = float(np.abs(dense[0] - dense[1]).mean())
    if {"rx", "ry", "rz"} <= own.keys():
        norms = []
        for d in dense:
            mu = [(small[f"n{c}"] - float((d[own[f"r{c}"].i] * own[f"r{c}"].vals).sum())) * DEBYE for c in "xyz"]
            norms.append(np.sqrt(sum(m * m for m in mu)))
        out["dipole_error"] = float(abs(norms[0] - norms[1]))
    k, (x, y) = same_rows(a, b)
    cosines = _cosines(x, y)
    energies = [o.column("eps")[np.searchsorted(o.i, k)] for o in (a, b)]
    occupied = k <= last
    if occupied.any():
        some = cosines[occupied]
        out["occupied_similarity"] = float(np.nanmean(some)) if not np.isnan(some).all() else None
        out["occupied_energy_mae"] = float(np.abs(energies[0] - energies[1])[occupied].mean())
    front = []
    for name, at in (("homo", last), ("lumo", last + 1)):
        here = np.flatnonzero(k == at) if last >= 0 else k[:0]
        front.append([float(e[here[0]]) if len(here) else None for e in energies])
        if len(here):
            out[f"{name}_similarity"] = None if np.isnan(cosines[here[0]]) else float(cosines[here[0]])
    (homo, lumo), none = front, None
    out["homo_mae"], out["lumo_mae"] = (none if p[0] is none else abs(p[0] - p[1]) * HARTREE_EV for p in front)
    out["gap_mae"] = none if none in (*homo, *lumo) else abs((lumo[0] - homo[0]) - (lumo[1] - homo[1])) * HARTREE_EV
    return out


def molecule_metrics(rows: DataFrame, electrons: DataFrame, owner: DataFrame, atoms: DataFrame) -> DataFrame:
    """``mol_id, metric, value``: every metric of a molecule, from one group of its rows.

    Tags: Hamiltonians ``a`` and ``b``, overlaps ``s`` of b and ``t`` of a, orbitals ``u`` and ``v``, dipole integrals ``rx``, ``ry``
    and ``rz``.  A molecule without an occupied orbital has densities of zero and no similarity of occupied
    orbitals; its frontier errors are null.  Only rows of the matrices and orbitals are large; each is
    shuffled once, to its molecule."""
    kind = rows.schema["mol_id"].dataType.simpleString()
    core = atoms.groupBy("mol_id").agg(*(F.sum(F.col("z") * F.col(src) * BOHR_PER_ANGSTROM).alias(f"n{c}") for c, src in zip("xyz", ("x", "y", "z_c"), strict=True)))
    small = electrons.select("mol_id", "homo_idx").join(owner, "mol_id", "left").join(core, "mol_id", "left")

    def make(own: pa.Table, few: pa.Table | None) -> pa.Table:
        found = by_tag(own) if own.num_rows and few is not None else {}
        metrics = _metrics(found, few.to_pylist()[0]) if {"a", "b"} <= found.keys() else {}
        mol = pa.repeat(own["mol_id"][0], len(metrics)) if metrics else pa.array([], own.schema.field("mol_id").type)
        return pa.table([mol, pa.array(list(metrics), pa.string()), pa.array(list(metrics.values()), pa.float64())], names=["mol_id", "metric", "value"])

    return _grouped(rows, small, make, f"mol_id {kind}, metric string, value double")
