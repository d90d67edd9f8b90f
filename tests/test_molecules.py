"""Hand-written expected values, numpy transcriptions and algebra on small molecules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave.functions.constants import HARTREE_EV, convention_rows, resolve_basis
from orbweave.operators import basis, fields, matrices, molecules, orbitals, report, structures
from orbweave.sources import files
from orbweave.sources.fixtures import Fixtures

ATOMS = "mol_id bigint, atom int, z int, x double, y double, z_c double"


@pytest.fixture(scope="module")
def water(spark):
    """Molecule 1: O, H, H; molecule 2: a lone H; molecule 3: Li."""
    return spark.createDataFrame([(1, 0, 8, 0.0, 0.0, 0.0), (1, 1, 1, 1.0, 0.0, 0.0), (1, 2, 1, 0.0, 1.0, 0.0), (2, 0, 1, 0.0, 0.0, 0.0), (3, 0, 3, 1.0, 2.0, 3.0)], ATOMS).cache()


def rows_of(spark, mol, matrix):
    return spark.createDataFrame([(mol, i, [float(v) for v in row]) for i, row in enumerate(matrix)], "mol_id bigint, i int, vals array<double>")


def matrix_of(df, mol=1):
    return np.array([r.vals for r in df.filter(F.col("mol_id") == mol).orderBy("i").collect()])


def random_matrix(n, seed):
    m = np.random.default_rng(seed).normal(size=(n, n))
    return m + m.T


def test_layout_of_shells(water):
    ao = basis.ao_layout(water, "back2pyscf")
    assert [r["count"] for r in ao.groupBy("mol_id").count().orderBy("mol_id").collect()] == [24, 5, 9]
    assert [r.atom for r in ao.filter("mol_id = 1").orderBy("pos").collect()] == [0] * 14 + [1] * 5 + [2] * 5
    offsets = {(r.atom, r.shell): r.ao_offset for r in basis.ao_offsets(water, "back2pyscf").filter("mol_id = 1").collect()}
    assert offsets[0, 0] == 0 and offsets[0, 5] == 9 and offsets[1, 0] == 14 and offsets[2, 2] == 21


def test_unknown_names_raise(spark):
    with pytest.raises(ValueError):
        convention_rows("pyscf_631G")
    with pytest.raises(ValueError):
        resolve_basis("sto-3g")


def test_permutation_equals_gather_and_round_trips(spark, water):
    m = random_matrix(24, 1)
    rows = rows_of(spark, 1, m)
    there = basis.ao_layout(water, "pyscf_def2svp")
    back = basis.ao_layout(water, "back2pyscf")
    index = [r.old_pos for r in basis.permutation(there).filter("mol_id = 1").orderBy("pos").collect()]
    moved = basis.permute_basis(rows, there)
    assert np.array_equal(matrix_of(moved), m[np.ix_(index, index)])
    assert np.array_equal(matrix_of(basis.permute_basis(moved, back)), m)


def test_matrix_errors_equal_numpy(spark, water):
    a, b = random_matrix(24, 2), random_matrix(24, 3)
    aligned = matrices.align(rows_of(spark, 1, a), rows_of(spark, 1, b))
    assert matrices.matrix_mae(aligned).first()["mae"] == pytest.approx(np.abs(a - b).mean())
    owner = np.array([0] * 14 + [1] * 5 + [2] * 5)
    means = {(i, j): np.abs(a - b)[np.ix_(owner == i, owner == j)].mean() for i in range(3) for j in range(3)}
    row = molecules.matrix_errors(molecules.together(a=rows_of(spark, 1, a), b=rows_of(spark, 1, b)), basis.owners(basis.ao_layout(water, "back2pyscf"))).first()
    assert row.diag_mae == pytest.approx(np.mean([v for (i, j), v in means.items() if i == j]))
    assert row.non_diag_mae == pytest.approx(np.mean([v for (i, j), v in means.items() if i != j]))


def test_one_atom_has_no_block_off_the_diagonal(spark, water):
    m = rows_of(spark, 2, random_matrix(5, 1))
    row = molecules.matrix_errors(molecules.together(a=m, b=m), basis.owners(basis.ao_layout(water, "back2pyscf"))).first()
    assert (row.diag_mae, row.non_diag_mae) == (0.0, None)


def test_shift_of_the_reference(spark):
    a, b, s = random_matrix(6, 1), random_matrix(6, 2), random_matrix(6, 3)
    moved = molecules.shifted_rows(molecules.together(a=rows_of(spark, 1, a), b=rows_of(spark, 1, b), s=rows_of(spark, 1, s)))
    assert np.allclose(matrix_of(moved), b + np.diagonal(a - b).mean() * s)
    same = molecules.shifted_rows(molecules.together(a=rows_of(spark, 1, a), b=rows_of(spark, 1, a), s=rows_of(spark, 1, s)))
    assert np.allclose(matrix_of(same), a)


def test_missing_matrices_are_reported(spark, water):
    own = rows_of(spark, 1, random_matrix(3, 1))
    assert {r.mol_id for r in matrices.missing_matrices(water.select("mol_id").distinct(), own).collect()} == {2, 3}


def test_solver_with_a_nearly_singular_overlap(spark):
    f, s = random_matrix(4, 5), np.diag([1.0, 1.0, 1.0, 1e-14])
    eps = orbitals.solve_orbitals(rows_of(spark, 1, f), rows_of(spark, 1, s)).orderBy("k").collect()
    x = np.diag([1, 1, 1, 1e4])
    assert np.allclose([r.eps for r in eps], np.linalg.eigvalsh(x @ f @ x))
    one = orbitals.solve_orbitals(rows_of(spark, 7, [[3.0]]), rows_of(spark, 7, [[4.0]])).first()
    assert one.eps == pytest.approx(0.75) and one.coef[0] ** 2 == pytest.approx(0.25)


def test_frontier_and_odd_electrons(spark, water):
    e = {r.mol_id: (r.n_el, r.n_occ, r.homo_idx) for r in orbitals.electron_count(water).collect()}
    assert e == {1: (10, 5, 4), 2: (1, 0, -1), 3: (3, 1, 0)}
    charged = spark.createDataFrame([(1, 2), (2, None)], "mol_id bigint, charge int")
    assert {r.mol_id: r.n_el for r in orbitals.electron_count(water, charged).collect()} == {1: 8, 2: 1, 3: 3}
    own = spark.createDataFrame([(m, k, float(k), [1.0]) for m in (1, 2, 3) for k in range(6)], "mol_id bigint, k int, eps double, coef array<double>")
    front = {r.mol_id: (r.homo, r.lumo, r.gap) for r in orbitals.frontier(own, orbitals.electron_count(water)).collect()}
    assert front == {1: (4.0, 5.0, 1.0), 2: (None, None, None), 3: (0.0, 1.0, 1.0)}
    assert orbitals.orbital_pick(own, orbitals.electron_count(water), 1).filter("mol_id = 2").count() == 0
    assert orbitals.frontier_ev(orbitals.frontier(own, orbitals.electron_count(water))).filter("mol_id = 3").first().lumo_ev == HARTREE_EV


def test_cosine_density_and_dipole_equal_numpy(spark, water):
    c = np.random.default_rng(1).normal(size=(4, 4))
    own = spark.createDataFrame([(1, k, float(k), [float(v) for v in c[:, k]]) for k in range(4)], "mol_id bigint, k int, eps double, coef array<double>")
    electrons = spark.createDataFrame([(1, 4, 2, 1)], "mol_id bigint, n_el bigint, n_occ int, homo_idx int")
    occ = orbitals.occupations(own, electrons)
    d = 2 * c[:, :2] @ c[:, :2].T
    assert np.allclose(matrix_of(orbitals.density(occ)), d)
    same = orbitals.abs_cosine(own, own.withColumn("coef", F.transform("coef", lambda x: -x)), ["mol_id", "k"]).collect()
    assert all(r.cosine == pytest.approx(1.0) for r in same)
    zero = own.withColumn("coef", F.transform("coef", lambda x: x * 0))
    assert {r.cosine for r in orbitals.abs_cosine(own, zero, ["mol_id", "k"]).collect()} == {None}
    r = np.random.default_rng(2).normal(size=(3, 4, 4))
    integrals = spark.createDataFrame([(1, i, *([float(v) for v in r[a, i]] for a in range(3))) for i in range(4)], "mol_id bigint, i int, rx array<double>, ry array<double>, rz array<double>")
    row = orbitals.dipole(orbitals.density(occ), integrals, water).first()
    mu = (np.array([1.0, 1.0, 0.0]) * 1.8897259886 - (d * r).sum((1, 2))) * 2.541746
    assert np.allclose([row.dx, row.dy, row.dz, row.norm], [*mu, np.linalg.norm(mu)])


def test_metric_format(spark):
    values = [0.0, 1.0, 123.456, 0.123456, 0.00012345, -0.5, -9.876, 0.999, None, 1e-9]
    own = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double")
    shown = [r.s for r in own.select("k", report.format_metric(F.col("v")).alias("s")).orderBy("k").collect()]
    expected = [None if v is None else float(f"{v:.2f}" if abs(v) >= 1 else f"{v:.3g}") for v in values]
    assert shown == expected


def test_reports_skip_missing_values(spark):
    own = spark.createDataFrame([(1, "a_vs_b", "hamiltonian_mae", 2.0), (2, "a_vs_b", "hamiltonian_mae", None), (1, "a_vs_b", "homo_similarity", 0.5)], "mol_id bigint, comparison string, metric string, value double")
    out = report.corpus_report(own)
    assert {(r.metric, r.value, r["items"]) for r in out.collect()} == {("hamiltonian_mae", 2.0, 1), ("homo_similarity", 0.5, 1)}
    row = report.report_row(out, ["hamiltonian_mae", "homo_similarity"]).first()
    assert (row.hamiltonian_mae, row.homo_similarity, row.total_items) == (2e6, 50.0, 1)
    whole = report.report_row(out).first()
    assert len(report.FACTORS) == 16 and whole.dipole_error is None and whole.hamiltonian_mae == 2e6


def test_labels_have_two_significant_digits(spark):
    values = [0.9999, 0.0042, 0.5, 0.123, 0.00004321, 0.000123, 1.0, 0.0, 9.96, 99.6, 123.0, -0.27, 0.996, None]
    own = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").orderBy("k")
    assert [r.s for r in own.select(report.two_digits(F.col("v")).alias("s")).collect()] == [None if v is None else f"{v:.2g}" for v in values]
    one, two = report.detail_label(F.lit(3), F.lit(0.9999)), report.detail_label(F.lit(3), F.lit(0.9999), F.lit(0.0042))
    assert tuple(own.select(one, two).first()) == ("idx_3_sim_1", "idx_3_pred_sim_1_label_sim_0.0042")


def test_structures_round_trip(spark, water, tmp_path):
    folded = structures.fold_structures(water)
    path = f"file://{tmp_path}/s"
    files.write_structures(folded, path)
    back = structures.unfold_structures(files.read_structures(spark, path))
    assert sorted(map(tuple, back.select(*water.columns).collect())) == sorted(map(tuple, water.collect()))
    record = structures.model_records(water).filter("idx = 1").first()
    assert record.numbers == [8, 1, 1] and record.pos[1] == [1.0, 0.0, 0.0] and record.pbc == [False] * 3 and record.cell == [[0.0] * 3] * 3


def test_dense_index_and_limits(spark):
    own = spark.createDataFrame([(7 * k % 101,) for k in range(101)], "mol_id bigint")
    index = structures.dense_index(own, "mol_id")
    assert {(r.mol_id, r.idx) for r in index.collect()} == {(k, k) for k in range(101)}
    assert [structures.first_n(index, n).count() for n in (None, 0, 3, 500)] == [101, 0, 3, 101]
    assert structures.dense_index(own.limit(0), "mol_id").count() == 0
    odd = spark.createDataFrame([("b", 1), (None, 2), ("a", 3), ("b", 4)], "name string, x int")
    found = sorted(structures.dense_index(odd, "name", "place").collect(), key=lambda r: r.place)
    assert [r.name for r in found] == [None, "a", "b", "b"] and [r.place for r in found] == [0, 1, 2, 3]


def test_orbitals_by_energy(spark):
    own = spark.createDataFrame([(1, 0, 2.0), (1, 1, -1.0), (1, 2, 2.0)], "mol_id bigint, k int, eps double")
    assert {(r.k, r.place) for r in orbitals.orbitals_by_energy(own).collect()} == {(1, 0), (0, 1), (2, 2)}
    assert {(r.k, r.place) for r in orbitals.orbitals_by_energy(own, descending=True).collect()} == {(2, 0), (0, 1), (1, 2)}


def test_smiles_and_rejects(spark, tmp_path, water):
    lines = spark.createDataFrame([(" CO ",), ("",), ("   ",), ("N",)], "value string")
    lines.write.text(f"file://{tmp_path}/smiles")
    assert sorted(r.smile for r in files.read_smiles(spark, f"file://{tmp_path}/smiles").collect()) == ["CO", "N"]
    smiles = spark.createDataFrame([(1, "O"), (9, "bad")], "mol_id bigint, smile string")
    assert {(r.status, r.n) for r in structures.ingest_counts(smiles, water).collect()} == {("accepted", 1), ("rejected", 1)}
    files.write_rejects(structures.split_accepted(smiles, water)[1], f"file://{tmp_path}/rejects")
    assert [r.smile for r in files.read_smiles(spark, f"file://{tmp_path}/rejects").collect()] == ["bad"]


def test_logs_with_one_sentence(spark):
    logs = spark.createDataFrame([(1, "x\n The maximum is 2.5E-1 at -1 0.5 3 Bohr\n The maximum is 9 at 1 1 1 Bohr"), (2, "nothing"), (3, None)], "id int, value string")
    rows = {r.id: r for r in files.parse_esp_logs(logs, "id", "a.u.").collect()}
    assert (rows[1].high_value, rows[1].high_x, rows[1].high_y, rows[1].high_z, rows[1].low_value) == (0.25, -1.0, 0.5, 3.0, None)
    assert rows[2].high_value is None and rows[3].low_x is None


def test_matrix_files(spark, tmp_path):
    m = random_matrix(3, 1)
    (tmp_path / "m" / "5").mkdir(parents=True)
    np.save(tmp_path / "m" / "5" / "original_ham.npy", (m + 1j * m)[None])
    out = files.read_npy_matrices(spark, f"file://{tmp_path}/m")
    assert np.array_equal(matrix_of(out, 5), m) and (out.first().source, out.first().kind) == ("label", "ham")


def test_fields(spark):
    own = spark.createDataFrame([(1, 0, 3, [-2.0, 3.0, 3.0, -2.0, 0.0, 0.5]), (1, 1, 3, [0.0] * 5 + [3.0])], "mol_id bigint, ix int, nz int, vals array<double>")
    row = fields.field_extrema(own).first()
    assert (row.low_value, row.low_ix, row.low_iy, row.low_iz) == (-2.0, 0, 0, 0)
    assert (row.high_value, row.high_ix, row.high_iy, row.high_iz) == (3.0, 1, 1, 2)
    assert {(r.lobe, r.voxels, r.integral) for r in fields.iso_lobes(own, 1.0).collect()} == {("pos", 3, 9.0), ("neg", 2, -4.0)}
    assert {(r.ix, r.lobe): r.places for r in fields.iso_select(own, 1.0).collect()} == {(0, "pos"): [1, 2], (0, "neg"): [0, 3], (1, "pos"): [5]}
    assert {(r.ix, r.iy, r.iz): r.value for r in fields.voxels(own).collect()}[0, 1, 2] == 0.5
    turned = own.withColumn("vals", F.transform("vals", lambda v: -v))
    assert {v for r in fields.difference_field(own, turned, align_sign=True).collect() for v in r.vals} == {0.0}
    assert [r.vals for r in fields.difference_field(own, turned.filter("ix = 0")).collect()] == [[-4.0, 6.0, 6.0, -4.0, 0.0, 1.0]]
    assert fields.difference_field(own, turned.limit(0)).count() == 0


def test_orbital_and_density_fields_equal_numpy(spark):
    rng = np.random.default_rng(5)
    c, phi = rng.normal(size=(3, 4)), rng.normal(size=(8, 6, 4))
    own = spark.createDataFrame([(1, k, 2.0 * (k < 2), [float(v) for v in c[k]]) for k in range(3)], "mol_id bigint, k int, occ double, coef array<double>")
    grid = spark.createDataFrame([(m, x, 3, [float(v) for v in phi[x].ravel()]) for x in range(8) for m in (1, 2)], "mol_id bigint, ix int, nz int, phi array<double>")
    for slabs in (1, 3, 8):
        psi = {(r.k, r.ix): r.vals for r in fields.orbital_field(own, grid, slabs).collect()}
        assert psi == {(k, x): pytest.approx(list(phi[x] @ c[k])) for k in range(3) for x in range(8)}
        rho = {r.ix: r.vals for r in fields.density_field(own, grid, slabs).collect()}
        assert rho == {x: pytest.approx(list(2 * ((phi[x] @ c[:2].T) ** 2).sum(1))) for x in range(8)}


def test_trees_of_cubes_and_logs(spark, tmp_path):
    for folder, name in (("a/idx_7_sim_1", "HOMO.cube"), ("b/c/idx_12", "LUMO.cube"), ("d", "skip.txt")):
        (tmp_path / "cubes" / folder).mkdir(parents=True)
        (tmp_path / "cubes" / folder / name).write_text("c\nc\n1 0 0 0\n1 1 0 0\n2 0 1 0\n2 0 0 1\n8 8.0 0 0 0\n 1.0 2.0 3.0\n 4.0\n")
    rows = fields.voxels(files.read_cubes(spark, f"file://{tmp_path}/cubes")).collect()
    assert {(r.mol_id, r.folder, r.field) for r in rows} == {(7, "idx_7_sim_1", "HOMO"), (12, "idx_12", "LUMO")}
    assert {(r.ix, r.iy, r.iz): r.value for r in rows if r.mol_id == 7} == {(0, 0, 0): 1.0, (0, 0, 1): 2.0, (0, 1, 0): 3.0, (0, 1, 1): 4.0}
    (tmp_path / "logs" / "x").mkdir(parents=True)
    (tmp_path / "logs" / "x" / "1.log").write_text("The minimum is -2.5 at 1 2 3 Bohr")
    row = files.read_esp_logs(spark, f"file://{tmp_path}/logs", "a.u.").first()
    assert (row.path, row.low_value, row.low_z, row.high_value, row.unit) == ("x/1.log", -2.5, 3.0, None, "a.u.")


def test_edges_within_cutoffs(spark, water):
    cut = spark.createDataFrame([(a, b, 1.2) for a in (1, 8) for b in (1, 8)], "z_i int, z_j int, cutoff double")
    assert {(r.mol_id, r.atom_i, r.atom_j) for r in structures.radius_edges(water, cut).collect()} == {(1, 0, 1), (1, 1, 0), (1, 0, 2), (1, 2, 0)}


def test_downcast_keeps_other_columns(spark):
    own = spark.createDataFrame([(1, 0.1, [0.1], "a")], "i int, d double, a array<double>, s string")
    assert [f.dataType.simpleString() for f in structures.downcast(own).schema.fields] == ["int", "float", "array<float>", "string"]


def test_fixture_sizes(spark):
    f = Fixtures(spark, "/root/testdata/sf0.001")
    assert f.atoms().count() == f.table("lineitem").count()
    assert f.ao().count() == f.sizes().agg(F.sum("n")).first()[0] == f.ham("pred").count()


def test_padded_scores(spark, water):
    """A model loaded once for each worker; a structure that does not fit raises."""

    def make_model():
        loads = [0]

        def predict(numbers, places):
            loads[0] += 1
            return numbers + places.sum(2) / 10

        return predict

    records = structures.model_records(water)
    rows = {(r.idx, r.atom): r.score for r in orbitals.score_padded(records, make_model, 3, batch_size=2).collect()}
    assert rows == {(1, 0): 8.0, (1, 1): 1.1, (1, 2): 1.1, (2, 0): 1.0, (3, 0): pytest.approx(3.6)}
    with pytest.raises(Exception, match="atoms of a structure: 3"):
        orbitals.score_padded(records, make_model, 2).collect()
