"""How often the large columns of each source are shuffled."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave.operators import basis, matrices, molecules, orbitals, report, structures
from orbweave.sources import files
from orbweave.sources.fixtures import Fixtures


@pytest.fixture(scope="module")
def plain(spark):
    """Without broadcast joins, as of large tables."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield spark
    spark.conf.set(name, before)


def shuffled_arrays(df):
    """Exchanges of rows that hold an array of doubles, of those that the plan has but once."""
    plan = df._jdf.queryExecution().executedPlan()
    text = plan.toString()
    arrays = set(re.findall(r"(\w+#\d+)", " ".join(re.findall(r"(?:vals|coef|rx|ry|rz|a|b)#\d+", text))))

    def walk(node):
        own = 0
        if node.nodeName() == "Exchange" and {f"{x.name()}#{x.exprId().id()}" for x in (node.output().apply(k) for k in range(node.output().size()))} & arrays:
            own = 1
        children = node.children()
        if node.nodeName() == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        return own + sum(walk(children.apply(k)) for k in range(children.size()))

    return walk(plan)


@pytest.fixture(scope="module")
def f(spark, sf_dir):
    return Fixtures(spark, sf_dir)


@pytest.fixture(scope="module")
def rows(plain, f, tmp_path_factory):
    """Matrices as files, so that nothing is dealt out by molecule yet."""
    path = f"file://{tmp_path_factory.mktemp('rows')}"
    f.matrix_rows().filter("mol_id < 300").write.mode("overwrite").parquet(path)
    return files.read_matrices(plain, path)


def test_a_table_dealt_out_by_molecule_is_not_shuffled(plain, rows, tmp_path):
    table = files.write_matrix_table(rows, "matrices_of_test", f"file://{tmp_path}/t", 5)
    pair = {"a": ("pred", "ham"), "b": ("ref", "ham")}
    own = molecules.of_table(table, **pair)
    assert shuffled_arrays(molecules.matrix_errors(own)) == 0
    assert shuffled_arrays(molecules.aligned_rows(own)) == 0
    assert shuffled_arrays(molecules.shifted_rows(molecules.of_table(table, **pair, s=("ref", "overlap")))) == 0
    assert shuffled_arrays(molecules.matrix_errors(molecules.of_table(rows, **pair))) == 1
    mae = lambda own: {r.mol_id: r.mae for r in molecules.matrix_errors(own).collect()}
    assert mae(own) == mae(molecules.of_table(rows, **pair)) and len(mae(own)) > 50
    plain.sql("DROP TABLE matrices_of_test")


def test_each_source_is_shuffled_once(plain, rows, f):
    pick = lambda s, k: matrices.select_matrix(rows, s, k)
    pred, ref, over, owner = pick("pred", "ham"), pick("ref", "ham"), pick("ref", "overlap"), basis.owners(f.ao())
    union = molecules.together(a=pred, b=ref, s=over)
    assert shuffled_arrays(molecules.matrix_errors(union, owner)) == 1  # of the three together
    assert shuffled_arrays(basis.permute_basis(pred, f.ao())) == 1
    solved = orbitals.solve_orbitals(matrices.join_structures(f.molecules(), basis.permute_basis(pred, f.ao())), over)
    assert shuffled_arrays(solved) == 2  # one of each
    gamma = orbitals.assemble_gamma(*f.blocks())
    assert shuffled_arrays(gamma) == 1
    own = orbitals.occupations(f.orbitals("pred"), orbitals.electron_count(f.atoms())).persist()
    dipoles = f.ao_dipole().persist()
    whole = report.evaluate(pred, ref, over, over, own, own, orbitals.electron_count(f.atoms()), owner, dipoles, f.atoms(), "x")
    assert shuffled_arrays(whole) == 1
    own.unpersist(), dipoles.unpersist()


def test_blocks_of_owners_in_any_order(spark):
    rng = np.random.default_rng(4)
    for _ in range(20):
        n = int(rng.integers(1, 12))
        d, owner, i = rng.random((n, n)), rng.integers(0, 4, int(rng.integers(1, n + 3))), np.sort(rng.permutation(n)[: int(rng.integers(1, n + 1))])
        found = molecules.block_means(d[i], i, owner)
        means = {}
        for p in range(4):
            for q in range(4):
                cells = [d[r, c] for r in i for c in range(n) if r < len(owner) and c < len(owner) and owner[r] == p and owner[c] == q]
                if cells:
                    means[p, q] = np.mean(cells)
        for got, which in zip(found, ([v for (p, q), v in means.items() if p == q], [v for (p, q), v in means.items() if p != q]), strict=True):
            assert got == (pytest.approx(np.mean(which)) if which else None)


def test_dense_index_with_many_files(spark):
    own = spark.createDataFrame([(k * 7919 % 10_007,) for k in range(10_007)], "k bigint").repartition(3)
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "7")
    try:
        for column in (F.col("k"), F.format_string("%05d", "k")):
            found = structures.dense_index(own.select(F.when(F.col("k") > 0, column).alias("key")), "key").collect()
            assert sorted((r.idx, r.key is None, int(r.key or 0)) for r in found) == [(k, k == 0, k) for k in range(10_007)]
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")


def test_dense_index_with_more_ranges_than_five_digits(spark, monkeypatch):
    """A written table whose range numbers pass 99,999: they are numbers, not names of files."""
    own = spark.range(40).select("id", (99_990 + F.col("id")).cast("int").alias("range of key"))
    monkeypatch.setattr(structures, "_dealt", lambda df, order: own)
    assert {(r.id, r.idx) for r in structures.dense_index(spark.range(40), "id").collect()} == {(k, k) for k in range(40)}


def test_formats_equal_python(spark):
    rng = random.Random(8)
    values = [rng.randrange(1 << 14) / (1 << rng.randrange(14)) * rng.choice((-1, 1)) for _ in range(60_000)]  # many ties
    values += [float(f"{rng.random():.{rng.randrange(1, 6)}f}") * 10 ** rng.randrange(-5, 4) for _ in range(40_000)]
    values += [0.0, -0.0, 1.125, 0.5625, 2.675, 0.125, 99.5, 9.995, 0.9995, math.nan, math.inf, None]
    own = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double")
    for r in own.select("v", report.format_metric(F.col("v")).alias("metric"), report.two_digits(F.col("v")).alias("two")).toLocalIterator():
        if r.v is None or math.isnan(r.v):
            assert r.metric is None and r.two is None
        else:
            assert (r.metric, r.two) == (float(f"{r.v:.2f}" if abs(r.v) >= 1 else f"{r.v:.3g}"), f"{r.v:.2g}")


def test_pairs_grow_with_the_atoms(spark):
    rng = np.random.default_rng(6)
    place = rng.random((5000, 3)) * 60 - 30
    atoms = spark.createDataFrame([(1, k, int(rng.integers(1, 3)), *map(float, x)) for k, x in enumerate(place)], "mol_id bigint, atom int, z int, x double, y double, z_c double")
    cut = {(1, 1): 1.5, (1, 2): 2.0, (2, 1): 3.0, (2, 2): 2.5}
    found = {(r.atom_i, r.atom_j) for r in structures.radius_edges(atoms, spark.createDataFrame([(*k, v) for k, v in cut.items()], "z_i int, z_j int, cutoff double")).collect()}
    z = np.array([r.z for r in atoms.orderBy("atom").collect()])
    d2 = ((place[:, None] - place[None]) ** 2).sum(2)
    most = np.array([[cut.get((a, b), 0) for b in range(3)] for a in range(3)])[z[:, None], z[None]]
    assert found == set(zip(*(x.tolist() for x in np.nonzero((d2 <= most**2) & ~np.eye(5000, dtype=bool))), strict=True)) and len(found) > 4000
    tested = structures.cell_pairs(atoms, 3.0).count()
    assert tested < 5000 * 27 * 5000 / 20**3 * 2 < 5000 * 4999 / 10


def test_images_and_own_images_of_blocks(spark):
    a, b, c, d = (np.random.default_rng(k).normal(size=s) for k, s in enumerate(((2, 2), (2, 3), (2, 3), (3, 3))))
    flat = lambda x: [float(v) for v in x.ravel()]
    nodes = spark.createDataFrame([(1, 0, flat(a + a.T)), (1, 1, flat(d + d.T)), (1, 9, [1.0])], "mol_id bigint, atom int, vals array<double>")
    edges = spark.createDataFrame([(1, 0, 1, 0, 0, 0, flat(b)), (1, 0, 1, 1, 0, -1, flat(c)), (1, 0, 0, 1, 0, 0, flat(a))], "mol_id bigint, a int, b int, rx int, ry int, rz int, vals array<double>")
    offsets = spark.createDataFrame([(1, 0, 0, 2), (1, 1, 2, 3), (2, 0, 0, 1)], "mol_id bigint, atom int, at int, size int")
    rows = orbitals.assemble_gamma(nodes, edges, offsets).filter("mol_id = 1").orderBy("i").collect()
    expected = np.block([[2 * (a + a.T), b + c], [(b + c).T, d + d.T]])
    assert np.allclose(np.array([r.vals for r in rows]), expected)


def test_molecules_without_an_occupied_orbital(spark):
    own = spark.createDataFrame([(1, k, float(k), 0.0, [1.0, 2.0]) for k in range(2)], "mol_id bigint, k int, eps double, occ double, coef array<double>")
    assert [r.vals for r in orbitals.density(own).collect()] == [[0.0, 0.0]] * 2
    assert orbitals.density_mae(own, own).first().mae == 0.0
    atoms = spark.createDataFrame([(1, 0, 1, 1.0, 0.0, 0.0)], "mol_id bigint, atom int, z int, x double, y double, z_c double")
    integrals = spark.createDataFrame([(1, i, *[[1.0, 1.0]] * 3) for i in range(2)], "mol_id bigint, i int, rx array<double>, ry array<double>, rz array<double>")
    assert orbitals.dipole(orbitals.density(own), integrals, atoms).first().norm == pytest.approx(1.8897259886 * 2.541746)
