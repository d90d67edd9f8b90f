"""Matrices and trees that are written where they are read: no array is shuffled or sorted for it, and few files hold many molecules."""

import io
import tarfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql.readwriter import DataFrameWriter

from orbweave.operators import folders
from orbweave.plans.queries import QUERIES
from orbweave.sources import files, trees
from orbweave.sources.fixtures import MATRICES, Fixtures, reading_matrices

#: Queries by the finding that named them.
WRITTEN_IN_TASKS = [
    "k1_write_matrices",  # F1
    "j2_align_table",  # F5
    "k1_matrix_table_mae",  # F6
]


def arrays_moved(df):
    """Exchanges and sorts of rows that hold an array of doubles."""
    found = []

    def walk(node):
        kinds = [node.output().apply(k).dataType().simpleString() for k in range(node.output().size())]
        if node.nodeName() in ("Exchange", "Sort", "ObjectHashAggregate", "SortAggregate") and any("array<double>" in k.replace("array<array<double>>", "") for k in kinds):
            found.append(node.nodeName())
        children = node.children()
        if node.nodeName() == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        for k in range(children.size()):
            walk(children.apply(k))

    walk(df._jdf.queryExecution().executedPlan())
    return found


@pytest.fixture()
def written(spark, monkeypatch):
    """Every table that is written, without broadcast joins."""
    name, seen = "spark.sql.autoBroadcastJoinThreshold", []
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    for method in ("parquet", "save", "saveAsTable"):
        own = getattr(DataFrameWriter, method)
        monkeypatch.setattr(DataFrameWriter, method, lambda self, *a, _own=own, **k: (seen.append(self._df), _own(self, *a, **k))[1])
    yield seen
    spark.conf.set(name, before)


@pytest.mark.parametrize("name", WRITTEN_IN_TASKS)
def test_no_array_is_shuffled_or_sorted(spark, sf_dir, written, name):
    found = QUERIES[name](spark, sf_dir)
    assert written and [arrays_moved(df) for df in [*written, found]] == [[]] * (len(written) + 1)


def test_files_of_matrices_are_read_by_spark_too(spark, sf_dir, tmp_path):  # F1
    f, path = Fixtures(spark, sf_dir), f"file://{tmp_path}/m"
    keys = f.sizes().filter("mol_id < 200")
    to = {f"kind={kind}/source={source}": {"vals": name} for name, (source, kind) in MATRICES.items()}
    files.write_matrix_files(folders.parquet_files(keys, reading_matrices(), to), path)
    rows = lambda df: sorted((r.mol_id, r.source, r.kind, r.i, r.vals) for r in df.collect())
    found = rows(files.read_matrices(spark, path))
    assert found == rows(f.matrix_rows().filter("mol_id < 200")) and len(found) > 5000


def test_row_groups_are_whole_molecules(monkeypatch):  # F1
    monkeypatch.setattr(folders, "GROUP_BYTES", 300), monkeypatch.setattr(folders, "FILE_BYTES", 3000)
    own, made = folders._ParquetFiles("a"), []
    for m in range(50):
        made += own.add(pa.RecordBatch.from_arrays([pa.array([m] * 5), pa.array(range(5)), pa.array(np.random.default_rng(m).random((5, 5)).tolist())], names=["mol_id", "i", "vals"]))
    made += own.end()
    read = [pq.ParquetFile(pa.BufferReader(x.column(2)[0].as_buffer())) for x in made]
    assert len(read) > 2 and len({x.column(1)[0].as_py() for x in made}) == len(read) and max(x.num_row_groups for x in read) > 1
    groups = [x.read_row_group(k)["mol_id"].to_pylist() for x in read for k in range(x.num_row_groups)]
    assert sum(groups, []) == [m for m in range(50) for _ in range(5)] and all(g.count(m) == 5 for g in groups for m in g)


def test_sums_of_rows_and_molecules():
    rows = pa.RecordBatch.from_arrays([pa.array([5, 5, 2, 9]), pa.array([0, 1, 0, 0]), pa.array([[1.0, 2.0], [3.0, 4.0], [], [5.0]])], names=["mol_id", "i", "a"])
    size, sums = folders.row_sums(rows, lambda a: a * 2)
    assert size.tolist() == [2, 2, 0, 1] and sums.tolist() == [6.0, 14.0, 0.0, 10.0]
    mol, n, total = folders.of_molecules(rows, lambda a: a)
    assert mol.to_pylist() == [5, 2, 9] and n.tolist() == [2, 1, 1] and total.tolist() == [10.0, 0.0, 5.0]
    none = folders.of_molecules(rows.slice(0, 0), lambda a: a)
    assert [len(x) for x in none] == [0, 0, 0] and isinstance(none[2], np.ndarray)


@pytest.mark.parametrize("name", ["k6_write_xyz", "s4_read_cubes", "s2_read_npy_matrices"])  # F2, F3, F9
def test_many_molecules_are_few_files(spark, sf_dir, tmp_path, monkeypatch, written, name):
    monkeypatch.setattr(files, "shared_path", lambda spark, name: f"file://{tmp_path}/{name}-{uuid.uuid4().hex}")
    found = QUERIES[name](spark, sf_dir)
    own = [p for p in tmp_path.rglob("*") if p.is_file()]
    assert found.select("mol_id").distinct().count() > 1000 and sum(not p.name.startswith((".", "_", "part-")) for p in own) <= 4
    if name != "k6_write_xyz":
        assert [arrays_moved(df) for df in written] == [[]] * len(written)


def test_packed_trees(spark, tmp_path, monkeypatch):  # F2, F3, F9
    rows = spark.range(300).selectExpr("concat('a/', id % 7, repeat('long', 30)) folder", "concat(id, '.txt') name", "CAST(repeat('x', CAST(id * 7 AS INT)) AS BINARY) content")
    path = f"file://{tmp_path}/t"
    trees.write_packed(rows.unionAll(spark.sql("SELECT '', 'top.log', CAST(NULL AS BINARY)")).repartition(3), path)
    assert len(list((tmp_path / "t").iterdir())) == 3
    key = lambda df: sorted((r.folder, r.name, bytes(r.content)) for r in df.collect())
    assert key(trees.read_packed(spark, path, "*.txt")) == key(rows) and key(trees.read_packed(spark, path, "*.log")) == [("", "top.log", b"")]
    for archive in (tmp_path / "t").iterdir():  # as any other program does
        with pa.CompressedInputStream(pa.OSFile(str(archive)), "zstd") as raw, tarfile.open(fileobj=io.BytesIO(raw.read())) as tar:
            tar.extractall(tmp_path / "plain", filter="data")
    assert key(trees.read_tree(spark, f"file://{tmp_path}/plain", "*.txt")) == key(rows)
    trees.write_packed(rows.limit(5), path, overwrite=True)
    assert trees.read_packed(spark, path).count() == 5
    monkeypatch.setattr(trees, "STEP", 2)
    own = trees._Archive()
    for k in range(5):
        own.add(f"m/{k}", bytes([k]) * k)
    assert [b.to_pydict()["content"] for b in trees._unpacked(own.end().column(2)[0].as_buffer(), "*")] == [[b"", b"\x01"], [b"\x02" * 2, b"\x03" * 3], [b"\x04" * 4]]


def test_a_packed_job_that_fails_leaves_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    broken = spark.range(4000).repartition(3).selectExpr("'a' folder", "concat(id, '.txt') name", "CASE WHEN id = 3999 THEN CAST(raise_error('killed') AS BINARY) ELSE CAST('x' AS BINARY) END content")
    with pytest.raises(Exception, match="killed"):
        trees.write_packed(broken, path)
    assert trees.read_packed(spark, path).count() == 0


def test_files_of_arrays(spark, tmp_path):  # F3, F9
    own = np.random.default_rng(2).integers(-9, 9, (3, 4, 16)) / 256
    texts = spark.createDataFrame([(m, "x", ix, own[m, ix].tolist()) for m in range(3) for ix in range(4)], "mol_id bigint, field string, ix int, vals array<double>")
    head = lambda text: text.split()[:14]
    for r, made in zip(files.cube_texts(texts, 4).orderBy("mol_id").collect(), files.cube_contents(own), strict=True):
        assert head(r.value) == head(made.decode()) and list(map(float, r.value.split()[14:])) == list(map(float, made.decode().split()[14:])) and r.value.count("\n") == made.count(b"\n")
    for m, made in enumerate(files.npy_contents(own)):
        assert (np.load(io.BytesIO(made)) == own[m : m + 1]).all()
