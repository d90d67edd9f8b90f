"""File trees: whole files only, whatever becomes of the tasks that write them."""

import pickle

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orbweave.sources import files, trees


def rows_of(spark, n, size=10):
    return spark.range(n).select(F.concat(F.lit("a/"), (F.col("id") % 7).cast("string")).alias("folder"), F.format_string("%d.txt", "id").alias("name"), F.repeat(F.lit("x"), F.lit(size)).cast("binary").alias("content"))


def names(path):
    return sorted(p.relative_to(path).as_posix() for p in path.rglob("*") if p.is_file())


def test_round_trip_and_modes(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    trees.write_tree(rows_of(spark, 50).repartition(4), path)
    assert len(names(tmp_path / "t")) == 50 and not list((tmp_path / "t").glob("_*"))
    (tmp_path / "t" / "_hidden").mkdir()
    (tmp_path / "t" / "_hidden" / "1.txt").write_text("no")
    (tmp_path / "t" / "top.log").write_text("at the root")
    back = trees.read_tree(spark, path, "*.txt")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows_of(spark, 50).collect()))
    assert [tuple(r) for r in trees.read_tree(spark, path, "*.log").collect()] == [("", "top.log", bytearray(b"at the root"))]
    trees.write_tree(rows_of(spark, 3, 5), path)
    assert trees.read_tree(spark, path, "*.txt").filter("length(content) = 5").count() == 3
    trees.write_tree(rows_of(spark, 4), path, overwrite=True)
    assert len(names(tmp_path / "t")) == 4
    trees.write_tree(rows_of(spark, 0), f"file://{tmp_path}/none")
    assert trees.read_tree(spark, f"file://{tmp_path}/t", "*.none").count() == 0


def test_a_job_that_fails_leaves_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    broken = rows_of(spark, 4000).repartition(3).withColumn("content", F.when(F.col("name") == "3999.txt", F.raise_error(F.lit("killed"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="killed"):
        trees.write_tree(broken, path)
    assert all(n.startswith("_writing-") for n in names(tmp_path / "t"))
    assert trees.read_tree(spark, path).count() == 0


def test_attempts_of_a_task(tmp_path):
    """A first attempt ends half-way, two others write the same files: one of them counts."""
    batch = lambda k: pa.RecordBatch.from_pydict({"folder": ["m"] * 3, "name": [f"{k}{i}" for i in range(3)], "content": [b"whole"] * 3})

    def dying():
        yield batch("a")
        raise RuntimeError("lost")

    writer = trees._Writer(f"file://{tmp_path}", False)
    with pytest.raises(RuntimeError):
        writer.write(dying())
    messages = [writer.write(iter([batch("a"), batch("b")])) for _ in range(2)]
    assert not (tmp_path / "m").exists()
    writer.commit([messages[1], None])
    assert names(tmp_path) == [f"m/{k}{i}" for k in "ab" for i in range(3)]


def test_files_are_listed_once_and_dealt_out_by_bytes(spark, tmp_path, monkeypatch):
    for k in range(40):
        (tmp_path / f"{k}").mkdir()
        (tmp_path / f"{k}" / "x.bin").write_bytes(b"y" * 1000)
    monkeypatch.setattr(trees, "PART_BYTES", 10 * (1000 + trees.OPEN))
    parts = trees._Reader(f"file://{tmp_path}", "*.bin").partitions()
    assert [len(p.files) for p in parts] == [10] * 4


def test_matrices_of_other_names_are_left_out(spark, tmp_path):
    own = spark.createDataFrame([(m, i, [float(m), float(i)]) for m in (1, 2) for i in range(2)], "mol_id bigint, i int, vals array<double>")
    path = f"file://{tmp_path}/npy"
    files.write_npy_matrices(own, path, "fock")
    files.write_npy_matrices(own, path, "something_else")
    back = files.read_npy_matrices(spark, path)
    assert sorted((r.mol_id, r.i, r.vals) for r in back.collect()) == sorted((r.mol_id, r.i, r.vals) for r in own.collect())
    assert {(r.source, r.kind) for r in back.collect()} == {("ref", "ham")}


def test_the_driver_gets_no_list_of_files(spark, tmp_path):  # F27
    n = 2 * trees.STEP + 5
    writer = trees._Writer(f"file://{tmp_path}/t", False)
    message = writer.write(iter([pa.RecordBatch.from_pydict({"folder": [f"m{k % 3}" for k in range(n)], "name": [str(k) for k in range(n)], "content": [b"x"] * n})]))
    assert len(pickle.dumps(message)) < 1000 and not list((tmp_path / "t").glob("m*"))
    writer.commit([message])
    assert names(tmp_path / "t") == sorted(f"m{k % 3}/{k}" for k in range(n))
    plan = trees.read_tree(spark, f"file://{tmp_path}/t")._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" not in plan and "MapInArrow" in plan and trees.read_tree(spark, f"file://{tmp_path}/t").count() == n


def test_files_are_moved_once_however_often_a_task_runs(tmp_path):  # F27
    writer = trees._Writer(f"file://{tmp_path}", False, "_writing-x")
    message = writer.write(iter([pa.RecordBatch.from_pydict({"folder": ["a", "b/c", None], "name": list("xyz"), "content": [b"1", None, b"3"]})]))
    writer.commit([message, None])
    assert not (tmp_path / "a").exists()
    store, root = trees._store(f"file://{tmp_path}")
    for _ in range(2):
        assert trees._place(store, root, message.attempt, 0) == 3
    trees._clean(f"file://{tmp_path}", "_writing-x")
    assert names(tmp_path) == ["a/x", "b/c/y", "z"] and (tmp_path / "b" / "c" / "y").read_bytes() == b""


def test_trees_of_many_depths(spark, tmp_path):  # F27
    kept = ["0.log", "a/1.log", "a/b/c/d/2.log", "e/f/3.log"]
    for name in [*kept, "_h/4.log", "a/.h/5.log", "a/_6.log", "e/7.txt"]:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    (tmp_path / "empty" / "er").mkdir(parents=True)
    found = trees.read_tree(spark, f"file://{tmp_path}/", "*.log").collect()
    assert sorted(f"{r.folder}/{r.name}".lstrip("/") for r in found) == kept and all(r.content.decode() == f"{r.folder}/{r.name}".lstrip("/") for r in found)
    listed = trees.list_tree(spark, f"file://{tmp_path}").collect()
    assert sorted((f"{r.folder}/{r.name}".lstrip("/"), r.size) for r in listed) == sorted((k, len(k)) for k in [*kept, "e/7.txt"])


def test_logs_are_written_by_all_tasks(spark, sf_dir):  # F27
    from orbweave.sources.fixtures import Fixtures

    assert Fixtures(spark, sf_dir).esp_logs().rdd.getNumPartitions() == 4
