"""Readers and writers: structures, matrix files, grids, logs, SMILES lines, reports."""

from __future__ import annotations

import io
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.sources.trees import SCHEMA as TREE
from orbweave.sources.trees import read_packed, read_tree, write_packed, write_tree

#: Bytes of matrices that are rows at once.
ROWS_BYTES = 4 << 20
MATRIX_ROWS = "mol_id bigint, source string, kind string, i int, vals array<double>"

#: File names of matrices: source and kind.
MATRIX_FILES = {"predicted_ham": ("pred", "ham"), "original_ham": ("label", "ham"), "predicted_overlap": ("pred", "overlap"), "original_overlap": ("label", "overlap"), "fock": ("ref", "ham"), "overlap": ("ref", "overlap")}


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share, which spark.checkpoint.dir
    names.  Only a local session, as in tests, may leave that unset and gets a temporary
    folder of this machine; on a cluster it raises."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local") or "cluster" in spark.conf.get("spark.master", ""):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = getattr(shared_path, "own", None) or "file://" + tempfile.mkdtemp(prefix="orbweave-")
        shared_path.own = base
    return f"{base.rstrip('/')}/orbweave/{name}-{uuid.uuid4().hex}"


def read_structures(spark: SparkSession, path: str) -> DataFrame:
    """``mol_id, numbers, positions`` from Parquet."""
    return spark.read.schema("mol_id bigint, numbers array<int>, positions array<array<double>>").parquet(path)


def write_structures(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.write.mode("overwrite" if overwrite else "append").parquet(path)


def read_npy_matrices(spark: SparkSession, path: str, packed: bool = False, figures: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, schema: str = MATRIX_ROWS) -> DataFrame:
    """Matrix rows of a tree ``{mol_id}/{name}.npy`` of the names of MATRIX_FILES, others left out; leading axes of
    one are dropped and only the real part is kept.  Each file is decoded in the task that reads it.  ``figures`` makes rows of
    ``schema`` of some molecules' rows there, so that no array is handed on."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, size = [], 0
            for folder, name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                matrix = np.real(np.load(io.BytesIO(content), allow_pickle=False)).astype(np.float64, copy=False)
                own.append((int(folder.rpartition("/")[2]), *MATRIX_FILES[name.removesuffix(".npy")], matrix.reshape(matrix.shape[-2:])))
                size += matrix.nbytes
                if size > ROWS_BYTES:
                    yield (figures or _same)(_matrix_rows(own))
                    own, size = [], 0
            if own:
                yield (figures or _same)(_matrix_rows(own))

    known = F.regexp_replace("name", r"\.npy$", "").isin(*MATRIX_FILES)
    return (read_packed if packed else read_tree)(spark, path, "*.npy").filter(known).mapInArrow(decode, schema if figures else MATRIX_ROWS)


def _same(rows: pa.RecordBatch) -> pa.RecordBatch:
    return rows


def _matrix_rows(own: list[tuple[int, str, str, np.ndarray]]) -> pa.RecordBatch:
    n = [len(matrix) for *_, matrix in own]
    which = pa.array(np.repeat(np.arange(len(own)), n))
    keys = [pa.array(c, kind).take(which) for c, kind in zip(list(zip(*own, strict=True))[:3], (pa.int64(), pa.string(), pa.string()), strict=True)]
    offsets = np.concatenate([[0], np.cumsum(np.repeat([matrix.shape[1] for *_, matrix in own], n))])
    vals = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([matrix.ravel() for *_, matrix in own])))
    return pa.RecordBatch.from_arrays([*keys, pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in n])), vals], names=["mol_id", "source", "kind", "i", "vals"])


def npy_contents(matrices: np.ndarray) -> list[bytes]:
    """Each of ``(molecules, n, n)`` as a NumPy file with a leading axis of one."""
    head = io.BytesIO()
    np.lib.format.write_array_header_1_0(head, {"descr": "<f8", "fortran_order": False, "shape": (1, *matrices.shape[1:])})
    return [head.getvalue() + matrix.astype("<f8").tobytes() for matrix in matrices]


def write_npy_matrices(df: DataFrame, path: str, name: str) -> None:
    """A file ``{mol_id}/{name}.npy`` for each molecule of matrix rows, with a leading axis of one."""

    def encode(rows: pa.Table) -> pa.Table:
        rows, out = rows.sort_by("i"), io.BytesIO()
        flat = rows["vals"].combine_chunks()
        np.save(out, flat.flatten().to_numpy(zero_copy_only=False).reshape(1, len(flat), -1))
        return pa.table({"folder": [str(rows["mol_id"][0].as_py())], "name": [f"{name}.npy"], "content": pa.array([out.getvalue()], pa.binary())})

    write_tree(df.select("mol_id", "i", "vals").groupBy("mol_id").applyInArrow(encode, TREE), path)


def write_matrices(df: DataFrame, path: str, overwrite: bool = True) -> None:
    """Matrix rows as Parquet, a folder for each kind and source; a molecule's rows lie together."""
    df.repartition("mol_id").sortWithinPartitions("mol_id", "i").write.mode("overwrite" if overwrite else "append").partitionBy("kind", "source").parquet(path)


def write_matrix_files(files: DataFrame, path: str) -> None:
    """Parquet files as folders.parquet_files() makes them, each of whole molecules; where ``folder`` is ``kind=../source=..``,
    read_matrices() reads them too."""
    write_tree(files, path)


def matrix_file_figures(spark: SparkSession, path: str, columns: list[str], figures: Callable[[str, pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``figures(folder, rows)`` of the rows of each row group, which are whole molecules, in the task that reads the file; only these
    ``columns`` are read, and no array is handed on."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder, content in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                own = pq.ParquetFile(pa.BufferReader(content.as_buffer()))
                for k in range(own.num_row_groups):
                    yield figures(folder, own.read_row_group(k, columns, use_threads=False).combine_chunks().to_batches()[0])

    return read_tree(spark, path, "*.parquet").mapInArrow(read, schema)


def write_matrix_table(df: DataFrame, table: str, path: str, buckets: int | None = None) -> DataFrame:
    """Matrix rows as a table that is dealt out by molecule into ``buckets`` (else as many as shuffle
    partitions), in a folder for each kind and source; returns the table.  What groups its rows by molecule, or joins them
    with another table of as many buckets, does not shuffle them again."""
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(n, "mol_id").write.mode("overwrite").partitionBy("kind", "source").bucketBy(n, "mol_id").sortBy("mol_id", "i")
    dealt.option("path", path).saveAsTable(table)
    return spark.table(table)


def read_matrices(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MATRIX_ROWS).parquet(path)


def read_smiles(spark: SparkSession, path: str) -> DataFrame:
    """``smile``: one on each line, trimmed, blank lines left out.  Spark deals out files by bytes,
    so lines have no number; dense_index() gives one where an order is needed."""
    return spark.read.text(path).select(F.trim("value").alias("smile")).filter("smile != ''")


def parse_cubes(texts: DataFrame) -> DataFrame:
    """Grid fields of whole cube texts ``value`` by planes, ``ix, nz, vals``, with their other columns: two comment lines, the
    number of atoms, three axis lines, the atoms, then the values with z running fastest."""
    keys = [c for c in texts.columns if c != "value"]
    words = texts.select(*keys, F.split(F.regexp_replace("value", r"^[^\n]*\n[^\n]*\n\s*|\s+$", ""), r"\s+").alias("w"))
    size = lambda k: F.get("w", F.lit(k)).cast("int")
    rows = words.select(*keys, size(4).alias("nx"), size(8).alias("ny"), size(12).alias("nz"), F.slice("w", 17 + F.abs(size(0)) * 5, F.size("w")).cast("array<double>").alias("all"))
    rows = rows.filter("nx > 0").withColumn("ix", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)))
    return rows.select(*keys, "ix", "nz", F.slice("all", 1 + F.col("ix") * F.col("ny") * F.col("nz"), F.col("ny") * F.col("nz")).alias("vals"))


def cube_texts(field: DataFrame, n: int) -> DataFrame:
    """Whole cube texts of fields on n points along each side, without atoms."""
    planes = F.transform(F.array_sort(F.collect_list(F.struct("ix", "vals"))), lambda e: F.array_join(e["vals"].cast("array<string>"), " "))
    return field.groupBy("mol_id", "field").agg(F.concat(F.lit(_cube_head(n)), F.array_join(planes, "\n")).alias("value"))


def _cube_head(n: int) -> str:
    return f"grid\nfield\n0 0 0 0\n{n} 1 0 0\n{n} 0 1 0\n{n} 0 0 1\n"


def cube_contents(fields: np.ndarray) -> list[bytes]:
    """Whole cube files, without atoms, of fields ``(molecules, n, n * n)``, a line for each plane."""
    values, which = np.unique(fields, return_inverse=True)
    words = np.array([repr(v) for v in values.tolist()], object)[which.reshape(fields.shape)]
    head = _cube_head(fields.shape[1])
    return [(head + "\n".join(map(" ".join, planes))).encode() for planes in words]


def read_cubes(spark: SparkSession, path: str, glob: str = "*.cube", packed: bool = False) -> DataFrame:
    """``folder, mol_id, field, ix, nz, vals`` of all cube files under a folder, at any depth, by planes.

    ``folder`` is the name of a file's own folder, ``field`` the file's name without its ending,
    and ``mol_id`` the first number in the folder's name, null without one."""
    own = F.element_at(F.split("folder", "/"), -1)
    mol = F.nullif(F.regexp_extract(own, r"(\d+)", 1), F.lit("")).try_cast("bigint")
    texts = (read_packed if packed else read_tree)(spark, path, glob).select(F.col("content").cast("string").alias("value"), own.alias("folder"), mol.alias("mol_id"), F.regexp_replace("name", r"\.[^.]*$", "").alias("field"))
    return parse_cubes(texts)


def read_esp_logs(spark: SparkSession, path: str, unit: str, glob: str = "*.log") -> DataFrame:
    """Extrema of all logs under a folder, at any depth, as parse_esp_logs() gives them, by
    ``path``, the log's path from the folder on."""
    logs = read_tree(spark, path, glob)
    return parse_esp_logs(logs.select(F.concat_ws("/", F.nullif("folder", F.lit("")), "name").alias("path"), F.col("content").cast("string").alias("value")), "path", unit)


def parse_esp_logs(logs: DataFrame, key: str, unit: str) -> DataFrame:
    """``key, low_value, low_x.., high_value, high_x.., unit``: the first match of each sentence in
    a log; null where there is none."""
    number = r"(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)"
    out = [F.col(key)]
    for name, word in (("low", "minimum"), ("high", "maximum")):
        pattern = rf"The {word} is\s+{number}\s+at\s+{number}\s+{number}\s+{number}\s+Bohr"
        out += [F.nullif(F.regexp_extract("value", pattern, g), F.lit("")).try_cast("double").alias(f"{name}_{c}") for g, c in enumerate(("value", "x", "y", "z"), 1)]
    return logs.select(*out, F.lit(unit).alias("unit"))


def write_texts(texts: DataFrame, path: str, name: str, packed: bool = False) -> None:
    """A file ``{folder}/{name}`` for each row ``folder, value``: the trees of whole files that other programs
    read.  A null value is an empty file.  ``packed`` puts them into archives."""
    (write_packed if packed else write_tree)(texts.select("folder", F.lit(name).alias("name"), F.coalesce("value", F.lit("")).cast("binary").alias("content")), path)


def write_frontier_csv(df: DataFrame, path: str) -> None:
    """``HOMO, LUMO, Gap`` in the order of the molecules."""
    df.orderBy("mol_id").select(F.col("homo_ev").alias("HOMO"), F.col("lumo_ev").alias("LUMO"), F.col("gap_ev").alias("Gap")).write.mode("overwrite").csv(path, header=True)


def write_json_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_rejects(df: DataFrame, path: str) -> None:
    df.select(F.col("smile").alias("value")).write.mode("append").text(path)


def xyz_texts(atoms: DataFrame, comment: str = "") -> DataFrame:
    """``mol_id, value``: the molecule in XYZ format, six decimals."""
    from orbweave.operators.basis import symbols

    line = F.format_string("%s %.6f %.6f %.6f", "symbol", "x", "y", "z_c")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("atom", line.alias("line")))), lambda e: e["line"])
    return symbols(atoms).groupBy("mol_id").agg(F.count("*").alias("n"), lines.alias("l")).select("mol_id", F.concat_ws("\n", F.col("n").cast("string"), F.lit(comment), F.array_join("l", "\n")).alias("value"))


def write_xyz(atoms: DataFrame, path: str, packed: bool = False) -> None:
    """``{mol_id}/atomic_structure.xyz`` for each molecule."""
    write_texts(xyz_texts(atoms).select(F.col("mol_id").cast("string").alias("folder"), "value"), path, "atomic_structure.xyz", packed)


def write_detail_sample(df: DataFrame, path: str, n: int = 10) -> None:
    """The details of the first molecules by dense index, picked before they are built."""
    df.filter(F.col("idx") < n).write.mode("overwrite").parquet(path)
