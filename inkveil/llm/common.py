"""Shared plumbing of the corpus operators: inputs, shared storage, Arrow helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

_scratch: list[list[str]] = []
_own_dirs: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Only where that is unset and everything runs in one process (tests) a temporary folder is
    made, one for each application; on a cluster it has to be set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_dirs:
            _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="inkveil-shared-")
        path = _own_dirs[app]
    return path.rstrip("/")


def shared_path(spark: SparkSession, label: str, lasting: int = 0) -> str:
    """A new name in the shared folder; within ``scratch`` it is deleted at the end (lasting: of so many levels further out)."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if len(_scratch) > lasting:
        _scratch[-1 - lasting].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes what was staged within, so results have to be written before it ends.

    Without it staged folders stay, as the frames that operators return read them.
    """
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def staged(df: DataFrame, label: str, lasting: int = 0) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage and computes df once.

    A lost executor costs only its unfinished tasks, as the files outlive it.
    """
    spark = df.sparkSession
    path = shared_path(spark, label, lasting)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Smaller Arrow batches than the default of 10,000 rows, as texts are long; other settings stay."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, rows)


def keyed_texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty) only, whatever further columns the table has."""
    small_batches(docs.sparkSession)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *more,
    )


def batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], type=f.type) for f in schema], schema=schema
    )


def pieces_of(batches, rows: int = 0, size: int = 16 << 20, column: str = "text"):
    """Splits Arrow batches so that each part's texts stay near ``size`` bytes.

    A single longer text is a part of its own; nothing is cut.
    """
    for b in batches:
        col = b.column(b.schema.get_field_index(column))
        lengths = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, n in enumerate(lengths):
            if i > start and (total + n > size or (rows and i - start >= rows)):
                yield b.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        if b.num_rows > start:
            yield b.slice(start)
