"""What the operators of this folder share: tables, Arrow batches, shipped code, shared folders."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession

import voxtally
from voxtally.session import ensure_checkpoint_dir, written

__all__ = ["file_store", "free_name", "map_batches", "put_file", "read_table", "shared_folder", "ship", "written"]

#: Rows and bytes of an Arrow batch. Texts may be long, so a batch is far below Spark's 10,000 rows and 64 MB.
BATCH_ROWS = 512
BATCH_BYTES = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send the library to the executors, once per application, as ``--py-files`` would."""
    context = spark.sparkContext
    if getattr(context, "_voxtally_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(voxtally.__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="voxtally-code-"), "voxtally.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("voxtally", os.path.relpath(path, root)))
    context.addPyFile(archive)
    context._voxtally_shipped = True


def map_batches(
    df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """``mapInArrow`` with small batches and the library at hand on the executors."""
    ship(df.sparkSession)
    small_batches(df.sparkSession)
    return df.mapInArrow(function, schema)


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches for the session. Spark reads these settings when a job starts, so they stay on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table does not have, whatever the case of its letters."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the checkpoint folder, which all executors see; it is not made yet."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def file_store(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The store of a path as executors see it, and the path within it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pa.fs.FileSystem.from_uri(path)


def put_file(path: str, parts: list[bytes]) -> None:
    """Write a whole file under its name, or nothing: a lost task leaves no half file behind a good name."""
    store, name = file_store(path)
    store.create_dir(name.rsplit("/", 1)[0], recursive=True)
    attempt = f"{name}.{uuid.uuid4().hex}.attempt"
    with store.open_output_stream(attempt) as out:
        for part in parts:
            out.write(part)
    store.move(attempt, name)
