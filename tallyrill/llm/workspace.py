"""Intermediate tables in the folder that driver and executors share.

A table written here replaces ``localCheckpoint``: it survives the loss of any
executor and cuts the lineage, so later jobs do not run earlier ones again.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import ClassVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_root(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only in local mode, where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if context._jsc.sc().getCheckpointDir().isEmpty():
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="tallyrill-"))
        root = context._jsc.sc().getCheckpointDir().get()
    return root.rstrip("/")


class Workspace:
    """A private folder below the shared root."""

    #: Folders of this process, in order; ``discard`` deletes those made after some point.
    opened: ClassVar[list[str]] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.opened.append(self.path)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and return the table read again."""
        path = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later plan reads."""
        for name in names:
            _delete(self.spark, f"{self.path}/{name}")


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(spark: SparkSession, since: int) -> None:
    """Delete all workspaces opened after the first ``since``, whose results have been written elsewhere."""
    for path in Workspace.opened[since:]:
        _delete(spark, path)
    del Workspace.opened[since:]


def opened(folder: str):
    """A pyarrow file system and the path in it; any store that pyarrow can write."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("/") else f"file://{folder}".replace("file://file:", "file://"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores behind all of them as it takes to clash with no column."""
    taken, tail = {c.lower() for c in df.columns}, ""
    while any((n + tail).lower() in taken for n in names):
        tail += "_"
    return [n + tail for n in names]


def columns(df: DataFrame, *without: str) -> list[Column]:
    """The columns of any name, but for those named (in any case)."""
    gone = {c.lower() for c in without}
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c.lower() not in gone]


def mapped(df: DataFrame, function: Callable[[list[str | None]], list[pa.Array]], added: list[T.StructField], several: Callable = iter) -> DataFrame:
    """``df`` with columns that ``function`` makes of the texts of a batch; columns of any name pass (mapInArrow itself takes none with a dot)."""
    names = df.columns
    text = [c.lower() for c in names].index("text")
    safe = df.toDF(*(f"c{k}" for k in range(len(names))))
    schema = T.StructType([*safe.schema.fields, *(T.StructField(f"d{k}", f.dataType) for k, f in enumerate(added))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in several(batches):
            made = function(batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=schema.names)

    return safe.mapInArrow(task, schema).toDF(*names, *(f.name for f in added))


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that further columns of any name cannot clash."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*columns)
