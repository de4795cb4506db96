"""Where intermediate tables go: the checkpoint folder the cluster names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the session; a fresh local one only in local mode."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root:
        if not context.getCheckpointDir():
            context.setCheckpointDir(root)
        return root
    if not context.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder all executors can reach.")
    root = tempfile.mkdtemp(prefix="tablereview-")
    context.setCheckpointDir(root)
    return root


_scopes: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark).rstrip('/')}/tablereview/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Scratch tables written inside are deleted at the end, also after an error.

    Results that read them have to be written or collected inside. Tables of an inner scope go at its
    end; without a scope they stay until the shared folder is cleaned.
    """
    _scopes.append([])
    try:
        yield
    finally:
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in _scopes.pop():
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)


def materialize(df: DataFrame) -> DataFrame:
    """Compute once into the shared folder and cut the lineage there."""
    scratch_root(df.sparkSession)
    return df.checkpoint(eager=True)


def store(
    df: DataFrame,
    name: str,
    partition_by: tuple[str, ...] = (),
    schema: StructType | None = None,
) -> DataFrame:
    """Write a table into the shared folder and read it back: later passes are
    column-pruned scans that no lost executor can undo. ``schema`` reads it under
    other types of the same storage."""
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(schema or df.schema).parquet(path)


#: Session setting: into how many pieces tables are dealt before operators that pass over them many times.
PIECES = "spark.tablereview.pieces"


def spread(df: DataFrame) -> DataFrame:
    """Deal a table that lies in few pieces, if the session asks for it with ``PIECES``.

    One big row group keeps all but one core idle in each pass, which only matters for tables of a
    few files. Unless the setting is given, every table is read as it lies, whatever its size.
    """
    pieces = int(df.sparkSession.conf.get(PIECES, None) or 0)
    if not pieces or len(df.inputFiles()) >= pieces:
        return df
    return store(df.repartition(pieces), "spread")
