"""Folders and tables that all executors see."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir. Where that is unset, a temporary one, but only if all tasks run in this process's machine."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not root:
        known = context._jsc.sc().getCheckpointDir()
        if known.isDefined():
            root = known.get()
        elif re.match(r"local(\[|$)", context.master):
            root = f"file://{tempfile.mkdtemp(prefix='cueloom-')}"
            context.setCheckpointDir(root)
        else:
            raise RuntimeError("spark.checkpoint.dir is not set: executors need a folder that all of them see")
    return f"{root.rstrip('/')}/cueloom-{uuid.uuid4().hex}"


#: Folders made in each open ``scratch``, the innermost last.
_OPEN: list[list[str]] = []


def removed_at_exit(spark: SparkSession, path: str) -> None:
    """Have the file system delete ``path`` when the driver ends, or when the ``scratch`` around the call does."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    if _OPEN:
        _OPEN[-1].append(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """A block whose shared tables are deleted at its end: run a query in it and write its result there."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
            files.delete(folder, True)
            files.cancelDeleteOnExit(folder)


def shared_table(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: cuts lineage, survives lost executors. It is there until the driver, or the ``scratch`` around the call, ends."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    removed_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)
