"""Shared-folder tables used to cut lineage between stages.

Everything that must not be computed twice (generator answers, row order) is
written below the folder the cluster names in ``spark.checkpoint.dir``, so that
a lost executor re-reads it instead of re-running the stage behind it.
"""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_OWN_FOLDERS: dict[str, str] = {}
_RUN: contextvars.ContextVar[str] = contextvars.ContextVar("run", default="")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only for a local session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN_FOLDERS:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        _OWN_FOLDERS[app] = tempfile.mkdtemp(prefix="reqweave-")
    return _OWN_FOLDERS[app]


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has been written to yet."""
    return f"{_RUN.get() or shared_folder(spark) + '/reqweave'}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def run_tables(spark: SparkSession, keep: bool = False) -> Iterator[str]:
    """Tables written inside the block lie in one folder, which is removed at its end.

    Results read from them must be written before that; ``keep`` leaves the folder for looking at.
    """
    folder = f"{shared_folder(spark)}/reqweave/run-{uuid.uuid4().hex}"
    token = _RUN.set(folder)
    try:
        yield folder
    finally:
        _RUN.reset(token)
        if not keep:
            remove_folder(spark, folder)


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder on whatever file system it lies."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and continue from the written table."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
