"""Where intermediate results go: a folder that every executor can reach."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Spark's own setting: shuffle files of a statement go when it ends, not when the driver next collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Paths written by this process, and those written while the innermost ``written_alone`` of this thread runs.
_WRITTEN: list[str] = []
_OWN: ContextVar[list[str] | None] = ContextVar("own", default=None)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``, known to ``delete_written``; on a local master a temporary folder is set there if it is unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="acrework-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    if (own := _OWN.get()) is not None:
        own.append(path)
    return path


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside are deleted as soon as it ends; the session's setting is then as before."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, name: str, codec: str = "snappy") -> tuple[DataFrame, str]:
    """Write ``df`` once; the written table, where lineage starts anew, and its path."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    with shuffles_end(spark):
        df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and go on from the written table, so that a lost executor never restarts the whole chain."""
    return written(df, name)[0]


def written_alone(df_of, spark: SparkSession, name: str, codec: str = "zstd") -> DataFrame:
    """Write what ``df_of()`` returns and delete all tables that it wrote to compute it.

    What other threads write meanwhile is theirs and stays.
    """
    outer, own = _OWN.get(), []
    token = _OWN.set(own)
    try:
        out, path = written(df_of(), name, codec)
    finally:
        _OWN.reset(token)
    if outer is not None:
        outer.append(path)
    delete = [p for p in own if p != path]
    if delete:
        delete_written(spark, *delete)
    return out


def delete_written(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that nothing reads any more; without paths, all that this process wrote.

    To be called when the results that read them have been stored.
    """
    for path in paths or tuple(_WRITTEN):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        if path in _WRITTEN:
            _WRITTEN.remove(path)
