"""Folders that the driver and every executor can reach.

The cluster names one in ``spark.checkpoint.dir``. Only a local master, whose executors are this machine, gets a
private folder where that is unset (tests); on a cluster it is an error, as a machine's own folder would be lost with it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session, as a URI or path that Spark's writers accept."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet; removed with the scope around it or when the JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, at = _at(spark, path)
    fs.deleteOnExit(at)
    if _scopes:
        _scopes[-1].append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    fs, at = _at(spark, path)
    fs.delete(at, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are deleted at the end; what must stay has its path from before."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            remove(spark, path)


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query inside go when it ends, and not once the driver happens to collect its garbage.

    For queries that write their result: a second run of the same frame would have to shuffle again.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write *df* as Parquet in the shared folder and read it back.

    This cuts the lineage (a lost executor costs no recomputation of what led here) and gives the planner the
    true size, so that it broadcasts the table only while it is below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
