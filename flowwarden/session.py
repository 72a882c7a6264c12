"""Session defaults and materialised intermediate tables."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_created: list[str] = []
_scopes: dict[int, list[str]] = {}  # tables of the innermost block, by thread


def build_session(app_name: str = "flowwarden", master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.variant.allowDuplicateKeys", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder for materialised tables: the cluster's ``spark.checkpoint.dir``.

    A private folder is made only for a local session that names none.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    path = tempfile.mkdtemp(prefix="flowwarden-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the written table.

    Cuts lineage (a lost executor re-reads files instead of recomputing the fit) and keeps an
    intermediate that several actions need from being computed more than once.
    """
    path = new_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession, tag: str) -> str:
    """Path in the shared folder that is deleted as written tables are."""
    path = os.path.join(shared_dir(spark), "flowwarden", f"{tag}-{uuid.uuid4().hex}")
    _scopes.get(threading.get_ident(), _created).append(path)
    return path


def spread_small(df: DataFrame, key: str) -> DataFrame:
    """Give every core a share of a table stored in fewer files than there are cores.

    For expensive per-row work on small inputs.  A large table has more files than cores and is returned as
    it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if len(df.inputFiles()) < cores else df


@contextmanager
def scoped_tables(spark: SparkSession) -> Iterator[None]:
    """Delete what :func:`materialize` writes inside this block when it ends, however it ends.

    For work that is repeated while a process runs, such as a micro-batch.  Blocks of other threads keep their tables.
    """
    thread = threading.get_ident()
    outer, mine = _scopes.get(thread), []
    _scopes[thread] = mine
    try:
        yield
    finally:
        if outer is None:
            del _scopes[thread]
        else:
            _scopes[thread] = outer
        _delete(spark, mine)


def release_materialized(spark: SparkSession) -> int:
    """Delete the tables this process wrote with :func:`materialize` outside of :func:`scoped_tables`."""
    return _delete(spark, _created)


def _delete(spark: SparkSession, paths: list[str]) -> int:
    jvm = spark.sparkContext._jvm
    hadoop_conf = spark.sparkContext._jsc.hadoopConfiguration()
    count = 0
    while paths:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(hadoop_conf).delete(path, True)
        count += 1
    return count
