"""Cutting lineage between the rounds of iterative operators."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own only where it is unset and the driver is the only machine."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="readloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """While it holds, what a query has shuffled goes as soon as it ends, not when the driver happens to collect its garbage: by then later steps have added theirs."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREED) if before is None else spark.conf.set(FREED, before)


def save(df: DataFrame, path: str, compression: str) -> None:
    """df as a Parquet table. What it shuffled goes as soon as it is written."""
    with freed_shuffles(df.sparkSession):
        df.write.option("compression", compression).parquet(path)


@contextmanager
def without_broadcasts(spark: SparkSession) -> Iterator[None]:
    """While it holds, no join side goes through the driver, however small: those of a loop's rounds add up."""
    names = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = [spark.conf.get(n, None) for n in names]
    for n in names:
        spark.conf.set(n, "-1")
    try:
        yield
    finally:
        for n, b in zip(names, before, strict=True):
            spark.conf.unset(n) if b is None else spark.conf.set(n, b)


def cut(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """df written as a Parquet table to the shared folder, and read again.

    A table outlives lost executors, is compressed and lets later scans read single columns; the folder is the cluster's to clear."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    save(df, path, compression)
    out = spark.read.schema(df.schema).parquet(path)
    _TABLES[id(out)] = weakref.ref(out), path
    return out


_TABLES: dict[int, tuple[weakref.ref, str]] = {}


def forget(*tables: DataFrame | None) -> None:
    """Removes what cut has written for tables: those of earlier rounds, on which nothing depends that isn't written itself. Others are left alone."""
    for df in tables:
        known, path = _TABLES.get(id(df), (lambda: None, ""))
        if df is not None and known() is df:
            del _TABLES[id(df)]
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def files_of(path: str):
    """pyarrow's file system of an address, and the path there: for binary files that tasks write."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
