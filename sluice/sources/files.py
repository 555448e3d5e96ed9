"""Folders of whatever file system a path names, through Hadoop."""

from __future__ import annotations

from pyspark.sql import SparkSession


def opened(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def names(spark: SparkSession, path: str) -> list[str]:
    """Entries of a folder, hidden ones left out; none if there is no such folder."""
    fs, p = opened(spark, path)
    found = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(n for n in found if n[0] not in "._")


def size(spark: SparkSession, path: str) -> int:
    fs, p = opened(spark, path)
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def delete(spark: SparkSession, path: str) -> bool:
    fs, p = opened(spark, path)
    return fs.delete(p, True)
