"""Intermediate tables in the folder that the driver and all executors share.

A step whose result several later steps read is written once as Parquet below ``spark.checkpoint.dir``. Unlike a
cached or locally checkpointed frame it survives lost executors, and a join on it is a plain shuffle that adaptive
execution can split when one key is hot. A table is deleted when the JVM ends, or earlier by `drop`.
"""

from __future__ import annotations

import functools
import shutil
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; with a local master and no such setting, a temporary folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="fiscalspark-llm-"))
    return f"file://{_local[0]}"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/fiscalspark-llm/{name}-{uuid.uuid4().hex}"


def _filesystem(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def delete_at_end(spark: SparkSession, path: str) -> None:
    files, place = _filesystem(spark, path)
    files.deleteOnExit(place)


def drop(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        files, place = _filesystem(spark, path)
        files.delete(place, True)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session, so that they need no copy of their own."""
    context = spark.sparkContext
    if not getattr(context, "_fiscalspark_shipped", False):
        package = Path(__file__).resolve().parents[1]
        target = Path(tempfile.mkdtemp(prefix="fiscalspark-package-")) / package.name
        context.addPyFile(shutil.make_archive(str(target), "zip", package.parent, package.name))
        context._fiscalspark_shipped = True


def with_package(function: Callable) -> Callable:
    """A function of (session, ...) that ships the package first."""
    @functools.wraps(function)
    def run(spark: SparkSession, *args):
        ship_package(spark)
        return function(spark, *args)
    return run


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write the frame and read it back."""
    return keep_at(df, name)[0]


def keep_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As `keep`, with the folder, for tables that are dropped before the session ends."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    delete_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path), path
