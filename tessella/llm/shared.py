"""Helpers that the operators of this package share: cut lineage, free names, row keys."""

from __future__ import annotations

import atexit
import gc
import os
import re
import shutil
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the row contracts: space, tab, LF, VT, FF, CR.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where that setting is missing a folder of our own is set for the session:
    one beside the warehouse, which is shared as well. A warehouse on this machine's
    disk is taken in local mode only.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        local = warehouse.startswith(("file:", "/"))
        if local and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"{warehouse.rstrip('/')}/_tessella-{os.getpid()}-{uuid.uuid4().hex[:8]}"
        if local:
            folder = Path(re.sub("^file:/*", "/", found))
            folder.mkdir(parents=True, exist_ok=True)
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str, scratch: Scratch | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if scratch is not None:
        scratch.paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables between the steps of one job; drop() removes those that no result reads any more."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def drop(self, keep: int = 0) -> None:
        """Remove all tables but the ``keep`` last ones, and let Spark drop the shuffle files of steps that are done."""
        context = self.spark.sparkContext
        gone = self.paths[: len(self.paths) - keep]
        for path in gone:
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
        self.paths = self.paths[len(gone) :]
        gc.collect()
        context._jvm.System.gc()


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have (Spark's names ignore case)."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name += "_"
    return name


def lower_ascii(column):
    """A-Z become a-z and nothing else changes, unlike lower()."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
