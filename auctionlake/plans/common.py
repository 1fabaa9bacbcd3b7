"""Reading the tables, and small helpers for queries."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return d.select(*columns) if columns else d


def money(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(14,2)")


def big(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder that all executors share: under ``spark.checkpoint.dir``, or a temporary one in local mode only."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        top = tempfile.mkdtemp(prefix="spark-")
    return f"{top}/{label}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table that is read in few tasks, dealt over all cores before costly expressions; a table of many files stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
