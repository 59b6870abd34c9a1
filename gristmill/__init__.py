"""Declarative decision workflows over JSON records, and analytics over their runs, as PySpark DataFrame programs."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Lets Python workers on this machine import the package; on a cluster, submit it with --py-files."""
    root = str(Path(__file__).resolve().parent.parent)
    paths = spark.sparkContext.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(":")
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = ":".join([root, *filter(None, paths)])
    return spark


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder of spark.checkpoint.dir, which driver and executors share; in one of our own where that is unset."""
    return f"{(spark.sparkContext.getConf().get('spark.checkpoint.dir') or '/tmp/checkpoints').rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: Rows that a task gets of a table that is dealt out by its rows, about.
DEALT = 400_000


def dealt(df: DataFrame, *keys: str, most: int | None = None, of: DataFrame | None = None) -> DataFrame:
    """df dealt out by keys to as many tasks as its rows (those of ``of``) need, with ``most`` rows each, about.

    Spark joins small parts of a shuffle by their bytes, and narrow rows have few: a task would get millions of them.
    """
    return df.repartition(max(1, -(-(df if of is None else of).count() // (most or DEALT))), *keys)


def settled(df: DataFrame) -> DataFrame:
    """Computes df once and cuts its plan, in the folder of spark.checkpoint.dir; in one of our own only where that is unset."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or "/tmp/checkpoints")
    return df.checkpoint()
