"""Cutting lineage through a folder that every executor can reach."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    The cluster names it in spark.checkpoint.dir. Only where that is unset and the
    master is local (tests, one machine) is a temporary folder made.
    """
    context = spark.sparkContext
    known = context.getCheckpointDir()
    if known:
        return known
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="pressloom-")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """`df` written once to the shared folder; later reads survive a lost executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
