"""Cutting lineage with checkpoints in the folder the cluster names."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the folder of ``spark.checkpoint.dir``, its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from the session; one on this machine is set only where the session is local and names none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="qk-ckpt-"))
    return sc.getCheckpointDir()


def spread(df: DataFrame, rows_a_task: int = 100_000) -> DataFrame:
    """``df`` in as many partitions as give each about ``rows_a_task`` rows; as it is where it has so many already.

    For frames that are read again and again: a file of one row group, however long, is otherwise read by one task each time.
    """
    parts = -(-df.count() // rows_a_task)
    return df if parts <= df.rdd.getNumPartitions() else df.repartition(parts)
