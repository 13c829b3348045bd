"""Checkpoints in the folder that the cluster shares, and bounded batches."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def saved(df: DataFrame) -> DataFrame:
    """df written to spark.checkpoint.dir and read from there; a folder of our own only where that is unset on a local master."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="kmerloom-checkpoint-"))
    return df.checkpoint(eager=True)


#: Bytes of a batch that Spark hands to a Python worker.
BATCH_BYTES = 4_000_000


def bound_batches(spark: SparkSession) -> None:
    """Bound a session's Arrow batches by bytes: 10,000 long reads would be held whole. A smaller limit that was set stays."""
    now = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
