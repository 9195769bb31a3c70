"""The folder that driver and executors share, and tables cut from their lineage in it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset: on one machine (a local master, as in tests) the warehouse; on a cluster an error, since no folder is known to be shared."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.sparkContext.master.startswith("local"):
        root = spark.conf.get("spark.sql.warehouse.dir")
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return root.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """A copy of df in a table of its own in the shared folder, which survives the loss of any executor.

    A written table, not checkpoint(): what is read back has the size of its files, while a checkpoint keeps the estimate of the plan it was made by, which loops that join
    with themselves square in each round.
    """
    path = f"{shared_root(df.sparkSession)}/cut-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
