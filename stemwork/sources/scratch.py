"""Where tables that a job writes for itself go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode where it is unset.

    On a cluster without that setting there is no such folder, and this is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="stemwork-"))
    return f"file://{_local[0]}"


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/stemwork-core/{name}-{uuid.uuid4().hex}"


def checkpoints(spark: SparkSession) -> None:
    """A checkpoint folder where the session has none."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint."""
    checkpoints(df.sparkSession)
    return df.checkpoint()
