"""What needs a setting of the session, and tables that are kept in the folder that a cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, one of its own on a single machine, and an error on a cluster, whose machines would each write to theirs."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="tradewind-"))
        found = _OWN[0]
    return found.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    """A name for a new folder there."""
    return f"{shared_folder(spark)}/tradewind-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def kept(frame: DataFrame) -> DataFrame:
    """`frame` from a checkpoint, which cuts its lineage, in the shared folder."""
    spark = frame.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return frame.checkpoint()
