"""Helpers that several operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a table that is broadcast after its size has been counted.
BROADCAST_ROWS = 200_000


def sized(table: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """table for a join: broadcast if a count shows at most `bound` rows."""
    return F.broadcast(table) if table.limit(bound + 1).count() <= bound else table


def new_folder(session: SparkSession) -> str:
    """A new folder in the checkpoint folder that executors share; where none is set, only a local session makes one."""
    sc = session.sparkContext
    if not sc.getCheckpointDir():
        folder = session.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"


def stable(df: DataFrame) -> DataFrame:
    """df written as a table in the checkpoint folder that executors share, and read from there: computed once, with no lineage to replay."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
