"""Keeping an intermediate table: a reliable checkpoint, so that later plans start from its rows.

Tables that build on one another would otherwise carry their whole history in every plan.
"""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local session without one uses a folder of its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        where = sc.getConf().get("spark.checkpoint.dir")
        if not where and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset; it must name a folder that all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def kept(df: DataFrame) -> DataFrame:
    """The same rows, checkpointed in the shared folder."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The same rows, written once to a table in the shared folder and read again: rows are worked out once, and later scans read the columns they need."""
    path = f"{folder(df.sparkSession)}/tables/{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
