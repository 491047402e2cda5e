"""Staged tables: results written once to the shared folder and read back.

A staged table cuts lineage in a way that survives the loss of executors, and
gives the optimizer its true size, so that Catalyst itself broadcasts it only
while it is below ``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, which every executor can reach.

    Only in local mode, where one process does everything, the warehouse folder
    stands in for a setting that is missing.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staged"


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder; nothing is created."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and return it as a file scan."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
