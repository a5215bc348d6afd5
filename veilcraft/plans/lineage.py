"""Cutting a plan's lineage where several later branches read the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: that of ``spark.checkpoint.dir``, else the session's own, else one in the warehouse.

    Where executors run on other machines and neither is set, the warehouse must not be a local folder: there it would be another one for each.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if not sc.master.startswith("local") and warehouse.startswith(("file:", "/")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = f"{warehouse}/checkpoints"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared folder, so that later steps and lost executors don't compute it again."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
