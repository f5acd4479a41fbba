"""Where lineage is cut: the shared folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where it is unset."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut off from its lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written once as Parquet in the shared folder, and read from there."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over as many tasks as a shuffle has, where each row makes much work and its files are few."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
