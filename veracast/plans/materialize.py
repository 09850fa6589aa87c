"""Tables written once and read back where a plan would compute them again and again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``; set here only on a single machine that names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "/tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder: lineage ends there, and losing an executor costs no recomputation."""
    path = f"{shared_folder(df.sparkSession)}/veracast-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lazily(df: DataFrame, name: str) -> DataFrame:
    """``df`` as it is: the whole computation stays one plan."""
    return df
