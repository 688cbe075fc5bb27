"""Cutting lineage where a result feeds several later jobs, and the folder for it."""

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, below ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="nametrail-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def materialized(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows survive the loss of executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
