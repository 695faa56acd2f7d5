"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one serves only a session on one machine."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), "driftline-checkpoints"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` without its lineage, for steps of a few rounds."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


_FOLDERS: set[str] = set()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, for loops of many rounds.

    Sizes that the planner goes by are those of the files; a checkpoint keeps
    estimates, which multiply from round to round. The tables go when the
    driver ends.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    folder = f"{checkpoint_folder(spark)}/rounds-{context.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)

        def remove() -> None:
            if context._jsc is not None and not context._jsc.sc().isStopped():
                path = context._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)

        atexit.register(remove)
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
