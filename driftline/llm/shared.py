"""Helpers that the corpus operators share: Arrow batches, materialised steps, ids."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a text column that a task turns into Python objects at once.
SLICE_ROWS = 256


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which driver and executors share.

    It is ``spark.checkpoint.dir``. Where that is unset, a temporary folder
    serves a session on one machine; on a cluster it is an error.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), "driftline-checkpoints"))
    return context._jsc.sc().getCheckpointDir().get()


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


_FOLDERS: set[str] = set()


def _stored_folder(spark: SparkSession) -> str:
    """A folder of this session's own below the shared one, removed when the driver ends."""
    folder = f"{shared_folder(spark)}/tables-{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        context = spark.sparkContext

        def remove() -> None:
            if context._jsc is not None and not context._jsc.sc().isStopped():
                path = context._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)

        atexit.register(remove)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again."""
    path = f"{_stored_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused_prefix(columns: list[str]) -> str:
    """Underscores with which no column begins, for columns of a stage's own."""
    lead = max((len(c) - len(c.lstrip("_")) for c in columns), default=0)
    return "_" * (lead + 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_remainder(key: Column | str, modulus: int) -> Column:
    """crc32 of an id as text, modulo ``modulus``; a null id gives -1."""
    col = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(col.cast("string")) % modulus, F.lit(-1))


def release_memory() -> None:
    """Give what a worker has freed back to the machine, for workers live on from stage to stage."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that few long texts are Python objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null is the empty text."""
    return [t or "" for t in batch.column(name).to_pylist()]
