"""Jobs of several stages whose outputs are kept, so that a stopped one goes on where it was, and counters of a pass."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession

#: A stage makes its output from those of the stages before it, by name.
Stage = Callable[[dict[str, DataFrame]], DataFrame]


class Files:
    """What staged jobs ask of the file system of a folder, whichever it is."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.system = self.path(folder).getFileSystem(self.conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.system.getUri(), self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def exists(self, name: str) -> bool:
        return self.system.exists(self.path(name))

    def read(self, name: str) -> str:
        stream = self.system.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Write a file beside ``name`` and put it in its place at once: readers see the old text or the new."""
        beside = f"{name}.{uuid.uuid4().hex}"
        stream = self.system.create(self.path(beside))
        stream.write(text.encode())
        stream.close()
        kind = self.jvm.org.apache.hadoop.fs.Options.Rename
        how = self.jvm.java.lang.reflect.Array.newInstance(kind.OVERWRITE.getClass(), 1)
        self.jvm.java.lang.reflect.Array.set(how, 0, kind.OVERWRITE)
        self.context.rename(self.path(beside), self.path(name), how)


def counted(df: DataFrame, path: str, counters: dict[str, Column]) -> dict[str, int]:
    """Write ``df`` to ``path``; its counters, gathered in the same pass over it."""
    seen = Observation()
    df.observe(seen, *[c.alias(name) for name, c in counters.items()]).write.mode("overwrite").parquet(path)
    return seen.get


class StagedJob:
    """Stages in order, each written below ``folder``/``version``; the version is published once all are there.

    A stage is finished when its record is there, which is written after its
    rows; what a stopped run left of a stage without one is replaced. Readers
    go by :func:`published`, so they never see half a version.
    """

    def __init__(self, spark: SparkSession, folder: str, version: str, stages: list[tuple[str, Stage]], counters: dict[str, dict[str, Column]] | None = None):
        self.spark, self.folder, self.version, self.stages, self.counters = spark, folder, version, stages, counters or {}
        self.files = Files(spark, folder)

    def _at(self, name: str) -> str:
        return f"{self.folder}/{self.version}/{name}"

    def records(self) -> dict[str, dict[str, int]]:
        """Counters of the stages that are finished, in order."""
        return {name: json.loads(self.files.read(f"{self._at(name)}.json")) for name, _ in self.stages if self.files.exists(f"{self._at(name)}.json")}

    def run(self, until: str | None = None) -> dict[str, DataFrame]:
        """The outputs by stage; those of finished stages are read, the others made, up to ``until`` if it is given."""
        from pyspark.sql import functions as F

        done, made = self.records(), {}
        for name, stage in self.stages:
            if name not in done:
                counts = counted(stage(dict(made)), self._at(name), {"rows": F.count(F.lit(1)), **self.counters.get(name, {})})
                self.files.replace(f"{self._at(name)}.json", json.dumps(counts))
            made[name] = self.spark.read.parquet(self._at(name))
            if name == until:
                return made
        self.files.replace(f"{self.folder}/PUBLISHED", self.version)
        return made


def published(spark: SparkSession, folder: str, stage: str) -> DataFrame | None:
    """A stage's output in the version that was published last; none before the first."""
    files = Files(spark, folder)
    pointer = f"{folder}/PUBLISHED"
    return spark.read.parquet(f"{folder}/{files.read(pointer)}/{stage}") if files.exists(pointer) else None
