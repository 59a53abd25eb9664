"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEAN = ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.shuffleDependency.fileCleanup.enabled")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names; one of our own only where none is named and all runs in one process, as in tests."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="quire-checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, shuffle files of a finished query are removed at once instead of at some later collection."""
    was = {}
    for key in _CLEAN:
        try:
            was[key] = spark.conf.get(key, None)
            spark.conf.set(key, "true")
        except Exception:  # a key that this Spark version doesn't have
            was.pop(key, None)
    try:
        yield
    finally:
        for key, value in was.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


class Scratch:
    """Tables of one job in the shared folder: written, read again, and deleted together when the job is done."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.path, self.tables = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}", 0

    def cut(self, df: DataFrame) -> DataFrame:
        """Write `df` and go on from what was written."""
        self.tables += 1
        place = f"{self.path}/{self.tables}"
        with shuffles_dropped(self.spark):
            df.write.option("compression", "zstd").parquet(place)
        return self.spark.read.schema(df.schema).parquet(place)

    def close(self) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()
