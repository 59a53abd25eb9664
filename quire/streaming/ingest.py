"""Files that land in a folder are ingested as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from quire.plans.store import Store
from quire.sources.docx import with_hash


def stream_folder(spark: SparkSession, folder: str, store: Store, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Each micro-batch is one Store.add, which is idempotent, so a batch that is tried again does no harm."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.[dD][oO][cC][xX]").load(folder)

    def add(batch: DataFrame, _: int) -> None:
        rows = with_hash(batch).persist()
        if not rows.isEmpty():
            store.add(rows)
        rows.unpersist()

    writer = files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
