"""Messages of threads as a stream: each gets the next number of its thread, once.

State, kept by Spark in its state store by thread: the next number, and the ids
of the messages that have one. A message that comes again, in the same batch, in
a later one or because a source repeats itself, gives no row. Spark keeps state
and offsets together in the query's checkpoint, so a batch that is tried again
gives the same numbers, and the log's file sink takes each batch once.

Within a batch a thread's messages are numbered by `at`, then message_id; over
batches by arrival. A null thread_id or message_id gives no row: neither can be
told apart. A thread's messages of one batch are one task's work and in its memory;
`forget` lets ids of messages go after so many hours, without which state grows
with the number of messages (some tens of bytes each).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

LOG = "thread_id string, seq long, message_id string, role string, content string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Numbering(StatefulProcessor):
    def __init__(self, forget: float | None = None) -> None:
        self.forget = None if forget is None else int(forget * 3_600_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.following = handle.getValueState("following", "seq long")
        self.known = handle.getMapState("known", "message_id string", "seq long", self.forget)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows), ignore_index=True).sort_values(["at", "message_id"], kind="stable").drop_duplicates("message_id")
        new = found[[not self.known.containsKey((m,)) for m in found["message_id"]]].copy()
        if len(new):
            first = self.following.get()[0] if self.following.exists() else 0
            new["seq"] = range(first, first + len(new))
            for message, seq in zip(new["message_id"], new["seq"], strict=True):
                self.known.updateValue((message,), (seq,))
            self.following.update((first + len(new),))
            new["thread_id"] = key[0]
            yield new[["thread_id", "seq", "message_id", "role", "content"]]

    def close(self) -> None:
        pass


def number(sent: DataFrame, forget: float | None = None) -> DataFrame:
    """thread_id, seq, message_id, role, content of a stream of thread_id, message_id, at (what orders a batch), role, content.

    Needs the RocksDB state store, which is set in the session.
    """
    sent.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = sent.where(F.col("thread_id").isNotNull() & F.col("message_id").isNotNull()).select("thread_id", "message_id", "at", "role", "content")
    mode = "None" if forget is None else "ProcessingTime"
    return rows.groupBy("thread_id").transformWithStateInPandas(Numbering(forget), LOG, "Append", mode)


def write_numbered(numbered: DataFrame, log: str, checkpoint: str) -> StreamingQuery:
    """Append what is there to a log of Parquet files."""
    return numbered.writeStream.format("parquet").option("path", log).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_log(spark: SparkSession, log: str) -> DataFrame:
    return spark.read.schema(LOG).parquet(log)
