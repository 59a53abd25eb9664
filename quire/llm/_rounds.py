"""Exchange rounds between chunks of documents and hash shards.

A chunk is a set of documents (chosen by a hash of doc_id) of a few megabytes.
A shard is a range of a hash space. In each round every chunk sends one packed
message to each shard that concerns it and gets one packed reply, so a key that
a third of all documents hold costs a shard one entry per chunk and no more.

The work of a chunk is a generator: it yields the messages of a round
({shard: bytes}), is sent the replies ({shard: bytes}), and returns a table in
the end. Executors keep nothing between rounds: each round replays the
generator with the replies so far. Replies are cut off from their lineage in
the shared checkpoint folder; texts are shuffled, never written.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Generator, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm._text import order_key, text_bytes
from quire.plans.shared import shared_folder, shuffles_dropped

Program = Callable[[np.ndarray, np.ndarray, np.ndarray, int], Generator[dict[int, bytes], dict[int, bytes], pa.Table]]
ShardWork = Callable[[list[bytes]], list[bytes]]

MESSAGE = "chunk int, round int, shard int, data binary"


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """Write `df` as Parquet into the shared folder and read it again; with the path."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    with shuffles_dropped(df.sparkSession):
        df.select("*").write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Delete what `stored` wrote, when nothing reads it any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def plain_names(docs: DataFrame, own: tuple[str, ...]) -> DataFrame:
    """`docs` with positional names for all columns but `own`, so that no name clashes or needs quoting."""
    return docs.toDF(*(c if c in own else f"carry{k}" for k, c in enumerate(docs.columns)))


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the cluster's shared checkpoint folder and go on from there."""
    spark = df.sparkSession
    shared_folder(spark)
    with shuffles_dropped(spark):
        return df.select("*").checkpoint(eager=True)  # a query follows the setting of the time when it was made


def clamp(x: float, lo: float, hi: float) -> int:
    return int(max(lo, min(hi, x)))


def layout(docs: DataFrame, chunk_bytes: int | None = None, shard_bytes: int | None = None) -> tuple[int, int]:
    """(chunks, shards) for the corpus. Both sizes grow with it, so that a message keeps many entries at any scale."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunk = chunk_bytes or clamp(total / 2**18, 2 << 20, 128 << 20)
    shard = shard_bytes or clamp(total / 2**17, 12 << 20, 1 << 30)
    return max(1, math.ceil(total / chunk)), max(1, math.ceil(total / shard))


def by_chunk(docs: DataFrame, chunks: int, *more: Column) -> DataFrame:
    """Documents with their chunk; repeated doc_ids fall into one chunk."""
    return docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int").alias("chunk"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def sorted_chunk(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """The rows of a chunk in an order that doesn't depend on how the shuffle delivered them."""
    table = table.append_column("__key", pa.array(order_key(table["doc_id"])))
    table = table.sort_by([("__key", "ascending"), ("text", "ascending")])
    return table, table["__key"].to_numpy()


def _replay(program: Program, table: pa.Table, replies: pa.Table | None, shards: int, last: int):
    table, ids = sorted_chunk(table)
    buf, offs = text_bytes(table["text"])
    got: list[dict[int, bytes]] = [{} for _ in range(last)]
    if replies is not None:
        for r, s, data in zip(replies["round"].to_pylist(), replies["shard"].to_pylist(), replies["data"].to_pylist(), strict=True):
            got[r][s] = data
    work = program(ids, buf, offs, shards)
    try:
        sent = next(work)
        for answer in got:
            sent = work.send(answer)
    except StopIteration as end:
        return table, end.value
    return table, sent


def _messages(chunk: int, round_no: int, sent: dict[int, bytes]) -> pa.Table:
    n = len(sent)
    return pa.table({"chunk": pa.array([chunk] * n, pa.int32()), "round": pa.array([round_no] * n, pa.int32()), "shard": pa.array(list(sent), pa.int32()), "data": pa.array(list(sent.values()), pa.binary())})


def run(docs: DataFrame, program: Program, works: Iterable[ShardWork], schema: str, chunks: int, shards: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """The tables that `program` returns for all chunks, each with its doc_id column first and the columns `carry` of `docs` last."""
    base = by_chunk(docs, chunks, *(F.col(c).alias(f"__carry{k}") for k, c in enumerate(carry)))
    replies: DataFrame | None = None
    works = list(works)

    def step(round_no: int, last: bool) -> Callable:
        def finish(table: pa.Table, answers: pa.Table | None) -> pa.Table:
            chunk = table["chunk"][0].as_py()
            table, out = _replay(program, table, answers, shards, round_no)
            if not last:
                return _messages(chunk, round_no, out)
            for k in range(len(carry)):
                out = out.append_column(f"__carry{k}", table[f"__carry{k}"])
            return out.add_column(0, "doc_id", table["doc_id"])

        def alone(table: pa.Table) -> pa.Table:
            return finish(table, None)

        def joined(table: pa.Table, answers: pa.Table) -> pa.Table:
            if not table.num_rows:
                raise RuntimeError("replies for a chunk without documents")
            return finish(table, answers)

        return alone if round_no == 0 else joined

    def shard_step(work: ShardWork, round_no: int) -> Callable:
        def answer(table: pa.Table) -> pa.Table:
            table = table.sort_by("chunk")
            out = work([x.as_py() for x in table["data"]])
            return table.set_column(table.schema.get_field_index("data"), "data", pa.array(out, pa.binary()))

        return answer

    def apply(round_no: int, last: bool, to: str) -> DataFrame:
        grouped = base.groupBy("chunk")
        if round_no == 0:
            return grouped.applyInArrow(step(0, last), to)
        return grouped.cogroup(replies.groupBy("chunk")).applyInArrow(step(round_no, last), to)

    for k, work in enumerate(works):
        answers = cut(apply(k, False, MESSAGE).groupBy("shard").applyInArrow(shard_step(work, k), MESSAGE))
        replies = answers if replies is None else replies.unionByName(answers)
    kinds = docs.select(*carry).schema
    out = apply(len(works), True, ", ".join(["doc_id long", schema, *(f"__carry{k} {f.dataType.simpleString()}" for k, f in enumerate(kinds))]))
    return out.withColumnsRenamed({f"__carry{k}": c for k, c in enumerate(carry)})
