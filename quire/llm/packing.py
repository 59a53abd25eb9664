"""Token ids and packed sequences: best-fit-decreasing with a segment tree over capacities.

Documents are encoded with a byte-level vocabulary of ranks, so that every text
has ids and its ids give it back, and cut into pieces of at most `length`
tokens, without loss. Pieces are packed from the longest to the shortest, each
into the open sequence with the least free space that holds it; a segment tree
over free sizes finds it. Each packed sequence is a row of the id matrix, padded
with `pad`, by default the first id after the vocabulary's, with its cumulative
segment lengths, the position of every token, which starts again at zero with
every segment, and `resets`, the places where it does. Segments name their
document and the offset in it. `write_ids` writes the matrices as plain files.

Documents are dealt to buckets of bounded size by a hash of doc_id and text, so
that one id or null ids in most rows spread too; each bucket is packed on its
own, so the loss against packing everything at once is at most a few open
sequences a bucket. Null or empty texts have no tokens and no segment. Null
doc_id: a value like others. Repeated rows are packed each, wholly equal ones in
one bucket; pieces of equal size keep the order of ids and texts. Very long texts are cut into as many full
pieces as they need. Extra columns are ignored. An empty table gives an empty
result.
"""

from __future__ import annotations

import base64
import math
import uuid
from collections.abc import Iterable
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm._rounds import clamp, sorted_chunk

SCHEMA = "bucket int, row int, n_tokens int, ids binary, cu_lengths array<int>, positions binary, resets array<int>, segments array<struct<doc_id:long,offset:long,n:int>>"


_ENCODINGS: dict[int, tiktoken.Encoding] = {}


def encoding(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file (a base64 token and its rank in each line), once in a process."""
    key = hash((ranks, pattern))
    if key not in _ENCODINGS:
        parts = (line.split() for line in ranks.splitlines() if line)
        _ENCODINGS[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks={base64.b64decode(t): int(r) for t, r in parts}, special_tokens={})
    return _ENCODINGS[key]


class Capacities:
    """Segment tree over free sizes 0..most: how many open sequences have each size, and the least size that holds a piece."""

    def __init__(self, most: int) -> None:
        self.leaves = 1 << max(1, most.bit_length())
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, free: int, sequence: int) -> None:
        self.open[free].append(sequence)
        self._add(free, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(free size, sequence) of least free size from `need` on."""
        node = need + self.leaves
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        free = node - self.leaves
        self._add(free, -1)
        return free, self.open[free].pop()

    def _add(self, free: int, n: int) -> None:
        node = free + self.leaves
        while node:
            self.count[node] += n
            node >>= 1


def best_fit_decreasing(sizes: Iterable[int], length: int) -> list[list[int]]:
    """Sequences as lists of piece numbers; pieces of equal size keep their order."""
    sizes = list(sizes)
    free, out = Capacities(length), []
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        if found := free.take(sizes[k]):
            left, sequence = found
            out[sequence].append(k)
        else:
            left, sequence = length, len(out)
            out.append([k])
        if left - sizes[k]:
            free.put(left - sizes[k], sequence)
    return out


def pack_documents(bucket: int, ids: list[int | None], tokens: list[np.ndarray], length: int, pad: int) -> pa.Table:
    pieces = [(d, at, min(length, len(t) - at)) for d, t in enumerate(tokens) for at in range(0, len(t), length)]
    packed = best_fit_decreasing([n for _, _, n in pieces], length)
    columns: list[list] = [[] for _ in range(6)]
    for members in packed:
        row, place, ends = np.full(length, pad, "<u4"), np.zeros(length, "<u4"), [0]
        for k in members:
            d, at, n = pieces[k]
            row[ends[-1] : ends[-1] + n] = tokens[d][at : at + n]
            place[ends[-1] : ends[-1] + n] = np.arange(n)
            ends.append(ends[-1] + n)
        segments = [{"doc_id": ids[pieces[k][0]], "offset": pieces[k][1], "n": pieces[k][2]} for k in members]
        for column, value in zip(columns, (ends[-1], row.tobytes(), ends, place.tobytes(), ends[:-1], segments), strict=True):
            column.append(value)
    segment = pa.struct([("doc_id", pa.int64()), ("offset", pa.int64()), ("n", pa.int32())])
    kinds = [pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int32()), pa.list_(segment)]
    numbers = [pa.array([bucket] * len(packed), pa.int32()), pa.array(range(len(packed)), pa.int32())]
    return pa.Table.from_arrays([*numbers, *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["bucket", "row", "n_tokens", "ids", "cu_lengths", "positions", "resets", "segments"])


def packing(docs: DataFrame, vocabulary: str, pattern: str, length: int = 2048, pad: int | None = None, bucket_bytes: int | None = None) -> DataFrame:
    """bucket, row, n_tokens, ids and positions (little-endian unsigned 32-bit, filled up to `length`), cu_lengths, resets, segments.

    vocabulary: path of a rank file on the driver; pattern: how texts are split before merging.
    """
    content = Path(vocabulary).read_bytes()
    ranks = docs.sparkSession.sparkContext.broadcast(content)  # a megabyte, whatever the corpus
    pad = encoding(content, pattern).max_token_value + 1 if pad is None else pad
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = math.ceil(total / (bucket_bytes or clamp(total / 2**18, 2 << 20, 64 << 20))) or 1

    def work(table: pa.Table) -> pa.Table:
        bucket = table["chunk"][0].as_py()
        table, _ = sorted_chunk(table)
        encode = encoding(ranks.value, pattern).encode_ordinary
        tokens = [np.array(encode(t.as_py() or ""), "<u4") for t in table["text"]]
        return pack_documents(bucket, table["doc_id"].to_pylist(), tokens, length, pad)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int").alias("chunk"), "doc_id", "text")
    return dealt.groupBy("chunk").applyInArrow(work, SCHEMA)


def write_ids(packed: DataFrame, path: str) -> None:
    """Plain files of row-major unsigned 32-bit matrices, ids-<bucket>.u32 and positions-<bucket>.u32, and the rest as Parquet in index.

    path: a folder that driver and executors share, as a URI or an absolute path. A bucket's
    files are written under another name and then renamed, so a task that is run again does no harm.
    """

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        files, folder = fs.FileSystem.from_uri(path)
        files.create_dir(folder, recursive=True)
        bucket = table["bucket"][0].as_py()
        for name in ("ids", "positions"):
            target = f"{folder}/{name}-{bucket:06}.u32"
            part = f"{folder}/.{name}-{bucket:06}-{uuid.uuid4().hex}"
            with files.open_output_stream(part) as out:
                for x in table[name]:
                    out.write(x.as_py())
            files.move(part, target)
        return table.drop_columns(["ids", "positions"])

    rest = packed.drop("ids", "positions").schema
    packed.groupBy("bucket").applyInArrow(work, rest).write.parquet(f"{path}/index")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """bucket, name (ids or positions), content: the matrices that `write_ids` wrote; the index is plain Parquet."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.u32").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.regexp_extract(name, r"-(\d+)", 1).cast("int").alias("bucket"), F.regexp_extract(name, r"^\w+", 0).alias("name"), "content")
