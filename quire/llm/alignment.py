"""Alignment of two tokenizers by an event sweep over the ends of their tokens.

1. Encode. Each text is encoded by A (byte-level) and B (pieces); the union of
   both sides' token ends goes out as runs of at most `RUN` events, each with
   the byte offset where it starts. Ends follow from the ids, since a token's
   bytes are fixed, so a run is its ids.
2. Repartition by document, sort within partitions by offset.
3. Sweep. A machine streams over the runs. Its state is what has come since the
   last offset where both sides end: it puts out the groups between such
   offsets, and the links of each group. Runs of many short documents are swept
   together, as arrays.
4. Counts. A chunk of documents asks once for each id pair that it holds, with
   the number of its documents; counts are summed over chunks, their highest
   for each A id is taken, and both go back to the chunks that asked.

A pair is sent once a chunk, however many documents hold it, so that a pair in
every document is a few rows. Chunks have a fixed size, so memory doesn't grow
with the corpus.

Null or empty texts, and texts whose tokens don't give back their bytes, have no
tokens: zeros and an empty digest. Very long texts come in several runs and are
swept a run at a time. Repeated rows and rows that share a doc_id, or have none,
are documents of their own, and each counts for its pairs. Ties for the highest
count all are highest. Extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm._rounds import cut
from quire.llm._text import blocks, pack, spread, text_bytes, unpack

#: Events of one side in a row of the shuffle; bytes of text that are swept at once; bytes of text in a chunk.
RUN, SWEEP, CHUNK = 16_384, 1 << 20, 32 << 20
_EVENTS = "key long, copy long, doc_id long, at long, side int, ids binary"
_DOCS = "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_pairs int, pairs binary"


@dataclass
class Vocabulary:
    """Bytes of each token."""

    tokens: list[bytes]
    size: np.ndarray = field(init=False)
    first: np.ndarray = field(init=False)
    flat: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.size = np.array([len(t) for t in self.tokens], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(self.tokens), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[spread(self.first[ids], self.size[ids])]


class ByteLevel:
    """Side A: a byte-level vocabulary given as ranks."""

    def __init__(self, ranks: bytes, pattern: str) -> None:
        import tiktoken

        pairs = [line.split() for line in ranks.splitlines() if line]
        table = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.encoding = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        tokens = [b""] * (max(table.values()) + 1)
        for token, rank in table.items():
            tokens[rank] = token
        self.vocabulary = Vocabulary(tokens)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.encoding.encode_ordinary(" " + t) for t in texts]


class Pieces:
    """Side B: a piece vocabulary that puts a space first and falls back to bytes."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.processor = p = sentencepiece.SentencePieceProcessor(model_proto=model)
        token = lambda k: bytes([int(p.id_to_piece(k)[3:-1], 16)]) if p.is_byte(k) else b"" if p.is_control(k) or p.is_unknown(k) else p.id_to_piece(k).replace("▁", " ").encode()
        self.vocabulary = Vocabulary([token(k) for k in range(p.get_piece_size())])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.processor.encode(texts, num_threads=1)


_SIDES: dict[int, tuple[ByteLevel, Pieces]] = {}


def sides(ranks: bytes, pattern: str, model: bytes) -> tuple[ByteLevel, Pieces]:
    """Both encoders, made once in each process."""
    key = hash((ranks, pattern, model))
    if key not in _SIDES:
        _SIDES[key] = ByteLevel(ranks, pattern), Pieces(model)
    return _SIDES[key]


def _squeezed(values: np.ndarray, width: int) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pack(values, width))


def _whole(data: bytes, width: int) -> np.ndarray:
    return unpack(zstandard.ZstdDecompressor().decompress(data), width).astype(np.int64)


def exact(ids: np.ndarray, lengths: np.ndarray, vocabulary: Vocabulary, texts: list[bytes]) -> np.ndarray:
    """For each text, are its tokens' bytes its own? lengths: number of ids of each."""
    total = np.append(0, np.cumsum(vocabulary.size[ids]))
    ends = total[np.cumsum(lengths)] if len(lengths) else np.zeros(0, np.int64)
    found = vocabulary.bytes_of(ids).tobytes()
    starts = np.append(0, ends)
    return np.array([found[a:b] == t for a, b, t in zip(starts[:-1].tolist(), ends.tolist(), texts, strict=True)], bool)


def event_runs(texts: list[str | None], a: ByteLevel, b: Pieces) -> Iterator[tuple[int, int, int, np.ndarray | None]]:
    """(text, offset, side, ids) for each run of events; one without ids for a text without tokens."""
    given = [k for k, t in enumerate(texts) if t]
    full = [texts[k] for k in given]
    wanted = [b" " + t.encode() for t in full]
    kept = np.ones(len(full), bool)
    coded = []
    for side in (a, b):
        found = side.encode(full)
        lengths = np.array([len(x) for x in found], np.int64)
        ids = np.fromiter((i for x in found for i in x), np.int64, int(lengths.sum()))
        kept &= exact(ids, lengths, side.vocabulary, wanted)
        coded.append((ids, np.append(0, np.cumsum(lengths)), side.vocabulary))
    whole = set()
    for k, text in enumerate(given):
        if not kept[k]:
            continue
        whole.add(text)
        for side, (ids, first, vocabulary) in enumerate(coded):
            at = 0
            for lo in range(first[k], first[k + 1], RUN):
                run = ids[lo : min(lo + RUN, first[k + 1])]
                yield text, at, side, run
                at += int(vocabulary.size[run].sum())
    for text in range(len(texts)):
        if text not in whole:
            yield text, 0, 0, None


@dataclass
class Swept:
    """What one document has so far."""

    doc_id: int | None
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    n_links: int = 0
    bytes: int = 0
    digest: object = None
    pairs: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    def merged_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(id pairs as a * |B| + b, how many links hold each)."""
        if len(self.pairs) == 1:
            return self.pairs[0]
        if not self.pairs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        codes, back = np.unique(np.concatenate([c for c, _ in self.pairs]), return_inverse=True)
        return codes, np.bincount(back, np.concatenate([n for _, n in self.pairs]), len(codes)).astype(np.int64)


class Sweep:
    """Streams over runs in the order of document and offset."""

    def __init__(self, a: Vocabulary, b: Vocabulary) -> None:
        self.size, self.span = (a.size, b.size), len(b.tokens)
        self.cells, self.width = zip(*(self._decimal(len(v.tokens)) for v in (a, b)), strict=True)
        self.doc: Swept | None = None
        self.name: tuple | None = None
        self.open: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])  # runs since the last offset where both sides end
        self.reach = [0, 0]  # bytes since then, by side
        self.parts: list[tuple[Swept, np.ndarray, np.ndarray]] = []  # stretches that end on both sides, not yet swept
        self.held = 0
        self.done: list[Swept] = []

    @staticmethod
    def _decimal(n: int) -> tuple[np.ndarray, np.ndarray]:
        """Each id in decimal and room for one separator, and the number of digits."""
        text = [str(k).encode() for k in range(n)]
        width = np.array([len(t) for t in text], np.int64)
        return np.frombuffer(b"".join(t.ljust(int(width.max()) + 1, b"\0") for t in text), np.uint8).reshape(n, -1), width

    def run(self, name: tuple, doc_id: int | None, side: int, ids: np.ndarray | None) -> None:
        if name != self.name:
            self.close()
            self.name, self.doc = name, Swept(doc_id)
        if ids is None:
            return
        self.open[side].append(ids)
        self.reach[side] += int(self.size[side][ids].sum())
        if all(self.reach):
            self._cut()

    def _cut(self) -> None:
        """Put apart what ends at the last offset where both sides end."""
        a, b = (np.concatenate(x) for x in self.open)
        if self.reach[0] == self.reach[1]:
            ready, rest = (a, b), (a[:0], b[:0])
        else:
            ends = [np.cumsum(self.size[s][x]) for s, x in enumerate((a, b))]
            common = np.intersect1d(*ends, assume_unique=True)
            last = int(common[-1]) if len(common) else 0
            k = [int(np.searchsorted(e, last, "right")) for e in ends]
            ready, rest = (a[: k[0]], b[: k[1]]), (a[k[0] :], b[k[1] :])
        self.open = tuple([x] if len(x) else [] for x in rest)
        self.reach = [int(self.size[s][x].sum()) for s, x in enumerate(rest)]
        if len(ready[0]):
            self.parts.append((self.doc, *ready))
            self.held += int(self.size[0][ready[0]].sum())

    def close(self) -> None:
        """End the document in hand."""
        if self.doc is not None:
            if any(self.reach):
                raise RuntimeError("a document's sides have different lengths")
            self.done.append(self.doc)
        self.doc = self.name = None

    def finished(self, last: bool = False) -> list[Swept]:
        """Documents that have ended, once there is enough to sweep."""
        if last:
            self.close()
        elif self.held < SWEEP and len(self.done) < 4096:
            return []
        self._sweep()
        out, self.done = self.done, []
        return out

    def _sweep(self) -> None:
        if not self.parts:
            return
        a, b = (np.concatenate([p[k] for p in self.parts]) for k in (1, 2))
        n_a, n_b = (np.array([len(p[k]) for p in self.parts], np.int64) for k in (1, 2))
        end_a, end_b = np.cumsum(self.size[0][a]), np.cumsum(self.size[1][b])
        event = np.zeros(int(end_a[-1]) + 1, np.uint8)
        event[end_a] |= 1
        event[end_b] |= 2
        last_a, last_b = event[end_a] == 3, event[end_b] == 3  # the token that ends a group
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        groups = int(last_a.sum())
        in_a, in_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        first_b = np.cumsum(in_b) - in_b
        per_part = np.diff(np.append(group_a[np.cumsum(n_a) - n_a], groups))  # groups of each stretch
        part_of = np.repeat(np.arange(len(self.parts)), per_part)
        links = np.bincount(part_of, in_a * in_b, len(self.parts)).astype(np.int64)
        # links as codes of stretch and pair
        each = in_b[group_a]
        left = part_of[group_a] * (1 << 32) + a * self.span
        codes, many = np.unique(np.repeat(left, each) + b[spread(first_b[group_a], each)], return_counts=True)
        bounds = np.searchsorted(codes, np.arange(len(self.parts) + 1) << 32)
        # the groups in decimal
        where_a = np.arange(len(a)) + first_b[group_a]
        where_b = np.arange(len(b)) + np.cumsum(in_a)[group_b]
        width = np.zeros(len(a) + len(b), np.int64)
        cells = np.zeros((len(width), max(c.shape[1] for c in self.cells)), np.uint8)
        for k, (ids, where, last, mark) in enumerate(((a, where_a, last_a, b"|"), (b, where_b, last_b, b";"))):
            w = self.width[k][ids]
            text = self.cells[k][ids]
            text[np.arange(len(ids)), w] = np.where(last, mark[0], b","[0])
            cells[where, : text.shape[1]] = text
            width[where] = w + 1
        text = cells[np.arange(cells.shape[1]) < width[:, None]].tobytes()
        ends = np.append(0, np.cumsum(width))[np.append(0, np.cumsum(n_a + n_b))]
        for k, (doc, ids, _) in enumerate(self.parts):
            piece = text[ends[k] : ends[k + 1] - 1]
            if doc.digest is None:
                doc.digest = hashlib.sha256(piece)
            else:
                doc.digest.update(b";" + piece)
            doc.n_a += int(n_a[k])
            doc.n_b += int(n_b[k])
            doc.n_groups += int(per_part[k])
            doc.n_links += int(links[k])
            doc.bytes += int(self.size[0][ids].sum())
            lo, hi = bounds[k], bounds[k + 1]
            doc.pairs.append((codes[lo:hi] & 0xFFFFFFFF, many[lo:hi].astype(np.int64)))
        self.parts, self.held = [], 0


def _pair_bytes(codes: np.ndarray, many: np.ndarray) -> bytes:
    """Sorted codes as steps, and the number of links of each."""
    return zstandard.ZstdCompressor(level=1).compress(pack(np.diff(codes, prepend=0), 4) + pack(many, 4))


def _pairs_of(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    return np.cumsum(unpack(raw[: 4 * n], 4).astype(np.int64)), unpack(raw[4 * n :], 4).astype(np.int64)


def align(docs: DataFrame, ranks: str, pattern: str, model: str) -> DataFrame:
    """Documents with their numbers of tokens, groups and links, the digest of their groups, and their id pairs packed, by chunk.

    ranks, model: paths of vocabulary files on the driver, a few megabytes each.
    """
    spark = docs.sparkSession
    given = spark.sparkContext.broadcast((Path(ranks).read_bytes(), pattern, Path(model).read_bytes()))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = sides(*given.value)
        place, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            _, offs = text_bytes(batch["text"])
            for lo, hi in blocks(offs):
                part = batch.slice(lo, hi - lo)
                keys, ids = part["key"].to_pylist(), part["doc_id"].to_pylist()
                copies = []
                for k in keys:  # equal rows of a partition are numbered, so that each is a document
                    copies.append(place << 32 | seen[k])
                    seen[k] += 1
                rows = [(keys[t], copies[t], ids[t], at, side, None if run is None else _squeezed(run, 2)) for t, at, side, run in event_runs(part["text"].to_pylist(), a, b)]
                columns = list(zip(*rows, strict=True)) if rows else [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["key", "copy", "doc_id", "at", "side", "ids"])

    def sweep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = sides(*given.value)
        machine, chunk, filled = Sweep(a.vocabulary, b.vocabulary), TaskContext.get().partitionId() << 32, 0

        def put(found: list[Swept]) -> Iterator[pa.RecordBatch]:
            nonlocal chunk, filled
            rows = []
            for d in found:
                codes, many = d.merged_pairs()
                rows.append((chunk, d.doc_id, d.n_a, d.n_b, d.n_groups, d.n_links, d.digest.hexdigest() if d.digest else "", len(codes), _pair_bytes(codes, many)))
                filled += d.bytes
                if filled >= CHUNK:
                    chunk, filled = chunk + 1, 0
            if rows:
                kinds = (*[pa.int64()] * 6, pa.string(), pa.int32(), pa.binary())
                names = [x.split()[0] for x in _DOCS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for key, copy, doc_id, side, ids in zip(*(batch[c].to_pylist() for c in ("key", "copy", "doc_id", "side", "ids")), strict=True):
                machine.run((key, copy), doc_id, side, None if ids is None else _whole(ids, 2))
                yield from put(machine.finished())
        yield from put(machine.finished(last=True))

    events = base.mapInArrow(encode, _EVENTS)
    ordered = events.repartition("key", "copy").sortWithinPartitions("key", "copy", "at", "side")
    return ordered.mapInArrow(sweep, _DOCS)


def pair_counts(aligned: DataFrame, span: int) -> tuple[DataFrame, DataFrame]:
    """(chunk, code, n: documents of the chunk that hold the id pair linked; code, count, best: over all documents, and is the count the A id's highest?)."""

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, size = None, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                codes, n = np.unique(np.concatenate(held), return_counts=True)
                for lo in range(0, len(codes), 1 << 16):
                    part = slice(lo, lo + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes[part]), chunk, np.int64)), pa.array(codes[part]), pa.array(n[part].astype(np.int64))], ["chunk", "code", "n"])
                held.clear()

        for batch in batches:
            for c, n, pairs in zip(batch["chunk"].to_pylist(), batch["n_pairs"].to_pylist(), batch["pairs"].to_pylist(), strict=True):
                if c != chunk:
                    yield from flush()
                    chunk, size = c, 0
                if n:
                    held.append(_pairs_of(pairs, n)[0])
        yield from flush()

    asked = aligned.select("chunk", "n_pairs", "pairs").mapInArrow(ask, "chunk long, code long, n long")
    totals = asked.groupBy("code").agg(F.sum("n").alias("count")).withColumn("a", F.floor(F.col("code") / span))
    highest = F.max("count").over(Window.partitionBy("a"))  # at most as many rows as B has ids
    return asked, totals.select("code", "count", (F.col("count") == highest).alias("best"))


def alignment(docs: DataFrame, ranks: str, pattern: str, model: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    import sentencepiece

    span = sentencepiece.SentencePieceProcessor(model_file=model).get_piece_size()
    aligned = cut(align(docs, ranks, pattern, model))
    asked, totals = pair_counts(aligned, span)
    answers = asked.select("chunk", "code").join(totals, "code").select("chunk", "code", "count", "best")

    def finish(table: pa.Table, reply: pa.Table) -> pa.Table:
        codes = reply["code"].to_numpy()
        order = np.argsort(codes)
        codes, count, best = codes[order], reply["count"].to_numpy()[order], reply["best"].to_numpy(zero_copy_only=False)[order]
        sums = []
        for n, pairs in zip(table["n_pairs"].to_pylist(), table["pairs"], strict=True):
            own, many = _pairs_of(pairs.as_py(), n) if n else (np.zeros(0, np.int64),) * 2
            at = np.searchsorted(codes, own)
            sums.append((int(many[best[at]].sum()), int((many * count[at]).sum())) if n else (0, 0))
        keep = table.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
        for k, name in enumerate(("n_best", "count_sum")):
            keep = keep.append_column(name, pa.array([s[k] for s in sums], pa.int64()))
        return keep.append_column("groups_sha256", table["groups_sha256"])

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return aligned.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, schema)
