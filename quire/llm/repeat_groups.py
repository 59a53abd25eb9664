"""Maximal repeats of a corpus, of any length, each with all its occurrences.

A string of at least `length` bytes is a maximal repeat if it occurs twice or
more and its occurrences differ in the byte before and in the byte after; the
edge of a document differs from everything. Occurrences may overlap, lie in one
document or in many.

Suffix arrays of whole texts are beyond the corpus's size, so the groups are found
from windows that repeat, by joins and windows:

1. Windows of `length` bytes are dealt by anchor as in `_repeats`; only those whose
   anchor occurs twice are looked at, and only those that occur twice stay.
2. A window is followed alike if all its occurrences have the same next byte. If
   the next window has no more occurrences, both have the same ones, shifted by one.
   Such windows in a row are a block. A block is a maximal repeat if its last window
   is not followed alike and its first one not preceded alike.
3. A maximal repeat that holds a window of a block holds the block. So longer
   repeats are sequences of blocks, and the same step is taken with two adjacent
   blocks as a window and the blocks around them as bytes, until no pair occurs
   twice.

Every row of a step is part of an occurrence of a maximal repeat, so the work
follows the size of the result. That is large for texts that repeat within themselves at every
length: a run of n equal bytes has some n * n / 2 occurrences and n steps. Windows are
told apart by 111 bits of hash, sequences of blocks by 128.

Null and empty texts, and those shorter than `length`, have no repeats. Equal rows
(doc_id and text) count once; rows that share a doc_id with different texts are
documents of their own, as are rows without a doc_id. There are no ties: every
occurrence is a row. The windows of one document that repeat are sorted in one task, which
spills. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm._repeats import Unit, _runs, _spans_hash
from quire.llm._rounds import cut
from quire.llm._text import blocks, byte_grams, spread, text_bytes

DOCUMENT = ("doc_id", "text_hash")


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values))


def _fragments(docs: DataFrame, unit: Unit) -> DataFrame:
    """Rows of windows with one anchor: document, anchor, first start, and for each window its hash and the bytes before and after it (-1 at a document's edge)."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = text_bytes(batch["text"])
            for lo, hi in blocks(offs):
                part, at = buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                g = byte_grams(part, unit.gram)
                r = _runs(unit, g, at, len(part), 0, 0)
                if r is None:
                    continue
                s = spread(r.at, r.count)
                end = s + unit.length
                doc = np.repeat(r.doc, r.count)
                before = np.where(s == at[doc], -1, part[s - 1].astype(np.int16))
                after = np.where(end == at[doc + 1], -1, np.append(part, 0)[end].astype(np.int16))
                bounds = np.append(0, np.cumsum(r.count))
                rows = pa.array(r.doc + lo)
                columns = [batch["doc_id"].take(rows), batch["text_hash"].take(rows), pa.array(r.key.view(np.int64)), pa.array(r.start), _lists(_spans_hash(g, s, end, unit.gram).view(np.int64), bounds), _lists(before, bounds), _lists(after, bounds)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "key", "first", "hashes", "before", "after"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.where(F.octet_length("text") >= unit.length).distinct().withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(work, "doc_id long, text_hash long, key long, first long, hashes array<long>, before array<short>, after array<short>")


def _first_windows(docs: DataFrame, unit: Unit) -> DataFrame:
    """Windows of bytes whose anchor occurs twice or more."""
    found = cut(_fragments(docs, unit))
    again = found.groupBy("key").count().where("count > 1").select("key")
    each = found.join(again, "key", "left_semi").select(*DOCUMENT, "key", "first", F.posexplode(F.arrays_zip("hashes", "before", "after")).alias("k", "w"))
    start = F.col("first") + F.col("k")
    around = [F.when(F.col(f"w.{c}") >= 0, F.struct(F.col(f"w.{c}").cast("long").alias("a"), F.lit(0).cast("long").alias("b"))).alias(c) for c in ("before", "after")]
    return each.select(*DOCUMENT, start.alias("at"), F.struct(F.col("key").alias("a"), F.col("w.hashes").alias("b")).alias("window"), *around, start.alias("start"), (start + unit.length).alias("end"))


def _blocks(windows: DataFrame) -> DataFrame:
    """Runs of adjacent windows that have the same occurrences: document, at, block, n (occurrences), maximal, start, end.

    windows: document, at (adjacent windows follow each other by one), window, before, after, start, end. A block's `at` is one more
    than that of the block before it only where the two are adjacent.
    """

    def alike(side: str) -> Column:
        return F.coalesce((F.count(side) == F.count("*")) & (F.min(side) == F.max(side)), F.lit(False))

    classes = windows.groupBy("window").agg(F.count("*").alias("n"), alike("before").alias("led"), alike("after").alias("followed")).where("n > 1")
    place = Window.partitionBy(*DOCUMENT).orderBy("at")
    last = lambda c: F.lag(c).over(place)
    apart = ~F.coalesce(last("at") == F.col("at") - 1, F.lit(False))
    new = apart | ~F.coalesce(last("followed") & (last("n") == F.col("n")), F.lit(False))
    marked = windows.join(classes, "window").withColumns({"apart": apart.cast("long"), "new": new.cast("long")})
    running = lambda c: F.sum(c).over(place.rowsBetween(Window.unboundedPreceding, 0))
    numbered = marked.withColumns({"zone": running("apart"), "number": running("new")})
    maximal = ~F.min_by("led", "at") & ~F.max_by("followed", "at")
    found = numbered.groupBy(*DOCUMENT, "zone", "number").agg(F.min_by("window", "at").alias("block"), F.max("n").alias("n"), maximal.alias("maximal"), F.min("start").alias("start"), F.max("end").alias("end"))
    return found.select(*DOCUMENT, (F.col("number") + F.col("zone")).alias("at"), "block", "n", "maximal", "start", "end")


def _pairs(found: DataFrame) -> DataFrame:
    """Two adjacent blocks each as a window, with the blocks around them."""
    place = Window.partitionBy(*DOCUMENT).orderBy("at")

    def near(column: str, k: int) -> Column:
        return F.when(F.lead("at", k).over(place) == F.col("at") + k, F.lead(column, k).over(place))

    both = found.select(*DOCUMENT, "at", "block", near("block", -1).alias("before"), near("block", 1).alias("next"), near("block", 2).alias("after"), "start", near("end", 1).alias("end")).where("next is not null")
    name = F.struct(F.xxhash64("block", "next").alias("a"), F.xxhash64(F.lit(1), "next", "block").alias("b"))
    return both.select(*DOCUMENT, "at", name.alias("window"), "before", "after", "start", "end")


def repeat_groups(docs: DataFrame, length: int = 50, gram: int = 24) -> DataFrame:
    """group_id, n_bytes, n_occurrences, doc_id, text_hash, start: a row for each occurrence of each maximal repeat.

    gram: bytes of an anchor, a multiple of 8 and at least a quarter of `length`. text_hash tells rows that share a doc_id apart.
    """
    windows, levels = _first_windows(docs, Unit(words=False, length=length, gram=gram, within=True)), []
    while True:
        levels.append(cut(_blocks(windows)))
        if levels[-1].isEmpty():
            break
        windows = _pairs(levels[-1])
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    name = F.concat(F.lpad(F.hex("block.a"), 16, "0"), F.lpad(F.hex("block.b"), 16, "0"))
    return every.where("maximal").select(name.alias("group_id"), (F.col("end") - F.col("start")).alias("n_bytes"), F.col("n").alias("n_occurrences"), *DOCUMENT, "start")
