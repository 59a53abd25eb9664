"""Noise removal among a document's body items: contents regions, blank paragraphs, template lines."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.text import blank, template_line

#: Template noise is looked for in so many paragraphs at either end.
EDGE = 3


def field_depth(marks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds depth: open fields after each paragraph that holds field marks, never below zero.

    A mark e takes the depth x to max(0, x + e). Such steps x -> max(a, x + b)
    compose to one of their kind, so a paragraph's marks are one step and the
    steps before it are one: their sum, less the least that a sum came to below
    zero. Two running windows give both, whatever the number of marks.
    """
    w = Window.partitionBy(key).orderBy("seq")
    walk = F.aggregate("fld_events", F.struct(F.lit(0).alias("sum"), F.lit(0).alias("least")), lambda acc, e: F.struct((acc["sum"] + e).alias("sum"), F.least(acc["least"], acc["sum"] + e).alias("least")))
    stepped = marks.withColumn("__walk", walk).withColumn("__sum", F.sum("__walk.sum").over(w))
    lowest = F.min(F.col("__sum") - F.col("__walk.sum") + F.col("__walk.least")).over(w)
    return stepped.withColumn("depth", (F.col("__sum") - F.least(F.lit(0), lowest)).cast("int")).drop("__walk", "__sum")


def contents_regions(items: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds in_contents: contents-field paragraphs and those in their results.

    items: key, seq, kind ('p' or 'tbl'), is_toc, fld_events (array of +1 and -1).
    Field depth carries over paragraphs, and a contents field that stays open
    drops what follows until the depth falls below where it began. Where a region
    begins depends on where the one before has ended, so the paragraphs that hold
    marks are gone through once, sorted, with two numbers as state; the others
    take what the last of these left.
    """
    toc, events = F.coalesce("is_toc", F.lit(False)), F.coalesce("fld_events", F.array().cast("array<int>"))
    marks = items.where((F.col("kind") == "p") & (toc | (F.size(events) > 0))).select(F.col(key), F.col("seq").cast("int").alias("seq"), toc.alias("is_toc"), events.alias("fld_events"))
    deep = field_depth(marks, key).select(F.col(key), "seq", "is_toc", "depth")
    schema = f"{key} {items.schema[key].dataType.simpleString()}, seq int, gone boolean, open boolean"

    def regions(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        document, begun = object(), None  # begun: the depth where the open region began
        for batch in batches:
            gone, still = [], []
            for own, contents, depth in zip(batch[key].to_pylist(), batch["is_toc"].to_pylist(), batch["depth"].to_pylist(), strict=True):
                if own != document:
                    document, begun = own, None
                gone.append(begun is not None or contents)
                if begun is not None:
                    begun = None if depth < begun else begun
                elif contents and depth > 0:
                    begun = depth
                still.append(begun is not None)
            yield pa.RecordBatch.from_arrays([batch[key], batch["seq"], pa.array(gone, pa.bool_()), pa.array(still, pa.bool_())], [key, "seq", "gone", "open"])

    found = deep.repartition(key).sortWithinPartitions(key, "seq").mapInArrow(regions, schema)
    joined = items.join(found, [key, "seq"], "left")
    before = F.last("open", ignorenulls=True).over(Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    inside = (F.col("kind") == "p") & F.coalesce(F.col("gone"), before, F.lit(False))
    return joined.withColumn("in_contents", inside).drop("gone", "open")


def template_noise(items: DataFrame, key: str = "doc_id", order: str = "seq", template: Column | None = None) -> DataFrame:
    """Adds is_noise: a template line among the first or last paragraphs of its document. template: is it such a line, if its text doesn't say so."""
    template = template_line(F.col("text")) if template is None else template
    w = Window.partitionBy(key, "kind")
    at, total = F.row_number().over(w.orderBy(order)), F.count("*").over(w)
    edge = (at <= EDGE) | (at > total - EDGE)
    return items.withColumn("is_noise", (F.col("kind") == "p") & edge & F.coalesce(template, F.lit(False)))


def select_body(items: DataFrame, key: str = "doc_id", template: Column | None = None, empty: Column | None = None) -> DataFrame:
    """Items that stay, with para_index over the paragraphs among them. template, empty: what is told of items that are without their text."""
    marked = contents_regions(template_noise(items, key, template=template), key)
    empty = blank(F.col("text")) if empty is None else empty
    kept = marked.where((F.col("kind") != "p") | ~(F.col("in_contents") | F.col("is_noise") | empty)).drop("in_contents", "is_noise")
    number = F.row_number().over(Window.partitionBy(key, "kind").orderBy("seq")) - 1
    return kept.withColumn("para_index", F.when(F.col("kind") == "p", number))
