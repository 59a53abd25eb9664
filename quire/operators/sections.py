"""Which chapter a paragraph or table belongs to, and the chapters' contents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def attribute(items: DataFrame, key: str = "doc_id", order: str = "seq", heading: str = "heading") -> DataFrame:
    """Body items with the last heading before them as `section`; headings, and items before the first, go.

    heading: the chapter that the item opens, null for body items.
    """
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    placed = items.withColumn("section", F.last(heading, ignorenulls=True).over(w))
    return placed.where(F.col(heading).isNull() & F.col("section").isNotNull())


def contents(body: DataFrame, key: str = "doc_id", order: str = "seq", text: str = "text") -> DataFrame:
    """content of each section: its items' texts in order, one a line."""
    lines = F.sort_array(F.collect_list(F.struct(order, text)))
    return body.groupBy(key, "section").agg(F.array_join(F.transform(lines, lambda x: x[text]), "\n").alias("content"))


def filled(nodes: DataFrame, parts: list[DataFrame], key: str = "doc_id", order: str = "seq", node: str = "order_num") -> DataFrame:
    """nodes with `content`, one line for each item of their section, empty if there is none.

    parts: tables of key and order with `section`, `text` or both; of an item that one has the section
    of and another the text both count, and an item without either is left out. Texts are dealt out
    once, by key, and what belongs together then is found in each partition.
    """
    opened = nodes.select(key, (-1 - F.col(node)).alias(order), F.col(node).alias("section"), F.struct(*(c for c in nodes.columns if c != key)).alias("__node"))
    rows = opened
    for part in parts:
        rows = rows.unionByName(part, allowMissingColumns=True)
    items = rows.repartition(key).groupBy(key, order).agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("section", "text", "__node")))
    line = F.when(F.col("text").isNotNull(), F.struct(order, "text"))
    lines = F.transform(F.sort_array(F.collect_list(line)), lambda x: x["text"])
    found = items.where("section is not null").groupBy(key, "section").agg(F.first("__node", ignorenulls=True).alias("__node"), F.array_join(lines, "\n").alias("content"))
    return found.where("__node is not null").select(key, "__node.*", "content")


def ordinal(rows: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """Adds a place from 0 within the keys."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)
