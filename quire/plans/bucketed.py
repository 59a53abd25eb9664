"""Stored tables once more in a catalog, bucketed by document, for listings and attribution without a shuffle.

Tables of one `Bucketed` have the same number of buckets by the same hash of the
document, and are sorted by it in each file. A sum by document, a join of
chapters, tables and documents, and windows by document then need no exchange:
each task reads one bucket of every table. The number of buckets is the number of
tasks, so choose it for some 100 to 500 MB a bucket of the largest table.

A bucket is a hash of the document alone, so one document with a third of all
rows is a third of one task's work; sums that must not hang on it are better
taken from the store's own tables, with a partial sum before the shuffle. A null
document is in a bucket like any other and joins nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import catalog
from quire.plans.store import Store


class Bucketed:
    """Tables `prefix`_name in the session's catalog, their files below `folder`."""

    def __init__(self, spark: SparkSession, prefix: str, folder: str, buckets: int) -> None:
        self.spark, self.prefix, self.folder, self.buckets = spark, prefix, folder, buckets

    def write(self, name: str, rows: DataFrame, document: str) -> None:
        """Write a table by buckets of `document`; one of that name is replaced.

        Rows are dealt by the buckets' own hash first, so that each bucket is one
        file and a reader needs no sort.
        """
        dealt = rows.repartition(self.buckets, F.col(document)).sortWithinPartitions(document)
        dealt.write.mode("overwrite").option("path", f"{self.folder}/{name}").bucketBy(self.buckets, document).sortBy(document).saveAsTable(f"{self.prefix}_{name}")

    def table(self, name: str) -> DataFrame:
        return self.spark.table(f"{self.prefix}_{name}")

    def drop(self) -> None:
        """Take the tables out of the catalog; their files stay."""
        for name in ("documents", "chapters", "tables", "cells"):
            self.spark.sql(f"drop table if exists {self.prefix}_{name}")

    def listing(self) -> DataFrame:
        return catalog.listing(*(self.table(n) for n in ("documents", "chapters", "tables")))

    def children(self) -> DataFrame:
        """doc_id, parent_id, parent_title, id, order_num, title of every chapter below another one: parents are in the children's bucket.

        The join has a second key beside the document, so Spark leaves the exchange out only where the session
        has `spark.sql.requireAllClusterKeysForCoPartition` set to false.
        """
        chapters = self.table("chapters")
        parents = chapters.select("doc_id", F.col("id").alias("parent_id"), F.col("title").alias("parent_title"))
        return chapters.join(parents, ["doc_id", "parent_id"]).select("doc_id", "parent_id", "parent_title", "id", "order_num", "title")


def publish(store: Store, prefix: str, folder: str, buckets: int = 200) -> Bucketed:
    """The present version of a store as bucketed tables."""
    version, made = store.version(), Bucketed(store.spark, prefix, folder, buckets)
    for name in ("documents", "chapters", "tables", "cells"):
        made.write(name, store.table(name, version=version), "id" if name == "documents" else "doc_id")
    return made
