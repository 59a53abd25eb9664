"""Stored tables: a registry of documents by content hash, their chapters, tables and cells, and two full-text indexes.

A batch is appended: its rows go to new files, and one small version file, which
is renamed into its place, makes them count. The version names the batches that
count, in order, and for each table whether the batch replaces documents; the
replaced ids are a table too, so that readers leave out what a later batch has
replaced. A reader sees a whole version or the one before, never half a batch,
and nothing is written but the new documents. Two writers can't make the same
version: the later one fails and may try again. `compact` writes all that counts
as one batch; files of older versions can then be deleted.

While a batch is written its documents have status `processing`; a batch that
breaks off leaves them so, with their old rows, and adding the files again
repairs it. Tables of documents are parted by blocks of documents, so that
reading one document touches its block alone; postings are parted by hash of
their trigram, so that a search touches its terms' parts alone.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from quire.operators import catalog, decisions, postings, search
from quire.plans.ingest import PER_DOCUMENT, Decider, Ingested, ingest
from quire.plans.shared import Scratch, shuffles_dropped
from quire.sources.docx import read_files

BLOCK, BUCKETS = 1000, 64
MESSAGES = "thread_id string, seq long, role string, content string, call_id string"
SCHEMAS = {
    "documents": "id long, doc_name string, doc_type string, doc_hash string, status string, error_msg string, total_chars long, create_time timestamp",
    "chapters": "id long, doc_id long, parent_id long, level int, number_prefix string, title string, content string, content_chars int, order_num int, chapter_path string, source string, confidence double, needs_review int",
    "tables": "id long, doc_id long, chapter_id long, table_caption string, total_rows int, total_cols int, order_num int, chapter_path string",
    "cells": "table_id long, doc_id long, row_idx int, col_idx int, row_span int, col_span int, content string, is_header int",
    "statistics": "doc_id long, error string, total_paragraphs long, total_chars long, candidates long, anchors long, pending long, chapters long, needs_review long, tables long",
    "postings": f"gram string, {postings.INDEX.replace('gram string, ', '')}",
}
#: Columns by which files and row groups are skipped, with a Bloom filter, of a size that fits a file's values: 1 MB halved up to ten times.
BLOOM = {"parquet.bloom.filter.adaptive.enabled": "true", "parquet.bloom.filter.enabled#{}": "true", "parquet.bloom.filter.candidates.number#{}": "11"}
SOUGHT = {"documents": "doc_hash", "postings": "gram", "chapters": "id", "tables": "id", "cells": "table_id", "statistics": "doc_id"}
#: Characters of chapters that are indexed at a time, which bounds the postings that are on their way to their buckets.
INDEXED = 1 << 27
#: The fields of both indexes.
FIELDS = {"text": search.indexed_text, "title": lambda: F.coalesce(F.col("title"), F.lit(""))}


class Conflict(RuntimeError):
    """Another writer has made the version that this one was about to make."""


@dataclass
class Version:
    """What counts: batches in order, each with its tables and with those of whose documents it replaces some; and totals of all chapters."""

    number: int = 0
    batches: list[dict] = field(default_factory=list)
    chapters: int = 0
    trigrams: int = 0

    def of(self, name: str) -> list[str]:
        return [b["batch"] for b in self.batches if name in b["tables"]]


def _key(name: str) -> str:
    return "id" if name == "documents" else "doc_id"


class Store:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    # files
    def _place(self, *parts: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return place, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> Version:
        """The version that counts now."""
        folder, fs = self._place("versions")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        names = sorted(n for n in names if n.endswith(".json") and not n.startswith("."))
        if not names:
            return Version()
        return Version(**json.loads(self.spark.read.text(f"{self.path}/versions/{names[-1]}", wholetext=True).first()[0]))

    def _commit(self, old: Version, new: Version) -> None:
        """Make `new` the version after `old`, at once or not at all."""
        new = replace(new, number=old.number + 1)
        passing, fs = self._place("versions", f".{uuid.uuid4().hex}")
        out = fs.create(passing)
        out.write(bytearray(json.dumps(new.__dict__).encode()))
        out.close()
        jvm, place = self.spark._jvm, self._place("versions", f"{new.number:012d}.json")[0]
        kinds = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(kinds, 1)
        how[0] = kinds.NONE  # fails if the name is taken
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(passing, place, how)
        except Exception as e:
            fs.delete(passing, False)
            if fs.exists(place):
                raise Conflict(f"version {new.number} is another writer's") from e
            raise

    def _batch(self, version: Version) -> str:
        """Name of a new batch: its place in the order, and what no other writer has."""
        return f"{version.number + 1:012d}-{uuid.uuid4().hex[:12]}"

    def _write(self, name: str, batch: str, rows: DataFrame) -> None:
        kind = StructType.fromDDL(SCHEMAS[name])
        part = F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)) if name == "postings" else F.floor(F.col(_key(name)) / BLOCK)
        column = "bucket" if name == "postings" else "block"
        found = rows.select(*(F.col(f.name).cast(f.dataType) for f in kind)).withColumn(column, part.cast("long"))
        found = found.hint("rebalance", column).sortWithinPartitions(column, kind.names[0])  # a large block is split over tasks
        bloom = {k.format(SOUGHT[name]): v for k, v in BLOOM.items()}
        with shuffles_dropped(self.spark):
            found.write.mode("append").options(compression="zstd", **bloom).partitionBy(column).parquet(f"{self.path}/{name}/batch={batch}")

    def _index(self, batch: str) -> tuple[int, int]:
        """Index a batch's chapters, some blocks of documents at a time: (chapters, trigrams of their texts)."""
        chapters = self._rows("chapters", [batch])
        n, total = self._totals(chapters)
        parts = max(1, -(-total // INDEXED))
        for k in range(parts):
            self._write("postings", batch, postings.build(chapters.where(F.col("block") % parts == k), {name: f() for name, f in FIELDS.items()}, k))
        return n, total

    def _rows(self, name: str, batches: list[str]) -> DataFrame:
        column = "bucket" if name == "postings" else "block"
        schema = StructType.fromDDL(SCHEMAS[name]).add(column, "long").add("batch", "string")
        if not batches:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.path}/{name}/batch={b}" for b in batches]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(*paths)

    def _replaced(self, name: str, version: Version) -> DataFrame | None:
        """doc, last: the last batch that replaces rows of the document in the table; none if no batch does."""
        first = next(iter(version.of(name)), None)
        later = [b["batch"] for b in version.batches if name in b["replaces"] and b["batch"] > (first or "")]
        if first is None or not later:
            return None
        read = self.spark.read.schema("doc long, batch string").option("basePath", f"{self.path}/replaced/{_key(name)}").parquet(*(f"{self.path}/replaced/{_key(name)}/batch={b}" for b in later))
        return read.groupBy("doc").agg(F.max("batch").alias("last"))

    def _live(self, name: str, rows: DataFrame, version: Version, doc: Column) -> DataFrame:
        replaced = self._replaced(name, version)
        if replaced is None:
            return rows
        joined = rows.withColumn("__doc", doc).join(replaced.withColumnRenamed("doc", "__doc"), "__doc", "left")
        return joined.where(F.col("last").isNull() | (F.col("batch") >= F.col("last"))).drop("__doc", "last")

    # tables
    def table(self, name: str, doc_id: int | None = None, version: Version | None = None) -> DataFrame:
        """A stored table, or its rows of one document, for which one block is read. Postings come with their batch."""
        version = version or self.version()
        rows = self._rows(name, version.of(name))
        if name == "postings":
            return rows
        if doc_id is not None:
            rows = rows.where((F.col("block") == int(doc_id) // BLOCK) & (F.col(_key(name)) == int(doc_id)))
        return self._live(name, rows, version, F.col(_key(name))).drop("block", "batch")

    def register(self, files: DataFrame) -> DataFrame:
        """doc_hash, doc_name, path, doc_id, known of each different content: the registry's id for a known one, the next free ones for new.

        Only names and hashes are shuffled; of equal files the least name and path count.
        """
        known = self.table("documents").select("doc_hash", F.col("id").alias("doc_id"))
        distinct = files.groupBy("doc_hash").agg(F.min(F.struct("doc_name", "path")).alias("f")).select("doc_hash", "f.doc_name", "f.path")
        last = known.agg(F.max("doc_id")).first()[0] or 0
        part = F.substring("doc_hash", 1, 2)  # 256 stretches of the order of hashes, numbered each
        fresh = distinct.select("doc_hash").join(known, "doc_hash", "left_anti").withColumn("part", part)
        before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ahead = fresh.groupBy("part").agg(F.count("*").alias("n")).select("part", before.alias("before"))
        within = F.row_number().over(Window.partitionBy("part").orderBy("doc_hash"))
        numbered = fresh.withColumn("within", within).join(F.broadcast(ahead), "part").select("doc_hash", (F.lit(last) + F.col("before") + F.col("within")).alias("doc_id"))  # at most 256 rows
        ids = known.withColumn("known", F.lit(True)).unionByName(numbered.withColumn("known", F.lit(False)))
        return distinct.join(ids, "doc_hash")

    def _registry(self, registered: DataFrame, old: DataFrame, statistics: DataFrame | None) -> DataFrame:
        """Rows of the registry: `processing` without statistics, else `done` or `failed` with the number of characters; names, times and, if none is given, that number stay."""
        old = old.select(F.col("id").alias("doc_id"), F.col("doc_name").alias("old_name"), F.col("create_time").alias("old_time"), F.col("total_chars").alias("old_chars"))
        found = registered.join(old, "doc_id", "left")
        if statistics is None:
            status, error, chars = F.lit("processing"), F.lit(None).cast("string"), F.col("old_chars")
        else:
            found = found.join(statistics.select("doc_id", "error", "total_chars"), "doc_id")
            status, error, chars = F.when(F.col("error").isNull(), "done").otherwise("failed"), F.col("error"), F.coalesce("total_chars", "old_chars")
        return found.select(
            F.col("doc_id").alias("id"), F.coalesce("old_name", "doc_name").alias("doc_name"), F.lit("docx").alias("doc_type"), "doc_hash",
            status.alias("status"), error.alias("error_msg"), chars.alias("total_chars"), F.coalesce("old_time", F.current_timestamp()).alias("create_time"),
        )

    def _replaces(self, batch: str, key: str, ids: DataFrame) -> bool:
        """Write the ids that a batch replaces; are there any?"""
        if ids.isEmpty():
            return False
        ids.select(F.col("doc_id").alias("doc")).write.parquet(f"{self.path}/replaced/{key}/batch={batch}")
        return True

    @staticmethod
    def _totals(chapters: DataFrame) -> tuple[int, int]:
        """(chapters, trigrams of their texts)."""
        size = F.greatest(F.lit(0), F.length(F.lower(search.indexed_text())) - (postings.GRAM - 1))
        n, total = chapters.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
        return n, total

    def add(self, files: DataFrame, decide: Decider | None = decisions.rule_decisions, typed: bool = True, parsed: Callable[[], None] | None = None) -> DataFrame:
        """Ingest files (path, content, doc_name, doc_hash) and give their statistics; the same bytes again replace what they made before. typed: as for `ingest`; parsed: called when the files have been read for the last time, and may go."""
        began = time.monotonic()
        with shuffles_dropped(self.spark), Scratch(self.spark) as scratch, Scratch(self.spark) as steps:
            start = self.version()
            registered = scratch.cut(self.register(files))
            known = registered.where("known")
            first = self._batch(start)
            self._write("documents", first, self._registry(registered, self.table("documents", version=start), None))
            over = ["documents"] if self._replaces(first, "id", known) else []
            self._commit(start, Version(batches=[*start.batches, {"batch": first, "tables": ["documents"], "replaces": over}], chapters=start.chapters, trigrams=start.trigrams))
            now = self.version()
            contents = files.join(registered.select("path", "doc_hash", "doc_id"), ["path", "doc_hash"]).select("doc_id", "content")
            found: Ingested = ingest(contents, decide, steps, typed)
            if parsed:
                parsed()
            batch = self._batch(now)
            self._write("statistics", batch, found.statistics)
            statistics = self._rows("statistics", [batch]).drop("block", "batch")
            for name in ("chapters", "tables", "cells"):
                self._write(name, batch, getattr(found, name))
            found.close()  # the index is made from the stored chapters
            added = self._index(batch)
            self._write("documents", batch, self._registry(registered, self.table("documents", version=now), statistics))
            over = [n for n in SCHEMAS if n != "documents"] if self._replaces(batch, "doc_id", known) else []
            gone = self._totals(self.table("chapters", version=now).join(known.select("doc_id"), "doc_id", "left_semi")) if over else (0, 0)
            self._replaces(batch, "id", registered)
            entry = {"batch": batch, "tables": list(SCHEMAS), "replaces": ["documents", *over]}
            self._commit(now, Version(batches=[*now.batches, entry], chapters=now.chapters + added[0] - gone[0], trigrams=now.trigrams + added[1] - gone[1]))
        return statistics.withColumn("elapsed_seconds", F.lit(round(time.monotonic() - began, 3)))

    def add_folder(self, folder: str, decide: Decider | None = decisions.rule_decisions) -> DataFrame:
        return self.add(read_files(self.spark, folder), decide)

    def compact(self) -> None:
        """Write what counts as one batch without replaced rows. Files of older versions stay for their readers until `vacuum`."""
        now = self.version()
        batch = self._batch(now)
        for name in SCHEMAS:
            if name != "postings":
                self._write(name, batch, self.table(name, version=now))
        n, total = self._index(batch)
        self._commit(now, Version(batches=[{"batch": batch, "tables": list(SCHEMAS), "replaces": []}], chapters=n, trigrams=total))

    def vacuum(self) -> int:
        """Delete batches that the present version doesn't name, also those of batches that broke off; how many folders went. Not while others read or write."""
        keep, gone = {b["batch"] for b in self.version().batches}, 0
        for parts in [(n,) for n in SCHEMAS] + [("replaced", "id"), ("replaced", "doc_id")]:
            folder, fs = self._place(*parts)
            for status in fs.listStatus(folder) if fs.exists(folder) else []:
                if status.getPath().getName().removeprefix("batch=") not in keep:
                    gone += fs.delete(status.getPath(), True)
        return gone

    # message logs
    def log(self, thread: str, messages: list[dict]) -> None:
        """Append messages to a thread, in order, after those that it has."""
        last = self.thread(thread).agg(F.max("seq")).first()[0]
        first = 0 if last is None else last + 1
        rows = [(thread, first + k, m["role"], m["content"], m.get("call_id")) for k, m in enumerate(messages)]
        self.spark.createDataFrame(rows, MESSAGES).coalesce(1).write.mode("append").parquet(f"{self.path}/messages")

    def thread(self, thread: str) -> DataFrame:
        folder, fs = self._place("messages")
        if not fs.exists(folder):
            return self.spark.createDataFrame([], MESSAGES)
        return self.spark.read.schema(MESSAGES).parquet(f"{self.path}/messages").where(F.col("thread_id") == thread).orderBy("seq")

    # views
    def require(self, doc_id: int) -> None:
        """An error for an id that the registry doesn't have."""
        if self.table("documents", doc_id).isEmpty():
            raise LookupError(f"no document {doc_id}")

    def listing(self) -> DataFrame:
        version = self.version()
        return catalog.listing(*(self.table(n, version=version) for n in ("documents", "chapters", "tables")))

    def stats(self, doc_id: int) -> DataFrame:
        """Name, status, characters and error of a document, and its numbers of chapters, chapters to review, roots and tables."""
        self.require(doc_id)
        version = self.version()
        counts = catalog.stats(self.table("chapters", doc_id, version), self.table("tables", doc_id, version))
        named = self.table("documents", doc_id, version).select(F.col("id").alias("doc_id"), "doc_name", "status", "total_chars", "error_msg")
        return named.join(counts, "doc_id", "left").na.fill(0, [c for c in counts.columns if c != "doc_id"])

    def map(self, doc_id: int) -> DataFrame:
        self.require(doc_id)
        return catalog.document_map(self.table("chapters", doc_id))

    def tree(self, doc_id: int) -> DataFrame:
        self.require(doc_id)
        return catalog.tree_lines(self.table("chapters", doc_id)).orderBy("order_num")

    def chapter(self, chapter_id: int) -> DataFrame:
        """The row of one chapter; an error if there is none."""
        found = self.table("chapters", chapter_id // PER_DOCUMENT).where(F.col("id") == chapter_id)
        if found.isEmpty():
            raise LookupError(f"no chapter {chapter_id}")
        return found

    def page(self, chapter_id: int, max_chars: int = 4000, offset: int = 0) -> DataFrame:
        return catalog.chapter_page(self.chapter(chapter_id), max_chars, offset)

    def children(self, chapter_id: int) -> DataFrame:
        return catalog.children(self.table("chapters", chapter_id // PER_DOCUMENT)).where(F.col("parent_id") == chapter_id).orderBy("order_num")

    def matches(self, field: str, terms: list[str], version: Version) -> DataFrame:
        """id, doc_id, length, tf of all chapters that hold any term, from one of the indexes: only the parts of the terms' trigrams are read."""
        grams = sorted({"", *(g for t in terms for g in postings.cover(t).values())})
        buckets = self.spark.range(1).select(F.array(*(F.pmod(F.xxhash64(F.lit(g)), F.lit(BUCKETS)) for g in grams)).alias("b")).first().b
        index = self.table("postings", version=version).where(F.col("bucket").isin(sorted(set(buckets))))
        found = postings.matches(index, field, terms, ("batch", "segment")).withColumn("doc_id", F.floor((F.col("id") - 1) / PER_DOCUMENT).cast("long"))
        return self._live("postings", found, version, F.col("doc_id")).select("id", "doc_id", "length", "tf")

    def ranked(self, keywords: str, version: Version | None = None) -> DataFrame:
        """id, doc_id, length, tf, rank of all chapters that hold all keywords of three characters or more, by statistics of the whole store. Reads no text."""
        version, terms = version or self.version(), search.split_terms(keywords)
        totals = self.spark.range(1).select(F.lit(float(version.chapters)).alias("__n"), F.lit(version.trigrams / max(version.chapters, 1)).alias("__avg"))
        return search.ranked_matches(self.matches("text", terms, version), len(terms), totals)

    def _texts(self, best: DataFrame, order: tuple[str, ...], most: int, version: Version) -> DataFrame:
        """The chapters of the first `most` rows (id, doc_id and what orders them) of `best`, whose blocks and ids alone are then read."""
        top = best.orderBy(*order).limit(most).toPandas()  # `most` rows
        ids = [int(x) for x in top["id"]]
        blocks = sorted({int(d) // BLOCK for d in top["doc_id"]})
        rows = self._rows("chapters", version.of("chapters")).where(F.col("block").isin(blocks or [-1]) & F.col("id").isin(ids or [-1]))
        chapters = self._live("chapters", rows, version, F.col("doc_id")).drop("block", "batch")
        kinds = StructType([f for f in best.schema if f.name == "id" or f.name in order])
        return chapters.join(F.broadcast(self.spark.createDataFrame([tuple(r) for r in top[kinds.names].itertuples(index=False)], kinds)), "id").orderBy(*order)

    def search(self, doc_id: int | None, keywords: str, chapter_id: int | None = None, top_k: int = 5) -> DataFrame:
        """Best chapters of a document, or of all, with id, chapter_path, title, hit, rank: ranked from the index, and then only those texts are read. Short terms scan the document's own chapters."""
        terms = search.split_terms(keywords)
        if not terms:
            raise ValueError("no keywords")
        if doc_id is not None:
            self.require(doc_id)
        if any(len(t) < search.SHORTEST_INDEXED for t in terms):
            return search.search_content(self.table("chapters", doc_id), keywords, doc_id, chapter_id, top_k)
        version = self.version()
        best = self.ranked(keywords, version)
        best = best.where(F.col("doc_id") == doc_id) if doc_id is not None else best
        best = best.where(F.col("id") == chapter_id) if chapter_id is not None else best
        return self._texts(best, ("rank", "id"), top_k, version).select("id", "chapter_path", "title", search.snippet(search.indexed_text(), terms).alias("hit"), "rank")

    def find(self, doc_id: int | None, keywords: str, most: int = 20) -> DataFrame:
        """Chapters of a document, or of all, whose title holds all keywords, in document order, from the index of titles; short terms, and terms that it doesn't have, scan the document's own titles."""
        terms = search.split_terms(keywords)
        if not terms:
            raise ValueError("no keywords")
        if doc_id is not None:
            self.require(doc_id)
        version = self.version()
        if any(len(t) < search.SHORTEST_INDEXED for t in terms):
            return search.find_title(self.table("chapters", doc_id, version), keywords, doc_id, most)
        found = postings.holding(self.matches("title", terms, version))
        found = found.where(F.col("doc_id") == doc_id) if doc_id is not None else found
        found = found.withColumn("place", (F.col("id") - 1) % PER_DOCUMENT)  # of the chapter in its document
        return self._texts(found, ("place", "id"), most, version).select("id", "level", "chapter_path", "title")
