"""Views of the stored tables: document listing and statistics, maps, chapter pages, trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.text import joined_name

#: A map of more rows lists the two upper levels only.
FULL_MAP = 300


def listing(documents: DataFrame, chapters: DataFrame, tables: DataFrame) -> DataFrame:
    """Documents with their numbers of chapters and tables, zero if they have none; each side is summed before it is joined."""
    n_chapters = chapters.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("chapter_count"))
    n_tables = tables.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("table_count"))
    joined = documents.join(n_chapters, "id", "left").join(n_tables, "id", "left")
    return joined.withColumn("chapter_count", F.coalesce("chapter_count", F.lit(0))).withColumn("table_count", F.coalesce("table_count", F.lit(0)))


def stats(chapters: DataFrame, tables: DataFrame) -> DataFrame:
    """Chapters, chapters to review, roots and tables of each document."""
    by = chapters.groupBy("doc_id").agg(F.count("*").alias("chapters"), F.count_if(F.col("needs_review") == 1).alias("needs_review"), F.count_if(F.col("level") == 1).alias("roots"), F.sum(F.length(F.coalesce("content", F.lit("")))).alias("content_chars"))
    other = tables.groupBy("doc_id").agg(F.count("*").alias("tables"))
    return by.join(other, "doc_id", "left").withColumn("tables", F.coalesce("tables", F.lit(0)))


def map_line() -> F.Column:
    return F.concat_ws("|", F.col("id").cast("string"), F.col("level").cast("string"), F.coalesce(F.col("chapter_path"), F.lit("")), joined_name(F.col("number_prefix"), F.col("title")))


def map_rows(chapters: DataFrame, full: int = FULL_MAP) -> DataFrame:
    """doc_id, order_num, line of each document's map; in a folded map a root's line tells how many chapters follow it."""
    w = Window.partitionBy("doc_id")
    run = F.count_if(F.col("level") == 1).over(w.orderBy("order_num").rowsBetween(Window.unboundedPreceding, 0))
    grouped = chapters.withColumn("__n", F.count("*").over(w)).withColumn("__root", run)
    below = F.count("*").over(Window.partitionBy("doc_id", "__root")) - 1
    folded = F.col("__n") > full
    line = F.when(folded & (F.col("level") == 1), F.concat(map_line(), F.lit("\n…含"), F.col("__below").cast("string"), F.lit("个小节"))).otherwise(map_line())
    kept = grouped.withColumn("__below", below).where(~folded | (F.col("level") <= 2))
    return kept.select("doc_id", "order_num", line.alias("line"))


def document_map(chapters: DataFrame, full: int = FULL_MAP) -> DataFrame:
    """doc_id, map: the lines of each document in order."""
    lines = F.sort_array(F.collect_list(F.struct("order_num", "line")))
    return map_rows(chapters, full).groupBy("doc_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("map"))


def chapter_page(chapters: DataFrame, max_chars: int = 4000, offset: int = 0) -> DataFrame:
    """id, page of the content from `offset`, truncated, next_offset."""
    content = F.coalesce(F.col("content"), F.lit(""))
    more = F.length(content) > offset + max_chars
    return chapters.select("id", "doc_id", "level", "chapter_path", joined_name(F.col("number_prefix"), F.col("title")).alias("title"), F.substring(content, offset + 1, max_chars).alias("page"), more.alias("truncated"), F.when(more, offset + max_chars).alias("next_offset"))


def children(chapters: DataFrame) -> DataFrame:
    """parent_id, order_num, child: a JSON line for each chapter below another."""
    child = F.to_json(F.struct(F.col("id").alias("chapter_id"), "level", joined_name(F.col("number_prefix"), F.col("title")).alias("title"), F.coalesce("content_chars", F.lit(0)).alias("content_chars"), F.coalesce("chapter_path", F.lit("")).alias("chapter_path")))
    return chapters.where("parent_id <> 0").select("doc_id", "parent_id", "order_num", child.alias("child"))


def tree_lines(chapters: DataFrame) -> DataFrame:
    """doc_id, order_num, line: indented names, a star where review is needed."""
    indent = F.repeat(F.lit("  "), F.greatest(F.col("level"), F.lit(1)) - 1)
    star = F.when(F.col("needs_review") == 1, " *").otherwise("")
    return chapters.select("doc_id", "order_num", F.concat(indent, joined_name(F.col("number_prefix"), F.col("title")), star).alias("line"))
