"""Decisions about heading candidates: requests, the rule-based decider, validation, chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Candidates of one request at most.
CHUNK = 450


def requests(candidates: DataFrame) -> DataFrame:
    """doc_id, idx, payload: what a decider is told of each candidate."""
    payload = F.to_json(F.struct(
        F.col("para_index").alias("idx"), F.coalesce("number_prefix", F.lit("")).alias("number_prefix"), F.substring(F.coalesce("text", F.lit("")), 1, 40).alias("title"),
        F.coalesce("bold", F.lit(False)).alias("bold"), F.coalesce(F.col("font_size_halfpt").cast("string"), F.lit("")).alias("font_size"), F.coalesce(F.col("suggested_level").cast("string"), F.lit("")).alias("suggested_level"),
    ))
    return candidates.select("doc_id", F.col("para_index").alias("idx"), payload.alias("payload"))


def rule_decisions(candidates: DataFrame) -> DataFrame:
    """A title at its suggested level where there is one, else none."""
    title = F.coalesce(F.col("suggested_level") >= 1, F.lit(False))
    return candidates.select("doc_id", F.col("para_index").alias("idx"), title.alias("is_title"), F.when(title, F.greatest(F.lit(1), F.least(F.lit(9), "suggested_level"))).alias("level"))


def validate(decisions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Decisions of documents whose decisions cover just their candidates; the first of several counts; levels are 1 to 9 and titles' only.

    decisions: doc_id, seq (order in which they came), idx, is_title, level. A
    title may state no level; one that doesn't say whether it is a title counts
    as missing.
    """
    first = decisions.groupBy("doc_id", "idx").agg(F.min_by(F.struct("is_title", "level"), "seq").alias("d"))
    wanted = candidates.select("doc_id", F.col("para_index").alias("idx")).withColumn("wanted", F.lit(1))
    both = first.join(wanted, ["doc_id", "idx"], "full")
    fits = both.groupBy("doc_id").agg(F.bool_and(F.col("wanted").isNotNull() & F.col("d.is_title").isNotNull()).alias("fits")).where("fits")
    level = F.when(F.col("d.is_title") & F.col("d.level").isNotNull(), F.greatest(F.lit(1), F.least(F.lit(9), F.col("d.level"))))
    return both.where("d is not null").join(fits, "doc_id", "left_semi").select("doc_id", "idx", F.col("d.is_title").alias("is_title"), level.cast("int").alias("level"))


def chunks(candidates: DataFrame, most: int = CHUNK) -> DataFrame:
    """Adds chunk to the candidates: a document of more than `most` is cut, greedily, at the last first-level anchor in reach, else after `most`.

    A cut is decided when the reach is full, and then no anchor lies between it
    and the reach's end, so one fold over a document's levels finds all cuts.
    """
    decide = "i - s.start = {most}"
    anchor = "case when i > s.start and levels[i] = 1 then i else s.anchor end"
    fold = f"""case when size(levels) <= {most} then array(0) else aggregate(sequence(0, size(levels) - 1), named_struct('start', 0, 'anchor', cast(null as int), 'cuts', array(0)),
        (s, i) -> case when {decide.format(most=most)} then named_struct('start', coalesce({anchor}, i), 'anchor', cast(null as int), 'cuts', array_append(s.cuts, coalesce({anchor}, i)))
                       else named_struct('start', s.start, 'anchor', {anchor}, 'cuts', s.cuts) end,
        s -> case when s.anchor is null then s.cuts else array_append(s.cuts, s.anchor) end) end"""
    rows = F.sort_array(F.collect_list(F.struct("para_index", F.coalesce("suggested_level", F.lit(0)).alias("level"))))
    listed = candidates.groupBy("doc_id").agg(rows.alias("rows")).withColumn("levels", F.expr("transform(rows, r -> r.level)")).withColumn("cuts", F.expr(fold))
    numbered = listed.select("doc_id", F.inline(F.expr("transform(rows, (r, i) -> named_struct('para_index', r.para_index, 'chunk', size(filter(cuts, c -> c <= i)) - 1))")))
    return candidates.join(numbered, ["doc_id", "para_index"])
