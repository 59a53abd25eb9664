"""From files to chapters, tables and cells: one job for a whole batch of documents."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import cleaning, decisions, features, grids, numbering, sections, tree
from quire.plans.shared import Scratch
from quire.sources.docx import BARE_RUN, PARSED, RUN, parse_files

#: Makes ids of chapters and tables from a document's id and a place, which is below it in any file.
PER_DOCUMENT = 1 << 32
#: Paragraphs have their whole text, so of runs it is enough whether they have one.
COLUMNS = PARSED.replace(RUN, BARE_RUN)

Decider = Callable[[DataFrame], DataFrame | None]


def rendered_numbers(paragraphs: DataFrame, pstyles: DataFrame, levels: DataFrame) -> DataFrame:
    """doc_id, para_index, number_text of the paragraphs of a list: by their own list, else by one that their style belongs to."""
    styled = pstyles.select("doc_id", "style_id", F.col("num_id").alias("style_num"), F.col("ilvl").alias("style_ilvl"))
    joined = paragraphs.join(styled, ["doc_id", "style_id"], "left")
    counted = joined.select("doc_id", F.col("para_index").alias("order"), F.coalesce("num_id", "style_num").alias("num_id"), F.when(F.col("num_id").isNotNull(), F.col("ilvl")).otherwise(F.col("style_ilvl")).alias("ilvl"))
    return numbering.render(counted.where("num_id > 0").withColumn("ilvl", F.coalesce("ilvl", F.lit(0))), levels).select("doc_id", F.col("order").alias("para_index"), "number_text")


def body_items(parsed: DataFrame, typed: bool = True) -> DataFrame:
    """Body items that stay, with the features of paragraphs and n, the length of their text; the text itself only where it may be a heading's, so that rows are narrow."""
    items = features.items_with_styles(parsed).select("doc_id", "seq", "kind", "text", "is_toc", "fld_events", "style_id", "ppr", "runs", "chain", "list")
    read = features.resolve_features(items)
    own = F.col("num_id").isNotNull()
    narrow = read.select(
        "doc_id", "seq", "kind", "is_toc", "fld_events", F.length("text").alias("n"), text.template_line(F.col("text")).alias("template"), text.blank(F.col("text")).alias("empty"),
        F.when(features.may_be_candidate(typed), F.col("text")).alias("text"), "style_id", "style_name", "font_size_halfpt", "bold", "first_line_indent_chars", "outline_lvl", "has_numpr", "mixed_run_fmt",
        F.coalesce("num_id", "list.num_id").alias("num_id"), F.when(own, F.col("ilvl")).otherwise(F.col("list.ilvl")).alias("ilvl"),
    )
    return cleaning.select_body(narrow, template=F.col("template"), empty=F.col("empty")).drop("template", "empty", "is_toc", "fld_events")


def found_headings(body: DataFrame, typed: bool = True) -> DataFrame:
    """The heading candidates among body items, as yet without the numbers that lists give them."""
    paragraphs = body.where("kind = 'p'")
    near = features.baselines(paragraphs, length=F.col("n"))
    return paragraphs.where("text is not null").join(near, "doc_id", "left").where(features.is_candidate(typed)).drop("base_font", "base_indent")


def numbered(found: DataFrame, body: DataFrame, parsed: DataFrame, typed: bool = True) -> DataFrame:
    """The candidates, with numbers and titles."""
    listed = body.where("kind = 'p' and num_id > 0").select("doc_id", F.col("para_index").alias("order"), "num_id", F.coalesce("ilvl", F.lit(0)).alias("ilvl"))
    shown = listed.join(found.select("doc_id", F.col("para_index").alias("order"), F.lit(True).alias("shown")), ["doc_id", "order"], "left")
    rendered = numbering.render(shown, parsed.select("doc_id", F.inline("levels"))).select("doc_id", F.col("order").alias("para_index"), "number_text")
    # there is one of each; that it is stated lets the optimizer leave the numbers out for who doesn't read them
    rendered = rendered.groupBy("doc_id", "para_index").agg(F.max("number_text").alias("number_text"))
    manual = text.manual_prefix(F.col("text")) if typed else F.lit(None).cast("string")
    level = features.suggest_level(F.col("outline_lvl"), text.style_level(F.col("style_name"), F.col("style_id")))
    return found.join(rendered, ["doc_id", "para_index"], "left").select(
        "doc_id", "seq", "para_index", text.strip(F.col("text")).alias("text"), F.coalesce(manual, F.col("number_text")).alias("number_prefix"),
        F.when(manual.isNotNull(), text.after_prefix(F.col("text"))).otherwise(text.strip(F.col("text"))).alias("title"),
        level.alias("suggested_level"), level.isNotNull().alias("is_anchor"), "bold", "font_size_halfpt", "first_line_indent_chars",
    )


def headings(parsed: DataFrame, scratch: Scratch | None = None, typed: bool = True) -> tuple[DataFrame, DataFrame]:
    """(body items that stay, as of `body_items`; heading candidates among them). typed: as for `ingest`."""
    cut = (scratch or Scratch(parsed.sparkSession)).cut
    body = cut(body_items(parsed, typed))
    return body, numbered(cut(found_headings(body, typed)), body, parsed, typed)


def valid_decisions(candidates: DataFrame, said: DataFrame, scratch: Scratch) -> DataFrame:
    """Decisions of documents whose decisions cover just their candidates; the others' candidates are left to the rules."""
    said = said if "seq" in said.columns else said.withColumn("seq", F.lit(0))
    return decisions.validate(scratch.cut(said), candidates)  # asked once


def _key(order: str) -> Column:
    return F.col("doc_id") * PER_DOCUMENT + F.col(order) + 1


class Ingested:
    """What a batch of parsed files gives: chapters, tables, placed_tables, cells, statistics, errors.

    Each is made when it is first asked for, by the steps that it takes: cells need no numbers of
    headings, no paths and no contents. Steps that several share are written to the scratch folder once.
    """

    def __init__(self, parsed: DataFrame, decide: Decider | None, scratch: Scratch, typed: bool) -> None:
        self._parsed, self._decide, self.scratch, self._typed = parsed, decide, scratch, typed

    def close(self) -> None:
        """Delete what the batch wrote on its way; its tables can't be read, or made, after that."""
        self.scratch.close()

    @cached_property
    def _headings(self) -> tuple[DataFrame, DataFrame]:
        return headings(self._parsed, self.scratch, self._typed)

    @cached_property
    def _decisions(self) -> DataFrame | None:
        _, candidates = self._headings
        return valid_decisions(candidates, self._decide(candidates), self.scratch) if self._decide else None

    @cached_property
    def _opens(self) -> DataFrame:
        """doc_id, seq, heading: where chapters begin, by their order; as build_tree has it."""
        _, candidates = self._headings
        nodes = tree.resolve_levels(candidates, self._decisions).where("is_node").select("doc_id", "seq", "para_index")
        return self.scratch.cut(sections.ordinal(nodes, ["doc_id"], "para_index", "heading").drop("para_index"))

    @cached_property
    def _nodes(self) -> DataFrame:
        cut = self.scratch.cut
        return cut(tree.build_tree(cut(self._headings[1]), self._decisions, cut))

    @cached_property
    def _grids(self) -> DataFrame:
        """Tables with cells, below their chapters' order as `section`."""
        # tables without cells go before anything is made of them
        items = self._parsed.select("doc_id", F.inline("items")).where("kind = 'tbl' and total_rows > 0 and total_cols > 0 and size(cells) > 0")
        rows = items.select("doc_id", "seq", "total_rows", "total_cols", "cells", F.lit(None).cast("int").alias("heading"))
        return self.scratch.cut(sections.attribute(rows.unionByName(self._opens, allowMissingColumns=True)).drop("heading"))

    @cached_property
    def _identified(self) -> DataFrame:
        found = sections.ordinal(self._grids, ["doc_id", "section"], "seq", "order_num")
        return sections.ordinal(found, ["doc_id"], "seq", "__at").withColumn("id", _key("__at")).withColumn("chapter_id", _key("section"))

    @cached_property
    def chapters(self) -> DataFrame:
        body, _ = self._headings
        placed = sections.attribute(body.where("kind = 'p'").select("doc_id", "seq").join(self._opens, ["doc_id", "seq"], "left")).drop("heading")
        items = self._parsed.select("doc_id", F.inline("items")).where("kind = 'p'").select("doc_id", "seq", text.strip(F.col("text")).alias("text"))
        tables = grids.to_markdown(self._grids).select("doc_id", "seq", "section", F.col("markdown").alias("text"))
        filled = sections.filled(self._nodes, [placed, items, tables])
        parent = F.coalesce(_key("parent_order"), F.lit(0))
        return filled.select(_key("order_num").alias("id"), "doc_id", parent.alias("parent_id"), "level", "number_prefix", "title", "content", F.length("content").alias("content_chars"), "order_num", "chapter_path", "source", "confidence", "needs_review")

    @cached_property
    def placed_tables(self) -> DataFrame:
        """The tables without the paths of their chapters."""
        return self._identified.select("id", "doc_id", "chapter_id", F.lit(None).cast("string").alias("table_caption"), "total_rows", "total_cols", "order_num")

    @cached_property
    def tables(self) -> DataFrame:
        paths = self._nodes.select("doc_id", _key("order_num").alias("chapter_id"), "chapter_path")
        return self.placed_tables.join(paths, ["doc_id", "chapter_id"]).select(*self.placed_tables.columns, "chapter_path")

    @cached_property
    def cells(self) -> DataFrame:
        return self._identified.select(F.col("id").alias("table_id"), "doc_id", F.inline("cells")).withColumn("is_header", F.col("is_header").cast("int"))

    @cached_property
    def statistics(self) -> DataFrame:
        body, candidates = self._headings
        counts = [
            body.where("kind = 'p'").groupBy("doc_id").agg(F.count("*").alias("total_paragraphs"), F.sum("n").alias("total_chars")),
            candidates.groupBy("doc_id").agg(F.count("*").alias("candidates"), F.count_if("is_anchor").alias("anchors"), F.count_if(~F.col("is_anchor")).alias("pending")),
            self._nodes.groupBy("doc_id").agg(F.count("*").alias("chapters"), F.count_if(F.col("needs_review") == 1).alias("needs_review")),
            self._grids.groupBy("doc_id").agg(F.count("*").alias("tables")),
        ]
        statistics = self._parsed.select("doc_id", "error")
        for part in counts:
            statistics = statistics.join(part, "doc_id", "left")
        return statistics.na.fill(0)

    @cached_property
    def errors(self) -> DataFrame:
        return self._parsed.where("error is not null").select("doc_id", "error")


def ingest(files: DataFrame, decide: Decider | None = decisions.rule_decisions, scratch: Scratch | None = None, typed: bool = True) -> Ingested:
    """files: doc_id, content. decide: candidates to decisions; none leaves levels to the rules alone,
    as do decisions that are incomplete. typed: are numbers that a heading's text begins with its
    numbering, and cut from its title? If not, only lists number, and titles are whole; for texts whose
    lines may begin with amounts, addresses or the numbers of cards.

    Parsed files, body items, candidates, decisions, nodes and tables are written to the shared folder
    (`scratch`), which keeps plans small and survives lost executors; `Ingested.close` deletes them.
    """
    scratch = scratch or Scratch(files.sparkSession)
    return Ingested(scratch.cut(parse_files(files, columns=COLUMNS)), decide, scratch, typed)
