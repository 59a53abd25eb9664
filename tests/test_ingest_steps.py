"""What ingest's steps write and read, and that leaving things out leaves nothing out of the result."""

import itertools

from docx_files import cell, docx, paragraph, run, style, table
from pyspark.sql import functions as F

from quire.operators import features, numbering
from quire.plans.ingest import COLUMNS, ingest
from quire.plans.shared import Scratch
from quire.sources.docx import parse_files

BODY = "text of a body paragraph that goes on for a while and is no heading at all"


def files(spark, *contents):
    return spark.createDataFrame([(k + 1, bytearray(c)) for k, c in enumerate(contents)], "doc_id long, content binary")


def test_cells_take_narrow_rows_and_no_tree(spark, monkeypatch):
    written, cut = [], Scratch.cut

    def noted(self, df):
        written.append(cut(self, df))
        return written[-1]

    monkeypatch.setattr(Scratch, "cut", noted)
    grid = table(2, [cell("a"), cell("b")])
    found = ingest(files(spark, docx(paragraph("Title", style="Top"), paragraph(BODY), grid, paragraph("Next", style="TopKin"), grid, grid)))
    assert sorted((r["content"], r["table_id"] % 8) for r in found.cells.collect()) == [(c, k) for c in "ab" for k in (1, 2, 3)]
    _, *later = written
    columns = set().union(*(df.columns for df in later))
    assert not columns & {"runs", "ppr", "items", "chain", "chapter_path", "number_prefix"}
    texts = {r["text"] for df in later if "text" in df.columns for r in df.collect()}
    assert texts == {"Title", "Next", None}  # the body's text isn't written again
    placed = [tuple(r) for r in found.placed_tables.orderBy("id").collect()]
    assert [tuple(r)[:-1] for r in found.tables.orderBy("id").collect()] == placed and [r["chapter_path"] for r in found.tables.orderBy("id").collect()] == ["Title", "Next", "Next"]


def test_styles_in_the_row_are_those_of_the_joins(spark):
    styles = (style("A", "heading 1", base="B", size=30), style("B", "b", base="C", bold=True), style("C", "c", base="D", outline=3, first_line=200), style("D", "d", size=9), style("L", "loop", base="L", bold=True), style("M", "gone", base="nothing", first_chars=150))
    body = [paragraph(run(f"text {s} {k}", *r), style=s) for s in (None, "A", "B", "C", "D", "L", "M", "unknown") for k, r in enumerate(((), (20,), (None, False)))]
    content = [docx(*body, paragraph(run("x"), run(" ", 30), run("y", 31)), paragraph(run("  ", 30), run("z", 31)), styles=styles), docx(*body, styles=()), docx(styles=styles), b"no file"]
    whole, bare = parse_files(files(spark, *content)), parse_files(files(spark, *content), columns=COLUMNS)
    items = ("doc_id", "seq", "text", "style_id", "ppr", "runs")
    joined = features.resolve_features(whole.select("doc_id", F.inline("items")).select(*items), whole.select("doc_id", F.inline("styles")))
    looked = features.resolve_features(features.items_with_styles(bare).select(*items, "chain"))
    rows = [sorted(map(tuple, df.select(joined.columns).collect())) for df in (joined, looked)]
    assert rows[0] == rows[1] and len(rows[0]) == 50


def test_no_candidate_is_beyond_those_that_may_be(spark):
    texts = ("", "  ", "short", "1.2 short", "key: value", "ends；", "1、ends；", "x" * 51, "1.2 " + "x" * 60)
    choices = texts, (None, 3), (None, "heading 2", "plain"), (None, True, False), (None, True), (None, 20, 30), (None, 0.0, 2.0), (None, True), (None, 21), (None, 1.0)
    names = "text string, outline_lvl int, style_name string, bold boolean, mixed_run_fmt boolean, font_size_halfpt int, first_line_indent_chars double, has_numpr boolean, base_font int, base_indent double"
    cases = spark.createDataFrame(list(itertools.product(*choices)), names).withColumn("style_id", F.lit("s"))
    for manual in (True, False):
        found = cases.where(features.is_candidate(manual))
        assert found.count() > 100 and found.where(~features.may_be_candidate(manual)).isEmpty() and not cases.where(~features.may_be_candidate(manual)).isEmpty()


def test_numbers_that_are_not_shown_count(spark):
    levels = spark.createDataFrame([(1, 1, 0, "decimal", "%1.", 1, None)], "doc_id int, num_id int, ilvl int, num_fmt string, lvl_text string, start int, start_override int")
    items = spark.createDataFrame([(1, 1, 0, k, k in (2, 5) or None) for k in range(7)], "doc_id int, num_id int, ilvl int, order int, shown boolean")
    assert [(r["order"], r["number_text"]) for r in numbering.render(items, levels).orderBy("order").collect()] == [(2, "3."), (5, "6.")]
