"""Formatting features of paragraphs, body-text baselines, and the heading-candidate cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import CLOSING_MARKS, KEY_VALUE, MANUAL_NUMBER, blank, style_level

LONGEST_HEADING = 50
SHORTEST_BODY = 10


def _true(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def suggest_level(outline: Column, style: Column) -> Column:
    """Level from the outline level (0-based) and the style's; none if they disagree."""
    stated = outline + 1
    return F.when(stated.isNotNull() & style.isNotNull(), F.when(stated == style, style)).otherwise(F.coalesce(stated, style))


def round_half_even(x: Column, digits: int) -> Column:
    """A double rounded by its exact binary value, ties to even.

    The scaled value is a rounded product; its error is found exactly by
    splitting x into halves of its bits (Dekker, 1971), and decides near ties.
    """
    scale = F.lit(float(10**digits))
    wide = x * 134217729.0
    high = wide - (wide - x)
    product = x * scale
    error = (high * scale - product) + (x - high) * scale
    below = F.floor(product).cast("double")
    over = (product - (below + 0.5)) + error
    up = F.when(over > 0, 1.0).when(over < 0, 0.0).otherwise(F.pmod(below, F.lit(2.0)))
    return (below + up) / scale


def mode(rows: DataFrame, key: str, value: Column, order: str, name: str) -> DataFrame:
    """Most frequent value for each key, of several the one that came first; two grouped aggregates, no sort of the rows."""
    counted = rows.select(key, value.alias("v"), order).where("v is not null").groupBy(key, "v").agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counted.groupBy(key).agg(F.max_by("v", F.struct("n", -F.col("first"))).alias(name))


def baselines(paragraphs: DataFrame, key: str = "doc_id", order: str = "para_index", length: Column | None = None) -> DataFrame:
    """base_font and base_indent of body-like paragraphs of each document. length: that of paragraphs without their text."""
    body = paragraphs.where((F.length("text") if length is None else length) >= SHORTEST_BODY)
    font = mode(body, key, F.col("font_size_halfpt"), order, "base_font")
    indent = mode(body, key, round_half_even(F.col("first_line_indent_chars"), 2), order, "base_indent")
    return font.join(indent, key, "full")


def diverges() -> Column:
    """Does the paragraph differ from the body's font or indent?"""
    font, indent, base_font, base_indent = (F.col(c) for c in ("font_size_halfpt", "first_line_indent_chars", "base_font", "base_indent"))
    unknown = base_font.isNull() & base_indent.isNull()
    return unknown | _true(font != base_font) | indent.isNull() | _true(indent != base_indent)


def _numbered(manual: bool) -> Column:
    listed = _true(F.col("has_numpr"))
    return listed | F.col("text").rlike(MANUAL_NUMBER) if manual else listed


def may_be_candidate(manual: bool = True) -> Column:
    """Can the cascade hold, whatever the document's baselines are? manual: as for `is_candidate`."""
    text = F.col("text")
    short = F.length(text) <= LONGEST_HEADING
    stated = F.col("outline_lvl").isNotNull() | style_level(F.col("style_name"), F.col("style_id")).isNotNull()
    # a font tells by itself whether it may be larger; the other rules want a short text
    marked = F.col("font_size_halfpt").isNotNull() | (short & (_true(F.col("bold")) | _numbered(manual)))
    return ~blank(text) & (stated | (~_true(F.col("mixed_run_fmt")) & marked & ~text.rlike(KEY_VALUE)))


def is_candidate(manual: bool = True) -> Column:
    """The cascade over a paragraph's features and its document's baselines; the first rule that holds decides.

    manual: does a number typed at the start of the text make a paragraph a numbered one, as its list does?
    """
    text, font, indent, base_font, base_indent = (F.col(c) for c in ("text", "font_size_halfpt", "first_line_indent_chars", "base_font", "base_indent"))
    short = F.length(text) <= LONGEST_HEADING
    numbered = short & _numbered(manual)
    last = F.right(F.regexp_replace(text, r"(?U)\s+$", ""), F.lit(1))
    return (
        F.when(blank(text), False)
        .when(F.col("outline_lvl").isNotNull(), True)
        .when(style_level(F.col("style_name"), F.col("style_id")).isNotNull(), True)
        .when(text.rlike(KEY_VALUE), False)
        .when(_true(F.col("mixed_run_fmt")), False)
        .when(_true(F.col("bold")) & short & diverges(), True)
        .when(_true(font > base_font), True)
        .when(numbered & _true(indent == base_indent), False)
        .when(numbered & ~F.lit(CLOSING_MARKS).contains(last), True)
        .when(numbered & _true(indent < base_indent), True)
        .otherwise(False)
    )


def items_with_styles(parsed: DataFrame) -> DataFrame:
    """doc_id and the items of parsed files, a row each, with `chain` (their style, its base, the base's base) and `list` (num_id, ilvl of the list that their style belongs to).

    A file's styles are in the row that has its items, so they are looked up there and nothing is dealt out.
    """
    by_id = lambda rows, value: F.map_from_entries(F.transform(rows, lambda x: F.struct(x["style_id"], value(x))))
    whole = parsed.withColumn("__styles", by_id("styles", lambda s: s)).withColumn("__lists", by_id("pstyles", lambda x: F.struct(x["num_id"].alias("num_id"), x["ilvl"].alias("ilvl"))))

    def chain(s: Column) -> Column:
        base = F.col("__styles")[s["based_on"]]
        return F.array(s, base, F.col("__styles")[base["based_on"]])

    whole = whole.withColumn("__chains", F.when(F.size("__styles") > 0, by_id("styles", chain)))
    fields = [f.name for f in parsed.schema["items"].dataType.elementType]
    found = F.transform("items", lambda x: F.struct(*(x[f].alias(f) for f in fields), F.col("__chains")[x["style_id"]].alias("chain"), F.col("__lists")[x["style_id"]].alias("list")))
    # the mention of the maps outside the lambda keeps the optimizer from making them anew for every item
    ready = F.coalesce(F.size("__chains"), F.lit(0)) + F.coalesce(F.size("__lists"), F.lit(0)) >= 0
    return whole.select("doc_id", F.inline(F.when(ready, found).otherwise(found)))


def resolve_features(paragraphs: DataFrame, styles: DataFrame | None = None) -> DataFrame:
    """Features of parsed paragraphs: own and run formatting, else the style chain's (itself, its base, the base's base).

    Styles are few for each document but unbounded over a corpus, so the chain
    is made by two joins of styles and joined once; the planner may broadcast.
    Without styles, paragraphs have their `chain`, as `items_with_styles` makes it.
    """
    p = paragraphs
    if styles is not None:
        s = styles.select("doc_id", "style_id", F.struct("name", "sz", "bold", "first_line_chars", "first_line_twips", "outline_lvl").alias("s0"), F.col("based_on").alias("up0"))
        chained = s
        for k in (1, 2):
            base = s.select("doc_id", F.col("style_id").alias(f"up{k - 1}"), F.col("s0").alias(f"s{k}"), F.col("up0").alias(f"up{k}"))
            chained = chained.join(base, ["doc_id", f"up{k - 1}"], "left")
        chained = chained.select("doc_id", "style_id", F.array("s0", "s1", "s2").alias("chain"))
        p = paragraphs.join(chained, ["doc_id", "style_id"], "left")

    def of_chain(field: str) -> Column:
        return F.coalesce(*(F.col("chain")[k][field] for k in range(3)))

    bare = "written" in p.schema["runs"].dataType.elementType.names
    written = F.filter("runs", lambda r: r["written"] if bare else ~blank(r["text"]))
    p = p.withColumn("__first", F.get(written, F.lit(0)))
    p = p.withColumn("font_size_halfpt", F.coalesce(F.col("__first")["sz"], F.col("ppr.sz"), of_chain("sz")))
    p = p.withColumn("bold", F.coalesce(F.col("__first")["b"], F.col("ppr.b"), of_chain("bold"), F.lit(False)))
    twips = lambda x: F.when(F.coalesce(F.col("font_size_halfpt"), F.lit(0)) != 0, x / (F.col("font_size_halfpt") / 2.0 * 20.0))
    styled = F.coalesce(*(F.coalesce(F.col("chain")[k]["first_line_chars"], twips(F.col("chain")[k]["first_line_twips"])) for k in range(3)))
    direct_chars, direct_twips = F.col("ppr.first_line_chars"), F.col("ppr.first_line")
    has_font = F.coalesce(F.col("font_size_halfpt"), F.lit(0)) != 0
    indent = F.when(direct_chars.isNotNull(), direct_chars.try_cast("int") / 100.0).when(direct_twips.isNotNull() & has_font, twips(direct_twips.try_cast("int"))).otherwise(styled)
    outline = F.coalesce(F.col("ppr.outline_lvl"), of_chain("outline_lvl"))
    sizes = F.size(F.array_distinct(F.transform(written, lambda r: F.coalesce(r["sz"], F.col("font_size_halfpt")))))
    bolds = F.size(F.array_distinct(F.transform(written, lambda r: F.coalesce(r["b"], F.col("bold")))))
    numbered = F.coalesce(F.col("ppr.num_id"), F.lit(0)) != 0
    return p.select(
        *(c for c in paragraphs.columns if c not in ("runs", "ppr", "chain")),
        F.col("chain")[0]["name"].alias("style_name"), "font_size_halfpt", "bold",
        indent.alias("first_line_indent_chars"),
        F.when(outline < 9, outline).alias("outline_lvl"),
        numbered.alias("has_numpr"),
        F.when(numbered, F.col("ppr.num_id")).alias("num_id"),
        F.when(numbered, F.coalesce(F.col("ppr.ilvl"), F.lit(0))).alias("ilvl"),
        F.when(F.size("runs") > 1, (sizes > 1) | (bolds > 1)).otherwise(False).alias("mixed_run_fmt"),
    )
