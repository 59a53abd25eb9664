"""Text rules of document structure as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a manual number, a heading style, a key-value line, template noise.
MANUAL_NUMBER = (
    r"(?U)^\s*(第[一二三四五六七八九十百千0-9]+[章节条款部分]"
    r"|[一二三四五六七八九十百千]+、"
    r"|[（(][一二三四五六七八九十百千0-9]+[）)]"
    r"|\d+(?:\.\d+)+(?!\.?\d)"
    r"|\d+(?:\.\d+)*[、.．\s（(]"
    r"|[①②③④⑤⑥⑦⑧⑨⑩])"
)
HEADING_STYLE = r"(?iU)^(heading|标题)\s*(\d+)$"
KEY_VALUE = r"(?U)[:：]\s*\S{4}"
NOISE = r"(?U)共\s*\d+\s*页|第\s*\d+\s*页|特此声明"
CLOSING_MARKS = "。；：，"
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩"
UNIT = r"^第.+?(部分|[章节条款])$"


def strip(x: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def blank(x: Column) -> Column:
    return ~F.coalesce(x.rlike(r"(?U)\S"), F.lit(False))


def template_line(x: Column) -> Column:
    """Does a text match NOISE? Few hold what any match has, so few are gone through by the pattern."""
    return (x.contains("页") | x.contains("特此声明")) & x.rlike(NOISE)


def manual_prefix(x: Column) -> Column:
    """The manual number at the start, stripped; null if there is none."""
    found = F.regexp_extract(x, MANUAL_NUMBER, 1)
    return F.when(F.coalesce(x, F.lit("")).rlike(MANUAL_NUMBER), strip(found))


def after_prefix(x: Column) -> Column:
    """What follows the manual number, stripped; null if there is none."""
    return F.when(F.coalesce(x, F.lit("")).rlike(MANUAL_NUMBER), strip(F.regexp_replace(x, MANUAL_NUMBER, "")))


def number_pattern(prefix: Column) -> Column:
    """The class of a number prefix: numbers of one class are expected on one level."""
    p = strip(F.coalesce(prefix, F.lit("")))
    dots = F.size(F.split(p, r"\."))
    return (
        F.when(p == "", "无")
        .when(p.rlike(UNIT), F.concat(F.lit("第#"), F.regexp_extract(p, UNIT, 1)))
        .when(p.rlike(r"^[（(].+[）)]$"), "（#）")
        .when(p.rlike(r"(?U)^\d+(?:\.\d+)+$"), F.concat(F.lit("#"), F.repeat(F.lit(".#"), dots - 1)))
        .when(p.rlike(r"(?U)^\d+\.$"), "#.")
        .when(p.endswith("、"), "#、")
        .when((F.length(p) == 1) & F.lit(CIRCLED).contains(p), "①")
        .otherwise(p)
    )


def style_level(name: Column, style_id: Column) -> Column:
    """Heading level that a style's name, or else its id, states."""

    def stated(x: Column) -> Column:
        # a cast that fails costs an exception, so what states no level isn't cast
        return F.nullif(F.regexp_extract(strip(F.coalesce(x, F.lit(""))), HEADING_STYLE, 2), F.lit("")).try_cast("int")

    return F.coalesce(stated(name), stated(style_id))


def joined_name(prefix: Column, title: Column) -> Column:
    """Number and title as one name."""
    p = strip(F.coalesce(prefix, F.lit("")))
    return F.when(p == "", title).otherwise(strip(F.concat(p, F.lit(" "), F.coalesce(title, F.lit("")))))


def quoted(term: str) -> str:
    """A pattern that matches just the term."""
    return "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def occurrences(text: Column, term: str) -> Column:
    """Overlapping, case-folded occurrences of a literal term."""
    return F.regexp_count(F.lower(text), F.lit(f"(?={quoted(term.lower())})"))
