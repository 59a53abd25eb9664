import random

import pytest
from pyspark.sql import functions as F

from quire.functions import numbers, text
from quire.operators import catalog, decisions, features, numbering, postings, search, tree
from quire.sources.config import load_settings


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    ("kind", "n", "expected"),
    [
        ("decimal", 7, "7"), ("chineseCountingThousand", 10, "十"), ("chineseCountingThousand", 12, "十二"), ("chineseCountingThousand", 110, "一百一十"), ("chineseCountingThousand", 105, "一百零五"),
        ("chineseCountingThousand", 999, "九百九十九"), ("chineseCountingThousand", 10000, "10000"), ("chineseLegalSimplified", 12, "拾贰"), ("chineseLegalSimplified", 110, "壹佰壹拾"),
        ("ideographTraditional", 11, "甲"), ("lowerLetter", 27, "aa"), ("upperLetter", 26, "Z"), ("lowerRoman", 4, "iv"), ("upperRoman", 1999, "MCMXCIX"), ("decimalEnclosedCircle", 10, "⑩"), ("decimalEnclosedCircle", 11, "(11)"), ("lowerRoman", 0, "0"),
    ],
)
def test_number_formats(spark, kind, n, expected):
    assert one(spark, numbers.number_text(F.lit(kind), F.lit(n))) == expected


@pytest.mark.parametrize(
    ("line", "prefix", "title"),
    [("第一章 总则", "第一章", "总则"), ("一、概述", "一、", "概述"), ("（一）范围", "（一）", "范围"), ("2.1 目标", "2.1", "目标"), ("3.4.2目标", "3.4.2", "目标"), ("1、目标", "1、", "目标"), ("① 目标", "①", "目标"), ("目标", None, None), ("2024年", None, None)],
)
def test_manual_prefix(spark, line, prefix, title):
    assert one(spark, F.struct(text.manual_prefix(F.lit(line)), text.after_prefix(F.lit(line)))) == (prefix, title)


@pytest.mark.parametrize(("prefix", "kind"), [("第三章", "第#章"), ("第一部分", "第#部分"), ("（一）", "（#）"), ("1.2.3", "#.#.#"), ("1.", "#."), ("一、", "#、"), ("③", "①"), (None, "无"), (" ", "无"), ("附件", "附件")])
def test_number_pattern(spark, prefix, kind):
    assert one(spark, text.number_pattern(F.lit(prefix).cast("string"))) == kind


def test_counters_match_a_sequential_count(spark):
    random.seed(4)
    items = [(d, 1 + random.random().__lt__(0.3), random.choice([0, 0, 1, 1, 2]), k) for d in range(4) for k in range(60)]
    levels = [(d, n, i, "decimal", t, s, None) for d in range(4) for n in (1, 2) for i, t, s in ((0, "%1", 1), (1, "%1.%2", 3), (2, "%1.%2.%3", 1))]
    got = {(r["doc_id"], r["order"]): r["number_text"] for r in numbering.render(spark.createDataFrame(items, "doc_id int, num_id int, ilvl int, order int"), spark.createDataFrame(levels, "doc_id int, num_id int, ilvl int, num_fmt string, lvl_text string, start int, start_override int")).collect()}
    now, start = {}, (1, 3, 1)
    for d, n, i, k in items:
        now[d, n, i] = now.get((d, n, i), start[i] - 1) + 1
        for deeper in range(i + 1, 3):
            now.pop((d, n, deeper), None)
        assert got[d, k] == ".".join(str(now.get((d, n, x), start[x])) for x in range(i + 1))


def test_a_level_can_restart_another(spark):
    levels = [(1, 1, 0, "decimal", "%1", 1, None, 1), (1, 1, 1, "decimal", "%1.%2", 1, None, None)]
    items = spark.createDataFrame([(1, 1, i, k) for k, i in enumerate([0, 0, 1, 0])], "doc_id int, num_id int, ilvl int, order int")
    spec = spark.createDataFrame(levels, "doc_id int, num_id int, ilvl int, num_fmt string, lvl_text string, start int, start_override int, lvl_restart int")
    assert [r["number_text"] for r in numbering.render(items, spec).orderBy("order").collect()] == ["1", "2", "1.1", "1"]


def test_tree_matches_a_stack(spark):
    random.seed(5)
    rows = [(d, k, None if random.random() < 0.1 else random.randint(1, 6)) for d in range(20) for k in range(30)]
    nodes = tree.clamp_levels(spark.createDataFrame(rows, "doc_id int, para_index int, raw_level int"))
    got = {(r["doc_id"], r["order_num"]): (r["level"], r["parent_order"], r["chapter_path"]) for r in tree.link_parents(nodes, F.col("para_index").cast("string")).collect()}
    for d in range(20):
        before, stack = None, []
        for _, k, raw in (r for r in rows if r[0] == d):
            level = raw if raw is not None else (before + 1 if before else 1)
            before = level = min(level, before + 1) if before else level
            while stack and stack[-1][0] >= level:
                stack.pop()
            assert got[d, k] == (level, stack[-1][1] if stack else None, " / ".join([str(x) for _, x in stack] + [str(k)]))
            stack.append((level, k))


def test_trees_of_any_depth(spark):
    nodes = tree.clamp_levels(spark.createDataFrame([(1, k, None if k < 40 else 1) for k in range(41)], "doc_id int, para_index int, raw_level int"))
    got = [(r["level"], r["parent_order"], r["chapter_path"]) for r in tree.link_parents(nodes, F.col("para_index").cast("string")).orderBy("order_num").collect()]
    assert got == [(k + 1, k - 1 if k else None, " / ".join(map(str, range(k + 1)))) for k in range(40)] + [(1, None, "40")]


def candidate(i, level=None, prefix=None, anchor=None):
    return (1, i, f"t{i}", prefix, f"t{i}", level, level is not None if anchor is None else anchor)


def build(spark, rows, said=None):
    c = spark.createDataFrame(rows, "doc_id int, para_index int, text string, number_prefix string, title string, suggested_level int, is_anchor boolean")
    d = spark.createDataFrame(said, "doc_id int, idx int, is_title boolean, level int") if said else None
    return [(r["para_index"], r["level"], r["source"], r["needs_review"]) for r in tree.build_tree(c, d).orderBy("order_num").collect()]


def test_tree_flags(spark):
    assert build(spark, [candidate(0, 1, "1."), candidate(1, 3, "1.1"), candidate(2)]) == [(0, 1, "rule", 0), (1, 2, "rule", 1)]
    assert build(spark, [candidate(0, 1, "a"), candidate(1)]) == [(0, 1, "rule", 1)]  # pending
    said = [(1, 0, True, 1), (1, 1, True, 1), (1, 2, False, None), (1, 3, True, None)]
    assert build(spark, [candidate(0, 1, "a"), candidate(1, 2, "b"), candidate(2, 1, "c"), candidate(3, None, "d")], said) == [(0, 1, "rule", 0), (1, 1, "llm", 1), (3, 2, "llm", 1)]
    assert build(spark, [candidate(0, 1, "1."), candidate(1, 2, "2.")]) == [(0, 1, "rule", 1), (1, 2, "rule", 1)]  # one pattern on two levels


def test_cascade(spark):
    fields = "text string, font_size_halfpt int, bold boolean, first_line_indent_chars double, outline_lvl int, has_numpr boolean, mixed_run_fmt boolean, style_name string, style_id string, base_font int, base_indent double"
    body = dict(text="普通正文", font_size_halfpt=21, bold=False, first_line_indent_chars=2.0, outline_lvl=None, has_numpr=False, mixed_run_fmt=False, style_name=None, style_id=None, base_font=21, base_indent=2.0)
    cases = [
        ({}, False), ({"text": "  "}, False), ({"outline_lvl": 0}, True), ({"style_name": "Heading 2"}, True), ({"style_id": "标题3"}, True), ({"text": "编号：ABCD", "bold": True, "font_size_halfpt": 30}, False),
        ({"mixed_run_fmt": True, "font_size_halfpt": 30}, False), ({"bold": True}, False), ({"bold": True, "first_line_indent_chars": 0.0}, True), ({"bold": True, "text": "长" * 51, "first_line_indent_chars": 0.0}, False),
        ({"font_size_halfpt": 24}, True), ({"has_numpr": True}, False), ({"has_numpr": True, "first_line_indent_chars": None}, True), ({"text": "1、要求；", "first_line_indent_chars": 0.0}, True), ({"text": "1、要求；", "first_line_indent_chars": 4.0}, False), ({"text": "1、要求", "first_line_indent_chars": 4.0}, True),
    ]
    rows = spark.createDataFrame([tuple((body | c).values()) for c, _ in cases], fields).select(features.is_candidate()).collect()
    assert [r[0] for r in rows] == [e for _, e in cases]


def test_baselines_keep_the_first_of_equals(spark):
    rows = spark.createDataFrame([(1, 0, "x" * 10, 24, 2.675), (1, 1, "x" * 10, 21, 2.675), (1, 2, "x" * 9, 21, 0.0), (2, 0, "short", 21, 1.0)], "doc_id int, para_index int, text string, font_size_halfpt int, first_line_indent_chars double")
    assert [tuple(r) for r in features.baselines(rows).collect()] == [(1, 24, round(2.675, 2))]


def test_exact_rounding(spark):
    random.seed(1)
    xs = [random.randint(0, 3000) / (random.choice([21, 24, 28, 32]) / 2 * 20) for _ in range(300)] + [2.675, 1.005, 0.125, 2.5]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(features.round_half_even(F.col("x"), 2)).collect()
    assert [r[0] for r in got] == [round(x, 2) for x in xs]


def test_search_is_literal(spark):
    rows = [(1, 1, "50% 方案", "a_b 100% Sure\\Emax", 0), (2, 1, "axb", "aab aaab AAAB", 1)]
    chapters = spark.createDataFrame(rows, "id long, doc_id long, title string, content string, order_num int").withColumn("chapter_path", F.col("title")).withColumn("level", F.lit(1))
    assert [r["id"] for r in search.search_like(chapters, ["%"]).collect()] == [1]
    assert [r["id"] for r in search.search_like(chapters, ["_"]).collect()] == [1]
    assert chapters.where("id = 2").select(text.occurrences(F.col("content"), "aa")).first()[0] == 5
    assert chapters.where("id = 1").select(text.occurrences(F.col("content"), "\\Emax")).first()[0] == 1
    assert search.search_content(chapters, "aab AAAB").first()["id"] == 2
    index = postings.build(chapters, {"text": search.indexed_text()})
    assert [r["id"] for r in postings.holding(postings.matches(index, "text", ["aaab"])).collect()] == [2]
    with pytest.raises(ValueError, match="no keywords"):
        search.search_content(chapters, " ")


def test_map_folds(spark):
    rows = [(k, 7, (1, 2, 3, 1)[k % 4], None, f"t{k}", f"p{k}", k) for k in range(8)]
    chapters = spark.createDataFrame(rows, "id long, doc_id long, level int, number_prefix string, title string, chapter_path string, order_num int")
    assert catalog.document_map(chapters).first()["map"].count("\n") == 7
    assert catalog.document_map(chapters, full=5).first()["map"].split("\n")[:5] == ["0|1|p0|t0", "…含2个小节", "1|2|p1|t1", "3|1|p3|t3", "…含0个小节"]


def test_chunks(spark):
    rows = spark.createDataFrame([(1, k, (1, 2, 2, 1, 2, 1, 2)[k]) for k in range(7)], "doc_id int, para_index int, suggested_level int")
    assert [r["chunk"] for r in decisions.chunks(rows, 4).orderBy("para_index").collect()] == [0, 0, 0, 1, 1, 2, 2]


def test_validation_needs_every_candidate(spark):
    c = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "doc_id int, para_index int")
    d = spark.createDataFrame([(1, 0, 0, True, 99), (1, 1, 1, False, 3), (1, 2, 0, True, 1), (2, 0, 5, True, 1)], "doc_id int, seq int, idx int, is_title boolean, level int")
    assert sorted(tuple(r) for r in decisions.validate(d, c).collect()) == [(1, 0, True, 9), (1, 1, False, None)]


def test_settings(tmp_path):
    path = tmp_path / "c.toml"
    path.write_text("top_k = 9\nmax_chars = 100\n")
    s = load_settings(str(path), {"QUIRE_TOP_K": "3", "QUIRE_MAX_CHARS": ""})
    assert (s.top_k, s.max_chars, s.rounds) == (3, 4000, 6)
