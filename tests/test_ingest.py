import pytest
from docx_files import cell, docx, field, instruction, list_kind, list_of, paragraph, run, table
from pyspark.sql import functions as F

from quire.operators.decisions import rule_decisions, validate
from quire.plans.ask import Call, ask
from quire.plans.deciders import decider, json_object, model_decisions
from quire.plans.ingest import PER_DOCUMENT, headings, ingest
from quire.plans.store import Store
from quire.sources.docx import parse, parse_files
from quire.streaming.ingest import stream_folder

BODY = "正文内容足够长，可以作为基线段落来统计。"


def report():
    return docx(
        paragraph("共 3 页"), paragraph("总则", style="Top", list_id=11, level=0), paragraph(BODY), paragraph("   "),
        paragraph(field("begin"), instruction(" TOC \\o "), "目录"), paragraph("第一章 ........ 1"), paragraph(field("end"), "末行"),
        paragraph("范围", outline=1, list_id=11, level=1), paragraph(BODY), table(2, [cell("名", bold=True), cell("值", bold=True)], [cell("a|b"), cell("1")]),
        paragraph("定义", outline=1, list_id=11, level=1), paragraph(BODY), paragraph("附则", style="TopKin", list_id=11), paragraph(BODY), paragraph("特此声明"),
    )


def files(spark, *contents):
    return spark.createDataFrame([(k + 1, bytearray(c)) for k, c in enumerate(contents)], "doc_id long, content binary")


@pytest.fixture(scope="module")
def found(spark):
    return ingest(files(spark, report(), b"not a zip"))


def test_chapters(found):
    rows = [tuple(r) for r in found.chapters.orderBy("order_num").select("level", "number_prefix", "title", "chapter_path", "content", "parent_id", "source", "confidence").collect()]
    shown = "| 名 | 值 |\n| --- | --- |\n| a\\|b | 1 |"
    assert rows == [
        (1, "I)", "总则", "I) 总则", BODY, 0, "rule", 1.0),
        (2, "I.a", "范围", "I) 总则 / I.a 范围", f"{BODY}\n{shown}", PER_DOCUMENT + 1, "rule", 1.0),
        (2, "I.b", "定义", "I) 总则 / I.b 定义", BODY, PER_DOCUMENT + 1, "rule", 1.0),
        (1, "II)", "附则", "II) 附则", BODY, 0, "rule", 1.0),
    ]


def test_tables_and_errors(found):
    t = found.tables.first()
    assert (t["id"], t["chapter_id"], t["total_rows"], t["total_cols"], t["order_num"]) == (PER_DOCUMENT + 1, PER_DOCUMENT + 2, 2, 2, 0)
    assert [(r["content"], r["is_header"]) for r in found.cells.orderBy("row_idx", "col_idx").collect()] == [("名", 1), ("值", 1), ("a|b", 0), ("1", 0)]
    assert found.errors.first()["doc_id"] == 2
    s = found.statistics.where("doc_id = 1").first()
    assert (s["total_paragraphs"], s["candidates"], s["anchors"], s["pending"], s["chapters"], s["tables"], s["total_chars"]) == (8, 4, 4, 0, 4, 1, 4 * len(BODY) + 8)


def test_features_follow_styles_and_runs(spark):
    content = docx(
        paragraph("x" * 12, style="Plain", first_line="480"), paragraph(run("y", 30, False), style="TopKin", first_chars="bad"),
        paragraph("z", outline=9), paragraph(run("a", 20), run("b", 22)), paragraph("n", list_id=0), paragraph("12、项目", list_id=12, level=0), paragraph("w", list_id=12),
    )
    from quire.operators.cleaning import select_body
    from quire.operators.features import resolve_features

    parsed = parse_files(files(spark, content))
    body = select_body(parsed.select("doc_id", F.inline("items")))
    rows = resolve_features(body.select("doc_id", "seq", "para_index", "text", "style_id", "ppr", "runs"), parsed.select("doc_id", F.inline("styles"))).orderBy("seq").collect()
    got = [(r["font_size_halfpt"], r["bold"], r["first_line_indent_chars"], r["outline_lvl"], r["has_numpr"], r["mixed_run_fmt"]) for r in rows]
    assert got[:5] == [(24, False, 2.0, None, False, False), (30, False, None, 0, False, False), (None, False, None, None, False, False), (20, False, None, None, False, True), (None, False, None, None, False, False)]
    _, candidates = headings(parsed)
    prefixes = {r["para_index"]: (r["number_prefix"], r["title"]) for r in candidates.collect()}
    assert prefixes[5] == ("12、", "项目") and prefixes[6] == ("VI)", "w")


def test_vertical_merge_and_spans():
    made = table(3, [cell("h", span=2), cell("m", merge="restart")], [cell("a"), cell("b"), cell("", merge="continue")], [cell("c", merge="continue"), cell("d"), cell("", merge="continue")])
    grid = parse(docx(made))["items"][0]
    spans = {(c["row_idx"], c["col_idx"]): (c["content"], c["row_span"], c["col_span"]) for c in grid["cells"]}
    assert spans == {(0, 0): ("h", 1, 2), (0, 2): ("m", 3, 1), (1, 0): ("a", 1, 1), (1, 1): ("b", 1, 1), (2, 0): ("c", 1, 1), (2, 1): ("d", 1, 1)}


def test_entities_are_refused():
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", '<!DOCTYPE x [<!ENTITY a "b">]><x/>')
    assert "refused" in parse(out.getvalue())["error"]


def test_rule_levels_without_decisions(spark):
    content = docx(paragraph("一级", outline=0), paragraph(run("加粗待定", bold=True), style="Plain", first_line="10"), paragraph(run("待定", bold=True), style="Plain"), paragraph(BODY, style="Plain"))
    chapters = ingest(files(spark, content), decide=None).chapters
    assert [(r["title"], r["needs_review"], r["confidence"]) for r in chapters.collect()] == [("一级", 1, 0.5)]


def test_incomplete_decisions_leave_a_document_to_the_rules(spark):
    content = docx(paragraph("甲", outline=0), paragraph("乙", outline=0), paragraph("丙", outline=0))

    def decide(candidates):
        said = candidates.select("doc_id", F.col("para_index").alias("idx"), F.lit(True).alias("is_title"), F.when(F.col("para_index") > 0, F.col("para_index") + 1).otherwise(F.lit(-3)).alias("level"))
        return said.where("not (doc_id = 1 and idx = 2)").unionByName(said.where("doc_id = 3 and idx = 2").withColumn("idx", F.lit(99)))

    chapters = ingest(files(spark, content, content, content), decide=decide).chapters
    assert sorted(tuple(r) for r in chapters.select("doc_id", "order_num", "level").collect()) == [(1, 0, 1), (1, 1, 1), (1, 2, 1), (2, 0, 1), (2, 1, 2), (2, 2, 3), (3, 0, 1), (3, 1, 1), (3, 2, 1)]


def test_a_title_without_level_stays_so(spark):
    c = spark.createDataFrame([(1, 0)], "doc_id int, para_index int")
    d = spark.createDataFrame([(1, 0, 0, True, None)], "doc_id int, seq int, idx int, is_title boolean, level int")
    assert [tuple(r) for r in validate(d, c).collect()] == [(1, 0, True, None)]


def test_store_search_and_ask(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.docx").write_bytes(report())
    (folder / "b.DOCX").write_bytes(docx(paragraph("评分办法", outline=0), paragraph("评分标准按照百分制计算，价格评分占三成。"), paragraph("投标保证金", outline=0), paragraph("保证金为五万元。")))
    store = Store(spark, str(tmp_path / "store"))
    assert store.add_folder(str(folder)).count() == 2
    before = {(r["id"], r["doc_hash"]) for r in store.table("documents").collect()}
    store.add_folder(str(folder))  # the same bytes again
    assert {(r["id"], r["doc_hash"]) for r in store.table("documents").collect()} == before
    listing = {r["doc_name"]: (r["status"], r["chapter_count"], r["table_count"]) for r in store.listing().collect()}
    assert listing == {"a.docx": ("done", 4, 1), "b.DOCX": ("done", 2, 0)}
    doc = store.table("documents").where("doc_name = 'b.DOCX'").first()["id"]
    assert [r["title"] for r in store.search(doc, "保证金").collect()] == ["投标保证金"]
    assert "【保证金】" in store.search(doc, "保证金").first()["hit"]
    assert store.search(doc, "评分").first()["hit"].endswith("…")
    assert [r["title"] for r in store.find(doc, "评分办").collect()] == ["评分办法"]
    trace = ask(store, doc, "保证金是多少？")
    assert trace.steps[0]["tool"] == "search_content" and "投标保证金" in trace.answer
    assert [r["role"] for r in store.thread(trace.thread).collect()] == ["system", "user", "assistant", "tool", "assistant"]
    chapter = store.table("chapters").where("title = '总则'").first()["id"]
    said = iter([[Call("get_chapter", {"chapter_id": chapter, "max_chars": 5})], "done"])
    trace = ask(store, store.table("chapters").where("title = '总则'").first()["doc_id"], "?", policy=lambda _: next(said))
    assert "offset=5" in trace.steps[0]["result"] and trace.answer == "done"


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.docx").write_bytes(report())
    store = Store(spark, str(tmp_path / "store"))
    stream_folder(spark, str(folder), store, str(tmp_path / "cp")).awaitTermination()
    assert store.table("chapters").count() == 4


def test_rule_decisions_are_used(spark):
    rows = spark.createDataFrame([(1, 0, 2), (1, 1, None), (1, 2, 12)], "doc_id long, para_index int, suggested_level int")
    assert [tuple(r)[1:] for r in rule_decisions(rows).orderBy("idx").collect()] == [(0, True, 2), (1, False, None), (2, True, 9)]


def test_repeated_lists_and_levels_harm_no_other_file(spark):
    twice = list_kind(40, ("upperRoman", "%1)"), ("decimal", "%2."))
    twice.extend(list_kind(40, ("lowerLetter", "(%1)")))  # level 0 again: the last holds
    odd = docx(paragraph("甲", outline=0, list_id=11, level=0), numbering=(twice, list_of(11, 40), list_of(11, 40, {0: 3})))
    found = ingest(files(spark, report(), odd))
    rows = {(r["doc_id"], r["title"]): r["number_prefix"] for r in found.chapters.collect()}
    assert rows[2, "甲"] == "(c)" and rows[1, "总则"] == "I)" and found.errors.isEmpty()


def test_deep_trees(spark):
    deep = docx(*(paragraph(f"级{k}", outline=k) for k in range(9)))
    chapters = ingest(files(spark, deep)).chapters
    assert chapters.where("level = 9").first()["chapter_path"].count(" / ") == 8


def test_stored_index_and_status(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.docx").write_bytes(report())
    (folder / "again.docx").write_bytes(report())
    (folder / "b.docx").write_bytes(docx(paragraph("评分办法", outline=0), paragraph("评分标准按照百分制计算，保证金为五万元。")))
    (folder / "c.docx").write_bytes(b"no zip")
    store = Store(spark, str(tmp_path / "store"))
    statistics = store.add_folder(str(folder))
    assert statistics.count() == 3 and statistics.first()["elapsed_seconds"] > 0
    assert sorted(r["status"] for r in store.table("documents").collect()) == ["done", "done", "failed"]
    assert {r["doc_name"] for r in store.table("documents").collect()} == {"a.docx", "b.docx", "c.docx"}
    doc = store.table("documents").where("doc_name = 'b.docx'").first()["id"]
    chapters = store.table("chapters")
    for words in ("保证金", "评分标准 保证金", "没有这个词"):
        from quire.operators.search import search_content

        scanned = search_content(chapters, words, doc).collect()
        assert store.search(doc, words).collect() == scanned
    index = store.table("postings")
    assert index.where("field = 'text' and gram = ''").agg(F.sum(F.size("ids"))).first()[0] == chapters.count() == store.version().chapters
    assert index.where("field = 'text' and gram = '保证金'").select(F.aggregate("counts", F.lit(0), lambda a, x: a + x)).first()[0] == 1
    plan = store.map(doc)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(block" in plan


def test_a_model_decides_by_chunks(spark):
    content = docx(*(paragraph(f"标题{k}", outline=k % 3) for k in range(7)))

    def answer(task, request):
        import json

        items = json.loads(request)["items"]
        said = [{"idx": x["idx"], "is_title": True, "level": 1 + x["idx"] % 2} for x in items]
        if len(items) == 1:
            raise OSError("no answer")
        return "Here you are:\n```json\n" + json.dumps({"items": said}) + "\n```\nDone."

    levels = lambda decide: [r["level"] for r in ingest(files(spark, content), decide=decide).chapters.orderBy("order_num").collect()]
    assert levels(model_decisions(answer, most=4)) == [1, 2, 3, 1, 2, 3, 1]  # the last chunk is one candidate and fails, so the rules decide
    assert levels(model_decisions(answer, most=7)) == [1, 2, 1, 2, 1, 2, 1]


def test_answers_with_words_around():
    assert json_object('sure {"items": []} ok') == {"items": []} and json_object('```\n{"a": {"b": 1}}\n```') == {"a": {"b": 1}}
    with pytest.raises(ValueError):
        json_object("no")


def test_deciders_by_setting(monkeypatch):
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from threading import Thread

    from quire.plans.deciders import http_chat
    from quire.sources.config import Settings, load_settings

    assert decider(Settings()) is rule_decisions and decider(Settings(decider="none")) is None
    with pytest.raises(ValueError):
        decider(Settings(decider="model"))
    seen = []

    class Answer(BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append((self.path, self.headers["Authorization"], self.rfile.read(int(self.headers["Content-Length"]))))
            body = b'{"choices": [{"message": {"content": "{}"}}]}'
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    Thread(target=server.serve_forever, daemon=True).start()
    settings = load_settings(environment={"QUIRE_DECIDER": "model", "QUIRE_API_KEY": "k", "QUIRE_BASE_URL": f"http://127.0.0.1:{server.server_port}/v1"})
    assert http_chat(settings)("task", "request") == "{}" and seen[0][:2] == ("/v1/chat/completions", "Bearer k")
    assert "api_key" not in repr(settings)
    server.shutdown()
