"""Versions of a store, its two indexes and its threads."""

import os
import random
import time

import pytest
from docx_files import docx, paragraph
from pyspark.sql import functions as F

from quire.operators import postings, search, sections
from quire.plans import store as stores
from quire.plans.ask import Call, ask, keyword_policy
from quire.plans.shared import Scratch
from quire.plans.store import Conflict, Store

BODY = "正文内容足够长，可以作为基线段落来统计。"


def files(spark, *named):
    rows = [(name, bytearray(content), name) for name, content in named]
    return spark.createDataFrame(rows, "path string, content binary, doc_name string").withColumn("doc_hash", F.sha2("content", 256))


def book(*heads, body=BODY):
    return docx(*(x for h in heads for x in (paragraph(h, outline=0), paragraph(body))))


def content(store):
    return {name: sorted(map(str, store.table(name).drop("create_time").collect())) for name in ("documents", "chapters", "tables", "cells", "statistics")}


def test_a_batch_that_breaks_off_changes_nothing_but_the_status(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "store"))
    store.add(files(spark, ("a", book("甲章", "乙章"))))
    before, version = content(store), store.version()
    write = Store._write

    def broken(self, name, batch, rows):
        if name == "cells":
            raise OSError("stopped between two tables")
        write(self, name, batch, rows)

    monkeypatch.setattr(Store, "_write", broken)
    with pytest.raises(OSError, match="stopped"):
        store.add(files(spark, ("a", book("甲章", "乙章")), ("b", book("丙章"))))
    after = content(store)
    assert {k: v for k, v in after.items() if k != "documents"} == {k: v for k, v in before.items() if k != "documents"}
    assert sorted(r.status for r in store.table("documents").collect()) == ["processing", "processing"]
    assert (store.version().chapters, store.version().trigrams) == (version.chapters, version.trigrams)
    monkeypatch.setattr(Store, "_write", write)
    store.add(files(spark, ("a", book("甲章", "乙章")), ("b", book("丙章"))))
    assert sorted(r.status for r in store.table("documents").collect()) == ["done", "done"]
    assert sorted(r.title for r in store.table("chapters").collect()) == ["丙章", "乙章", "甲章"] and store.version().chapters == 3
    held = content(store)
    found = [r.title for r in store.search(None, "正文内容", top_k=9).collect()]
    store.compact()
    assert store.vacuum() > 0 and content(store) == held
    assert [r.title for r in store.search(None, "正文内容", top_k=9).collect()] == found and len(found) == 3


def test_adds_leave_nothing_cached_and_no_scratch(spark, tmp_path):
    shared = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.sparkContext.getCheckpointDir() or "file:///nowhere")
    fs = shared.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    left = lambda: {s.getPath().getName() for s in (fs.listStatus(shared) if fs.exists(shared) else []) if s.getPath().getName().startswith("scratch-")}
    store, cached, mine = Store(spark, str(tmp_path / "store")), spark.sparkContext._jsc.getPersistentRDDs().size(), left()
    for k in range(2):
        store.add(files(spark, (f"f{k}", book(f"第{k}章"))))
        assert spark.sparkContext._jsc.getPersistentRDDs().size() == cached and left() == mine
    assert store.version().chapters == 2 == store.table("chapters").count()


def files_below(top, part):
    return {f"{d}/{n}": os.path.getsize(f"{d}/{n}") for d, _, names in os.walk(top) for n in names if part in n}


def test_what_an_add_holds_on_disk(spark, tmp_path, monkeypatch):
    """Files go when they are parsed, steps before the index is written; filters are as large as their values need."""
    store, held, write = Store(spark, str(tmp_path / "store")), {}, Store._write
    shared = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    scratch = lambda: {n for n in os.listdir(shared) if n.startswith("scratch-")}
    done, mine = [], scratch()

    def noted(self, name, batch, rows):
        held[name] = len(scratch() - mine), done[:]
        write(self, name, batch, rows)

    monkeypatch.setattr(Store, "_write", noted)
    store.add(files(spark, *((f"f{k}", book(f"第{k}章")) for k in range(9))).repartition(3), parsed=lambda: done.append(True))
    assert held["statistics"] == (2, [True]) and held["postings"] == (1, [True])  # at the index only the registered names are left
    sizes = files_below(store.path, ".parquet")
    assert sizes and max(sizes.values()) < 200_000  # a filter was 1 MB whatever it held


def test_shuffles_go_with_their_query(spark, tmp_path):
    local = spark.conf.get("spark.local.dir")
    before = set(files_below(local, "shuffle_"))
    counts = spark.range(1000).selectExpr("id as doc_id", "'' as error", *(f"id as {c}" for c in "total_paragraphs total_chars candidates anchors pending chapters needs_review tables".split())).repartition(3, "doc_id")
    with Scratch(spark) as scratch:
        assert scratch.cut(counts).count() == 1000
        Store(spark, str(tmp_path / "store"))._write("statistics", "one", counts)
        left = lambda: {f for f in set(files_below(local, "shuffle_")) - before if "_data" in f or f.endswith(".data")}
        until = time.time() + 20
        while len(left()) > 1 and time.time() < until:  # the count's own may stay
            time.sleep(0.5)
        assert len(left()) <= 1


def test_index_in_parts_is_the_index(spark, tmp_path, monkeypatch):
    rnd, parts, build = random.Random(5), [], postings.build
    monkeypatch.setattr(stores, "INDEXED", 500)
    monkeypatch.setattr(stores, "BLOCK", 3)
    monkeypatch.setattr(postings, "build", lambda texts, fields, part=0: parts.append(part) or build(texts, fields, part))
    store = Store(spark, str(tmp_path / "store"))
    store.add(files(spark, *((f"{k}", book(f"章{k}甲 Deposit", body="".join(rnd.choice(["标准", "评分", "aaa", "Deposit"]) for _ in range(40)))) for k in range(12))))
    assert parts == list(range(len(parts))) and len(parts) > 2
    for keywords in ("deposit 评分标准", "aaaa", "章1"):
        assert store.search(None, keywords, top_k=99).collect() == search.search_content(store.table("chapters"), keywords, top_k=99).collect()
    index = store.table("postings").where("gram = ''").select("field", "segment")
    assert index.count() == index.distinct().count()
    store.compact()
    assert store.version().chapters == 12 == len(store.search(None, "deposit", top_k=99).collect())


def test_contents_are_dealt_out_once(spark):
    nodes = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "doc_id long, order_num int, title string")
    places = spark.createDataFrame([(1, 3, 0), (1, 1, 0), (1, 9, 1)], "doc_id long, seq int, section int")
    texts = spark.createDataFrame([(1, 1, "one"), (1, 2, "no section"), (1, 3, ""), (1, 9, "nine"), (2, 9, "none")], "doc_id long, seq int, text string")
    tables = spark.createDataFrame([(1, 2 + 8, 0, "grid")], "doc_id long, seq int, section int, text string")
    found = sections.filled(nodes, [places, texts, tables])
    assert sorted(map(tuple, found.select("doc_id", "order_num", "title", "content").collect())) == [(1, 0, "a", "one\n\ngrid"), (1, 1, "b", "nine"), (2, 0, "c", "")]
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A store of one book and one file that can't be read."""
    store = Store(spark, str(tmp_path_factory.mktemp("small") / "store"))
    store.add(files(spark, ("a", docx(paragraph("投标保证金", outline=0), paragraph("保证金为五万元。"), paragraph("评分办法", outline=0), paragraph("评分标准按照百分制计算。"))), ("bad", b"no zip")))
    return store


def test_ranked_search_reads_only_the_best_texts(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    rnd = random.Random(4)
    words = ["标准", "评分", "保证金", "Deposit", "投标人", "aaa"]
    for b in range(2):
        store.add(files(spark, *((f"{b}-{k}", book(f"章{k}甲", f"节{k} Deposit", body="".join(rnd.choice(words) for _ in range(40)))) for k in range(6))))
    store.add(files(spark, ("0-0 again", bytes(store_bytes(rnd, words)))))
    chapters = store.table("chapters")
    for keywords in ("deposit 评分标准", "aaaa", "没有这个"):
        want = search.search_content(chapters, keywords, top_k=7).collect()
        assert store.search(None, keywords, top_k=7).collect() == want
        doc = chapters.first()["doc_id"]
        assert store.search(doc, keywords).collect() == search.search_content(chapters, keywords, doc).collect()
    assert all("/store/postings/" in f for f in store.ranked("保证金").inputFiles())  # no text before the limit
    plan = store.search(None, "保证金", top_k=2)._jdf.queryExecution().executedPlan().toString()
    assert "In(id" in plan and "block" in plan.split("PartitionFilters: [")[1].split("]")[0]  # two ids of a block or two
    for keywords in ("Deposit", "节1", "节1 Dep"):
        doc = store.table("documents").where("doc_name = '0-1'").first()["id"]
        assert store.find(doc, keywords).collect() == search.find_title(store.table("chapters", doc), keywords, doc).collect()


def store_bytes(rnd, words):
    return book("另一章", body="".join(rnd.choice(words) for _ in range(40)))


def test_postings_against_counting(spark):
    rnd = random.Random(9)
    texts = [(k * 7, rnd.choice([None, "", "ab"]) if k % 9 == 0 else "".join(rnd.choice("aAbİ日😀") for _ in range(rnd.randint(1, 300)))) for k in range(60)] + [(9999, "aab" * 5000)]
    df = spark.createDataFrame(texts, "id long, t string").repartition(4)
    index = postings.build(df, {"text": F.col("t"), "other": F.lit("aaa aaa")})
    low = {r.id: r.t or "" for r in df.select("id", F.lower("t").alias("t")).collect()}
    terms = ["aaa", "aba", "abab", "b日😀", "aabaabaab", "zzz"]
    got = {r.id: (r.length, list(r.tf)) for r in postings.matches(index, "text", terms).collect()}
    count = lambda t, x: sum(t.startswith(x, k) for k in range(len(t)))
    want = {k: (max(0, len(t) - 2), tf) for k, t in low.items() if any(tf := [count(t, x) for x in terms])}
    assert got == want
    assert {tuple(r.tf) for r in postings.matches(index, "other", ["aaa"]).collect()} == {(2,)}
    assert postings.matches(postings.build(df.limit(0), {"text": F.col("t")}), "text", terms).isEmpty()


def test_questions_in_a_thread_go_on(small):
    store = small
    doc = store.table("documents").where("doc_name = 'a'").first()["id"]
    first = ask(store, doc, "保证金是多少？", thread="t")
    seen = []

    def policy(messages):
        seen.append([m["role"] for m in messages])
        return keyword_policy(messages)

    second = ask(store, doc, "评分标准呢？", policy, thread="t")
    assert "投标保证金" in first.answer and "评分办法" in second.answer and "投标保证金" not in second.answer
    assert seen[0] == ["system", "user", "assistant", "tool", "assistant", "user"]
    rows = store.thread("t").collect()
    assert [r["seq"] for r in rows] == list(range(9)) and [r["role"] for r in rows] == [*seen[0], "assistant", "tool", "assistant"]
    assert keyword_policy([{"role": "user", "content": "废标和保证金"}]) == [Call("search_content", {"keywords": "保证金"})]


def test_what_is_not_there(spark, small, tmp_path):
    empty = Store(spark, str(tmp_path / "store"))
    assert empty.listing().count() == 0 and empty.search(None, "什么都没有").count() == 0
    for view in (small.stats, small.map, small.tree, lambda d: small.search(d, "甲章节"), lambda d: small.find(d, "甲章节")):
        with pytest.raises(LookupError, match="no document 99"):
            view(99)
    with pytest.raises(LookupError, match="no chapter 5"):
        small.page(5)
    stats = {r["doc_name"]: (r["status"], r["chapters"], r["tables"], r["error_msg"] is None) for d in (1, 2) for r in small.stats(d).collect()}
    assert stats == {"a": ("done", 2, 0, True), "bad": ("failed", 0, 0, False)}


def test_of_two_writers_one_fails(small):
    start = small.version()
    small.compact()
    with pytest.raises(Conflict):
        small._commit(start, start)
    assert small.version().number == start.number + 1 and small.table("chapters").count() == 2


def test_snippets_show_the_best_window(spark):
    def plain(text, terms, size):
        low, grams = text.lower(), size - 2
        hits = {t: [i for i in range(len(low)) if low.startswith(t.lower(), i)] for t in terms}
        best = None
        for at in sorted({i for h in hits.values() for i in h}):
            inside = {t: [i for i in h if at <= i < at + grams] for t, h in hits.items()}
            shown = sum(999 + len(h) for h in inside.values() if h)
            if best is None or shown > best[0]:
                best = shown, at, max(max(h) + len(t) - 2 for t, h in inside.items() if h)
        if best is None:
            return 0
        return max(0, min(best[1] - int((grams - (best[2] - best[1])) / 2), len(text) - 2 - grams))

    rnd = random.Random(12)
    texts = ["Deposit first, then a long way to the deposit of a bid", "no hit", "", "deposit", *("".join(rnd.choice(["bid ", "Deposit ", "xx ", "yyyy "]) for _ in range(rnd.randint(1, 30))) for _ in range(40))]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, t string")
    for terms in (["deposit"], ["bid", "deposit"], ["deposit", "bid ", "yyyy"]):
        got = {r[0]: r[1] for r in df.select("id", search.best_window(F.col("t"), terms, 20)).collect()}
        assert got == {k: plain(t, terms, 20) for k, t in enumerate(texts)}
    assert df.where("id = 0").select(search.snippet(F.col("t"), ["bid", "deposit"], 20)).first()[0] == "…the 【deposit】 of a 【bid】"
