"""Numbers of messages over batches, repeats and restarts; bucketed tables without exchanges."""

from docx_files import docx, paragraph
from pyspark.sql import functions as F

from quire.operators import catalog
from quire.plans.bucketed import publish
from quire.plans.store import Store
from quire.streaming import messages

KIND = "thread_id string, message_id string, at long, role string, content string"


def test_two_questions_in_a_thread(spark, tmp_path):
    folder, log, at = (str(tmp_path / n) for n in ("in", "log", "at"))

    def send(*rows):
        spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(folder)
        sent = spark.readStream.schema(KIND).parquet(folder)
        assert messages.write_numbered(messages.number(sent), log, at).awaitTermination(180)
        found = messages.read_log(spark, log).orderBy("thread_id", "seq").collect()
        return [(r["thread_id"], r["seq"], r["message_id"], r["content"]) for r in found]

    first = [("t", "m2", 2, "assistant", "answer one"), ("t", "m1", 1, "user", "question one"), ("u", "m1", 1, "user", "other"), (None, "m1", 1, "user", "no thread"), ("t", None, 1, "user", "no id")]
    one = [("t", 0, "m1", "question one"), ("t", 1, "m2", "answer one"), ("u", 0, "m1", "other")]
    assert send(*first) == one
    assert send(*first) == one  # repeated whole
    second = [("t", "m4", 4, "assistant", "answer two"), ("t", "m2", 9, "assistant", "answer one"), ("t", "m3", 3, "user", "question two"), ("t", "m3", 3, "user", "question two"), ("v", "a", None, "user", None)]
    assert send(*second) == [*one[:2], ("t", 2, "m3", "question two"), ("t", 3, "m4", "answer two"), one[2], ("v", 0, "a", None)]


def test_bucketed_tables_need_no_exchange(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    heads = [("a.docx", docx(*(paragraph(f"head {k}", outline=k % 2) for k in range(4)), paragraph("text"))), ("b.docx", docx(paragraph("alone", outline=0))), ("c.docx", b"broken")]
    rows = spark.createDataFrame([(n, n, bytearray(c)) for n, c in heads], "path string, doc_name string, content binary")
    store.add(rows.withColumn("doc_hash", F.sha2("content", 256)))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    try:
        made = publish(store, "published", str(tmp_path / "published"), 4)
        for found, plain in ((made.listing(), store.listing()), (made.children(), None)):
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan
            if plain is not None:
                assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect()))
        pairs = {(r["parent_title"], r["title"]) for r in made.children().collect()}
        assert pairs == {("head 0", "head 1"), ("head 2", "head 3")}
        assert "Exchange" in catalog.listing(*(store.table(n) for n in ("documents", "chapters", "tables")))._jdf.queryExecution().executedPlan().toString()
        publish(store, "published", str(tmp_path / "published"), 4)  # again
        assert made.table("chapters").count() == 5
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
    made.drop()
    assert not spark.catalog.tableExists("published_chapters")
