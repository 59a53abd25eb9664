"""Registered queries over made tables: what the given small tables don't hold."""

import duckdb
import pytest
from test_queries import rows

from quire.queries import ORACLE_SQL, QUERIES
from quire.sources.docx import parse_files
from quire.sources.docx_writer import write_files


def against_sql(spark, folder, name, table):
    """Rows of the query, which must be those of its SQL."""
    df = QUERIES[name](spark, folder)
    got = rows([tuple(r) for r in df.collect()], df.columns)
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    cursor = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    wanted = cursor.fetchall()
    assert wanted and got == rows(wanted, names)
    return got[0]


def test_conversations_in_several_files(spark, tmp_path):
    sent = [(c, t, "user", f"{c} {t}") for c in range(9) for t in range(1 + c % 4)]
    spark.createDataFrame(sent, "conv_id long, turn int, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    assert len(against_sql(spark, str(tmp_path), "message_numbers", "conversations")) == len(sent)


@pytest.fixture(scope="module")
def numbered(spark, tmp_path_factory):
    """Documents with lines that begin with what looks like a heading's number."""
    folder = str(tmp_path_factory.mktemp("numbered"))
    texts = [
        "body text of a first line that goes on for a while\nbody text of a second line\n28.68.191.238 Den schüsch ögeösch erzu chüpfber.\nlast line of text",
        "a title\n1219538112535716 Éaielletre.\nsome text\n1.2 more\n3.4.5 and the nation with its own motion",
        "（三）other title\n2、next\nthe nation of a long line of text that is no heading, since it goes on\n第一章 last",
        "short\n\n12. the option\n13. the motion of it all\n9 x", None, "",
    ]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(2).write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.mark.parametrize("name", ["candidate_cascade", "ingest_chapters", "ingest_statistics", "store_ranked", "store_find"])
def test_lines_that_begin_with_numbers(spark, numbered, name):
    assert against_sql(spark, numbered, name, "documents")


def test_line_ends_and_documents_over_many_batches(spark):
    """Files written row by row: a document's rows may be many batches, or none."""
    kind = "doc_id long, seq int, text string, style_id string, size int, bold boolean, outline int, list_id int, level int, first_chars int, cells array<string>"
    plain = (None,) * 8
    made = [(1, k, f"line {k}\r\n<&>\u0001", *plain) for k in range(25_000)] + [(2, None, None, *plain), (3, 1, None, *plain[:-1], ["a|\r", None]), (3, 0, "x", *plain)]
    parsed = parse_files(write_files(spark.createDataFrame(made, kind)), columns="items array<struct<seq:int,kind:string,text:string,cells:array<struct<content:string>>>>, error string")
    got = {r["doc_id"]: [(i["text"], i["cells"] and [c["content"] for c in i["cells"]]) for i in r["items"]] for r in parsed.collect() if r["error"] is None}
    assert got == {1: [(f"line {k}\r\n<&>", None) for k in range(25_000)], 2: [], 3: [("x", None), (None, ["a|", ""])]}
