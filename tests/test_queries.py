"""Every query with SQL gives the rows that DuckDB gives."""

import duckdb
import pytest

import __spark_entry__
from quire.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(found, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(repr(r[k]) for k in order) for r in found), sorted(names)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    got = rows([tuple(r) for r in df.collect()], df.columns)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    cursor = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert got == rows(cursor.fetchall(), names)
    assert got[0]


def test_markdown_shows_every_cell(spark):
    line = spark.read.parquet(f"{DATA}/documents.parquet").selectExpr("doc_id", "explode(split(text, '\\n')) as line").where("line like '%|%'")
    cells = line.selectExpr("doc_id", "explode(split(line, '[|]')) as cell").selectExpr("doc_id", "trim(cell) as cell").where("cell <> ''").distinct().collect()
    shown = {r["doc_id"]: r["markdown"] for r in QUERIES["grid_markdown"](spark, DATA).collect()}
    assert cells and all(r["cell"] in shown[r["doc_id"]] for r in cells)


def test_every_event_is_numbered(spark):
    events = {r["event_id"] for r in spark.read.parquet(f"{DATA}/events.parquet").collect()}
    assert {r["event_id"] for r in QUERIES["numbering_render"](spark, DATA).where("number_text is not null").collect()} == events


def test_every_line_is_split(spark):
    n = spark.read.parquet(f"{DATA}/documents.parquet").selectExpr("explode(split(text, '\\n'))").count()
    assert QUERIES["manual_prefix_split"](spark, DATA).count() == n


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLE_SQL) <= set(__spark_entry__.oracle_sql())
