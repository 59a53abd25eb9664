"""Files as a data source: columns and filters that spare work, partitions, streams, and the sink."""

import os
import pickle
import time

import pytest
from docx_files import docx, paragraph
from pyspark.sql import functions as F

from quire.sources import docx_format


@pytest.fixture
def folder(spark, tmp_path):
    docx_format.register(spark)
    for k in range(7):
        place = tmp_path / "in" / f"part-{k % 2}"
        place.mkdir(parents=True, exist_ok=True)
        (place / f"{k}.docx").write_bytes(docx(paragraph(f"text {k}")))
    (tmp_path / "in" / "broken.DOCX").write_bytes(b"no archive")
    (tmp_path / "in" / ".hidden.docx").write_bytes(b"")
    (tmp_path / "in" / "notes.txt").write_bytes(b"")
    return str(tmp_path / "in")


def test_rows_of_a_folder(spark, folder):
    rows = {r["doc_name"]: r for r in spark.read.format("docx").load(folder).collect()}
    assert sorted(rows) == [*(f"{k}.docx" for k in range(7)), "broken.DOCX"]
    assert all(rows[f"{k}.docx"]["items"][0]["text"] == f"text {k}" and rows[f"{k}.docx"]["error"] is None for k in range(7))
    assert rows["broken.DOCX"]["items"] == [] and rows["broken.DOCX"]["error"]
    binary = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{folder}/part-*").select(F.sha2("content", 256)).collect()
    assert sorted(r[0] for r in binary) == sorted(rows[f"{k}.docx"]["doc_hash"] for k in range(7))


def test_partitions_are_bounded(spark, folder):
    size = os.path.getsize(f"{folder}/part-0/0.docx")
    read = lambda **options: spark.read.format("docx").options(**options).schema("doc_name string").load(folder)
    assert read().rdd.getNumPartitions() == 1
    assert read(partitionFiles=3).rdd.getNumPartitions() == 3
    assert read(partitionBytes=size // 2).rdd.getNumPartitions() == 8  # a file over the bound is one
    assert read(partitionFiles=3).count() == 8


def test_names_alone_need_no_file(spark):
    kind = docx_format.StructType.fromDDL("path string, doc_name string")
    rows = [b.to_pylist() for b in docx_format.DocxReader({"path": "/none"}, kind).read(docx_format.Files(["/none/a.docx"]))]
    assert rows == [[{"path": "/none/a.docx", "doc_name": "a.docx"}]]


def test_names_and_filters(spark, folder):
    found = spark.read.format("docx").load(folder)
    assert [r["doc_name"] for r in found.where(F.col("doc_name").isin("1.docx", "2.docx") & F.col("path").contains("part-0")).collect()] == ["2.docx"]
    assert found.where("doc_name = 'none'").count() == 0
    assert found.where("doc_name = '1.docx' or error is not null").count() == 2  # of the same DataFrame
    assert [r["doc_name"] for r in spark.read.format("docx").option("pathGlobFilter", "B*.docx").schema("doc_name string").load(folder).collect()] == ["broken.DOCX"]


def test_unknown_columns_and_folders(spark, folder, tmp_path):
    with pytest.raises(Exception, match="no such column"):
        spark.read.format("docx").schema("doc_name string, content binary").load(folder).collect()
    with pytest.raises(Exception):
        spark.read.format("docx").load(str(tmp_path / "none")).collect()
    (tmp_path / "empty").mkdir()
    assert spark.read.format("docx").load(str(tmp_path / "empty")).count() == 0


def test_stream_takes_each_file_once(spark, folder, tmp_path):
    def run():
        rows = spark.readStream.format("docx").option("settleSeconds", 0).schema("doc_name string, items array<struct<text:string>>").load(folder)
        made = rows.selectExpr("doc_name", "get(items, 0).text as text").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "at")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        assert made.awaitTermination(120)
        return sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))

    first = [*((f"{k}.docx", f"text {k}") for k in range(7)), ("broken.DOCX", None)]
    assert run() == first
    assert run() == first
    with open(f"{folder}/8.docx", "wb") as out:
        out.write(docx(paragraph("later")))
    os.remove(f"{folder}/part-0/0.docx")
    assert run() == sorted([*first, ("8.docx", "later")])


def test_offsets(folder):
    reader = docx_format.DocxStreamReader({"path": folder, "settleSeconds": "60"}, docx_format.StructType.fromDDL("path string"))
    assert reader.latestOffset() == reader.initialOffset()  # nothing has settled
    os.utime(f"{folder}/part-0/4.docx", (time.time() - 100, time.time() - 100))
    end = reader.latestOffset()
    taken = lambda: [p for x in reader.partitions(reader.initialOffset(), end) for p in x.paths]
    assert [p.rsplit("/", 1)[-1] for p in taken()] == ["4.docx"] and taken() == taken()
    os.remove(f"{folder}/part-0/4.docx")
    assert reader.latestOffset() == end


def test_sink(spark, folder, tmp_path):
    content = bytearray(docx(paragraph("written")))
    rows = lambda *names: spark.createDataFrame([(n, content) for n in names], "doc_name string, content binary").repartition(2)
    place = tmp_path / "out"
    rows("a.docx", "b.docx").write.format("docx").mode("append").save(str(place))
    assert sorted(os.listdir(place)) == ["a.docx", "b.docx"]
    with pytest.raises(Exception, match="taken"):
        rows("b.docx", "c.docx").write.format("docx").mode("append").save(str(place))
    assert sorted(os.listdir(place)) == ["a.docx", "b.docx"]
    with pytest.raises(Exception, match="without folders"):
        rows("c.docx", "../d.docx").write.format("docx").mode("append").save(str(place))
    assert sorted(os.listdir(place)) == ["a.docx", "b.docx"]
    rows("b.docx", "c.docx").write.format("docx").mode("overwrite").save(str(place))
    assert sorted(os.listdir(place)) == ["a.docx", "b.docx", "c.docx"]
    assert {r["items"][0]["text"] for r in spark.read.format("docx").load(str(place)).collect()} == {"written"}


def test_sink_of_folders(spark, tmp_path):
    docx_format.register(spark)
    content = bytearray(docx(paragraph("written")))
    rows = lambda *names: spark.createDataFrame([(n, content) for n in names], "doc_name string, content binary").repartition(2)
    place = tmp_path / "out"
    write = lambda df, mode="append": df.write.format("docx").option("taskFolders", "true").mode(mode).save(str(place))
    write(rows(*(f"{k}.docx" for k in range(20))))
    assert len(os.listdir(place)) == 2 and all(n.startswith("part-") for n in os.listdir(place))
    assert sorted(r["doc_name"] for r in spark.read.format("docx").load(str(place)).collect()) == sorted(f"{k}.docx" for k in range(20))
    with pytest.raises(Exception, match="twice"):
        write(rows("x.docx", "x.docx").coalesce(1))
    with pytest.raises(Exception, match="overwrites nothing"):
        write(rows("x.docx"), "overwrite")
    write(rows())
    assert len(os.listdir(place)) == 2


def test_the_driver_holds_no_list_of_all_files(spark, tmp_path, monkeypatch):
    """What tasks tell the commit doesn't grow with their files, and planned paths are packed."""
    monkeypatch.setattr(docx_format, "FOLDER_FILES", 100)
    listed, listing = [], docx_format.DocxWriter._names
    monkeypatch.setattr(docx_format.DocxWriter, "_names", staticmethod(lambda files, folder: listed.append(listing(files, folder)) or listed[-1]))
    for whole in ("false", "true"):
        place = tmp_path / whole
        place.mkdir()
        writer = docx_format.DocxWriter({"path": str(place), "taskFolders": whole}, False)
        made = docx_format.pa.table({"doc_name": [f"{k}.docx" for k in range(1000)], "content": [b"x"] * 1000}).to_batches()
        message = writer.write(iter(made))
        assert len(pickle.dumps(message)) < 300
        writer.commit([message, None])
        assert max(map(len, listed), default=0) == (0 if whole == "true" else 100)
        listed.clear()
        reader = docx_format.DocxReader({"path": str(place)}, docx_format.StructType.fromDDL("path string"))
        parts = reader.partitions()
        paths = [p for x in parts for p in x.paths]
        assert paths == sorted(str(p) for p in place.rglob("*.docx")) and len(paths) == 1000
        assert sum(len(pickle.dumps(x)) for x in parts) < sum(map(len, paths)) / 4


def test_names_that_two_tasks_write(spark, tmp_path, monkeypatch):
    batch = lambda *names: iter(docx_format.pa.table({"doc_name": names, "content": [b"x"] * len(names)}).to_batches())
    for clash in (False, True):
        monkeypatch.setattr(docx_format, "_hashed", (lambda n: 7) if clash else docx_format._hashed)
        for overwrite in (False, True):
            place = tmp_path / f"{clash}-{overwrite}"
            writer = docx_format.DocxWriter({"path": str(place)}, overwrite)
            with pytest.raises(FileExistsError, match="b.docx"):
                writer.commit([writer.write(batch("a.docx", "b.docx")), writer.write(batch("c.docx", "b.docx"))])
            assert os.listdir(place) == []
            writer.commit([writer.write(batch("a.docx", "b.docx")), writer.write(batch("c.docx"))])
            assert sorted(os.listdir(place)) == ["a.docx", "b.docx", "c.docx"]


def test_files_come_in_the_order_of_paths(spark, tmp_path):
    for name in ("a/b.docx", "a-b.docx", "a.docx", "a/c/d.docx", "_no/x.docx", "b/.no/y.docx", "a0.docx"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"")
    reader = docx_format.DocxReader({"path": str(tmp_path)}, docx_format.StructType.fromDDL("path string"))
    found = [f.path[len(str(tmp_path)) + 1 :] for f in reader.listed()]
    assert found == sorted(found) and set(found) == {"a/b.docx", "a-b.docx", "a.docx", "a/c/d.docx", "a0.docx"}
