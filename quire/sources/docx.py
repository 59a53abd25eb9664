"""Word-processor files (zipped WordprocessingML) as rows: paragraphs, tables, styles, numbering.

Files are read by Spark as binary rows and parsed on the executors. A file is
one row, so it is one task's work. Input is untrusted: nothing is unpacked to
disk, markup with entity declarations is refused, and sizes are bounded. A file
that can't be read gives a row with `error` and no content.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from typing import Any
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
MOST_BYTES = 512 << 20
RUN = "struct<text:string,sz:int,b:boolean>"
#: The same with a mark in the place of the text, which the paragraph has too.
BARE_RUN = "struct<written:boolean,sz:int,b:boolean>"
CELL = "struct<row_idx:int,col_idx:int,row_span:int,col_span:int,content:string,is_header:boolean>"
PROPERTIES = "struct<sz:int,b:boolean,first_line_chars:string,first_line:string,outline_lvl:int,num_id:int,ilvl:int>"
ITEM = f"struct<seq:int,kind:string,text:string,is_toc:boolean,fld_events:array<int>,style_id:string,ppr:{PROPERTIES},runs:array<{RUN}>,total_rows:int,total_cols:int,cells:array<{CELL}>>"
STYLE = "struct<style_id:string,name:string,based_on:string,sz:int,bold:boolean,first_line_chars:double,first_line_twips:int,outline_lvl:int>"
LEVEL = "struct<num_id:int,abstract_id:int,ilvl:int,num_fmt:string,lvl_text:string,start:int,start_override:int,lvl_restart:int>"
PSTYLE = "struct<style_id:string,num_id:int,ilvl:int>"
PARSED = f"items array<{ITEM}>, styles array<{STYLE}>, levels array<{LEVEL}>, pstyles array<{PSTYLE}>, error string"

_T, _R, _RPR, _CHAR, _INSTRUCTION, _SIMPLE = (W + n for n in ("t", "r", "rPr", "fldChar", "instrText", "fldSimple"))
_STEP = {"begin": 1, "end": -1}
#: Parsed files go on together, so many body items or bytes of content at a time.
BATCH_ITEMS, BATCH_BYTES = 4096, 2 << 20
#: Styles and lists of so many bytes are kept for the next files, which often have the same.
SHARED_BYTES, SHARED_PARTS = 64 << 10, 32


def _int(text: str | None) -> int | None:
    try:
        return int(text) if text is not None else None
    except ValueError:
        return None


def _val(parent: ElementTree.Element | None, name: str) -> str | None:
    found = parent.find(W + name) if parent is not None else None
    return found.get(W + "val") if found is not None else None


def _switch(parent: ElementTree.Element | None, name: str) -> bool | None:
    """An on-off property; null if it isn't there."""
    found = parent.find(W + name) if parent is not None else None
    if found is None:
        return None
    return (found.get(W + "val") or "true").strip().lower() not in ("0", "false", "off")


def _text(of: Iterable[ElementTree.Element]) -> str:
    return "".join(t.text or "" for t in of)


def _properties(p: ElementTree.Element) -> dict:
    ppr = p.find(W + "pPr")
    rpr = ppr.find(W + "rPr") if ppr is not None else None
    ind = ppr.find(W + "ind") if ppr is not None else None
    num = ppr.find(W + "numPr") if ppr is not None else None
    get = ind.get if ind is not None else lambda _: None
    return {"sz": _int(_val(rpr, "sz")), "b": _switch(rpr, "b"), "first_line_chars": get(W + "firstLineChars"), "first_line": get(W + "firstLine"),
            "outline_lvl": _int(_val(ppr, "outlineLvl")), "num_id": _int(_val(num, "numId")), "ilvl": _int(_val(num, "ilvl"))}


def _runs(of: ElementTree.Element) -> list[dict]:
    out = []
    for r in of.iter(_R):
        text, rpr = "", None
        for x in r:
            if x.tag == _T:
                text += x.text or ""
            elif x.tag == _RPR and rpr is None:
                rpr = x
        out.append({"text": text, "written": bool(text) and not text.isspace(), "sz": _int(_val(rpr, "sz")), "b": _switch(rpr, "b")})
    return out


def _paragraph(seq: int, p: ElementTree.Element) -> dict:
    text, toc, events = [], False, []
    for x in p.iter():
        if x.tag == _T:
            text.append(x.text or "")
        elif x.tag == _CHAR:
            if (k := x.get(W + "fldCharType")) in _STEP:
                events.append(_STEP[k])
        elif x.tag == _INSTRUCTION:
            toc = toc or "TOC" in (x.text or "")
        elif x.tag == _SIMPLE:
            toc = toc or "TOC" in (x.get(W + "instr") or "")
    return {"seq": seq, "kind": "p", "text": "".join(text), "is_toc": toc, "fld_events": events, "style_id": _val(p.find(W + "pPr"), "pStyle"), "ppr": _properties(p), "runs": _runs(p)}


def grid(tbl: ElementTree.Element) -> dict:
    """Size and cells of a table. A cell that continues one above, over gaps too, lengthens it."""
    columns = tbl.find(W + "tblGrid")
    rows, cells, open_above = tbl.findall(W + "tr"), [], {}
    for r, row in enumerate(rows):
        bold = [x["b"] or False for x in _runs(row)]
        head = r == 0 and (row.find(f"{W}trPr/{W}tblHeader") is not None or (bool(bold) and all(bold)))
        at, opened = 0, {}
        for cell in row.findall(W + "tc"):
            props = cell.find(W + "tcPr")
            width = max(1, _int(_val(props, "gridSpan")) or 1)
            merge = props.find(W + "vMerge") if props is not None else None
            kind = (merge.get(W + "val") or "continue") if merge is not None else None
            source = open_above.get(at) if kind == "continue" else None
            if source:
                source["row_span"] += 1
            else:
                own = {"row_idx": r, "col_idx": at, "row_span": 1, "col_span": width, "content": _text(cell.iter(W + "t")).strip(), "is_header": head}
                cells.append(own)
                source = own if kind == "restart" else None
            if source:
                opened |= dict.fromkeys(range(at, at + width), source)
            at += width
        open_above |= opened
    return {"total_rows": len(rows), "total_cols": len(columns.findall(W + "gridCol")) if columns is not None else 0, "cells": cells}


def _styles(root: ElementTree.Element | None) -> list[dict]:
    out = []
    for s in root.findall(W + "style") if root is not None else ():
        ppr, rpr = s.find(W + "pPr"), s.find(W + "rPr")
        ind = ppr.find(W + "ind") if ppr is not None else None
        get = ind.get if ind is not None else lambda _: None
        chars = _int(get(W + "firstLineChars"))
        if style_id := s.get(W + "styleId"):
            out.append({"style_id": style_id, "name": _val(s, "name"), "based_on": _val(s, "basedOn"), "sz": _int(_val(rpr, "sz")), "bold": _switch(rpr, "b"),
                        "first_line_chars": None if chars is None else chars / 100, "first_line_twips": _int(get(W + "firstLine")), "outline_lvl": _int(_val(ppr, "outlineLvl"))})
    return list({s["style_id"]: s for s in out}.values())


def _numbering(root: ElementTree.Element | None) -> tuple[list[dict], list[dict]]:
    """Levels of each list, and the paragraph styles that number by themselves."""
    if root is None:
        return [], []
    kinds = {_int(a.get(W + "abstractNumId")): [(i, x) for x in a.findall(W + "lvl") if (i := _int(x.get(W + "ilvl"))) is not None] for a in root.findall(W + "abstractNum")}
    by_list, first_list = {}, {}  # of repeated lists and levels the last holds
    for num in root.findall(W + "num"):
        num_id, kind = _int(num.get(W + "numId")), _int(_val(num, "abstractNumId"))
        if num_id is None or kind is None:
            continue
        first_list.setdefault(kind, num_id)
        by_list[num_id] = own = {}
        starts = {_int(o.get(W + "ilvl")): _int(_val(o, "startOverride")) for o in num.findall(W + "lvlOverride")}
        for ilvl, x in kinds.get(kind, ()):
            start = _int(_val(x, "start"))
            own[ilvl] = {"num_id": num_id, "abstract_id": kind, "ilvl": ilvl, "num_fmt": _val(x, "numFmt") or "decimal", "lvl_text": _val(x, "lvlText") or "", "start": 1 if start is None else start, "start_override": starts.get(ilvl), "lvl_restart": _int(_val(x, "lvlRestart"))}
    levels = [x for own in by_list.values() for x in own.values()]
    pstyles = {style: {"style_id": style, "num_id": first_list[kind], "ilvl": ilvl} for kind, own in kinds.items() if kind in first_list for ilvl, x in own if (style := _val(x, "pStyle"))}
    return levels, list(pstyles.values())


def _root(data: bytes) -> ElementTree.Element:
    if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
        raise ValueError("entity declarations are refused")
    return ElementTree.fromstring(data)


def _part(archive: zipfile.ZipFile, name: str) -> bytes | None:
    return archive.read(name) if name in archive.NameToInfo else None


def _read_part(of: Callable[[ElementTree.Element | None], Any], data: bytes | None) -> Any:
    return of(None if data is None else _root(data))


_shared_part = lru_cache(SHARED_PARTS)(_read_part)


def _found(of: Callable[[ElementTree.Element | None], Any], data: bytes | None) -> Any:
    """What `of` finds in a part; it must not be changed, since the next file with the same part gets it too."""
    return (_shared_part if data is None or len(data) <= SHARED_BYTES else _read_part)(of, data)


def parse(content: bytes) -> dict:
    """One file as the columns of PARSED."""
    empty = {"items": [], "styles": [], "levels": [], "pstyles": []}
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            if sum(i.file_size for i in archive.infolist()) > MOST_BYTES:
                raise ValueError("too large when unpacked")
            data = _part(archive, "word/document.xml")
            body = _root(data).find(W + "body") if data is not None else None
            if body is None:
                raise ValueError("no document body")
            items = []
            for x in body:
                if x.tag == W + "p":
                    items.append(_paragraph(len(items), x))
                elif x.tag == W + "tbl":
                    items.append({"seq": len(items), "kind": "tbl"} | grid(x))
            levels, pstyles = _found(_numbering, _part(archive, "word/numbering.xml"))
            return {"items": items, "styles": _found(_styles, _part(archive, "word/styles.xml")), "levels": levels, "pstyles": pstyles, "error": None}
    except Exception as e:  # whatever is wrong with one file stays with it
        return empty | {"error": f"{type(e).__name__}: {e}"[:500]}


def read_files(spark: SparkSession, path: str, glob: str = "*.[dD][oO][cC][xX]") -> DataFrame:
    """path, content, doc_name, doc_hash of the files below a folder."""
    return with_hash(spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path))


def with_hash(files: DataFrame) -> DataFrame:
    return files.select("path", "content", F.element_at(F.split("path", "/"), -1).alias("doc_name"), F.sha2("content", 256).alias("doc_hash"))


def parse_files(files: DataFrame, key: str = "doc_id", columns: str = PARSED) -> DataFrame:
    """key and PARSED of each row with `content`, or only those columns, and fields of items, that `columns` names (BARE_RUN for RUN, too)."""
    arrow = [pa.field(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(columns)]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents, start, found, items, size = batch["content"], 0, [], 0, 0
            for k in range(batch.num_rows):
                content = contents[k].as_py() or b""
                found.append(parse(content))
                items, size = items + len(found[-1]["items"]), size + len(content)
                if items >= BATCH_ITEMS or size >= BATCH_BYTES or k == batch.num_rows - 1:
                    made = [pa.array([x[f.name] for x in found], f.type) for f in arrow]
                    yield pa.RecordBatch.from_arrays([batch[key].slice(start, k + 1 - start), *made], [key, *(f.name for f in arrow)])
                    start, found, items, size = k + 1, [], 0, 0

    return files.select(key, "content").mapInArrow(work, f"{key} {files.schema[key].dataType.simpleString()}, {columns}")


class DocxItems:
    """Table function: the body items of one file, a row each; none for a file that can't be read."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        for x in parse(content or b"")["items"]:
            yield tuple(x.get(c) for c in ("seq", "kind", "text", "is_toc", "style_id", "total_rows", "total_cols"))


def register(spark: SparkSession) -> None:
    """Make `docx_items(content)` a function of SQL, to be used with LATERAL over a table of files."""
    made = F.udtf(DocxItems, returnType="seq int, kind string, text string, is_toc boolean, style_id string, total_rows int, total_cols int", useArrow=True)
    spark.udtf.register("docx_items", made)
