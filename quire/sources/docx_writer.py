"""Rows as word-processor files: one for each document, with formatting, lists and tables."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree
from xml.etree.ElementTree import Element

import pyarrow as pa
from pyspark.sql import DataFrame

from quire.sources.docx import W

ElementTree.register_namespace("w", W[1:-1])


def element(name: str, *children: Element | None, text: str | None = None, **attributes: object) -> Element:
    """A WordprocessingML element; attributes and children that are None are left out."""
    out = Element(W + name, {W + k: str(v) for k, v in attributes.items() if v is not None})
    out.extend([c for c in children if c is not None])
    out.text = text
    return out


def valued(name: str, value: object) -> Element | None:
    return None if value is None else element(name, val=value)


def switch(name: str, on: bool | None) -> Element | None:
    return None if on is None else element(name, val=None if on else "off")


def run(text: str, size: int | None = None, bold: bool | None = None) -> Element:
    return element("r", element("rPr", switch("b", bold), valued("sz", size)), element("t", text=text))


def field(event: str) -> Element:
    """A mark where a field begins or ends."""
    return element("r", element("fldChar", fldCharType=event))


def instruction(text: str) -> Element:
    return element("r", element("instrText", text=text))


def paragraph(*runs: Element | str, style: str | None = None, outline: int | None = None, list_id: int | None = None, level: int | None = None, first_line: str | None = None, first_chars: str | None = None) -> Element:
    indent = element("ind", firstLine=first_line, firstLineChars=first_chars) if first_line or first_chars else None
    numbered = element("numPr", valued("ilvl", level), valued("numId", list_id)) if list_id is not None else None
    return element("p", element("pPr", valued("pStyle", style), numbered, indent, valued("outlineLvl", outline)), *(run(r) if isinstance(r, str) else r for r in runs))


def cell(text: str, span: int | None = None, merge: str | None = None, bold: bool | None = None) -> Element:
    """merge: 'restart' or 'continue'."""
    vertical = None if merge is None else element("vMerge", val="restart" if merge == "restart" else None)
    return element("tc", element("tcPr", valued("gridSpan", span), vertical), element("p", run(text, bold=bold)))


def table(columns: int, *rows: Iterable[Element]) -> Element:
    return element("tbl", element("tblGrid", *(element("gridCol") for _ in range(columns))), *(element("tr", *cells) for cells in rows))


def style(style_id: str, name: str, base: str | None = None, size: int | None = None, bold: bool | None = None, outline: int | None = None, first_line: int | None = None, first_chars: int | None = None) -> Element:
    indent = element("ind", firstLine=first_line, firstLineChars=first_chars)
    return element("style", valued("name", name), valued("basedOn", base), element("pPr", indent, valued("outlineLvl", outline)), element("rPr", switch("b", bold), valued("sz", size)), styleId=style_id)


def list_kind(kind: int, *levels: tuple[str, str], styles: dict[int, str] | None = None, restarts: dict[int, int] | None = None) -> Element:
    """levels: (format, template) from level 0 on; styles: paragraph styles that number by themselves."""
    made = [element("lvl", valued("start", 1), valued("numFmt", f), valued("pStyle", (styles or {}).get(k)), valued("lvlRestart", (restarts or {}).get(k)), valued("lvlText", t), ilvl=k) for k, (f, t) in enumerate(levels)]
    return element("abstractNum", *made, abstractNumId=kind)


def list_of(list_id: int, kind: int, starts: dict[int, int] | None = None) -> Element:
    return element("num", valued("abstractNumId", kind), *(element("lvlOverride", valued("startOverride", v), ilvl=k) for k, v in (starts or {}).items()), numId=list_id)


def _packed(parts: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, xml in parts.items():  # what has its own ZipInfo doesn't take the archive's level
            archive.writestr(zipfile.ZipInfo(f"word/{name}.xml"), xml, zipfile.ZIP_DEFLATED, compresslevel=1)
    return out.getvalue()


def document(body: Iterable[Element], styles: Iterable[Element] = (), numbering: Iterable[Element] = ()) -> bytes:
    parts = {"document": element("document", element("body", *body)), "styles": element("styles", *styles), "numbering": element("numbering", *numbering)}
    return _packed({name: ElementTree.tostring(root, "utf-8") for name, root in parts.items()})


#: The characters that XML can't hold.
_UNPRINTABLE = re.compile("[^\t\n\r -\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")


def _written(text: str | None) -> str:
    """Text of an element or attribute as markup, without the characters that XML can't hold; line ends stay what they are."""
    return _UNPRINTABLE.sub("", text or "").replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("\r", "&#13;")


# the same as `run`, `cell`, `paragraph` and `table` as markup, without a tree for each of very many rows
def _run_markup(text: str | None, size: int | None = None, bold: bool | None = None) -> str:
    b = "" if bold is None else "<w:b/>" if bold else '<w:b w:val="off"/>'
    sz = "" if size is None else f'<w:sz w:val="{size}"/>'
    return f"<w:r><w:rPr>{b}{sz}</w:rPr><w:t>{_written(text)}</w:t></w:r>"


def _cell_markup(text: str | None, span: int | None = None, merge: str | None = None, bold: bool | None = None) -> str:
    width = "" if span is None else f'<w:gridSpan w:val="{span}"/>'
    vertical = "" if merge is None else '<w:vMerge w:val="restart"/>' if merge == "restart" else "<w:vMerge/>"
    return f"<w:tc><w:tcPr>{width}{vertical}</w:tcPr><w:p><w:pPr/>{_run_markup(text, bold=bold)}</w:p></w:tc>"


def _table_markup(columns: int, rows: Iterable[Iterable[str]]) -> str:
    return f"<w:tbl><w:tblGrid>{'<w:gridCol/>' * columns}</w:tblGrid>{''.join(f'<w:tr>{"".join(cells)}</w:tr>' for cells in rows)}</w:tbl>"


def _paragraph_markup(runs: str, style: str | None, outline: int | None, list_id: int | None, level: int | None, first_chars: int | None) -> str:
    named = "" if style is None else f'<w:pStyle w:val="{_written(style)}"/>'
    at = "" if level is None else f'<w:ilvl w:val="{level}"/>'
    numbered = "" if list_id is None else f'<w:numPr>{at}<w:numId w:val="{list_id}"/></w:numPr>'
    indent = "" if first_chars is None else f'<w:ind w:firstLineChars="{first_chars}"/>'
    stated = "" if outline is None else f'<w:outlineLvl w:val="{outline}"/>'
    return f"<w:p><w:pPr>{named}{numbered}{indent}{stated}</w:pPr>{runs}</w:p>"


def _body(batch: pa.RecordBatch) -> Iterator[str]:
    """The markup of each row; that of a row without a place in its document is empty."""
    names = ("seq", "text", "style_id", "size", "bold", "outline", "list_id", "level", "first_chars", "cells", "grid", "grid_cols", "tail", "tail_size")
    columns = [batch[n].to_pylist() if n in batch.schema.names else [None] * batch.num_rows for n in names]
    for seq, text, style_id, size, bold, outline, list_id, level, first_chars, cells, grid, grid_cols, tail, tail_size in zip(*columns, strict=True):
        if seq is None:
            yield ""
        elif cells is not None:
            yield _table_markup(len(cells), [map(_cell_markup, cells)])
        elif grid is not None:
            yield _table_markup(grid_cols, ([_cell_markup(c["text"], c["span"], c["merge"], c["bold"]) for c in row] for row in grid))
        else:
            runs = _run_markup(text, size, bold) + (_run_markup(tail, tail_size) if tail else "")
            yield _paragraph_markup(runs, style_id, outline, list_id, level, first_chars)


#: Files of so many bytes, or so many files, go on together.
BATCH_BYTES, BATCH_FILES = 4 << 20, 256


def write_files(paragraphs: DataFrame, styles: Iterable[Element] = (), numbering: Iterable[Element] = ()) -> DataFrame:
    """doc_id, content: a file for each document.

    paragraphs: doc_id, seq, text, style_id, size, bold (of the run), outline, list_id, level, first_chars, cells (array of
    texts; a one-row table in the place of a paragraph). May also have grid (array of rows of text, span, merge, bold: a table of
    `grid_cols` columns in the place of a paragraph) and tail, tail_size (a second run). A row without seq makes no paragraph, so
    a document that has no other is an empty file. A document is one file, so it is one task's work: rows are dealt and sorted
    by document, and a task goes through them once.
    """
    fixed = {"styles": ElementTree.tostring(element("styles", *styles), "utf-8"), "numbering": ElementTree.tostring(element("numbering", *numbering), "utf-8")}
    head, tail = f'<w:document xmlns:w="{W[1:-1]}"><w:body>', "</w:body></w:document>"

    def packed(body: list[str]) -> bytes:
        return _packed({"document": "".join([head, *body, tail]).encode()} | fixed)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        document, body, ids, made, size = None, None, [], [], 0

        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(made, pa.binary())], ["doc_id", "content"])

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for own, markup in zip(batch["doc_id"].to_pylist(), _body(batch), strict=True):
                if body is not None and own != document:
                    ids.append(document)
                    made.append(packed(body))
                    size, body = size + len(made[-1]), None
                    if size >= BATCH_BYTES or len(made) >= BATCH_FILES:
                        yield flushed()
                        ids, made, size = [], [], 0
                if body is None:
                    document, body = own, []
                body.append(markup)
        if body is not None:
            ids.append(document)
            made.append(packed(body))
            yield flushed()

    return paragraphs.repartition("doc_id").sortWithinPartitions("doc_id", "seq").mapInArrow(work, f"doc_id {paragraphs.schema['doc_id'].dataType.simpleString()}, content binary")
