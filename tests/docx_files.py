"""Styles and lists that the tests of files share."""

from quire.sources.docx_writer import cell, document, field, instruction, list_kind, list_of, paragraph, run, style, table

STYLES = (
    style("Plain", "plain text", size=24),
    style("Top", "Heading 1", base="Plain", size=36, bold=True, outline=0, first_chars=50),
    style("TopKin", "like top", base="Top"),
)
LISTS = (list_kind(40, ("upperRoman", "%1)"), ("lowerLetter", "%1.%2")), list_of(11, 40), list_of(12, 40, {0: 5}))


def docx(*body, styles=STYLES, numbering=LISTS):
    return document(body, styles, numbering)


__all__ = ["cell", "docx", "field", "instruction", "list_kind", "list_of", "paragraph", "run", "style", "table"]
