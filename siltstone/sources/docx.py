"""Word documents as content blocks: a pull parser over the archive's parts, standard library only."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK = "document string, place int, block_type string, level int, text string, row_count int, col_count int"
#: Blocks of files that leave a task together.
BLOCKS = 2_000
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Names of styles that make headings and lists, and signs that begin an item.
_HEADING, _LIST, _BULLET = re.compile(r"^Heading\s*(\d+)$", re.IGNORECASE), re.compile(r"^List", re.IGNORECASE), re.compile(r"^[•\-*●○]\s+")


def style_names(archive: zipfile.ZipFile) -> dict[str | None, str]:
    """Names of paragraph styles by id; None is the default style."""
    names: dict[str | None, str] = {}
    if "word/styles.xml" in archive.namelist():
        with archive.open("word/styles.xml") as f:
            for _, e in ElementTree.iterparse(f):
                if e.tag == _W + "style":
                    name = e.find(_W + "name")
                    if name is not None and e.get(_W + "type", "paragraph") == "paragraph":
                        names[e.get(_W + "styleId")] = name.get(_W + "val", "")
                        if e.get(_W + "default") in ("1", "true"):
                            names[None] = names[e.get(_W + "styleId")]
                    e.clear()
    return names


def paragraph_text(p: ElementTree.Element) -> str:
    """The text of a paragraph's runs, those of links among them; tabs and breaks as characters. Deleted text has other tags."""
    out = []
    for run in p:
        for r in [run] if run.tag == _W + "r" else run.findall(_W + "r") if run.tag in (_W + "hyperlink", _W + "ins", _W + "smartTag") else []:
            for e in r:
                out.append((e.text or "") if e.tag == _W + "t" else "\t" if e.tag == _W + "tab" else "\n" if e.tag in (_W + "br", _W + "cr") else "-" if e.tag == _W + "noBreakHyphen" else "")
    return "".join(out)


def table_rows(table: ElementTree.Element) -> list[list[str]]:
    """Texts of cells, row by row; a cell that spans columns or rows stands in each place that it covers."""
    rows: list[list[str]] = []
    for row in table.findall(_W + "tr"):
        cells: list[str] = []
        for cell in row.findall(_W + "tc"):
            across, down = cell.find(f"{_W}tcPr/{_W}gridSpan"), cell.find(f"{_W}tcPr/{_W}vMerge")
            goes_on = down is not None and down.get(_W + "val", "continue") != "restart"
            text = "\n".join(paragraph_text(p) for p in cell.findall(_W + "p")).strip()
            for _ in range(int(across.get(_W + "val", "1")) if across is not None else 1):
                at = len(cells)
                cells.append(rows[-1][at] if goes_on and rows and at < len(rows[-1]) else text)
        rows.append(cells)
    return rows


def pipe_rows(rows: list[list[str]]) -> str:
    lines = ["| " + " | ".join(c.replace("|", "\\|") for c in row) + " |" for row in rows]
    if len(lines) > 1:
        lines.insert(1, "| " + " | ".join(["---"] * max(map(len, rows))) + " |")
    return "\n".join(lines)


def content_blocks(content: bytes) -> Iterator[tuple[str, int | None, str, int | None, int | None]]:
    """(block_type, level, text, rows, columns) in the order of the body. Each part of the body is dropped once it is read."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = style_names(archive)
        with archive.open("word/document.xml") as f:
            trail: list[ElementTree.Element] = []
            for event, e in ElementTree.iterparse(f, events=("start", "end")):
                if event == "start":
                    trail.append(e)
                    continue
                trail.pop()
                if len(trail) < 2 or trail[-1].tag != _W + "body":
                    continue
                if e.tag == _W + "p":
                    text = paragraph_text(e).strip()
                    style = e.find(f"{_W}pPr/{_W}pStyle")
                    name = names.get(style.get(_W + "val") if style is not None else None, "")
                    heading = _HEADING.match(name)
                    if text:
                        kind = "heading" if heading else "list" if _LIST.match(name) or _BULLET.match(text) else "paragraph"
                        yield kind, max(1, min(6, int(heading[1]))) if heading else None, text, None, None
                elif e.tag == _W + "tbl":
                    rows = table_rows(e)
                    yield "table", None, pipe_rows(rows), len(rows), max(map(len, rows), default=0)
                trail[-1].remove(e)


def docx_blocks(files: DataFrame) -> DataFrame:
    """Blocks of the files (document, content); a file that is no such archive has none. operators.layout.section_paths adds
    their sections."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, pa.string() if t == "string" else pa.int32()) for c, t in (x.split() for x in BLOCK.split(", "))])
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)
        for b in batches:
            out: list[tuple] = []
            for document, content in zip(b.column(0).to_pylist(), b.column(1)):
                own = []
                try:
                    own = [(document, k, *block) for k, block in enumerate(content_blocks(content.as_py() or b""))]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    pass
                out += own
                if len(out) >= BLOCKS:
                    yield batch(out)
                    out = []
            if out:
                yield batch(out)

    return files.selectExpr("cast(document as string) document", "content").mapInArrow(read, BLOCK)
