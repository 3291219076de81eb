"""HTML pages as Markdown text, with expanded tables."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SKIPPED = {"script", "style", "nav", "noscript", "template", "head"}
#: Extension to document type.
TYPES = {"md": "markdown", "txt": "text", "html": "html", "htm": "html", "pdf": "pdf", "docx": "docx", "json": "json", "jsonl": "jsonl"}


class Markdown(HTMLParser):
    """Headings, paragraphs, lists, code and tables; links are their text, images their description."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0
        self.lists: list[list] = []
        self.code = False
        self.tables: list[dict] = []

    def _add(self, text: str) -> None:
        if self.tables and self.tables[-1]["named"]:
            self.tables[-1]["caption"] += text
        elif self.tables and self.tables[-1]["cell"] is not None:
            self.tables[-1]["cell"]["text"] += text
        else:
            self.out.append(text)

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in SKIPPED:
            self.skip += 1
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self._add(f"\n\n{'#' * int(tag[1])} ")
        elif tag in ("p", "div", "article", "section", "blockquote"):
            self._add("\n\n" + ("> " if tag == "blockquote" else ""))
        elif tag == "br":
            self._add("\n")
        elif tag == "hr":
            self._add("\n\n---\n\n")
        elif tag in ("b", "strong"):
            self._add("**")
        elif tag in ("i", "em"):
            self._add("*")
        elif tag == "pre":
            self.code = True
            self._add("\n\n```\n")
        elif tag == "code" and not self.code:
            self._add("`")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self._add("\n")
        elif tag == "li" and self.lists:
            self.lists[-1][1] += 1
            mark = "-" if self.lists[-1][0] == "ul" else f"{self.lists[-1][1]}."
            self._add(f"\n{'  ' * (len(self.lists) - 1)}{mark} ")
        elif tag == "img" and a.get("alt"):
            self._add(f"![{a['alt']}]")
        elif tag == "table":
            self.tables.append({"rows": [], "cell": None, "caption": "", "head": False, "named": False, "first": None})
        elif tag == "caption" and self.tables:
            self.tables[-1]["named"] = True
        elif tag in ("thead", "tbody", "tfoot") and self.tables:
            self.tables[-1]["head"] = tag == "thead"
        elif tag == "tr" and self.tables:
            self.tables[-1]["rows"].append([])
        elif tag in ("td", "th") and self.tables:
            t = self.tables[-1]
            if not t["rows"]:
                t["rows"].append([])
            t["cell"] = {"text": "", "across": span(a.get("colspan"), 1_000), "down": span(a.get("rowspan"), 65_534), "head": tag == "th"}
            t["rows"][-1].append(t["cell"])
            if len([r for r in t["rows"] if r]) == 1:  # is the first row a header?
                t["first"] = bool(t["first"] or t["head"] or tag == "th")

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag in ("b", "strong"):
            self._add("**")
        elif tag in ("i", "em"):
            self._add("*")
        elif tag == "pre":
            self.code = False
            self._add("\n```\n")
        elif tag == "code" and not self.code:
            self._add("`")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self._add("\n")
        elif tag == "caption" and self.tables:
            self.tables[-1]["named"] = False
        elif tag == "thead" and self.tables:
            self.tables[-1]["head"] = False
        elif tag in ("td", "th") and self.tables:
            self.tables[-1]["cell"] = None
        elif tag == "table" and self.tables:
            t = self.tables.pop()
            caption = " ".join(t["caption"].split())
            self._add("\n\n" + (f"{caption}\n\n" if caption and any(t["rows"]) else "") + pipe_table([r for r in t["rows"] if r], bool(t["first"])) + "\n\n")

    def handle_data(self, data):
        if not self.skip:
            self._add(data if self.code else re.sub(r"\s+", " ", data))


def span(value: str | None, most: int) -> int:
    """A cell's span, one where it isn't a number; most is what the HTML standard allows."""
    value = (value or "").strip()
    return max(1, min(most, int(value))) if value.isascii() and value.isdecimal() else 1


def pipe_table(rows: list[list[dict]], headed: bool = True) -> str:
    """Spans are filled with the cell they cover, below the last row too; the first row is the header, or a blank one goes
    before it."""
    grid: list[list[str]] = []
    down: dict[int, tuple[str, int]] = {}
    for row in rows:
        line: list[str] = []
        cells = iter(row)
        cell = next(cells, None)
        while cell is not None or len(line) in down:
            k = len(line)
            if k in down:
                text, left = down.pop(k)
                if left > 1:
                    down[k] = (text, left - 1)
                line.append(text)
                continue
            text = " ".join(cell["text"].split()).replace("|", "\\|")
            for _ in range(cell["across"]):
                if cell["down"] > 1:
                    down[len(line)] = (text, cell["down"] - 1)
                line.append(text)
            cell = next(cells, None)
        grid.append(line)
    while down:  # cells that reach below the last row, from the left as far as they stand side by side
        line = []
        while len(line) in down:
            text, left = down.pop(len(line))
            if left > 1:
                down[len(line)] = (text, left - 1)
            line.append(text)
        if not line:
            break
        grid.append(line)
    width = max(map(len, grid), default=0)
    if not width:
        return ""
    grid = grid if headed else [[], *grid]
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in grid]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


def to_markdown(html: str) -> str:
    parser = Markdown()
    parser.feed(html or "")
    parser.close()
    lines = [x.strip() if not x.startswith("  ") else x.rstrip() for x in "".join(parser.out).split("\n")]
    out: list[str] = []
    for x in lines:
        if x.strip() or (out and out[-1]):
            out.append(x if x.strip() else "")
    return "\n".join(out).strip()


@F.pandas_udf(StringType())
def markdown(html: pd.Series) -> pd.Series:
    return html.map(to_markdown)


def document_type(path):
    """The type by extension, null for files that are skipped."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)(?:[?#].*)?$", 1))
    return F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])[ext]


def scan_files(spark, folder: str):
    """path, type, content (bytes), size of every file below the folder; unknown types have a null type."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return d.select("path", document_type(F.col("path")).alias("type"), "content", F.col("length").alias("size"))


#: Types of the files that an ingestion takes, and names that it passes over.
INGESTED = {"md": "markdown", "markdown": "markdown", "txt": "txt", "html": "html", "htm": "html", "pdf": "pdf", "doc": "doc", "docx": "docx", "chm": "markdown", "hdx": "markdown"}
PASSED_OVER = ("manifest.jsonl", "manifest.json", "html_to_md_mapping.json", "html_to_md_mapping.csv", ".ds_store", "thumbs.db", ".gitkeep")


def ingested_type(path):
    """The type of a file that is ingested, null for one that is skipped."""
    name = F.lower(F.regexp_extract(path, r"([^/]*)$", 1))
    ext = F.regexp_extract(name, r"\.([^.]+)$", 1)
    return F.when(~name.isin(*PASSED_OVER), F.create_map(*[F.lit(x) for kv in INGESTED.items() for x in kv])[ext])


def ingest_summary(files):
    """discovered, parsed, unparsed, archives, pdfs, skipped, failed: one row about files (path, error: null unless reading or
    converting failed). Text formats and what becomes text are parsed."""
    kind, ext = ingested_type(F.col("path")), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    d = files.select(kind.alias("kind"), ext.alias("ext"), F.col("error").isNull().alias("fine"))
    known, fine = F.col("kind").isNotNull(), F.col("fine")
    parsed = F.col("kind").isin("markdown", "txt", "html", "pdf", "docx", "doc")
    return d.agg(
        F.count_if(known).alias("discovered"), F.count_if(known & fine & parsed).alias("parsed"), F.count_if(known & fine & ~parsed).alias("unparsed"),
        F.count_if(known & fine & F.col("ext").isin("chm", "hdx")).alias("archives"), F.count_if(known & fine & (F.col("kind") == "pdf")).alias("pdfs"),
        F.count_if(~known).alias("skipped"), F.count_if(known & ~fine).alias("failed"),
    )
