"""From documents to segments: Markdown blocks, sections, merging, absorbing, splitting, re-indexing.

A document's blocks depend on each other in order, so one document is one call of a small function; Spark deals the
documents. All later steps (breadcrumbs, windows, indices) are column expressions.
"""

from __future__ import annotations

import bisect
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: The rank of block types; a merged segment takes the higher one, the earlier of equals.
RANK = {"table": 4, "html_table": 4, "list": 3, "code": 2, "blockquote": 1, "paragraph": 1, "raw_html": 1, "unknown": 0}
#: Types that take in no neighbour.
CLOSED = ("table", "html_table", "code")
_WIDE = re.compile("[一-鿿]")
_WORD = re.compile("[一-鿿]|[0-9A-Za-zÀ-ÖØ-öø-ÿ]+")
_STOP = re.compile(r"(?<=[。！？\n])")


@dataclass
class Policy:
    """Sizes are token estimates: below merge_below a segment joins a neighbour of its section, below chunk_below one of
    another section."""

    merge_below: int = 100
    chunk_below: int = 128
    most: int = 512
    table_alone: int = 300
    absorb_orphans: bool = True
    lead_in: bool = True


@dataclass
class Block:
    """A heading (level 1 to 6), or content of another kind (level 0), on lines start to end (from 0, end exclusive)."""

    kind: str
    level: int
    text: str
    start: int = 0
    end: int = 0
    structure: dict = field(default_factory=dict)


@dataclass
class Segment:
    kind: str
    path: list[str]
    text: str
    start: int | None = None
    end: int | None = None
    structure: dict = field(default_factory=dict)
    tokens: int = field(default=0)

    def __post_init__(self):
        self.tokens = estimate(self.text)

    def joined(self, kind: str, path: list[str], other: Segment) -> Segment:
        """This segment and a later part of it: one text, the lines of both, the structure of both (the later one's counts)."""
        lines = [x for x in (self.start, other.start) if x is not None], [x for x in (self.end, other.end) if x is not None]
        return Segment(kind, path, self.text + "\n\n" + other.text, min(lines[0], default=None), max(lines[1], default=None), {**self.structure, **other.structure})


def estimate(text: str) -> int:
    wide = len(_WIDE.findall(text))
    return len(_WORD.findall(text)) - wide + round(1.5 * wide)


_ITEM = re.compile(r"([ \t]*)([-*+]|\d+[.)])\s+(.*)")


def list_block(lines: list[str]) -> tuple[str, dict]:
    """A list's text, an item a line and two blanks for each level below the first, and its items with their depths. An item
    is inside another if it is indented to that one's text; a line without a mark goes on with the item before it."""
    items: list[dict] = []
    open_: list[tuple[int, int]] = []  # indentation of the mark and of the text
    ordered = False
    for line in lines:
        m = _ITEM.match(line.expandtabs(4))
        if not m:
            if items:
                items[-1]["text"] += "\n" + line.strip()
            continue
        indent = len(m[1])
        while open_ and indent < open_[-1][1] and indent <= open_[-1][0]:
            open_.pop()
        if not open_ or indent >= open_[-1][1]:
            open_.append((indent, indent + len(m[2]) + 1))
        ordered = ordered if items else m[2][0].isdigit()
        items.append({"text": m[3].strip(), "depth": len(open_)})
    out, number = [], 0
    for x in items:
        number += x["depth"] == 1
        out.append("  " * (x["depth"] - 1) + (f"{number}. " if ordered and x["depth"] == 1 else "- ") + x["text"])
    return "\n".join(out), {"kind": "list", "ordered": ordered, "items": [x["text"] for x in items if x["depth"] == 1], "items_nested": items, "item_count": len(items)}


def table_structure(lines: list[str]) -> dict:
    cells = [[c.strip() for c in re.split(r"(?<!\\)\|", x.strip().removeprefix("|").removesuffix("|"))] for x in lines]
    rule = len(cells) > 1 and all(re.fullmatch(r":?-+:?", c) for c in cells[1])
    columns, body = (cells[0], cells[2:]) if rule else ([], cells)
    rows = [dict(zip(columns, r)) if columns else {f"col{k}": c for k, c in enumerate(r)} for r in body]
    return {"kind": "markdown_table", "columns": columns, "rows": rows, "row_count": len(rows), "col_count": len(columns)}


def html_structure(text: str) -> dict:
    low = text.lower()
    rows = low.count("<tr")
    return {"kind": "html_table", "raw_html_preserved": True, "row_count": max(1, rows), "col_count": max(1, low.count("<td") // max(1, rows))}


def blocks(text: str) -> Iterator[Block]:
    """Blocks of Markdown-like text, by lines."""
    held: list[str] = []
    kind, start = "", 0
    fence = None

    def flush(end: int):
        nonlocal held, kind
        if held:
            body, structure = "\n".join(held), {}
            if kind == "list":
                body, structure = list_block(held)
            elif kind == "table":
                structure = table_structure(held)
            elif kind == "html_table":
                structure = html_structure(body)
            elif kind == "code":
                language = held[0].strip().strip("`~").strip()
                structure = {"kind": "code_block", "language": language} if language else {}
            elif kind == "paragraph":
                structure = {"paragraph_count": 1}
            yield Block(kind, 0, body, start, end, structure)
        held, kind = [], ""

    n = -1
    for n, line in enumerate(text.split("\n")):
        bare = line.strip()
        if fence:
            held.append(line)
            if bare.startswith(fence):
                fence = None
                yield from flush(n + 1)
            continue
        heading = re.match(r"(#{1,6})\s+(.+)", bare)
        if bare.startswith(("```", "~~~")):
            yield from flush(n)
            fence, kind, held, start = bare[:3], "code", [line], n
        elif heading:
            yield from flush(n)
            yield Block("heading", len(heading[1]), re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", heading[2].rstrip("# ")).strip(), n, n + 1)
        elif not bare:
            yield from flush(n)
        else:
            now = "table" if bare.startswith("|") else "list" if re.match(r"([-*+]|\d+[.)])\s", bare) else "blockquote" if bare.startswith(">") else "html_table" if bare.lower().startswith("<table") else "paragraph"
            if kind and now != kind and not (kind == "list" and line[:1] in " \t"):
                yield from flush(n)
            if not kind:
                kind, start = now, n
            held.append(line)
    yield from flush(n + 1)


@dataclass
class Section:
    """A node of the section tree; the root's title is None unless the document's only top section took its place."""

    title: str | None
    level: int
    parent: int | None
    path: list[str]


def section_tree(parts: list[Block]) -> tuple[list[Section], list[tuple[Block, int]]]:
    """The sections of a document, from the root, and its other blocks, each with the number of its section.

    A heading closes the sections of its level and below. If the first heading lies below the highest level, headings of its
    level or above it count for nothing until one of the highest level comes. A titled section that is the only one at the top
    becomes the root and owns what stands before it."""
    highest = min((b.level for b in parts if b.kind == "heading"), default=0)
    sections, owned = [Section(None, 0, None, [])], []
    open_, first = [0], None
    for b in parts:
        if b.kind != "heading":
            owned.append((b, open_[-1]))
            continue
        if first is None:
            first = b.level
        elif first > highest and b.level > highest and b.level <= first:
            continue
        if b.level == highest:
            first = highest
        while len(open_) > 1 and sections[open_[-1]].level >= b.level:
            open_.pop()
        above = open_[-1]
        sections.append(Section(b.text, b.level, above, sections[above].path + [b.text]))
        open_.append(len(sections) - 1)
    top = [k for k, x in enumerate(sections) if x.parent == 0]
    if len(top) == 1 and sections[top[0]].title:
        only = sections[top[0]]
        sections[0] = Section(only.title, only.level, None, only.path)
        owned = [(b, 0 if k == top[0] else k) for b, k in owned]
        for x in sections[1:]:
            x.parent = 0 if x.parent == top[0] else x.parent
        only.parent = None  # the root has its place
    return sections, owned


def walk(text: str) -> list[Segment]:
    """Standalone kinds are segments of their own, neighbouring paragraphs of a section are grouped."""
    sections, owned = section_tree(list(blocks(text)))
    out: list[Segment] = []
    last = None
    for b, k in owned:
        path = sections[k].path
        if out and b.kind == "paragraph" and out[-1].kind == "paragraph" and last == k:
            counted = {"paragraph_count": out[-1].structure.get("paragraph_count", 0) + 1}
            out[-1] = out[-1].joined(b.kind, path, Segment(b.kind, path, b.text, b.start, b.end, counted))
        else:
            out.append(Segment(b.kind, path, b.text, b.start, b.end, b.structure))
        last = k
    return out


def stronger(a: str, b: str) -> str:
    return a if RANK.get(a, 0) >= RANK.get(b, 0) else b


def merge_small(segments: list[Segment], p: Policy) -> list[Segment]:
    """In order, within a section and up to the limit: a small paragraph takes the list or table after it (but no table
    above table_alone), and a small segment joins the one before it unless either is a table or code."""
    out: list[Segment] = []
    for s in segments:
        last = out[-1] if out else None
        joins = False
        if last and last.path == s.path and last.tokens + s.tokens <= p.most:
            table = s.kind in ("table", "html_table")
            lead = last.kind == "paragraph" and last.tokens < p.merge_below and (s.kind == "list" or table and s.tokens <= p.table_alone)
            joins = lead or s.tokens < p.merge_below and s.kind not in CLOSED and last.kind not in CLOSED
        if joins:
            out[-1] = last.joined(stronger(last.kind, s.kind), s.path, s)
        else:
            out.append(s)
    return out


def absorb_orphans(segments: list[Segment], p: Policy) -> list[Segment]:
    """From the end, each segment that is small at the start joins the nearest segment of its closest ancestor section
    whose nearest one has room and is no table or code. Of two equally near ones the earlier counts. Segments of a
    section are in order, so the nearest one is found by bisection, past segments that are gone."""
    at: dict[tuple[str, ...], list[int]] = {}
    for i, s in enumerate(segments):
        at.setdefault(tuple(s.path), []).append(i)
    out: list[Segment | None] = list(segments)
    small = [i for i, s in enumerate(segments) if s.tokens < p.chunk_below and s.kind not in CLOSED]
    for i in reversed(small):
        orphan = out[i]
        for depth in range(len(orphan.path) - 1, -1, -1):
            there = at.get(tuple(orphan.path[:depth]), [])
            k = bisect.bisect_left(there, i)
            near = [j for j in (there[k - 1] if k else None, there[k] if k < len(there) else None) if j is not None]
            if not near:
                continue
            j = min(near, key=lambda j: (abs(j - i), j))
            host = out[j]
            if host.tokens + orphan.tokens <= p.most and host.kind not in CLOSED:
                out[j] = host.joined(stronger(host.kind, orphan.kind), host.path, orphan)
                out[i] = None
                own = at[tuple(orphan.path)]
                del own[bisect.bisect_left(own, i)]
                break
    return [s for s in out if s is not None]


def lead_forward(segments: list[Segment], p: Policy) -> list[Segment]:
    """A small paragraph joins the next segment if that is no table or code and lies above or below it in the section
    tree, not in the same section. What it becomes part of may be a small paragraph again."""
    out: list[Segment] = []
    for s in segments:
        last = out[-1] if out else None
        if last and last.kind == "paragraph" and last.tokens < p.chunk_below and s.kind not in CLOSED and last.tokens + s.tokens <= p.most:
            shared = min(len(last.path), len(s.path))
            if last.path != s.path and last.path[:shared] == s.path[:shared]:
                out[-1] = last.joined(s.kind, s.path, s)
                continue
        out.append(s)
    return out


def _packed(parts: list[str], most: int, glue: str) -> list[str]:
    out: list[list[str]] = []
    size = 0
    for x in parts:
        n = estimate(x)
        if not out or size + n > most:
            out.append([])
            size = 0
        out[-1].append(x)
        size += n
    return [glue.join(x) for x in out]


def split_large(segment: Segment, p: Policy) -> list[Segment]:
    """Paragraphs packed up to the limit; one beyond it gives its sentences, packed alike; a sentence beyond it stays
    whole."""
    if segment.tokens <= p.most:
        return [segment]
    texts: list[str] = []
    held: list[str] = []
    for para in segment.text.split("\n\n"):
        if estimate(para) > p.most:
            texts += _packed(held, p.most, "\n\n") + _packed([x.strip() for x in _STOP.split(para) if x.strip()], p.most, "")
            held = []
        else:
            held.append(para)
    texts += _packed(held, p.most, "\n\n")
    return [Segment(segment.kind, segment.path, x, segment.start, segment.end, segment.structure) for x in texts if x.strip()]


def segment_text(text: str, p: Policy) -> list[Segment]:
    s = merge_small(walk(text or ""), p)
    s = absorb_orphans(s, p) if p.absorb_orphans else s
    s = lead_forward(s, p) if p.lead_in else s
    return [x for y in s for x in split_large(y, p)]


def segment_documents(docs: DataFrame, policy: Policy | None = None) -> DataFrame:
    """document, segment_index, block_type, section_title, section_path, text, token_count, line_start, line_end (exclusive),
    structure (JSON of tables, lists and the like), breadcrumb; docs: document, title, text."""
    policy = policy or Policy()
    shape = "array<struct<block_type:string,section_title:string,section_path:array<string>,text:string,token_count:int,line_start:int,line_end:int,structure:string>>"

    @F.pandas_udf(shape)
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(
            lambda t: [
                {"block_type": s.kind, "section_title": s.path[-1] if s.path else None, "section_path": s.path, "text": s.text, "token_count": s.tokens, "line_start": s.start, "line_end": s.end, "structure": json.dumps(s.structure, ensure_ascii=False)}
                for s in segment_text(t, policy)
            ]
        )

    d = docs.select("document", "title", F.posexplode(cut("text")).alias("segment_index", "s")).select("document", "title", "segment_index", "s.*")
    return d.withColumn("breadcrumb", breadcrumb(F.col("title"), F.col("section_path"))).drop("title")


def outline(docs: DataFrame) -> DataFrame:
    """document, section (0 for the root), parent, level, title, path: the section trees; docs: document, text."""

    @F.pandas_udf("array<struct<section:int,parent:int,level:int,title:string,path:array<string>>>")
    def sections(texts: pd.Series) -> pd.Series:
        def rows(text: str | None) -> list[dict]:
            tree, _ = section_tree(list(blocks(text or "")))
            return [{"section": k, **vars(x)} for k, x in enumerate(tree) if k == 0 or x.parent is not None]

        return texts.map(rows)

    return docs.select("document", F.explode(sections("text")).alias("s")).select("document", "s.*")


def breadcrumb(title: Column, path: Column) -> Column:
    return F.array_join(F.array_distinct(F.filter(F.concat(F.array(title), path), lambda x: F.coalesce(x, F.lit("")) != "")), " > ")


def clean(text: Column) -> Column:
    """No image references, links as their text, no bold marks, breaks as lines, at most one blank line in a row."""
    out = F.regexp_replace(text, r"!\[[^\]]*\]\([^)]*\)", "")
    out = F.regexp_replace(out, r"\[([^\]]*)\]\([^)]*\)", "$1")
    out = F.regexp_replace(F.regexp_replace(out, r"\*\*|__", ""), r"(?i)<br\s*/?>", "\n")
    return F.trim(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def token_windows(docs: DataFrame, size: int = 300, overlap: int = 30) -> DataFrame:
    """document, window, tokens: overlapping runs of tokens; the last one that starts inside the text ends it."""
    t = docs.select("document", T.tokens(F.col("text")).alias("t")).where(F.size("t") > 0)
    # windows are cut before they become rows, so that no row carries the whole text's tokens
    runs = F.transform(F.sequence(F.lit(1), F.size("t"), F.lit(size - overlap)), lambda i: F.slice("t", i, size))
    return t.select("document", F.posexplode(runs).alias("window", "tokens"))
