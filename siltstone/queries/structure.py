"""Queries for the structure of documents: laid-out pages, Word files, sections."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..catalog import query
from ..operators import layout, segment
from ..sources import docx, toc

#: Lines of documents as laid-out blocks: four on a page, the first a running head, some numbered or in larger fonts.
LAID_OUT = """SELECT doc_id, i, i // 4 + 1 AS page, CASE WHEN i % 4 = 0 THEN 'Seite ' || (i // 4 + 1) || ' von 9' WHEN i % 5 = 2 THEN (i // 5 + 1) || '.' || (i % 3) || ' ' || trim(x) WHEN i % 7 = 3 THEN 'Table ' || i || ' ' || trim(x) WHEN i % 11 = 5 THEN '第' || i || '章 ' || trim(x) ELSE trim(x) END AS text,
  CASE WHEN i % 6 = 1 THEN 18.0::DOUBLE WHEN i % 9 = 4 THEN 14.0 ELSE 10.0 END AS font_size, 740.0::DOUBLE - (i % 4) * 225 AS y0
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents) WHERE trim(x) <> ''"""


def _laid_out(t):
    d = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "x")).where(F.trim("x") != "")
    i, x = F.col("i"), F.trim("x")
    page = F.floor(i / 4) + 1
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    text = F.when(i % 4 == 0, said("Seite ", page, " von 9")).when(i % 5 == 2, said(F.floor(i / 5) + 1, ".", i % 3, " ", x)).when(i % 7 == 3, said("Table ", i, " ", x)).when(i % 11 == 5, said("第", i, "章 ", x)).otherwise(x)
    font = F.when(i % 6 == 1, 18.0).when(i % 9 == 4, 14.0).otherwise(10.0)
    return d.select(F.col("doc_id").alias("document"), i.alias("seq"), page.alias("page"), text.alias("text"), font.alias("font_size"), (740.0 - (i % 4) * 225).alias("y0"), F.lit(800.0).alias("page_height"))


#: The open sections of blocks (doc_id, i, kind, level, text), as SQL.
OPEN = """l AS (SELECT *, """ + ", ".join(f"last(CASE WHEN level = {k} THEN i END IGNORE NULLS) OVER w AS h{k}, last(CASE WHEN level = {k} THEN text END IGNORE NULLS) OVER w AS t{k}" for k in range(1, 7)) + """ FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
o AS (SELECT *, array_to_string(list_filter([""" + ", ".join(f"CASE WHEN h{k} > greatest(-1{''.join(f', coalesce(h{j}, -1)' for j in range(1, k))}) THEN t{k} END" for k in range(1, 7)) + """], lambda x: x IS NOT NULL), ' > ') AS path FROM l)"""


@query("p07_layout", rf"""WITH r AS ({LAID_OUT}),
n AS (SELECT *, regexp_replace(text, '[0-9]+', 'N', 'g') AS folded, max(page) OVER (PARTITION BY doc_id) AS pages FROM r),
c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, folded) AS times FROM n),
k AS (SELECT * FROM c WHERE NOT (pages >= 3 AND times >= greatest(3, pages // 2) AND (800 - y0 < 120 OR y0 < 96))),
f AS (SELECT doc_id, arg_max(font_size, s) AS body, list_sort(list(font_size), 'DESC') AS sizes FROM (SELECT doc_id, font_size, {{'n': count(*), 'f': -min(i)}} AS s FROM k GROUP BY ALL) GROUP BY doc_id),
m AS (SELECT k.*, body, sizes, length(text) <= 400 AND font_size + 0.1 >= body AS fits, regexp_extract(text, '^([0-9]+(?:\.[0-9]+){{0,4}})[\x{{00a0}}\s]+(\S.{{0,200}})$', 1) AS number, trim(regexp_extract(text, '^([0-9]+(?:\.[0-9]+){{0,4}})[\x{{00a0}}\s]+(\S.{{0,200}})$', 2)) AS title FROM k JOIN f USING (doc_id)),
b AS (SELECT doc_id, i, CASE WHEN regexp_matches(text, '^第[0-9]+章') AND fits THEN 1 WHEN number <> '' AND NOT contains(title, '....') AND length(text) <= 200 AND fits THEN len(string_split(number, '.')) WHEN font_size > body * 1.2 AND length(text) < 200 THEN least(6, list_position(sizes, font_size)) END AS level,
  CASE WHEN regexp_matches(text, '^第[0-9]+章') AND fits THEN text WHEN number <> '' AND NOT contains(title, '....') AND length(text) <= 200 AND fits THEN number || ' ' || title ELSE text END AS text FROM m WHERE NOT regexp_matches(text, '\.{{4,}}\s*[0-9]+\s*$')),
{OPEN} SELECT doc_id, i AS seq, CASE WHEN level IS NOT NULL THEN 'heading' WHEN regexp_matches(text, '(?i)^Table\s+[0-9]+(\.[0-9]+)?\b') THEN 'table' ELSE 'paragraph' END AS block_type, level::BIGINT AS level, sha256(text) AS h, path FROM o""")
def laid_out(t):
    d = layout.section_paths(layout.content_blocks(_laid_out(t)))
    return d.select(F.col("document").alias("doc_id"), F.col("place.seq").alias("seq"), "block_type", "level", F.sha2("text", 256).alias("h"), F.array_join("path", " > ").alias("path"))


@query("p08_docx", f"""WITH x AS (SELECT doc_id, source, lang, list_filter(list_transform(string_split(text, chr(10)), lambda y: trim(y)), lambda y: y <> '') AS l FROM documents),
b AS (SELECT doc_id, 0 AS i, 1 AS level, source AS text, 'heading' AS kind FROM x UNION ALL SELECT doc_id, unnest(range(1, len(l) + 1)), unnest(list_transform(l, lambda y, k: CASE WHEN k % 5 = 1 THEN 2 END)), unnest(l), unnest(list_transform(l, lambda y, k: CASE WHEN k % 5 = 1 THEN 'heading' WHEN k % 5 = 3 THEN 'list' ELSE 'paragraph' END)) FROM x
  UNION ALL SELECT doc_id, len(l) + 1, NULL, '| a | a | ' || lang || ' |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| ' || source || ' | \\| | ' || lang || ' |', 'table' FROM x),
{OPEN} SELECT doc_id, i AS place, kind AS block_type, level::BIGINT AS level, sha256(text) AS h, path FROM o""")
def docx_structure(t):
    """Each document as a Word file, read again: lines by styles, and a table with cells over two columns and two rows."""
    blank = lambda e: F.filter(F.transform(F.split(e, "\n"), lambda y: F.trim(y)), lambda y: y != "")
    files = t.documents.select(F.col("doc_id").cast("string").alias("document"), _word_file("source", "lang", blank("text")).alias("content"))
    d = layout.section_paths(docx.docx_blocks(files))
    return d.select(F.col("document").cast("bigint").alias("doc_id"), "place", "block_type", "level", F.sha2("text", 256).alias("h"), F.array_join("path", " > ").alias("path"))


@F.pandas_udf(BinaryType())
def _word_file(source: pd.Series, lang: pd.Series, lines: pd.Series) -> pd.Series:
    name = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    styles = f'<w:styles {name}>' + "".join(f'<w:style w:type="paragraph" w:styleId="{i}"{d}><w:name w:val="{n}"/></w:style>' for i, n, d in (("Normal", "Normal", ' w:default="1"'), ("h1", "heading 1", ""), ("h2", "Heading 2", ""), ("lp", "List Paragraph", ""))) + "</w:styles>"
    run = lambda x: "<w:r>" + "<w:tab/>".join(f'<w:t xml:space="preserve">{escape(y)}</w:t>' for y in x.split("\t")) + "</w:r>"
    para = lambda x, style="": f'<w:p>{f"""<w:pPr><w:pStyle w:val="{style}"/></w:pPr>""" if style else ""}{run(x)}</w:p>'
    cell = lambda x, props="": f"<w:tc><w:tcPr>{props}</w:tcPr>{para(x)}</w:tc>"

    def file(s: str, g: str, ls: list[str]) -> bytes:
        body = para(s, "h1") + "".join(para(x, {1: "h2", 3: "lp"}.get(k % 5, "")) for k, x in enumerate(ls, 1))
        body += f'<w:tbl><w:tr>{cell("a", """<w:gridSpan w:val="2"/>""")}{cell(g, """<w:vMerge w:val="restart"/>""")}</w:tr><w:tr>{cell(s)}{cell("|")}{cell("", "<w:vMerge/>")}</w:tr></w:tbl>'
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("word/styles.xml", styles)
            z.writestr("word/document.xml", f"<w:document {name}><w:body>{body}</w:body></w:document>")
        return out.getvalue()

    return pd.Series([file(s, g, ls) for s, g, ls in zip(source, lang, lines)])


@query("p05_section_tree", f"""WITH x AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda y: trim(regexp_replace(y, '[^a-zA-Zà-ÿ ]', '', 'g'))), lambda y: y <> '') AS l FROM documents),
y AS (SELECT doc_id, 2 * unnest(range(len(l))) AS i, unnest(l) AS text, unnest(list_transform(l, lambda v, k: CASE WHEN k = 2 THEN 1 WHEN k % 7 = 4 THEN 2 WHEN k % 7 = 6 THEN 4 END)) AS level FROM x),
b AS (SELECT * FROM y), {OPEN}
SELECT doc_id, i AS line_start, CASE WHEN i < 2 AND n > 1 THEN t ELSE path END AS path FROM o JOIN (SELECT doc_id, len(l) AS n, l[2] AS t FROM x) USING (doc_id) WHERE level IS NULL OR i = 2 AND n > 2""")
def section_tree(t):
    """Lines as Markdown, a blank line after each, the second one a heading above all others: it owns what precedes it."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda y: F.trim(F.regexp_replace(y, "[^a-zA-Zà-ÿ ]", ""))), lambda y: y != "")
    marked = F.transform(lines, lambda y, k: F.concat(F.when(k == 1, "# ").when((k + 1) % 7 == 4, "## ").when((k + 1) % 7 == 6, "#### ").otherwise(""), y))
    one = segment.Policy(merge_below=0, chunk_below=0, most=1 << 30)
    d = t.documents.select(F.col("doc_id").cast("string").alias("document"), F.lit("").alias("title"), F.array_join(marked, "\n\n").alias("text"))
    # grouped paragraphs of a section give their lines again
    s = segment.segment_documents(d, one)
    at = s.select("document", "section_path", F.explode(F.sequence("line_start", F.col("line_end") - 1, F.lit(2))).alias("line_start"))
    return at.select(F.col("document").cast("bigint").alias("doc_id"), "line_start", F.array_join("section_path", " > ").alias("path"))


SITE = "regexp_extract(url, '^https?://([^/]+)', 1)"


@query("s06_toc_order", f"""WITH p AS (SELECT {SITE} AS archive, page_id, row_number() OVER (PARTITION BY {SITE} ORDER BY page_id DESC) - 1 AS n FROM pages)
SELECT archive, n * 2 AS place, (1 + n % 2)::BIGINT AS depth, 'Topic ' || page_id AS title, page_id FROM p WHERE page_id % 5 <> 0""")
def toc_order(t):
    """Each site as an archive whose contents list its pages backwards, every one twice; each fifth topic is missing."""
    p = t.pages.select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("archive"), "page_id", "html")
    item = F.concat(F.lit('<li><object type="text/sitemap"><param name="Name" value="Topic '), F.col("page_id").cast("string"), F.lit('"><param name="Local" value="p'), F.col("page_id").cast("string"), F.lit('.htm"></object>'))
    listed = p.groupBy("archive").agg(F.sort_array(F.collect_list(F.struct("page_id", item.alias("x"))), False).alias("l"))  # of a made-up archive
    text = F.concat(F.lit("<ul>"), F.array_join(F.transform("l", lambda e, k: F.concat(F.when(k % 2 == 1, F.concat(F.lit("<ul>"), e["x"], F.lit("</ul>"))).otherwise(e["x"]), e["x"])), ""), F.lit("</ul>"))
    topics = p.where("page_id % 5 <> 0").select("archive", F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".htm")).alias("local"), F.col("page_id").cast("string").alias("text"))
    return toc.ordered_topics(listed.select("archive", text.alias("text")), topics).select("archive", "place", "depth", "title", F.col("text").cast("bigint").alias("page_id"))


@query("s06_toc_summary", f"SELECT {SITE} AS archive, 2 * count(*) AS entries, count(*) FILTER (WHERE page_id % 5 <> 0) AS converted, count(*) FILTER (WHERE page_id % 5 = 0) AS missing FROM pages GROUP BY 1")
def toc_summary(t):
    p = t.pages.select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("archive"), F.col("page_id").cast("string").alias("page"), (F.col("page_id") % 5 != 0).alias("there"))
    item = F.concat(F.lit('<object type="text/sitemap"><param name="name" value="t"><param name="local" value="'), "page", F.lit('"></object>'))
    listed = p.groupBy("archive").agg(F.concat(F.array_join(F.collect_list(item), ""), F.array_join(F.collect_list(item), "")).alias("text"))
    return toc.toc_summary(listed, p.where("there").select("archive", F.col("page").alias("local")))
