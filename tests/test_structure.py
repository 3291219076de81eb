"""Laid-out pages, Word files, section trees, tables of contents and tables of pages against hand-computed cases."""

import io
import zipfile

from siltstone.operators import layout, segment
from siltstone.sources import docx, html, toc

PAGE = "document string, seq int, page int, text string, font_size double, y0 double, page_height double"


def pages(spark, rows):
    return spark.createDataFrame([("d", k, *r) for k, r in enumerate(rows)], PAGE)


def got(df):
    return [(r.block_type, r.level, r.text) for r in df.orderBy("place").collect()]


def test_running_heads_go_at_the_edges_only(spark):
    rows = [r for p in (1, 2, 3, 4) for r in ((p, f"Page {p} of 4", 10.0, 790.0, 800.0), (p, "Note 7", 10.0, 400.0, 800.0), (p, f"text {'abcd'[p - 1]}", 10.0, 300.0, 800.0))]
    left = [r.text for r in layout.without_running_heads(pages(spark, rows)).orderBy("seq").collect()]
    assert left == [x for p in "abcd" for x in ("Note 7", f"text {p}")]  # repeated, but in the middle
    assert layout.without_running_heads(pages(spark, rows[:6])).count() == 6  # two pages are too few
    unsized = [(p, "Head", 10.0, 400.0, 0.0) for p in (1, 2, 3)]
    assert layout.without_running_heads(pages(spark, unsized)).count() == 0


def test_headings_of_pages(spark):
    body = [(1, f"plain text number {k} of the page", 10.0, 400.0, 800.0) for k in range(4)]
    rows = [
        (1, "第一章 概述", 12.0, 400.0, 800.0), (1, "1.2 Scope\nof the work", 10.0, 400.0, 800.0), (1, "Big title", 18.0, 400.0, 800.0), (1, "Smaller", 14.0, 400.0, 800.0),
        (1, "2 Intro .......... 7", 10.0, 400.0, 800.0), (1, "Table 3.1 Values", 10.0, 400.0, 800.0), (1, "3 small print", 8.0, 400.0, 800.0), (1, "one\n \ntwo", 10.0, 400.0, 800.0),
        (1, "（一）细则", 10.0, 400.0, 800.0), (1, "1.2.3.4.5.6 deep", 10.0, 400.0, 800.0),
    ]
    blocks = layout.content_blocks(pages(spark, rows + body))
    assert got(blocks)[:11] == [
        ("heading", 1, "第一章 概述"), ("heading", 2, "1.2 Scope"), ("paragraph", None, "of the work"), ("heading", 1, "Big title"), ("heading", 2, "Smaller"),
        ("table", None, "Table 3.1 Values"), ("paragraph", None, "3 small print"), ("paragraph", None, "one"), ("paragraph", None, "two"), ("heading", 3, "（一）细则"),
        ("paragraph", None, "1.2.3.4.5.6 deep"),
    ]
    paths = [r.path for r in layout.section_paths(blocks).orderBy("place").collect()]
    assert paths[2] == ["第一章 概述", "1.2 Scope"] and paths[4] == ["Big title", "Smaller"] and paths[-1] == ["Big title", "Smaller", "（一）细则"]


def word_file(body, styles=True):
    name = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        if styles:
            z.writestr("word/styles.xml", f'<w:styles {name}><w:style w:type="paragraph" w:styleId="a"><w:name w:val="heading 2"/></w:style><w:style w:type="paragraph" w:styleId="b"><w:name w:val="List Bullet"/></w:style><w:style w:type="paragraph" w:styleId="n" w:default="1"><w:name w:val="Normal"/></w:style><w:style w:type="paragraph" w:styleId="z"><w:name w:val="Heading 9"/></w:style></w:styles>')
        z.writestr("word/document.xml", f"<w:document {name}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def para(text, style=None):
    return "<w:p>" + (f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else "") + f"<w:r><w:t>{text}</w:t></w:r></w:p>"


def test_word_files(spark):
    cell = lambda t, p="": f"<w:tc><w:tcPr>{p}</w:tcPr>{para(t)}</w:tc>"
    table = f'<w:tbl><w:tr>{cell("h|1", """<w:gridSpan w:val="2"/>""")}{cell("v", """<w:vMerge w:val="restart"/>""")}</w:tr><w:tr>{cell("a")}{cell("b")}{cell("", "<w:vMerge/>")}</w:tr></w:tbl>'
    body = para("Title", "a") + para("  ") + para("item", "b") + para("• dot") + "<w:p><w:r><w:t>two</w:t><w:tab/></w:r><w:hyperlink><w:r><w:t>linked</w:t><w:br/><w:t>line</w:t></w:r></w:hyperlink><w:del><w:r><w:delText>gone</w:delText></w:r></w:del></w:p>" + para("Deep", "z") + table + para("after")
    files = spark.createDataFrame([("d", word_file(body)), ("bare", word_file(para("x", "a"), styles=False)), ("no zip", b"%PDF"), ("none", None), ("empty", word_file(""))], "document string, content binary")
    rows = docx.docx_blocks(files).orderBy("document", "place").collect()
    assert [(r.block_type, r.text) for r in rows if r.document == "bare"] == [("paragraph", "x")] and {r.document for r in rows} == {"d", "bare"}
    mine = [r for r in rows if r.document == "d"]
    assert [(r.block_type, r.level, r.text) for r in mine if r.block_type != "table"] == [
        ("heading", 2, "Title"), ("list", None, "item"), ("list", None, "• dot"), ("paragraph", None, "two\tlinked\nline"), ("heading", 6, "Deep"), ("paragraph", None, "after"),
    ]
    t = next(r for r in mine if r.block_type == "table")
    assert t.text == "| h\\|1 | h\\|1 | v |\n| --- | --- | --- |\n| a | b | v |" and (t.row_count, t.col_count) == (2, 3)
    paths = {r.text: r.path for r in layout.section_paths(docx.docx_blocks(files.where("document = 'd'"))).collect()}
    assert paths["item"] == ["Title"] and paths["after"] == ["Title", "Deep"]


def tree(text):
    sections, owned = segment.section_tree(list(segment.blocks(text)))
    return [(x.title, x.level, x.parent) for x in sections], [(b.text, sections[k].path) for b, k in owned]


def test_section_trees():
    sections, owned = tree("before\n\n# [A](#a)\n\nx\n\n## B\n\ny\n\n### C\n\nz\n\n## D\n\nw")
    assert sections[0] == ("A", 1, None) and [s[:2] for s in sections[2:]] == [("B", 2), ("C", 3), ("D", 2)]
    assert owned == [("before", ["A"]), ("x", ["A"]), ("y", ["A", "B"]), ("z", ["A", "B", "C"]), ("w", ["A", "D"])]
    sections, owned = tree("p\n\n## A\n\nx\n\n## B\n\ny")
    assert sections == [(None, 0, None), ("A", 2, 0), ("B", 2, 0)] and owned[0] == ("p", [])
    # a deeper heading first: those of its level or above count for nothing until the highest level comes
    assert tree("### A\n\nx\n\n## B\n\ny\n\n#### E\n\ne\n\n# C\n\nz\n\n## F\n\nf")[1] == [("x", ["A"]), ("y", ["A"]), ("e", ["A", "E"]), ("z", ["C"]), ("f", ["C", "F"])]
    assert tree("") == ([(None, 0, None)], []) and tree("just text")[1] == [("just text", [])]


def test_lines_and_structure_of_segments():
    text = "# T\n\n- a\n  - b\n    more\n  - c\n1. d\n\n| x | y |\n|---|---|\n| 1 | 2 |\n\n```py\ncode\n```\n<table><tr><td>1</td><td>2</td></tr></table>\n\nend"
    s = segment.walk(text)
    assert [(x.kind, x.start, x.end) for x in s] == [("list", 2, 7), ("table", 8, 11), ("code", 12, 15), ("html_table", 15, 16), ("paragraph", 17, 18)]
    assert s[0].text == "- a\n  - b\nmore\n  - c\n- d" and s[0].structure["items"] == ["a", "d"] and [x["depth"] for x in s[0].structure["items_nested"]] == [1, 2, 2, 1]
    assert s[1].structure == {"kind": "markdown_table", "columns": ["x", "y"], "rows": [{"x": "1", "y": "2"}], "row_count": 1, "col_count": 2}
    assert s[2].structure == {"kind": "code_block", "language": "py"} and s[3].structure["col_count"] == 2
    assert segment.list_block(["1. one", "2. two", "   - in"])[0] == "1. one\n2. two\n  - in"
    merged = segment.merge_small(segment.walk("intro\n\n- a\n- b"), segment.Policy())
    assert (merged[0].start, merged[0].end) == (0, 4) and merged[0].structure["paragraph_count"] == 1 and merged[0].structure["item_count"] == 2


def test_segments_and_outlines_as_tables(spark):
    d = spark.createDataFrame([("d", "Doc", "# A\n\nx\n\n## B\n\ny"), ("e", "E", None)], "document string, title string, text string")
    rows = segment.segment_documents(d, segment.Policy(merge_below=0, chunk_below=0)).orderBy("segment_index").collect()
    assert [(r.section_title, r.section_path, r.line_start, r.line_end) for r in rows] == [("A", ["A"], 2, 3), ("B", ["A", "B"], 6, 7)]
    assert sorted((r.document, r.section, r.parent, r.title) for r in segment.outline(d).collect()) == [("d", 0, None, "A"), ("d", 2, 0, "B"), ("e", 0, None, None)]


def test_tables_of_contents(spark):
    entry = lambda name, local: f'<LI><OBJECT type="text/sitemap"><param name="Name" value="{name}"><param name="Local" value="{local}"></OBJECT>'
    text = f"<UL>{entry('One', 'a.htm')}<UL>{entry('Two &amp; more', 'b.htm')}</UL>{entry('Again', 'a.htm')}{entry('', 'x.htm')}{entry('Gone', 'c.htm')}</UL>"
    contents = spark.createDataFrame([("z", text), ("none", None)], "archive string, text string")
    topics = spark.createDataFrame([("z", "a.htm", "A"), ("z", "b.htm", "B"), ("z", "unlisted.htm", "U")], "archive string, local string, text string")
    assert [tuple(r) for r in toc.ordered_topics(contents, topics).orderBy("place").collect()] == [("z", 0, 1, "One", "a.htm", "A"), ("z", 1, 2, "Two & more", "b.htm", "B")]
    assert sorted(tuple(r) for r in toc.toc_summary(contents, topics).collect()) == [("none", 0, 0, 0), ("z", 4, 2, 1)]
    paths = spark.createDataFrame([("c", "x.hhc"), ("h", "resources/a.htm"), ("h", "profile.xml"), ("p", "index.html"), ("o", "deep/x.hhc")], "archive string, path string")
    assert {r.archive: r.layout for r in toc.archive_layout(paths).collect()} == {"c": "chm", "h": "hdx", "p": "chm", "o": None}


def test_headers_and_captions_of_tables():
    assert html.to_markdown("<table><caption>Fig <b>1</b></caption><tr><th>a</th></tr><tr><td>b</td></tr></table>") == "Fig **1**\n\n| a |\n| --- |\n| b |"
    assert html.to_markdown("<table><tr><td>a</td></tr></table>") == "|  |\n| --- |\n| a |"
    assert html.to_markdown("<table><thead><tr><td>a</td></tr></thead><tbody><tr><td rowspan=2>b</td></tr></tbody></table>") == "| a |\n| --- |\n| b |\n| b |"
