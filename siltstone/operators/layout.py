"""Blocks of laid-out pages (of PDF readers, say) as content blocks: running heads removed, headings found, sections named.

blocks: document, seq (reading order), page, text, font_size, y0 (of the lower edge), page_height. Reading files is a matter of
the source; all rules here are aggregates of a document's blocks and expressions over one block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 6
#: Patterns of headings, of lines of a table of contents, and of captions.
NUMBERED = r"^([0-9]+(?:\.[0-9]+){0,4})[ \s]+(\S.{0,200})$"
DOTTED = r"\.{4,}\s*[0-9]+\s*$"
CAPTION = r"(?i)^(Tabelle|Table|Abbildung|Figure|Bild)\s+[0-9]+(?:\.[0-9]+)?\b"
IDEOGRAPHIC = (
    (r"^第[一二三四五六七八九十百千零0-9]+[章部篇]", 1),
    (r"^第[一二三四五六七八九十百千零0-9]+[节条款]", 2),
    (r"^[（(][一二三四五六七八九十0-9]+[）)]\s*\S", 3),
    (r"^[一二三四五六七八九十]+[、．.]\s*\S", 3),
)
#: The shares of a page's height that count as its head and foot.
HEAD, FOOT = 0.15, 0.12


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def without_running_heads(blocks: DataFrame) -> DataFrame:
    """Drops blocks at the head or foot of their page whose text, digits folded, stands on half of the document's pages or
    more (three at least); shorter documents keep all."""
    folded = blocks.withColumn("__folded", F.regexp_replace("text", "[0-9]+", "N"))
    often = folded.groupBy("document", "__folded").agg(F.count("*").alias("__times"))
    pages = folded.groupBy("document").agg(F.max("page").alias("__pages"))
    least = F.greatest(F.lit(3), F.floor(F.col("__pages") / 2))
    repeated = often.join(pages, "document").where((F.col("__pages") >= 3) & (F.col("__times") >= least)).select("document", "__folded", F.lit(True).alias("__repeated"))
    edge = (F.col("page_height") <= 0) | (F.col("page_height") - F.col("y0") < F.col("page_height") * HEAD) | (F.col("y0") < F.col("page_height") * FOOT)
    marked = folded.join(repeated, ["document", "__folded"], "left")
    return marked.where(F.col("__repeated").isNull() | ~edge).select(*blocks.columns)


def split_long(blocks: DataFrame) -> DataFrame:
    """Blocks of several paragraphs become one each, and long ones without any become lines; adds part."""
    paragraphs = F.split("text", r"\n\s*\n")
    parts = F.when(F.size(paragraphs) > 1, paragraphs).when(F.length("text") > 1000, F.split("text", "\n")).otherwise(F.array("text"))
    whole = F.size(parts) == 1
    fine = F.when(whole, parts).otherwise(F.filter(F.transform(parts, stripped), lambda x: x != ""))
    return blocks.select(*[c for c in blocks.columns if c != "text"], F.posexplode(fine).alias("part", "text"))


def content_blocks(blocks: DataFrame) -> DataFrame:
    """document, place, block_type, level, text: headings by ideographic or decimal numbers, or by a font larger than the
    document's commonest by a fifth (its level is the font's place among the document's sizes); captions are tables, lines of a
    table of contents are dropped."""
    d = split_long(without_running_heads(blocks))
    sized = d.where("font_size > 0").groupBy("document", "font_size").agg(F.count("*").alias("n"), F.min(F.struct("seq", "part")).alias("first"))
    order = F.struct("n", (-F.col("first.seq")).alias("s"), (-F.col("first.part")).alias("p"))
    fonts = sized.groupBy("document").agg(F.max_by("font_size", order).alias("body"), F.sort_array(F.collect_set("font_size"), False).alias("sizes"))
    d = d.join(fonts, "document", "left").withColumn("body", F.coalesce("body", F.lit(10.0))).withColumn("sizes", F.coalesce("sizes", F.array().cast("array<double>")))
    line = stripped(F.substring_index("text", "\n", 1))
    rest = F.when(F.contains("text", F.lit("\n")), stripped(F.substring(F.col("text"), F.position(F.lit("\n"), F.col("text")) + 1, F.length("text")))).otherwise("")
    d = d.withColumn("line", line).withColumn("rest", rest)
    short, large = F.length("text") <= 400, F.col("font_size") + 0.1 >= F.col("body")
    named = F.lit(None).cast("int")
    for pattern, level in reversed(IDEOGRAPHIC):
        named = F.when(F.col("line").rlike(pattern), level).otherwise(named)
    number, title = F.regexp_extract("line", NUMBERED, 1), stripped(F.regexp_extract("line", NUMBERED, 2))
    depth = F.size(F.split(number, r"\."))
    numbered = (number != "") & ~F.contains(title, F.lit("....")) & (F.length("line") <= 200) & short & large & depth.between(1, LEVELS)
    at = F.array_position(F.transform("sizes", lambda s: F.abs(s - F.col("font_size")) < 0.5), True)
    by_font = F.when(at > 0, F.least(at, F.lit(LEVELS))).otherwise(4)
    bigger = (F.col("font_size") > F.col("body") * 1.2) & (F.length("line") < 200) & short

    def block(kind: str, level: Column, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("block_type"), level.cast("int").alias("level"), text.alias("text"))

    def heading(level: Column, text: Column) -> Column:
        own = block("heading", level, text)
        return F.when(F.col("rest") != "", F.array(own, block("paragraph", F.lit(None), F.col("rest")))).otherwise(F.array(own))

    plain = F.array(block("paragraph", F.lit(None), F.col("text")))
    found = (
        F.when(F.col("line").rlike(DOTTED), F.array().cast("array<struct<block_type:string,level:int,text:string>>"))
        .when(named.isNotNull() & short & large, heading(named, F.col("line")))
        .when(numbered, heading(depth, F.concat(number, F.lit(" "), title)))
        .when(bigger, heading(by_font, F.col("line")))
        .when(F.col("line").rlike(CAPTION), F.array(block("table", F.lit(None), F.col("text"))))
        .otherwise(plain)
    )
    d = d.select("document", "seq", "part", F.posexplode(found).alias("piece", "b"))
    return d.select("document", F.struct("seq", "part", "piece").alias("place"), "b.*")


def section_paths(blocks: DataFrame, place: str = "place") -> DataFrame:
    """Adds path: the titles of the sections a block lies in, from above; a heading is in its own. A heading ends those of its
    level and below. blocks: document, a place to order by, block_type, level, text."""
    w = Window.partitionBy("document").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    is_heading = F.col("block_type") == "heading"
    d = blocks
    for level in range(1, LEVELS + 1):  # the last heading of each level
        here = F.struct(F.col(place).alias("at"), F.col("text").alias("title"))
        d = d.withColumn(f"__h{level}", F.last(F.when(is_heading & (F.col("level") == level), here), ignorenulls=True).over(w))
    open_ = []
    for level in range(1, LEVELS + 1):  # it is open unless one above it came later
        own = F.col(f"__h{level}")
        fine = own.isNotNull()
        for above in range(1, level):
            fine = fine & (F.col(f"__h{above}").isNull() | (F.col(f"__h{above}.at") < own["at"]))
        open_.append(F.when(fine, own["title"]))
    return d.withColumn("path", F.filter(F.array(*open_), lambda x: x.isNotNull())).select(*blocks.columns, "path")
