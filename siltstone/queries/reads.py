"""Queries for reads of the knowledge tables: lists, counts, lookups and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import assembly, browse, ontology, units
from ..sources import html


@query("b06_units_of_documents", "SELECT conv_id AS document, turn AS unit, role AS unit_type, total FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations WHERE turn % 4 <> 3) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 2")
def units_of_documents(t):
    """The first page of every document's units, with their number."""
    u = t.conversations.where("turn % 4 <> 3").select(F.col("conv_id").alias("document"), F.col("turn").alias("unit"), F.col("role").alias("unit_type"))
    return browse.first_of_each(u, "document", [F.col("unit")], 2)


@query("b08_segment_browse", "SELECT doc_id, n_chars, count(*) OVER () AS total FROM documents WHERE source IN ('src1', 'src3') AND n_chars > 500 ORDER BY n_chars DESC, doc_id LIMIT 50 OFFSET 20")
def segment_browse(t):
    """A page of the segments of some snapshots that meet the one filter that is given."""
    s = t.documents.withColumnRenamed("source", "snapshot")
    scope = t.documents.where("source IN ('src1', 'src3')").select(F.col("source").alias("snapshot"))
    found = browse.scoped(s, scope, F.col("n_chars") > 500, None)
    return browse.total_and_page(found, [F.desc("n_chars"), F.col("doc_id")], 20, 50).select("doc_id", "n_chars", "total")


@query("b09_unit_browse", "SELECT conv_id, turn, count(*) OVER () AS total FROM conversations WHERE role = 'assistant' AND contains(lower(text), 'en') ORDER BY conv_id, turn LIMIT 40 OFFSET 10")
def unit_browse(t):
    found = browse.scoped(t.conversations.withColumn("snapshot", F.lit("s")), t.conversations.select(F.lit("s").alias("snapshot")), F.col("role") == "assistant", F.contains(F.lower("text"), F.lit("en")))
    return browse.total_and_page(found, [F.col("conv_id"), F.col("turn")], 10, 40).select("conv_id", "turn", "total")


@query("b10_relation_browse", """WITH s AS (SELECT conv_id * 1000 + turn AS segment, text FROM conversations), r AS (SELECT conv_id * 1000 + turn AS src, conv_id * 1000 + turn + 1 AS dst FROM conversations)
SELECT src, dst, a.text[:120] AS src_text, b.text[:120] AS dst_text FROM r LEFT JOIN s a ON a.segment = src LEFT JOIN s b ON b.segment = dst ORDER BY src LIMIT 100 OFFSET 5""")
def relation_browse(t):
    """Relations with the beginnings of their ends' texts; the last turn's next one is gone."""
    key = F.col("conv_id") * 1000 + F.col("turn")
    r = t.conversations.select(key.alias("src"), (key + 1).alias("dst"))
    return browse.page(browse.relations_with_text(r, t.conversations.select(key.alias("segment"), "text")), [F.col("src")], 5, 100).select("src", "dst", "src_text", "dst_text")


@query("b11_run_list", "SELECT o_orderkey AS run, o_orderdate::DATE AS started, count(*) OVER () AS total FROM orders WHERE o_orderstatus = 'F' ORDER BY started DESC, run DESC LIMIT 20")
def run_list(t):
    r = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("run"), F.to_date("o_orderdate").alias("started"))
    return browse.total_and_page(r, [F.desc("started"), F.desc("run")], 0, 20)


@query("b15_artifact_counts", """SELECT doc_id AS document, (SELECT count(*) FROM conversations WHERE conv_id = doc_id) AS segments, (SELECT count(*) FROM labels l WHERE l.doc_id = d.doc_id) AS units, (SELECT count(*) FROM events WHERE user_id = d.doc_id) AS mentions FROM documents d""")
def artifact_counts(t):
    own = lambda df, c: df.select(F.col(c).alias("document"))
    parts = {"segments": own(t.conversations, "conv_id"), "units": own(t.labels, "doc_id"), "mentions": own(t.events, "user_id")}
    return browse.artifact_counts(own(t.documents, "doc_id"), "document", parts)


@query("b16_run_trace", "SELECT user_id AS run, count(*) AS events, count(*) FILTER (WHERE event_type = 'error') AS errors, count(DISTINCT event_type) AS stages, round(sum(value), 2)::DOUBLE AS spent FROM events GROUP BY 1")
def run_trace(t):
    return t.events.groupBy(F.col("user_id").alias("run")).agg(F.count("*").alias("events"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_distinct("event_type").alias("stages"), F.round(F.sum("value"), 2).alias("spent"))


@query("b17_builds_with_release", """WITH r AS (SELECT o_orderkey AS build, o_orderpriority AS channel FROM orders WHERE o_orderkey % 7 = 0)
SELECT o_orderkey AS build, o_custkey AS base, channel FROM orders LEFT JOIN r ON build = o_orderkey QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 3""")
def builds_with_release(t):
    """Each base's last three builds and the channel in which one is active."""
    b = t.orders.select(F.col("o_custkey").alias("base"), F.col("o_orderkey").alias("build"), "o_orderdate")
    last = browse.first_of_each(b, "base", [F.desc("o_orderdate"), F.desc("build")], 3)
    active = t.orders.where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("build"), F.col("o_orderpriority").alias("channel"))
    return last.join(active, "build", "left").select("build", "base", "channel")


@query("b19_run_history", "SELECT o_custkey AS base, o_orderkey AS run, count(*) OVER (PARTITION BY o_custkey) AS total FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) <= 5")
def run_history(t):
    r = t.orders.select(F.col("o_custkey").alias("base"), F.col("o_orderkey").alias("run"), "o_orderdate")
    return browse.first_of_each(r, "base", [F.desc("o_orderdate"), F.col("run")], 5).select("base", "run", "total")


@query("b20_latest_knowledge", """WITH s AS (SELECT o_custkey AS document, max(o_orderkey) AS snapshot FROM orders GROUP BY 1)
SELECT document, snapshot, count(l_orderkey) AS segments, count(DISTINCT l_partkey) AS entities, coalesce(round(sum(l_quantity), 2), 0)::DOUBLE AS weight FROM s LEFT JOIN lineitem ON l_orderkey = snapshot GROUP BY ALL""")
def latest_knowledge(t):
    """What the latest snapshot of every document holds."""
    s = browse.latest(t.orders.select(F.col("o_custkey").alias("document"), F.col("o_orderkey").alias("snapshot")), ["document"], [F.col("snapshot")])
    held = t.lineitem.groupBy(F.col("l_orderkey").alias("snapshot")).agg(F.count("*").alias("segments"), F.count_distinct("l_partkey").alias("entities"), F.round(F.sum("l_quantity"), 2).alias("weight"))
    return s.join(held, "snapshot", "left").fillna(0, ["segments", "entities", "weight"]).select("document", "snapshot", "segments", "entities", "weight")


@query("b25_active_links", "SELECT user_id AS document, arg_max(event_id, event_id) AS link FROM events WHERE event_type <> 'error' AND ts + INTERVAL 1 DAY > TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1")
def active_links(t):
    links = t.events.select(F.col("user_id").alias("document"), F.col("event_id").alias("link"), (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("expires_at"), (F.col("event_type") == "error").alias("revoked"), F.col("event_id").alias("created_no"))
    return browse.active_links(links, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))


@query("b31_paradigms", """WITH p AS (SELECT c_custkey AS paradigm, CASE WHEN c_custkey % 3 <> 0 THEN 'd' || c_nationkey END AS domain, CASE WHEN c_custkey % 5 = 0 AND c_nationkey % 4 <> 0 THEN 'published' WHEN c_custkey % 35 = 0 THEN 'published' ELSE 'draft' END AS status, c_custkey % 7 = 0 AS is_default FROM customer),
o AS (SELECT domain, max(paradigm) AS paradigm FROM p WHERE status = 'published' AND domain IS NOT NULL GROUP BY 1)
SELECT 'd' || n_nationkey AS domain, coalesce(paradigm, (SELECT max(paradigm) FROM p WHERE status = 'published' AND is_default)) AS paradigm FROM nation LEFT JOIN o ON domain = 'd' || n_nationkey""")
def paradigms(t):
    k = F.col("c_custkey")
    published = ((k % 5 == 0) & (F.col("c_nationkey") % 4 != 0)) | (k % 35 == 0)
    p = t.customer.select(k.alias("paradigm"), F.when(k % 3 != 0, F.concat(F.lit("d"), "c_nationkey")).alias("domain"), F.when(published, "published").otherwise("draft").alias("status"), (k % 7 == 0).alias("is_default"), k.alias("version"))
    return browse.paradigm_of(t.nation.select(F.concat(F.lit("d"), "n_nationkey").alias("domain")), p)


@query("b34_sources", "SELECT DISTINCT conv_id AS unit_document, url FROM conversations JOIN pages ON page_id = conv_id WHERE turn % 2 = 0")
def sources(t):
    """Where the documents of some units come from, once each."""
    found = t.conversations.where("turn % 2 = 0").select(F.col("conv_id").alias("unit_document")).distinct()
    return found.join(t.pages.select(F.col("page_id").alias("unit_document"), "url"), "unit_document")


@query("a20_quality_counts", "SELECT conv_id % 30 AS build, 'unit' AS kind, role AS name, count(*) AS n FROM conversations GROUP BY ALL UNION ALL SELECT conv_id % 30, 'relation', CASE WHEN turn % 2 = 0 THEN 'causes' ELSE 'elaborates' END, count(*) FROM conversations WHERE turn % 3 <> 0 GROUP BY ALL")
def quality_counts(t):
    u = t.conversations.select((F.col("conv_id") % 30).alias("build"), F.col("role").alias("unit_type"))
    r = t.conversations.select((F.col("conv_id") % 30).alias("build"), F.when(F.col("turn") % 2 == 0, "causes").otherwise("elaborates").alias("type"), F.when(F.col("turn") % 3 != 0, "discourse_llm").otherwise("structure").alias("source"))
    return browse.quality_counts(u, r)


@query("m07_search_text", r"""WITH s AS (SELECT conv_id, turn, text, CASE WHEN turn % 5 = 4 THEN '' WHEN turn % 2 = 0 THEN 'Conversation ' || conv_id || ' > ' || role ELSE substr(text, 1, 5) END AS crumb, [role, substr(text, 3, 4), 'Part ' || turn] AS path, CASE WHEN turn % 3 = 0 THEN 'About ' || role END AS context FROM conversations)
SELECT conv_id, turn, sha256(array_to_string(list_filter([CASE WHEN crumb <> '' AND NOT contains(text, crumb) THEN crumb ELSE array_to_string(list_filter(path, lambda x: x <> '' AND NOT contains(text, x)), ' > ') END, coalesce(context, '')], lambda x: x <> '') || [text], chr(10))) AS h FROM s""")
def search_text(t):
    """Turns as segments whose breadcrumb is absent, new, or already in the text; every third has a context."""
    turn = F.col("turn")
    crumb = F.when(turn % 5 == 4, "").when(turn % 2 == 0, F.concat(F.lit("Conversation "), F.col("conv_id").cast("string"), F.lit(" > "), "role")).otherwise(F.substring("text", 1, 5))
    path = F.array("role", F.substring("text", 3, 4), F.concat(F.lit("Part "), turn.cast("string")))
    s = t.conversations.select(F.col("conv_id").alias("document"), turn.alias("segment_index"), crumb.alias("breadcrumb"), path.alias("section_path"), "text")
    c = t.conversations.where("turn % 3 = 0").select(F.col("conv_id").alias("document"), turn.alias("segment_index"), F.concat(F.lit("About "), "role").alias("context"))
    return units.search_text(s, c).select(F.col("document").alias("conv_id"), F.col("segment_index").alias("turn"), F.sha2("search_text", 256).alias("h"))


@query("o10_group_relations", """WITH f AS (SELECT 'c' || c_custkey AS item, 'n' || c_nationkey AS snapshot FROM customer), r AS (SELECT o_orderkey AS id, 'c' || o_custkey AS src, 'c' || (o_custkey * 7 % 1500) AS dst FROM orders WHERE o_orderstatus = 'P')
SELECT snapshot, count(DISTINCT item) AS "items", sha256(coalesce(string_agg(DISTINCT id::VARCHAR, ',' ORDER BY id::VARCHAR), '')) AS relations FROM f LEFT JOIN r ON item IN (src, dst) GROUP BY snapshot""")
def group_relations(t):
    f = t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("item_id"), F.concat(F.lit("n"), "c_nationkey").alias("snapshot"))
    r = t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("relation_id"), F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("c"), F.col("o_custkey") * 7 % 1500).alias("dst"))
    return assembly.group_relations(f, r).select("snapshot", F.size("item_ids").alias("items"), F.sha2(F.array_join(F.array_sort(F.col("relation_ids").cast("array<string>")), ","), 256).alias("relations"))


@query("x12_duplicate_of", r"""WITH e AS (SELECT DISTINCT p_type AS name FROM part UNION SELECT DISTINCT upper(string_split(p_name, ' ')[1]) FROM part), x AS (SELECT row_number() OVER (ORDER BY name) AS place, name, lower(regexp_replace(name, '\s+', '', 'g')) AS form, ['ex ' || name, length(name)::VARCHAR || ' Z'] AS examples FROM e),
p AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN 'Ex' || p_type WHEN 2 THEN length(p_type) || 'z' ELSE 'unheard' || p_partkey % 9 END AS name FROM part), q AS (SELECT name, lower(regexp_replace(name, '\s+', '', 'g')) AS form FROM p)
SELECT q.name, arg_min(x.name, place) AS duplicate_of FROM q JOIN x ON contains(q.form, x.form) OR contains(x.form, q.form) OR len(list_filter(examples, lambda y: lower(regexp_replace(y, '\s+', '', 'g')) = q.form)) > 0 GROUP BY q.name""")
def duplicate_of(t):
    """Proposed type names against existing ones with examples."""
    from pyspark.sql import Window

    e = t.part.select(F.col("p_type").alias("name")).union(t.part.select(F.upper(F.split("p_name", " ")[0]))).distinct()
    x = e.select(F.row_number().over(Window.orderBy("name")).alias("place"), "name", F.array(F.concat(F.lit("ex "), "name"), F.concat(F.length("name").cast("string"), F.lit(" Z"))).alias("examples"))  # a few types
    k = F.col("p_partkey") % 4
    p = t.part.select(F.when(k == 0, F.col("p_name")).when(k == 1, F.concat(F.lit("Ex"), "p_type")).when(k == 2, F.concat(F.length("p_type").cast("string"), F.lit("z"))).otherwise(F.concat(F.lit("unheard"), (F.col("p_partkey") % 9).cast("string"))).alias("name")).distinct()
    return ontology.duplicate_types(p, x)


@query("s01_ingest_summary", """WITH f AS (SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'a/b.MD' WHEN 1 THEN 'c.txt' WHEN 2 THEN 'x.html' WHEN 3 THEN 'm.chm' WHEN 4 THEN 'p.pdf' WHEN 5 THEN 'q/.DS_Store' WHEN 6 THEN 'data.xyz' ELSE 'noext' END AS path, page_id % 11 = 0 AS bad FROM pages), k AS (SELECT *, page_id % 8 < 5 AS known FROM f)
SELECT count(*) FILTER (WHERE known) AS discovered, count(*) FILTER (WHERE known AND NOT bad) AS parsed, 0::BIGINT AS unparsed, count(*) FILTER (WHERE known AND NOT bad AND path = 'm.chm') AS archives, count(*) FILTER (WHERE known AND NOT bad AND path = 'p.pdf') AS pdfs, count(*) FILTER (WHERE NOT known) AS skipped, count(*) FILTER (WHERE known AND bad) AS failed FROM k""")
def ingest_summary(t):
    names = ("a/b.MD", "c.txt", "x.html", "m.chm", "p.pdf", "q/.DS_Store", "data.xyz", "noext")
    path = F.element_at(F.array(*map(F.lit, names)), (F.col("page_id") % 8 + 1).cast("int"))
    return html.ingest_summary(t.pages.select(path.alias("path"), F.when(F.col("page_id") % 11 == 0, "unreadable").alias("error")))
