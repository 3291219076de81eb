"""Queries for segmentation, units, entities, assembly and versioned state."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import assembly, containment, discourse, graph, retrieval, segment, state, units
from ..operators.relational import bounded
from ..sources import html, records
from ..streaming import ingest as streaming

TOK = "regexp_extract_all(lower(text), '[一-鿿]|[0-9A-Za-zÀ-ÖØ-öø-ÿ]+')"


def _segments(t):
    d = t.documents.select(F.col("doc_id").cast("string").alias("document"), F.concat(F.lit("Document "), "doc_id").alias("title"), "text")
    return segment.segment_documents(d)


@query("p06_token_windows", f"""SELECT doc_id, w.i::BIGINT AS "window", len(list_slice(t, 1 + 270 * w.i, 300 + 270 * w.i)) AS size, t[1 + 270 * w.i] AS first_token FROM (SELECT doc_id, {TOK} AS t FROM documents), LATERAL (SELECT unnest(range((len(t) - 1) // 270 + 1)) AS i) w WHERE len(t) > 0""")
def windows(t):
    d = segment.token_windows(t.documents.select(F.col("doc_id").alias("document"), "text"))
    return d.select(F.col("document").alias("doc_id"), "window", F.size("tokens").alias("size"), F.col("tokens")[0].alias("first_token"))


@query("p10_clean", r"SELECT page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '!\[[^\]]*\]\([^)]*\)', '', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '\*\*|__', '', 'g'), '(?i)<br\s*/?>', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'))) AS h FROM pages")
def clean(t):
    return t.pages.select("page_id", F.sha2(segment.clean(F.col("html")), 256).alias("h"))


@query("p15_breadcrumb", r"SELECT page_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' > ') AS breadcrumb FROM (SELECT page_id, ['site'] || list_filter(string_split(regexp_extract(url, '^https?://[^/]+/([^?]*)', 1), '/'), lambda x: x <> '') AS l FROM pages)")
def crumbs(t):
    path = F.split(F.regexp_extract("url", r"^https?://[^/]+/([^?]*)", 1), "/")
    return t.pages.select("page_id", segment.breadcrumb(F.lit("site"), path).alias("breadcrumb"))


@query("p11_segments")
def segments(t):
    """All segments of all documents after merging, absorbing, lead-in and splitting."""
    return _segments(t).select("document", "segment_index", "block_type", "token_count", "line_start", "line_end", "structure", "breadcrumb", F.sha2("text", 256).alias("text_hash"))


@query("p17_reindex", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations WHERE role <> 'system'")
def reindex(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return t.conversations.where("role <> 'system'").select("conv_id", "turn", (F.row_number().over(w) - 1).alias("i"))


@query("m07_raw_units")
def raw_units(t):
    u = units.raw_text(_segments(t))
    return u.select("document", "segment_index", "unit_type", "title", "weight", F.sha2("text", 256).alias("text_hash"))


@query("m08_entity_cards")
def cards(t):
    """Cards of the addresses in each document's lines."""
    d = t.documents.select(F.col("doc_id").cast("string").alias("document"), F.posexplode(F.split("text", "\n")).alias("segment_index", "line"))
    found = F.regexp_extract_all("line", F.lit(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"), 0)
    m = d.select("document", "segment_index", F.posexplode(found).alias("position", "name")).withColumn("type", F.lit("address"))
    return units.entity_cards(m).select("document", "segment_index", "title", "weight")


@query("m09_questions", "SELECT conv_id, turn, trim(regexp_replace(text, '^Q[0-9]+[:：.]\\s*', '')) AS question FROM conversations WHERE role = 'user' AND length(trim(text)) >= 15 AND length(text) // 4 >= 50")
def questions(t):
    """User turns as generated questions of their turn."""
    c = t.conversations.where("role = 'user'").select(F.col("conv_id").alias("document"), F.col("turn").alias("segment_index"), F.lit("paragraph").alias("block_type"), F.lit("").alias("breadcrumb"), "text", F.floor(F.length("text") / 4).alias("token_count"))
    g = c.select("document", "segment_index", F.array("text").alias("questions"))
    return units.questions(c.where(F.length(F.trim("text")) >= 15), g).select(F.col("document").alias("conv_id"), F.col("segment_index").alias("turn"), F.col("text").alias("question"))


@query("m10_table_rows", "SELECT n_regionkey::VARCHAR AS document, 'n_nationkey为' || n_nationkey || '，n_name为' || n_name || '。' AS text FROM nation")
def table_rows(t):
    """A region's nations as one pipe table, and its row units."""
    rows = F.array_sort(F.collect_list(F.concat_ws(" | ", F.col("n_nationkey").cast("string"), "n_name")))
    head = F.array(F.lit("n_nationkey | n_name"), F.lit("--- | ---"))
    table = F.array_join(F.transform(F.concat(head, rows), lambda x: F.concat(F.lit("| "), x, F.lit(" |"))), "\n")
    d = t.nation.groupBy(F.col("n_regionkey").cast("string").alias("document")).agg(table.alias("text"))
    return units.table_rows(d.select("document", F.lit(0).alias("segment_index"), F.lit("table").alias("block_type"), F.lit("").alias("breadcrumb"), "text")).select("document", "text")


@query("m10_part_rows", "SELECT p_brand AS document, '行' || row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey::VARCHAR || ' | ' || p_name) || ': ' || p_partkey || '、' || p_name AS title, 'p_partkey为' || p_partkey || '，p_name为' || p_name || '。' AS text FROM part")
def part_rows(t):
    """A brand's parts as one pipe table, and its row units."""
    rows = F.array_sort(F.collect_list(F.concat_ws(" | ", F.col("p_partkey").cast("string"), "p_name")))
    head = F.array(F.lit("p_partkey | p_name"), F.lit("--- | ---"))
    table = F.array_join(F.transform(F.concat(head, rows), lambda x: F.concat(F.lit("| "), x, F.lit(" |"))), "\n")
    d = t.part.groupBy(F.col("p_brand").alias("document")).agg(table.alias("text"))
    return units.table_rows(d.select("document", F.lit(0).alias("segment_index"), F.lit("table").alias("block_type"), F.lit("").alias("breadcrumb"), "text")).select("document", "title", "text")


@query("s10_section_search", """SELECT doc_id, score FROM (SELECT doc_id, sum(1000 * s + least(h, 50))::BIGINT AS score, count(*) FILTER (WHERE s > 0 OR h > 0) AS met FROM (SELECT doc_id, (length(source) - length(replace(lower(source), w, ''))) // length(w) AS s, (length(lower(text)) - length(replace(lower(text), w, ''))) // length(w) AS h FROM documents, (VALUES ('s'), ('1')) v(w)) GROUP BY doc_id) WHERE met = 2 ORDER BY score DESC, doc_id LIMIT 10""")
def section_search(t):
    d = t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("title"), "text")
    return records.search_sections(d, ["S", "1"]).select(F.col("id").alias("doc_id"), "score")


@query("s15_query_log", """WITH r AS (SELECT lang, doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS k FROM documents)
SELECT lang, '[' || string_agg('{"unit_id":' || doc_id || ',"score":' || n_chars || '.0}', ',' ORDER BY k) || ']' AS items FROM r WHERE k <= 5 GROUP BY lang""")
def query_log(t):
    d = t.documents.select(F.col("lang").alias("query_id"), F.col("doc_id").alias("unit_id"), F.col("n_chars").cast("double").alias("score"))
    return records.compact_log(retrieval.top_per_query(d, 5)).select(F.col("query_id").alias("lang"), "items")


@query("st1_stream_ingest", "SELECT doc_id, len(string_split(text, chr(10))) AS n_lines FROM documents")
def stream_ingest(t):
    """The documents' files as a stream that ends when all are in."""
    at = f"{streaming.shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"
    lines = lambda d: d.select("doc_id", F.size(F.split("text", "\n")).cast("bigint").alias("n_lines"))
    return streaming.ingest(t.spark, f"{t.folder}/documents.parque[t]", t.documents.schema, lines, f"{at}/out", f"{at}/state")


@query("st5_hourly_failures", "SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def hourly(t):
    return streaming.hourly_counts(t.events, "ts", "event_type").withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query("st5_rolling_failures", "SELECT until, count(*) AS failures FROM (SELECT time_bucket(INTERVAL 5 MINUTE, ts) + unnest(range(1, 13)) * INTERVAL 5 MINUTE AS until FROM events WHERE event_type = 'error') GROUP BY until")
def rolling(t):
    return streaming.rolling_failures(t.events, "ts", F.col("event_type") == "error").withColumn("until", F.col("until").cast("timestamp_ntz"))


@query("st4_expired_leases", "SELECT event_id FROM events WHERE event_type = 'error' AND ts + INTERVAL 5 MINUTE <= TIMESTAMP '2024-01-10 00:00:00'")
def leases(t):
    q = t.events.select("event_id", F.when(F.col("event_type") == "error", "running").otherwise("done").alias("status"), (F.col("ts") + F.expr("INTERVAL 5 MINUTES")).alias("lease_expires_at"))
    return streaming.expired(q, F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")).select("event_id")


@query("s04_html_markdown")
def pages(t):
    return t.pages.select("page_id", html.document_type(F.col("url")).alias("type"), F.length(html.markdown("html")).alias("size"), F.sha2(html.markdown("html"), 256).alias("h"))


@query("s01_type_summary", "SELECT coalesce(CASE lower(regexp_extract(url, '\\.([A-Za-z0-9]+)(?:[?#].*)?$', 1)) WHEN 'html' THEN 'html' WHEN 'htm' THEN 'html' WHEN 'md' THEN 'markdown' WHEN 'txt' THEN 'text' WHEN 'pdf' THEN 'pdf' WHEN 'docx' THEN 'docx' WHEN 'json' THEN 'json' WHEN 'jsonl' THEN 'jsonl' END, 'skipped') AS type, count(*) AS files FROM pages GROUP BY 1")
def type_summary(t):
    return t.pages.groupBy(F.coalesce(html.document_type(F.col("url")), F.lit("skipped")).alias("type")).agg(F.count("*").alias("files"))


@query("m03_resolution", "SELECT event_id, CASE lower(trim(event_type)) WHEN 'click' THEN 'View' WHEN 'view' THEN 'View' WHEN 'purchase' THEN 'Order' ELSE event_type END AS canonical, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'auto' ELSE 'pending' END AS status FROM events")
def resolution(t):
    a = t.spark.createDataFrame([("click", "View"), ("purchase", "Order")], "alias string, canonical string")
    return graph.resolve(t.events.select("event_id", F.col("event_type").alias("name")), a).select("event_id", "canonical", "status")


@query("m04_relation_candidates", """WITH m AS (SELECT DISTINCT l_orderkey AS s, p_brand AS e, p_type AS ty FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT a.ty AS head_type, b.ty AS tail_type, r.rel AS relation_type, count(*) AS n FROM m a JOIN m b ON a.s = b.s AND a.e <> b.e LEFT JOIN (VALUES ('uses', 'ECONOMY', '*'), ('part_of', 'STANDARD', 'PROMO')) r(rel, h, t) ON (r.h = '*' OR r.h = a.ty) AND (r.t = '*' OR r.t = b.ty) GROUP BY ALL""")
def candidates(t):
    m = t.lineitem.select(F.col("l_orderkey").alias("segment"), "l_partkey").join(t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("entity"), F.col("p_type").alias("type")), "l_partkey")
    rules = t.spark.createDataFrame([("uses", "ECONOMY", "*"), ("part_of", "STANDARD", "PROMO")], "relation_type string, head_type string, tail_type string")
    return graph.relation_candidates(m, rules).groupBy("head_type", "tail_type", "relation_type").agg(F.count("*").alias("n"))


#: Labels in turn, one of them unknown, so that every rule for nuclei occurs, from either end.
LABELS = (*discourse.NUCLEUS, "unknown")
LABELLED = f"""r AS (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next, list_extract({list(LABELS)}, ((conv_id * 5 + turn) % {len(LABELS)} + 1)::INT) AS type, (length(text) % 100) / 100.0::DOUBLE AS c FROM conversations),
s AS (SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN turn ELSE next END AS src, CASE WHEN conv_id % 2 = 0 THEN next ELSE turn END AS dst, type, c FROM r WHERE next IS NOT NULL AND type <> 'unknown' AND c >= 0.5)"""


@query("m05_discourse", f"WITH {LABELLED} SELECT conv_id, src, dst, type, max(c) AS confidence, max(abs(src - dst))::BIGINT AS distance FROM s GROUP BY ALL")
def relations(t):
    return _relations(t).select(F.col("document").alias("conv_id"), "src", "dst", "type", "confidence", "distance")


def _relations(t):
    """Each turn and the next, named from either end."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    kind = F.element_at(F.array(*map(F.lit, LABELS)), ((F.col("conv_id") * 5 + F.col("turn")) % len(LABELS) + 1).cast("int"))
    r = t.conversations.select(F.col("conv_id").alias("document"), "turn", F.lead("turn").over(w).alias("next"), kind.alias("type"), ((F.length("text") % 100) / F.lit(100.0)).alias("confidence")).where("next IS NOT NULL")
    even = F.col("document") % 2 == 0
    return discourse.clean_relations(r.select("document", F.when(even, F.col("turn")).otherwise(F.col("next")).alias("src"), F.when(even, F.col("next")).otherwise(F.col("turn")).alias("dst"), "type", "confidence"))


@query("m06_roles", f"""WITH {LABELLED}, k AS (SELECT *, type IN ('summarizes', 'sequences', 'contrasts_with', 'parallels') AS two, type IN ('elaborates', 'exemplifies', 'evidences', 'justifies', 'purposes', 'results_in') AS earlier FROM s),
e AS (SELECT conv_id, least(src, dst) AS turn, two OR earlier AS nucleus FROM k UNION ALL SELECT conv_id, greatest(src, dst), two OR NOT earlier FROM k), b AS (SELECT conv_id, turn, bool_or(nucleus) AS nucleus FROM e GROUP BY ALL)
SELECT c.conv_id, c.turn, CASE WHEN b.nucleus IS NULL THEN 'standalone' WHEN b.nucleus THEN 'nucleus' ELSE 'satellite' END AS role FROM conversations c LEFT JOIN b ON c.conv_id = b.conv_id AND c.turn = b.turn""")
def roles(t):
    s = t.conversations.select(F.col("conv_id").alias("document"), F.col("turn").alias("segment"))
    return discourse.roles(s, _relations(t)).select(F.col("document").alias("conv_id"), F.col("segment").alias("turn"), "role")


EDGES = "e AS (SELECT 'c' || min(o_custkey) AS head, 's' || l_suppkey AS tail, count(*) / 40.0::DOUBLE AS confidence FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_suppkey, o_custkey HAVING count(*) >= 3)"


@query("r09_graph_recall", f"""WITH {EDGES}, b AS (SELECT head AS node, tail AS other, least(1.0, confidence) AS c FROM e UNION ALL SELECT tail, head, least(1.0, confidence) FROM e), s AS (SELECT min(tail) AS seed FROM e),
h1 AS (SELECT seed, other AS node, 1 AS hop, c FROM s JOIN b ON b.node = seed), h2 AS (SELECT h1.seed, b.other, 2, h1.c * b.c FROM h1 JOIN b ON h1.node = b.node WHERE b.other <> h1.seed AND b.other <> h1.node)
SELECT seed, node, min(hop)::BIGINT AS hop, round(max(c), 9) AS confidence FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY ALL""")
def graph_recall(t):
    d = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey").join(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey").groupBy("l_suppkey", "o_custkey").agg(F.count("*").alias("n")).where("n >= 3")
    e = d.select(F.concat(F.lit("c"), "o_custkey").alias("head"), F.concat(F.lit("s"), "l_suppkey").alias("tail"), F.least(F.lit(1.0), F.col("n") / 40.0).alias("confidence"))
    r = graph.recall(e.agg(F.min("tail").alias("seed")), e, 2, 0.0)
    return r.select("seed", "node", "hop", F.round("confidence", 9).alias("confidence"))


OLD = "old AS (SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN sha256(text || 'x') ELSE sha256(text) END AS hash FROM documents WHERE doc_id % 5 <> 0)"


@query("d02_classify", f"""WITH {OLD}, new AS (SELECT doc_id, sha256(text) AS hash FROM documents WHERE doc_id % 5 <> 2)
SELECT doc_id, CASE WHEN o.hash IS NULL THEN 'NEW' WHEN n.hash IS NULL THEN 'REMOVE' WHEN o.hash = n.hash THEN 'SKIP' ELSE 'UPDATE' END AS action FROM old o FULL JOIN new n USING (doc_id)""")
def classify(t):
    d = t.documents.select(F.col("doc_id").alias("document"), F.sha2("text", 256).alias("hash"), "text")
    old = d.where("document % 5 <> 0").withColumn("hash", F.when(F.col("document") % 5 == 1, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.col("hash")))
    return state.classify(old.drop("text"), d.where("document % 5 <> 2").drop("text")).select(F.col("document").alias("doc_id"), "action")


@query("d03_lifecycle", """WITH d AS (SELECT doc_id, sha256(text) AS hash, sha256(text || 'x') AS other FROM documents), a AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN hash ELSE other END AS hash FROM d WHERE doc_id % 4 <> 3), h AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN hash ELSE other END AS hash FROM d)
SELECT d.doc_id, CASE WHEN a.hash = d.hash THEN 'SKIP' WHEN EXISTS (SELECT 1 FROM h WHERE h.doc_id = d.doc_id AND h.hash = d.hash) THEN 'RESTORE' WHEN a.hash IS NOT NULL THEN 'UPDATE' ELSE 'NEW' END AS action FROM d LEFT JOIN a ON a.doc_id = d.doc_id""")
def lifecycle(t):
    d = t.documents.select(F.col("doc_id").alias("document"), F.sha2("text", 256).alias("hash"), F.sha2(F.concat("text", F.lit("x")), 256).alias("other"))
    pick = lambda same: F.when(same, F.col("hash")).otherwise(F.col("other")).alias("hash")
    active = d.where("document % 4 <> 3").select("document", pick(F.col("document") % 2 == 0))
    return state.lifecycle(d.select("document", "hash"), active, d.select("document", pick(F.col("document") % 3 == 0))).select(F.col("document").alias("doc_id"), "action")


@query("d05_assemble", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'new' ELSE 'old' END AS snapshot FROM orders")
def assemble(t):
    p = t.orders.select(F.col("o_orderkey").alias("document"), F.lit("old").alias("snapshot"), F.lit("active").alias("status"))
    n = t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("document"), F.lit("new").alias("snapshot"), F.lit("active").alias("status"))
    return state.assemble_build(p, n).select(F.col("document").alias("o_orderkey"), "snapshot")


@query("d06_build_problems", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def problems(t):
    s = t.orders.select(F.col("o_orderkey").alias("snapshot"), F.when(F.col("o_orderstatus") == "F", "removed").otherwise("active").alias("status"))
    return state.build_problems(s, t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("snapshot"))).select(F.col("snapshot").alias("o_orderkey"))


@query("d08_withdraw", "SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN 'removed' ELSE 'active' END AS status FROM orders")
def withdraw(t):
    s = t.orders.select("o_orderkey", F.col("o_custkey").alias("document"), F.lit("active").alias("status"))
    return state.withdraw(s, t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("document"))).select("o_orderkey", "status")


@query("o02_latest_selection", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1 AND o_orderstatus <> 'F'")
def latest_selection(t):
    b = t.orders.select(F.col("o_custkey").alias("document"), F.col("o_orderkey").alias("build_no"), F.when(F.col("o_orderstatus") == "F", "removed").otherwise("active").alias("status"))
    return state.latest_selections(b).select(F.col("document").alias("o_custkey"), F.col("build_no").alias("o_orderkey"))


#: Snapshots of contents: an active one and an old one for some, each of this workflow or another, complete or not.
SNAPSHOTS = """s AS (SELECT 'h' || doc_id // 2 AS hash, CASE WHEN n_chars % 3 = 0 THEN 'other' ELSE 'w' END AS workflow, doc_id % 2 = 0 AS active, n_chars % 5 <> 0 AS complete FROM documents WHERE n_chars % 7 < 4),
r AS (SELECT 'h' || doc_id // 2 AS hash, CASE WHEN n_chars % 2 = 0 THEN 'w' ELSE 'other' END AS workflow FROM documents WHERE doc_id % 11 = 0)"""


@query("d04_preflight", f"""WITH {SNAPSHOTS}, d AS (SELECT doc_id, 'h' || doc_id AS hash FROM documents), c AS (SELECT doc_id, CASE
WHEN EXISTS (SELECT 1 FROM s WHERE s.hash = d.hash AND active AND complete AND workflow = 'w') THEN 'REUSED'
WHEN EXISTS (SELECT 1 FROM r WHERE r.hash = d.hash AND workflow = 'w') THEN 'IN_PROGRESS'
WHEN EXISTS (SELECT 1 FROM s WHERE s.hash = d.hash AND NOT active AND complete AND workflow = 'w') THEN CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.hash = d.hash AND active) THEN 'RESTORABLE_CONFLICT' ELSE 'RESTORABLE' END
WHEN EXISTS (SELECT 1 FROM s WHERE s.hash = d.hash AND active) THEN 'WORKFLOW_CONFLICT' WHEN EXISTS (SELECT 1 FROM s WHERE s.hash = d.hash) THEN 'HISTORY_UNAVAILABLE' ELSE 'NEW' END AS classification FROM d)
SELECT doc_id, classification, CASE classification WHEN 'IN_PROGRESS' THEN 'JOINED_EXISTING' WHEN 'RESTORABLE' THEN 'RESTORED' WHEN 'RESTORABLE_CONFLICT' THEN 'KEPT_CURRENT' WHEN 'WORKFLOW_CONFLICT' THEN 'KEPT_CURRENT' WHEN 'HISTORY_UNAVAILABLE' THEN 'REMINED' ELSE classification END AS default_action FROM c""")
def preflight(t):
    d = t.documents.select(F.col("doc_id").alias("document"), F.concat(F.lit("h"), "doc_id").alias("hash"))
    h = F.concat(F.lit("h"), F.floor(F.col("doc_id") / 2)).alias("hash")
    s = t.documents.where("n_chars % 7 < 4").select(h, F.when(F.col("n_chars") % 3 == 0, "other").otherwise("w").alias("workflow"), (F.col("doc_id") % 2 == 0).alias("active"), (F.col("n_chars") % 5 != 0).alias("complete"))
    r = t.documents.where("doc_id % 11 = 0").select(h, F.when(F.col("n_chars") % 2 == 0, "w").otherwise("other").alias("workflow"))
    return state.preflight(d, s, r, "w").withColumnRenamed("document", "doc_id")


@query("o04_items", """WITH e AS (SELECT lang AS q, doc_id AS i, 1.0 / (1 + n_chars % 50) AS s, 0 AS o FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT lang, doc_id, 0.5, 1 FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT lang, doc_id, 0.25, 2 FROM documents),
b AS (SELECT *, row_number() OVER (PARTITION BY q, i ORDER BY o) AS r FROM e), d AS (SELECT *, row_number() OVER (PARTITION BY q, o = 0 ORDER BY o, s DESC, i) AS k FROM b WHERE r = 1)
SELECT q AS query_id, i AS item_id, CASE o WHEN 0 THEN 'seed' WHEN 1 THEN 'context' ELSE 'support' END AS role FROM d WHERE k <= CASE WHEN o = 0 THEN 10 ELSE 20 END""")
def pack_items(t):
    d = t.documents.select(F.col("lang").alias("query_id"), F.col("doc_id").alias("item_id"), (1.0 / (1 + F.col("n_chars") % 50)).alias("score"))
    return assembly.items(d.where("item_id % 2 = 0"), d.where("item_id % 3 = 0").withColumn("score", F.lit(0.5)), d.withColumn("score", F.lit(0.25))).select("query_id", "item_id", "role")


@query("o05_sole_document", "SELECT o_custkey, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) END AS o_orderstatus FROM orders GROUP BY o_custkey")
def sole(t):
    return assembly.sole_document(t.orders, "o_custkey", "o_orderstatus")


@query("o09_issues", "SELECT c_custkey, CASE WHEN m IS NULL THEN 'no_result' ELSE 'low_confidence' END AS issue FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS m FROM orders GROUP BY 1) ON c_custkey = o_custkey WHERE m IS NULL OR m < 200000")
def issues(t):
    f = t.orders.select(F.col("o_custkey").alias("query_id"), F.col("o_totalprice").alias("score"))
    return assembly.issues(t.customer.select(F.col("c_custkey").alias("query_id")), f, 200000).select(F.col("query_id").alias("c_custkey"), "issue")


@query("o09_conflicts", """WITH f AS (SELECT conv_id, turn, ['advantage', 'Disadvantage', 'pro', 'con', 'benefit', 'unknown', NULL][(conv_id * 3 + turn * 5) % 7 + 1] AS sr FROM conversations WHERE role = 'user')
SELECT conv_id, array_to_string(list(turn ORDER BY turn) FILTER (WHERE lower(sr) <> 'unknown'), ',') AS turns FROM f GROUP BY conv_id HAVING (bool_or(lower(sr) = 'advantage') AND bool_or(lower(sr) = 'disadvantage')) OR (bool_or(sr = 'pro') AND bool_or(sr = 'con'))""")
def conflicts(t):
    """User turns as seeds with a semantic role."""
    roles = F.array(*[F.lit(r) for r in ("advantage", "Disadvantage", "pro", "con", "benefit", "unknown", None)])
    f = t.conversations.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("item_id"), F.when(F.col("role") == "user", "seed").otherwise("context").alias("role"), F.get(roles, ((F.col("conv_id") * 3 + F.col("turn") * 5) % 7).cast("int")).alias("semantic_role"))
    return assembly.conflicts(f).select(F.col("query_id").alias("conv_id"), F.array_join(F.col("item_ids").cast("array<string>"), ",").alias("turns"))


BIGRAMS = "list_distinct(list_transform(range(1, length({0})), lambda i: substr({0}, i, 2)))"


@query("o11_compression", rf"""WITH i AS (SELECT doc_id, doc_id // 10 AS q, doc_id % 10 < 3 AS seed, text FROM documents),
a AS (SELECT i.*, b.text || ' ' || 'section' AS asked, sum(length(i.text)) OVER w AS size, greatest(200, 7200 // greatest(1, count(*) FILTER (WHERE seed) OVER w)) AS s, greatest(100, 4800 // greatest(1, count(*) FILTER (WHERE NOT seed) OVER w)) AS o
  FROM i LEFT JOIN benchmark b ON item_id = q % 40 WINDOW w AS (PARTITION BY q)),
l AS (SELECT *, s AS most FROM a WHERE seed UNION ALL SELECT *, o FROM a WHERE NOT seed),
p AS (SELECT *, list_filter(list_transform(string_split_regex(regexp_replace(text, '([。！？!?])\s*', '\1' || chr(10), 'g'), '\n+'), lambda x: regexp_replace(x, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')), lambda x: x <> '') AS parts, {BIGRAMS.format('asked')} AS g FROM l),
r AS (SELECT *, list_transform(list_sort(list_transform(parts, lambda x, i: {{'o': -len(list_intersect({BIGRAMS.format('x')}, g)), 'i': i, 'x': x}})), lambda z: {{'used': length(z.x)::BIGINT, 'ids': [z.i]::BIGINT[]}}) AS ranked FROM p),
f AS (SELECT *, list_reduce(ranked, lambda acc, z: CASE WHEN acc.used + z.used + (len(acc.ids) > 0)::BIGINT <= most THEN {{'used': acc.used + z.used + (len(acc.ids) > 0)::BIGINT, 'ids': acc.ids || z.ids}} ELSE acc END, {{'used': 0::BIGINT, 'ids': []::BIGINT[]}}).ids AS ids FROM r)
SELECT doc_id, sha256(CASE WHEN size <= 12000 OR length(text) <= most THEN text WHEN seed OR len(parts) <= 1 OR len(g) = 0 THEN substr(text, 1, most) || '...' WHEN len(ids) > 0 THEN array_to_string(list_transform(list_sort(ids), lambda i: parts[i]), ' ') ELSE substr(parts[ranked[1].ids[1]], 1, most) END) AS h FROM f""")
def compression(t):
    """Packs of ten documents, three of them seeds; each pack's query is a benchmark passage and a keyword."""
    f = t.documents.select(F.floor(F.col("doc_id") / 10).alias("query_id"), F.col("doc_id").alias("item_id"), F.when(F.col("doc_id") % 10 < 3, "seed").otherwise("context").alias("role"), "text")
    asked = f.select("query_id").distinct().withColumn("item", F.col("query_id") % 40)
    q = asked.join(t.benchmark.select(F.col("item_id").alias("item"), "text"), "item", "left").select("query_id", "text", F.array(F.lit("section")).alias("keywords"))
    return assembly.compress(f, q).select(F.col("item_id").alias("doc_id"), F.sha2("text", 256).alias("h"))


@query("e1_quality_checks", "SELECT 'question prefix' AS name, count(*) FILTER (WHERE regexp_matches(text, '^Q[0-9]+[:.]')) AS violations FROM conversations UNION ALL SELECT 'empty text', count(*) FILTER (WHERE trim(text) = '') FROM conversations UNION ALL SELECT 'orphan label', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def quality(t):
    one = lambda df, name, bad: df.agg(F.lit(name).alias("name"), F.count_if(bad).alias("violations"))
    orphans = t.labels.join(t.documents.select("doc_id"), "doc_id", "left_anti")
    return one(t.conversations, "question prefix", F.col("text").rlike(r"^Q[0-9]+[:.]")).unionByName(one(t.conversations, "empty text", F.trim("text") == "")).unionByName(one(orphans, "orphan label", F.lit(True)))


@query("e2_retrieval_eval", """WITH w AS (SELECT doc_id, text FROM documents), hit AS (SELECT item_id, doc_id FROM benchmark b JOIN w ON contains(w.text, b.text)), r AS (SELECT item_id, min(doc_id) AS first FROM hit GROUP BY item_id)
SELECT count(*) AS questions, round(avg(CASE WHEN first IS NOT NULL THEN 1.0 ELSE 0.0 END), 9) AS found FROM benchmark LEFT JOIN r USING (item_id)""")
def retrieval_eval(t):
    """Share of the benchmark passages whose whole text some document holds."""
    p = t.benchmark.select("item_id", F.col("text").alias("passage"))
    hit = containment.holders(p, t.documents.select(F.col("doc_id").alias("unit_id"), "text")).select("item_id").distinct().withColumn("hit", F.lit(1.0))
    return t.benchmark.select("item_id").join(hit, "item_id", "left").agg(F.count("*").alias("questions"), F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 9).alias("found"))
