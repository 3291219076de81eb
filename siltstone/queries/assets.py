"""Queries for sources, sinks, unit kinds, the entity graph and versioned state."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text as T
from ..operators import assembly, graph, relational, state, units
from ..sources import packs, records
from ..streaming import ingest as streaming


@query("s02_decoded", "SELECT doc_id, sha256(text) AS h FROM documents")
def decoded(t):
    return t.documents.select("doc_id", F.sha2(records.declared_text(F.encode("text", "UTF-8")), 256).alias("h"))


@query("s13_sink", "SELECT o_orderstatus AS snapshot, count(*) AS rows, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY 1")
def sink(t):
    """Two appends to one table, read back."""
    folder = f"{streaming.shared_folder(t.spark)}/assets-{uuid.uuid4().hex}"
    rows = t.orders.select(F.col("o_orderstatus").alias("snapshot"), "o_orderkey")
    for part in (0, 1):
        records.append_rows(rows.where(F.col("o_orderkey") % 2 == part), folder, "segments")
    return t.spark.read.parquet(f"{folder}/segments").groupBy("snapshot").agg(F.count("*").alias("rows"), F.sum("o_orderkey").alias("keys"))


@query("s14_export_import", "SELECT r_name, count(*) AS customers FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def export_import(t):
    folder = f"{streaming.shared_folder(t.spark)}/dump-{uuid.uuid4().hex}"
    records.export_tables({"region": t.region, "nation": t.nation, "customer": t.customer}, folder)  # parents first
    d = records.import_tables(t.spark, folder, ["region", "nation", "customer"])
    met = d["region"].join(d["nation"], F.col("n_regionkey") == F.col("r_regionkey")).join(d["customer"], F.col("c_nationkey") == F.col("n_nationkey"))
    return met.groupBy("r_name").agg(F.count("*").alias("customers"))


PACK = r"""{"entity_rules": [{"type": "address", "pattern": "[0-9]{1,3}(?:\\.[0-9]{1,3}){3}"}, {"type": "license", "pattern": "[Ll]icense [A-Za-z]+"}], "semantic_roles": [{"role": "concept"}]}"""


@query("ux7_pack_entities", r"""SELECT doc_id AS id, type, name, count(*) AS hits FROM (SELECT doc_id, 'address' AS type, unnest(regexp_extract_all(text, '[0-9]{1,3}(?:\.[0-9]{1,3}){3}')) AS name FROM documents UNION ALL SELECT doc_id, 'license', unnest(regexp_extract_all(text, '[Ll]icense [A-Za-z]+')) FROM documents) GROUP BY ALL""")
def pack_entities(t):
    return packs.rule_entities(t.documents.select(F.col("doc_id").alias("id"), "text"), packs.load_pack(t.spark, PACK)["entity_rules"])


@query("x38_mime", r"SELECT page_id, CASE lower(regexp_extract(u, '\.([A-Za-z0-9]+)(?:[?#].*)?$', 1)) WHEN 'html' THEN 'text/html' WHEN 'pdf' THEN 'application/pdf' WHEN 'md' THEN 'text/markdown' ELSE 'application/octet-stream' END AS mime FROM (SELECT page_id, url || CASE page_id % 5 WHEN 0 THEN '/a.PDF' WHEN 1 THEN '/b.md?x=1' WHEN 2 THEN '/c.html#top' WHEN 3 THEN '/d.exe' ELSE '' END AS u FROM pages)")
def mime(t):
    k = F.col("page_id") % 5
    end = F.when(k == 0, "/a.PDF").when(k == 1, "/b.md?x=1").when(k == 2, "/c.html#top").when(k == 3, "/d.exe").otherwise("")
    return t.pages.select("page_id", records.mime_type(F.concat("url", end)).alias("mime"))


@query("x15_serving_sentences", r"""SELECT doc_id, len(s) AS n FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([。！？!?' || chr(10) || '])', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(replace(x, chr(10), ' '))), lambda x: x <> '') AS s FROM documents)""")
def serving_sentences(t):
    return t.documents.select("doc_id", F.size(T.sentences(F.col("text"), "。！？!?\n")).alias("n"))


TABLE = "| a | b |\n|---|---|\n| x | y |\n| z |  |"


@query("u08_all_units", """WITH c AS (SELECT conv_id, turn, role, text, turn % 5 = 0 AS tab FROM conversations)
SELECT unit_type, count(*) AS n, sum(weight)::DOUBLE AS weight, sum(length(body)) AS chars FROM (
SELECT 'raw_text' AS unit_type, 1.0 AS weight, 'top' || chr(10) || CASE WHEN tab THEN '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| x | y |' || chr(10) || '| z |  |' ELSE text END AS body FROM c
UNION ALL SELECT 'table_row', 0.8, unnest(['a为x，b为y。', 'a为z。']) FROM c WHERE tab
UNION ALL SELECT 'generated_question', 0.7, trim(text) FROM c WHERE NOT tab AND role = 'user' AND length(text) >= 250
UNION ALL SELECT 'entity_card', 0.5, role || ' (speaker)' FROM (SELECT DISTINCT conv_id, role FROM c)) GROUP BY unit_type""")
def all_units(t):
    """Raw texts, table rows, questions and entity cards of one set of segments, as one table."""
    tab = F.col("turn") % 5 == 0
    s = t.conversations.select(F.col("conv_id").cast("string").alias("document"), F.col("turn").cast("int").alias("segment_index"), F.when(tab, "table").otherwise("paragraph").alias("block_type"), F.lit("top").alias("breadcrumb"), F.when(tab, TABLE).otherwise(F.col("text")).alias("text"), F.floor(F.length("text") / 5).alias("token_count"), "role")
    asked = s.where("block_type = 'paragraph' AND role = 'user'").select("document", "segment_index", F.array("text").alias("questions"))
    m = s.select("document", "segment_index", F.lit(0).alias("position"), F.lit("speaker").alias("type"), F.col("role").alias("name"))
    u = units.all_units(units.raw_text(s), units.table_rows(s), units.questions(s, asked), units.entity_cards(m))
    return u.groupBy("unit_type").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("weight"), F.sum(F.length("text")).alias("chars"))


MENTIONS = "m AS (SELECT DISTINCT l_orderkey AS s, p_brand AS e FROM lineitem JOIN part ON l_partkey = p_partkey)"
NPMI = f"""{MENTIONS}, n AS (SELECT count(DISTINCT s)::DOUBLE AS n FROM m), c AS (SELECT e, count(*) AS c FROM m GROUP BY 1),
b AS (SELECT x.e AS h, y.e AS t, count(*) AS nb FROM m x JOIN m y ON x.s = y.s AND x.e <> y.e GROUP BY ALL),
p AS (SELECT h, t, nb, ln((nb / n) / ((ch.c / n) * (ct.c / n))) / -ln(nb / n) AS npmi FROM b JOIN c ch ON ch.e = h JOIN c ct ON ct.e = t, n)"""


def _mentions(t):
    p = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("entity"))
    return t.lineitem.select(F.col("l_orderkey").alias("segment"), "l_partkey").join(p, "l_partkey").select("segment", "entity", F.lit("brand").alias("type")).distinct()


@query("m12_edges", f"WITH {NPMI} SELECT h AS head, t AS tail, 'with' AS relation_type, nb AS evidence, round(greatest(0, least(1, (npmi + 1) / 2)), 9) AS confidence FROM p WHERE npmi >= -0.01")
def edges(t):
    rules = t.spark.createDataFrame([("with", "*", "brand")], "relation_type string, head_type string, tail_type string")
    return graph.edges(_mentions(t), rules, -0.01).select("head", "tail", "relation_type", "evidence", F.round("confidence", 9).alias("confidence"))


@query("m14_scoped_recount", f"WITH {MENTIONS}, k AS (SELECT * FROM m WHERE s IN (SELECT s FROM m WHERE e = (SELECT min(e) FROM m))), c AS (SELECT e, count(*) AS c FROM k GROUP BY 1) SELECT x.e AS head, y.e AS tail, count(*) AS n_both, round(greatest(-1, least(1, ln((count(*) / 10000.0) / ((ch.c / 10000.0) * (ct.c / 10000.0))) / -ln(count(*) / 10000.0))), 9)::DOUBLE AS npmi FROM k x JOIN k y ON x.s = y.s AND x.e < y.e JOIN c ch ON ch.e = x.e JOIN c ct ON ct.e = y.e GROUP BY x.e, y.e, ch.c, ct.c")
def scoped_recount(t):
    """After a change of one entity: the pairs of its segments alone, over the known number of all segments."""
    m = _mentions(t).select("segment", "entity")
    own = m.join(F.broadcast(m.agg(F.min("entity").alias("entity"))), "entity").select("segment")
    d = graph.cooccurrence(m.join(own, "segment", "left_semi"), 10_000)
    return d.select("head", "tail", "n_both", F.round("npmi", 9).alias("npmi"))


@query("m19_neighbours", "WITH e AS (SELECT DISTINCT 'c' || o_custkey AS head, 'd' || o_orderkey % 97 AS tail FROM orders WHERE o_orderstatus = 'F'), s AS (SELECT min(head) AS n FROM e), r AS (SELECT n FROM s UNION SELECT tail FROM e, s WHERE head = n UNION SELECT head FROM e, s WHERE tail = n) SELECT head, tail FROM e WHERE head IN (SELECT n FROM r) OR tail IN (SELECT n FROM r)")
def neighbours(t):
    e = t.orders.where("o_orderstatus = 'F'").select(F.concat(F.lit("c"), "o_custkey").alias("head"), F.concat(F.lit("d"), F.col("o_orderkey") % 97).alias("tail")).distinct()
    return graph.neighbours(e.agg(F.min("head").alias("seed")), e, 2)


@query("d07_publish", "SELECT o_orderkey::VARCHAR AS build, o_orderpriority AS channel, CASE WHEN o_orderpriority = (SELECT min(o_orderpriority) FROM orders) AND o_orderstatus = 'O' THEN 'retired' ELSE CASE o_orderstatus WHEN 'O' THEN 'active' ELSE 'retired' END END AS status FROM orders UNION ALL SELECT 'next', min(o_orderpriority), 'active' FROM orders")
def publish(t):
    r = t.orders.select(F.col("o_orderkey").cast("string").alias("build"), F.col("o_orderpriority").alias("channel"), F.when(F.col("o_orderstatus") == "O", "active").otherwise("retired").alias("status"), F.lit("1").alias("at"))
    channel = t.orders.agg(F.min("o_orderpriority")).first()[0]
    return state.publish(r, "next", channel, "2").select("build", "channel", "status")


@query("d11_moved_folders", "SELECT page_id, CASE WHEN p = 'site' OR p LIKE 'site/%' THEN 'home' || substr(p, 5) ELSE p END AS path FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'site' WHEN 1 THEN 'site/' || page_id WHEN 2 THEN 'sites/x' ELSE 'other/site' END AS p FROM pages)")
def moved_folders(t):
    k = F.col("page_id") % 4
    p = F.when(k == 0, "site").when(k == 1, F.concat(F.lit("site/"), "page_id")).when(k == 2, "sites/x").otherwise("other/site")
    return state.move_subtree(t.pages.select("page_id", p.alias("path")), "site", "home")


@query("a23_preflight_counts", "SELECT classification, count(*) AS n FROM (SELECT CASE WHEN doc_id % 2 = 0 THEN CASE WHEN n_chars % 3 = 0 THEN 'WORKFLOW_CONFLICT' ELSE 'REUSED' END ELSE 'NEW' END AS classification FROM documents) GROUP BY 1")
def preflight_counts(t):
    d = t.documents.select(F.col("doc_id").alias("document"), F.concat(F.lit("h"), "doc_id").alias("hash"))
    s = t.documents.where("doc_id % 2 = 0").select(F.concat(F.lit("h"), "doc_id").alias("hash"), F.when(F.col("n_chars") % 3 == 0, "other").otherwise("w").alias("workflow"), F.lit(True).alias("active"), F.lit(True).alias("complete"))
    none = s.select("hash", "workflow").where("false")
    return state.preflight(d, s, none, "w").groupBy("classification").agg(F.count("*").alias("n"))


ITEMS = "f AS (SELECT 'p' || p_partkey AS item_id, p_brand AS snapshot FROM part), r AS (SELECT l_orderkey % 5000 AS relation_id, 'p' || min(l_partkey) AS src, 'p' || max(l_partkey) AS dst FROM lineitem GROUP BY 1)"


def _items(t):
    f = t.part.select(F.concat(F.lit("p"), "p_partkey").alias("item_id"), F.col("p_brand").alias("snapshot"))
    r = t.lineitem.groupBy((F.col("l_orderkey") % 5000).alias("relation_id")).agg(F.concat(F.lit("p"), F.min("l_partkey")).alias("src"), F.concat(F.lit("p"), F.max("l_partkey")).alias("dst"))
    return f, r


@query("o08_inner_relations", f"WITH {ITEMS} SELECT relation_id, src, dst FROM r WHERE src IN (SELECT item_id FROM f) AND dst IN (SELECT item_id FROM f)")
def inner_relations(t):
    f, r = _items(t)
    return assembly.inner_relations(r, f).select("relation_id", "src", "dst")


@query("o10_groups", f'WITH {ITEMS} SELECT snapshot, count(DISTINCT item_id) AS "items", count(DISTINCT relation_id) AS relations FROM f LEFT JOIN r ON item_id = src OR item_id = dst GROUP BY snapshot')
def groups(t):
    f, r = _items(t)
    return assembly.groups(f, r)


@query("o11_seed_budget", "SELECT conv_id, turn, least(length(text), greatest(200, (7200 // count(*) OVER (PARTITION BY conv_id))))::BIGINT AS given FROM conversations")
def seed_budget(t):
    f = t.conversations.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("item_id"), "text")
    return assembly.seed_budget(f).select(F.col("query_id").alias("conv_id"), F.col("item_id").alias("turn"), F.col("given").cast("bigint").alias("given"))


@query("w03_keep_best", "SELECT conv_id, role, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY length(text) DESC, turn) AS r FROM conversations WHERE (length(text) % 97) / 97.0 >= 0.01) WHERE r = 1")
def keep_best(t):
    """The best unit of each segment, of those that reach the least score."""
    fine = t.conversations.where((F.length("text") % 97) / 97.0 >= 0.01)
    return relational.best_of(fine, ["conv_id", "role"], [F.length("text"), -F.col("turn")], ["turn"])
