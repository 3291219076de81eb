"""Queries for scope, expansion, ontology review, browsing and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text as T
from ..operators import assembly, browse, ontology, scope, sparse
from ..operators import retrieval as R

TOK = "regexp_extract_all(lower({0}), '[一-鿿]|[0-9A-Za-zÀ-ÖØ-öø-ÿ]+')"
KEY = "conv_id * 1000 + turn"


def _pick(column, *values):
    """values[column % len(values)], as CASE in the SQL."""
    i = F.pmod(column, F.lit(len(values)))
    out = F.lit(None)
    for k, v in reversed(list(enumerate(values))):
        out = F.when(i == k, v).otherwise(out)
    return out


def _case(column, *values):
    return f"CASE ({column}) % {len(values)} " + " ".join(f"WHEN {k} THEN {'NULL' if v is None else repr(v)}" for k, v in enumerate(values)) + " END"


@query("o01_scope", "SELECT channel, CASE WHEN n = 1 THEN m END AS release, CASE WHEN n = 0 THEN 'no_active_release' WHEN n > 1 THEN 'multiple_active_releases' END AS issue FROM (SELECT c_custkey AS channel, count(o_orderkey) AS n, min(o_orderkey) AS m FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' GROUP BY 1)")
def resolve_scope(t):
    r = t.orders.select(F.col("o_custkey").alias("channel"), F.col("o_orderkey").alias("release"), F.when(F.col("o_orderstatus") == "P", "active").otherwise("retired").alias("status"))
    return scope.resolve_scope(t.customer.select(F.col("c_custkey").alias("channel")), r)


@query("j04_active_scope", "SELECT DISTINCT r_name AS channel, r_regionkey::BIGINT AS build, c_custkey AS document, c_nationkey::BIGINT AS snapshot FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE r_name <> 'ASIA' AND c_acctbal > 0")
def active_scope(t):
    releases = t.region.select(F.col("r_name").alias("channel"), F.col("r_regionkey").alias("build"), F.when(F.col("r_name") == "ASIA", "retired").otherwise("active").alias("status"))
    chosen = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("build"), F.col("c_custkey").alias("document"), F.col("c_nationkey").alias("snapshot"), F.when(F.col("c_acctbal") > 0, "active").otherwise("removed").alias("status"))
    return scope.active_scope(releases, t.region.select(F.col("r_regionkey").alias("build")), chosen, t.orders.select(F.col("o_custkey").alias("document")).distinct())


@query("o13_authorize", """WITH req AS (SELECT DISTINCT user_id, event_id % 60 AS base FROM events), b AS (SELECT c_custkey AS base, c_nationkey AS owner, c_acctbal > 5000 AS public FROM customer WHERE c_custkey < 50),
m AS (SELECT event_id % 60 AS base, user_id, min(CASE event_type WHEN 'purchase' THEN 'editor' ELSE 'viewer' END) AS role FROM events WHERE event_type IN ('purchase', 'signup') GROUP BY ALL)
SELECT user_id AS "user", base, CASE WHEN owner = user_id THEN 'owner' WHEN role = 'editor' THEN 'editor' WHEN role IS NOT NULL OR public THEN 'viewer' END AS role, (owner = user_id) IS TRUE OR role IS NOT NULL OR public IS TRUE AS allowed FROM req LEFT JOIN b USING (base) LEFT JOIN m USING (base, user_id)""")
def authorize(t):
    e = t.events.select(F.col("user_id").alias("user"), (F.col("event_id") % 60).alias("base"), "event_type")
    members = e.where(F.col("event_type").isin("purchase", "signup")).groupBy("base", "user").agg(F.min(F.when(F.col("event_type") == "purchase", "editor").otherwise("viewer")).alias("role"))
    bases = t.customer.where("c_custkey < 50").select(F.col("c_custkey").alias("base"), F.col("c_nationkey").alias("owner"), (F.col("c_acctbal") > 5000).alias("public"))
    return scope.authorize(e.select("user", "base").distinct(), bases, members)


@query("j19_hydrate", "SELECT l.doc_id AS unit_id, d.n_chars, d.doc_id IS NOT NULL AS found FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id AND d.lang IN ('en', 'de')")
def hydrate(t):
    details = t.documents.select(F.col("doc_id").alias("unit_id"), "n_chars", F.col("lang").alias("snapshot"))
    wanted = t.documents.where(F.col("lang").isin("en", "de")).select(F.col("lang").alias("snapshot"))
    return scope.hydrate(t.labels.select(F.col("doc_id").alias("unit_id")), details, "unit_id", wanted).select("unit_id", "n_chars", "found")


@query("j01_embedded_units", "SELECT vec_id AS unit_id, lang, len(embedding) AS size FROM embeddings JOIN documents ON vec_id = doc_id WHERE len(embedding) = 64")
def embedded_units(t):
    d = scope.embedded_units(t.embeddings.select(F.col("vec_id").alias("unit_id"), F.col("embedding").alias("v")), t.documents.select(F.col("doc_id").alias("unit_id"), "lang"), 64)
    return d.select("unit_id", "lang", F.size("v").alias("size"))


@query("o12_drill_down", f"""WITH refs AS (SELECT conv_id % 25 AS request, conv_id AS document, turn AS pos FROM conversations WHERE turn % 3 = 0), n AS (SELECT request, count(DISTINCT (document, pos)) AS n FROM refs GROUP BY 1),
near AS (SELECT r.request, c.conv_id AS document, c.turn AS segment_index, max(c.turn = r.pos) AS is_target FROM (SELECT DISTINCT * FROM refs) r JOIN n USING (request) JOIN conversations c ON c.conv_id = r.document AND abs(c.turn - r.pos) <= 1 WHERE n.n <= 7 GROUP BY ALL)
SELECT request, document::VARCHAR AS document, segment_index, is_target, NULL::VARCHAR AS issue FROM near UNION ALL SELECT request, NULL, NULL, NULL, 'too_many_refs' FROM n WHERE n > 7""")
def drill_down(t):
    """References are segments of even conversations and units of odd ones."""
    c = t.conversations.select(F.expr(KEY).alias("k"), F.col("conv_id").alias("document"), F.col("turn").alias("segment_index"))
    kind = F.when(F.col("document") % 2 == 0, "s").otherwise("u")
    refs = c.where("segment_index % 3 = 0").select((F.col("document") % 25).alias("request"), F.concat(kind, "k").alias("ref"))
    named = lambda p: c.select(F.concat(F.lit(p), "k").alias("ref"), "document", "segment_index")
    return scope.drill_down(refs, named("u"), named("s"), 1, 7)


KINDS = ("causes", "elaborates", "next", "parallels", "mentions")
REL = f"""rel AS (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst, {_case('l_linenumber', *KINDS)} AS type FROM lineitem WHERE l_quantity = 1),
b AS (SELECT src AS node, dst AS other, type, CASE type WHEN 'causes' THEN 8 WHEN 'elaborates' THEN 1 WHEN 'next' THEN 13 WHEN 'parallels' THEN 9 ELSE 1000000 END AS p FROM rel UNION ALL SELECT dst, src, type, CASE type WHEN 'causes' THEN 8 WHEN 'elaborates' THEN 1 WHEN 'next' THEN 13 WHEN 'parallels' THEN 9 ELSE 1000000 END FROM rel)"""


@query("r11_expand", f"""WITH {REL}, seeds AS (SELECT p_partkey % 400 AS q, 'p' || p_partkey AS segment FROM part),
m1 AS (SELECT q, other AS segment, segment AS root, type, p FROM seeds JOIN b ON node = segment WHERE (q, other) NOT IN (SELECT q, segment FROM seeds)),
f1 AS (SELECT *, row_number() OVER (PARTITION BY q, segment ORDER BY p, type, root) AS r FROM m1), k1 AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY p, segment) AS place FROM f1 WHERE r = 1),
e1 AS (SELECT q, segment, root, type FROM k1 WHERE place <= 6), seen AS (SELECT q, segment FROM seeds UNION ALL SELECT q, segment FROM e1), used AS (SELECT q, count(*) AS used FROM e1 GROUP BY 1),
m2 AS (SELECT q, other AS segment, root, b.type, p FROM e1 JOIN b ON node = segment WHERE (q, other) NOT IN (SELECT q, segment FROM seen)),
f2 AS (SELECT *, row_number() OVER (PARTITION BY q, segment ORDER BY p, type, root) AS r FROM m2), k2 AS (SELECT f2.*, used + row_number() OVER (PARTITION BY f2.q ORDER BY p, segment) AS place FROM f2 JOIN used USING (q) WHERE r = 1)
SELECT q AS query_id, segment, 1::BIGINT AS depth, type, root FROM e1 UNION ALL SELECT q, segment, 2, type, root FROM k2 WHERE place <= 6""")
def expand(t):
    rel = t.lineitem.where("l_quantity = 1").select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"), _pick(F.col("l_linenumber"), *KINDS).alias("type")).distinct()
    seeds = t.part.select((F.col("p_partkey") % 400).alias("query_id"), F.concat(F.lit("p"), "p_partkey").alias("segment"))
    return scope.expand_segments(seeds, rel, None, 2, 6)


ITEM_KINDS = (*scope.RELATION_ITEMS, "something")


@query("o06_relation_items", f"SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, coalesce(v.score, 0.3)::DOUBLE AS score, coalesce(v.role, 'background') AS role FROM (SELECT *, {_case('l_orderkey + l_linenumber', *ITEM_KINDS)} AS k FROM lineitem) LEFT JOIN (VALUES ('elaborates', 1.5, 'support'), ('conditions', 1.4, 'support'), ('backgrounds', 1.3, 'background'), ('enables', 1.2, 'support'), ('results_in', 1.1, 'support'), ('sequences', 1.0, 'background'), ('contrasts_with', 0.9, 'contrast'), ('causes', 0.8, 'support'), ('parallels', 0.7, 'context'), ('evidences', 1.35, 'support'), ('exemplifies', 1.25, 'support'), ('purposes', 1.15, 'support'), ('justifies', 1.10, 'support'), ('summarizes', 1.05, 'support'), ('concedes', 0.85, 'contrast'), ('section_header_of', 0.6, 'context'), ('same_section', 0.5, 'context'), ('previous', 0.4, 'context'), ('next', 0.4, 'context'), ('same_parent_section', 0.3, 'context')) v(k, score, role) USING (k)")
def relation_items(t):
    score, role = scope.relation_items(_pick(F.col("l_orderkey") + F.col("l_linenumber"), *ITEM_KINDS))
    return t.lineitem.select("l_orderkey", "l_linenumber", score.alias("score"), role.alias("role"))


@query("o07_evidence_role", f"""SELECT conv_id, turn, CASE WHEN r = 'seed' THEN CASE WHEN d <> 'satellite' AND s >= 0.7 THEN 'direct_answer' WHEN s >= 0.4 THEN 'support' ELSE 'background' END
WHEN rel <> '' THEN CASE WHEN rel = 'contrasts_with' THEN 'contrast' WHEN rel IN ('elaborates', 'conditions', 'causes', 'results_in') THEN 'support' ELSE 'background' END
WHEN d = 'satellite' THEN 'background' WHEN s >= 0.4 THEN 'support' ELSE 'background' END AS evidence_role
FROM (SELECT conv_id, turn, {_case('turn', 'seed', 'context', 'support')} AS r, coalesce({_case('conv_id', 'nucleus', 'satellite', 'standalone', None)}, 'standalone') AS d, coalesce({_case('turn + conv_id', '', 'contrasts_with', 'elaborates', 'parallels', None)}, '') AS rel, (length(text) % 100) / 100.0::DOUBLE AS s FROM conversations)""")
def evidence_role(t):
    c = t.conversations.withColumn("s", (F.length("text") % 100) / F.lit(100.0))
    role = assembly.evidence_role(_pick(F.col("turn"), "seed", "context", "support"), F.col("s"), _pick(F.col("conv_id"), "nucleus", "satellite", "standalone", None), _pick(F.col("turn") + F.col("conv_id"), "", "contrasts_with", "elaborates", "parallels", None))
    return c.select("conv_id", "turn", role.alias("evidence_role"))


@query("t07_seed_order", f"SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN turn % 2 = 0 THEN 0 ELSE 1 END, {_case('length(text)', 0, 1, 2)}, length(text) DESC, turn) AS place FROM conversations")
def seed_order(t):
    f = t.conversations.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("item_id"), F.length("text").alias("score"), (F.col("turn") % 2 == 0).alias("navigated"), _pick(F.length("text"), "nucleus", "standalone", "satellite").alias("discourse"))
    return assembly.order_seeds(f).select(F.col("query_id").alias("conv_id"), F.col("item_id").alias("turn"), "place")


@query("o03_source_segments", """WITH c AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 's' || event_id WHEN event_id % 4 = 3 THEN ' ' END AS own, CASE event_id % 4 WHEN 1 THEN '{"raw_segment_ids":["a' || user_id || '","b"]}' WHEN 2 THEN '[]' ELSE '{}' END AS refs, CASE WHEN event_id % 8 = 2 THEN 'segment' ELSE '' END AS kind, '["t' || user_id || '"]' AS target FROM events)
SELECT event_id, unnest(CASE WHEN trim(coalesce(own, '')) <> '' THEN [own] WHEN len(json_extract_string(refs, '$.raw_segment_ids[*]')) > 0 THEN json_extract_string(refs, '$.raw_segment_ids[*]') WHEN kind <> '' THEN json_extract_string(target, '$[*]') ELSE [] END) AS segment_id FROM c""")
def source_segments(t):
    k = F.col("event_id")
    c = t.events.select(F.lit(0).alias("query_id"), k.alias("unit_id"), F.when(k % 4 == 0, F.concat(F.lit("s"), k)).when(k % 4 == 3, " ").alias("source_segment_id"), F.when(k % 4 == 1, F.concat(F.lit('{"raw_segment_ids":["a'), "user_id", F.lit('","b"]}'))).when(k % 4 == 2, "[]").otherwise("{}").alias("source_refs"), F.when(k % 8 == 2, "segment").otherwise("").alias("target_type"), F.concat(F.lit('["t'), "user_id", F.lit('"]')).alias("target_ref"))
    return assembly.source_segments(c).select(F.col("unit_id").alias("event_id"), "segment_id")


@query("m01_enriched", f"""SELECT conv_id, turn, CASE WHEN n < 30 THEN 'note' WHEN r IN ('concept', 'example') THEN r ELSE 'unknown' END AS role, CASE WHEN n < 30 THEN FALSE ELSE s END AS is_substantive
FROM (SELECT conv_id, turn, length(text) // 5 AS n, CASE WHEN turn % 2 = 0 THEN {_case('conv_id', 'concept', 'bogus', '', 'example')} END AS r, CASE WHEN turn % 2 = 0 THEN conv_id % 3 = 0 END AS s FROM conversations)""")
def enriched(t):
    c = t.conversations.withColumn("segment", F.struct("conv_id", "turn"))
    segs = c.select("segment", F.floor(F.length("text") / 5).alias("token_count"), F.lit("unknown").alias("role"))
    res = c.where("turn % 2 = 0").select("segment", _pick(F.col("conv_id"), "concept", "bogus", "", "example").alias("role"), (F.col("conv_id") % 3 == 0).alias("is_substantive"), F.lit(False).alias("is_navigation"))
    return ontology.enriched(segs, res, ("concept", "example")).select("segment.conv_id", "segment.turn", "role", "is_substantive")


FOUND = "f AS (SELECT user_id AS segment, event_id AS position, 'n' || event_id % 20 AS name, event_type AS type, CASE WHEN event_id % 7 <> 0 THEN (event_id % 10) / 10.0::DOUBLE END AS confidence, event_id % 11 = 0 AS out FROM events)"


def _found(t):
    k = F.col("event_id")
    return t.events.select(F.col("user_id").alias("segment"), k.alias("position"), F.concat(F.lit("n"), k % 20).alias("name"), F.col("event_type").alias("type"), F.when(k % 7 != 0, (k % 10) / F.lit(10.0)).alias("confidence"), (k % 11 == 0).alias("out_of_schema"))


@query("m02_typed_entities", f"""WITH {FOUND}, r AS (SELECT *, CASE WHEN out THEN 'llm_out_of_schema' WHEN type NOT IN ('click', 'view') THEN 'off_schema_type' WHEN confidence < 0.5 THEN 'low_confidence' END AS reason FROM f),
k AS (SELECT segment, CASE WHEN reason IS NULL THEN type ELSE '__untyped__' END AS type, name, CASE WHEN reason IS NOT NULL THEN type END AS proposed_type, reason, position FROM r)
SELECT segment, type, name, proposed_type, reason FROM (SELECT *, row_number() OVER (PARTITION BY segment, type, name ORDER BY position) AS n FROM k) WHERE n = 1""")
def typed_entities(t):
    return ontology.typed_entities(_found(t), ("click", "view"))


@query("t09_best_entities", f"WITH {FOUND} SELECT segment, name, position FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY coalesce(confidence, 0) DESC, name) AS r FROM (SELECT segment, name, max(confidence) AS confidence, min(position) AS position FROM f GROUP BY ALL)) WHERE r <= 3")
def best_entities(t):
    d = _found(t).groupBy("segment", "name").agg(F.coalesce(F.max("confidence"), F.lit(0.0)).alias("confidence"), F.min("position").alias("position"))
    return ontology.best_entities(d, 3).select("segment", "name", "position")


@query("a15_entity_counts", "SELECT user_id AS entity, count(*) AS mention_count, count(DISTINCT event_id % 50) AS document_count FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def entity_counts(t):
    m = t.events.select(F.col("user_id").alias("entity"), (F.col("event_id") % 50).alias("document"), F.when(F.col("event_type") == "click", "auto").when(F.col("event_type") == "view", "human").otherwise("pending").alias("status"))
    return ontology.entity_counts(m)


@query("a17_relation_proposals", f"SELECT head_type, tail_type, count(*) AS cooccur, count(DISTINCT (head, tail)) AS n_examples, min(head || '|' || tail) AS first_example FROM (SELECT o_orderpriority AS head, o_orderstatus AS head_type, 'k' || o_custkey % 5 AS tail, {_case('o_custkey', 'a', 'b', '', 'c')} AS tail_type FROM orders) WHERE tail_type <> '' GROUP BY ALL")
def relation_proposals(t):
    p = t.orders.select(F.col("o_orderpriority").alias("head"), F.col("o_orderstatus").alias("head_type"), F.concat(F.lit("k"), F.col("o_custkey") % 5).alias("tail"), _pick(F.col("o_custkey"), "a", "b", "", "c").alias("tail_type"))
    d = ontology.relation_proposals(p)
    return d.select("head_type", "tail_type", "cooccur", F.size("examples").alias("n_examples"), F.concat(F.col("examples")[0]["head"], F.lit("|"), F.col("examples")[0]["tail"]).alias("first_example"))


@query("a18_merge_proposals", """WITH e AS (SELECT event_type AS name, user_id % 10 AS run_document, event_id % 7 AS cooccur, (event_id % 16) / 4.0::DOUBLE AS score, 'e' || user_id % 30 AS x, event_id % 2 AS new FROM events),
n AS (SELECT * FROM e WHERE new = 1 AND run_document < 5), every AS (SELECT * FROM e WHERE new = 0 AND (name, run_document) NOT IN (SELECT name, run_document FROM n) UNION ALL SELECT * FROM n),
x AS (SELECT name, x, row_number() OVER (PARTITION BY name ORDER BY x) AS r FROM (SELECT DISTINCT name, x FROM every))
SELECT name, sum(cooccur)::BIGINT AS cooccur, sum(score) AS score, (SELECT string_agg(x.x, ',' ORDER BY x.x) FROM x WHERE x.name = every.name AND r <= 20) AS examples FROM every GROUP BY name""")
def merge_proposals(t):
    e = t.events.select(F.col("event_type").alias("name"), (F.col("user_id") % 10).alias("run_document"), (F.col("event_id") % 7).alias("cooccur"), ((F.col("event_id") % 16) / F.lit(4.0)).alias("score"), F.array(F.concat(F.lit("e"), F.col("user_id") % 30)).alias("examples"), (F.col("event_id") % 2).alias("new"))
    return ontology.merge_proposals(e.where("new = 0").drop("new"), e.where("new = 1 AND run_document < 5").drop("new")).withColumn("examples", F.array_join("examples", ","))


@query("m15_induced_types", """WITH m AS (SELECT n_name AS type_name, c_custkey, c_custkey % 3 AS d, c_custkey % 11 AS m FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_custkey % 5 < 2), l AS (SELECT least(2, greatest(max(c_custkey % 3), 1)) AS least FROM customer)
SELECT type_name, sum(d)::BIGINT AS df, sum(m)::BIGINT AS support, count(*) AS n_members FROM m, l GROUP BY type_name, least HAVING sum(d) >= least""")
def induced_types(t):
    e = t.customer.select(F.col("c_custkey").alias("entity"), F.col("c_name").alias("name"), (F.col("c_custkey") % 3).alias("document_count"), (F.col("c_custkey") % 11).alias("mention_count"))
    named = t.customer.where("c_custkey % 5 < 2").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    said = F.concat(F.collect_list(F.concat(F.lit("  "), F.upper("c_name"), F.lit(" "))), F.array(F.lit("nobody"), F.min("c_name")))
    p = named.groupBy(F.col("n_name").alias("type_name")).agg(said.alias("members"))
    return ontology.induce_types(e, p).select("type_name", "df", "support", F.size("members").alias("n_members"))


@query("m16_promote", """WITH old AS (SELECT DISTINCT 1 AS version, 'node_type' AS kind, p_type AS name, 'concept' AS layer FROM part UNION ALL SELECT DISTINCT 2, 'node_type', p_brand, 'product' FROM part)
SELECT version::BIGINT AS version, kind, name, layer, 'superseded' AS status FROM old UNION ALL SELECT 3, kind, name, layer, 'active' FROM old WHERE version = 2 UNION ALL SELECT DISTINCT 3, 'node_type', c_mktsegment, 'concept', 'active' FROM customer""")
def promote(t):
    def types(version, column, layer, status):
        return t.part.select(F.lit(version).alias("version"), F.lit("node_type").alias("kind"), F.col(column).alias("name"), F.lit(layer).alias("layer"), F.lit(status).alias("status")).distinct()

    accepted = t.customer.select(F.lit("node_type").alias("kind"), F.col("c_mktsegment").alias("name"), F.lit(None).cast("string").alias("layer")).distinct()
    return ontology.promote(types(1, "p_type", "concept", "superseded").unionByName(types(2, "p_brand", "product", "active")), accepted)


@query("m17_review", """WITH m AS (SELECT event_id, event_type || '-' || user_id % 9 AS text, event_id % 4 AS k, user_id % 12 AS e FROM events)
SELECT event_id AS mention, CASE WHEN k = 0 AND e < 10 THEN 'e' || e WHEN k = 1 THEN 'new:' || CASE WHEN event_id % 8 = 1 THEN 'given' ELSE text END END AS entity, CASE WHEN k = 0 AND e < 10 THEN 'E ' || e WHEN k = 1 THEN CASE WHEN event_id % 8 = 1 THEN 'given' ELSE text END END AS canonical,
CASE WHEN (k = 0 AND e < 10) OR k = 1 THEN 'human' WHEN k = 2 THEN 'rejected' ELSE 'pending' END AS status FROM m""")
def review(t):
    k = F.col("event_id")
    none = F.lit(None).cast("string")
    m = t.events.select(k.alias("mention"), F.concat_ws("-", "event_type", F.col("user_id") % 9).alias("text"), none.alias("entity"), none.alias("canonical"), F.lit("pending").alias("status"))
    d = t.events.where(k % 4 < 3).select(k.alias("mention"), _pick(k, "merge", "new", "reject", None).alias("action"), F.concat(F.lit("e"), F.col("user_id") % 12).alias("entity"), F.when(k % 8 == 1, "given").alias("name"))
    e = t.events.select((F.col("user_id") % 10).alias("i")).distinct().select(F.concat(F.lit("e"), "i").alias("entity"), F.concat(F.lit("E "), "i").alias("canonical"))
    return ontology.review(m, d, e)


@query("m18_merge_entities", """WITH m AS (SELECT CASE WHEN o_custkey % 10 = 3 THEN o_custkey - 1 ELSE o_custkey END AS e, o_orderkey % 100 AS d FROM orders WHERE o_orderstatus IN ('F', 'O'))
SELECT c_custkey AS entity, CASE WHEN c_custkey % 10 = 2 AND c_custkey + 1 IN (SELECT c_custkey FROM customer) THEN (SELECT count(*) FROM m WHERE e = c_custkey) ELSE -1 END AS mention_count, CASE WHEN c_custkey % 10 = 2 AND c_custkey + 1 IN (SELECT c_custkey FROM customer) THEN (SELECT count(DISTINCT d) FROM m WHERE e = c_custkey) ELSE -1 END AS document_count FROM customer WHERE c_custkey % 10 <> 3""")
def merge_entities(t):
    e = t.customer.select(F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("type"), F.col("c_name").alias("name"), F.lit(-1).cast("long").alias("mention_count"), F.lit(-1).cast("long").alias("document_count"))
    m = t.orders.select(F.col("o_orderkey").alias("mention"), F.col("o_custkey").alias("entity"), (F.col("o_orderkey") % 100).alias("document"), F.when(F.col("o_orderstatus") == "F", "auto").when(F.col("o_orderstatus") == "O", "human").otherwise("pending").alias("status"))
    edges = t.orders.select(F.col("o_custkey").alias("head"), (F.col("o_custkey") + 1).alias("tail"))
    merges = t.customer.where("c_custkey % 10 = 3").select(F.col("c_custkey").alias("dropped"), (F.col("c_custkey") - 1).alias("kept"))
    return ontology.merge_entities(e, m, edges, merges)[0].select("entity", "mention_count", "document_count")


@query("m20_suggestions", """WITH m AS (SELECT p_partkey AS mention, lower(CASE WHEN p_partkey % 100 = 0 THEN p_name || ' extra' ELSE substr(p_name, 1, 4) END) AS t, p_brand FROM part)
SELECT mention, entity, place FROM (SELECT mention, p_partkey AS entity, row_number() OVER (PARTITION BY mention ORDER BY p_size DESC, p_partkey) AS place FROM m JOIN part USING (p_brand) WHERE contains(m.t, lower(p_name)) OR contains(lower(p_name), m.t)) WHERE place <= 5""")
def suggestions(t):
    m = t.part.select(F.col("p_partkey").alias("mention"), F.when(F.col("p_partkey") % 100 == 0, F.concat("p_name", F.lit(" extra"))).otherwise(F.substring("p_name", 1, 4)).alias("text"), F.col("p_brand").alias("type"))
    e = t.part.select(F.col("p_partkey").alias("entity"), F.col("p_name").alias("name"), F.col("p_brand").alias("type"), F.col("p_size").alias("mention_count"))
    return ontology.suggest(m, e)


@query("m21_entity_search", "SELECT p_partkey AS entity, p_size::BIGINT AS mention_count FROM part WHERE contains(lower(p_name), 'r') ORDER BY p_size DESC NULLS LAST, p_name, p_partkey LIMIT 25 OFFSET 10")
def entity_search(t):
    e = t.part.select(F.col("p_partkey").alias("entity"), F.col("p_name").alias("name"), F.col("p_size").alias("mention_count"))
    return ontology.search_entities(e, "R", None, 10, 25).select("entity", "mention_count")


@query("r08_linked_entities", "WITH q AS (SELECT DISTINCT c_nationkey AS query_id, CASE WHEN c_custkey % 2 = 0 THEN lower(c_name) ELSE 'a-' || c_custkey END AS form FROM customer) SELECT DISTINCT query_id::BIGINT AS query_id, c_custkey AS entity FROM q JOIN customer ON form = lower(c_name) OR (form = 'a-' || c_custkey AND c_custkey % 3 = 0)")
def linked_entities(t):
    q = t.customer.select(F.col("c_nationkey").alias("query_id"), F.when(F.col("c_custkey") % 2 == 0, F.upper("c_name")).otherwise(F.concat(F.lit("A-"), "c_custkey")).alias("name"))
    return ontology.link_entities(q, t.customer.select(F.col("c_custkey").alias("entity"), F.col("c_name").alias("name")), t.customer.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("entity"), F.concat(F.lit("a-"), "c_custkey").alias("alias")))


@query("j15_entity_units", "SELECT c_nationkey::BIGINT AS query_id, l_orderkey * 10 + l_linenumber AS unit_id, max(c_acctbal) AS score FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def entity_units(t):
    found = t.customer.select(F.col("c_nationkey").alias("query_id"), F.col("c_custkey").alias("entity"), F.col("c_acctbal").alias("score"))
    u = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("unit_id"), F.col("l_orderkey").alias("segment"))
    return ontology.entity_units(found, t.orders.select(F.col("o_custkey").alias("entity"), F.col("o_orderkey").alias("segment")), u)


UNITS = f"""u AS (SELECT {KEY} AS unit_id, {_case('turn', 'generated_question', 'raw_text', 'entity_card')} AS unit_type, CASE WHEN conv_id % 9 = 0 THEN 'Q1: ' ELSE '' END || text AS title, CASE WHEN turn % 7 <> 0 THEN ({KEY})::VARCHAR ELSE '' END AS segment, {_case('turn', '{"task_id":"t"}', '{"x":1}', 'bad', '[1]', '{}')} AS refs, conv_id % 4 = 0 AS nav, 'h' || conv_id % 13 AS hash FROM conversations)"""


def _units(t):
    k = F.expr(KEY)
    u = t.conversations.select(k.alias("unit_id"), _pick(F.col("turn"), "generated_question", "raw_text", "entity_card").alias("unit_type"), F.concat(F.when(F.col("conv_id") % 9 == 0, "Q1: ").otherwise(""), "text").alias("title"), F.when(F.col("turn") % 7 != 0, k.cast("string")).otherwise("").alias("segment"), _pick(F.col("turn"), '{"task_id":"t"}', '{"x":1}', "bad", "[1]", "{}").alias("refs"))
    s = t.conversations.select(k.cast("string").alias("segment"), F.concat(F.lit("h"), F.col("conv_id") % 13).alias("content_hash"), F.when(F.col("conv_id") % 4 == 0, '{"content_assessment":{"is_navigation":true}}').otherwise('{"content_assessment":1}').alias("metadata"))
    return u, s


@query("e1_unit_checks", f"""WITH {UNITS}, q AS (SELECT * FROM u WHERE unit_type = 'generated_question'), c AS (
SELECT 'no_qn_prefix' AS check_id, count(*) FILTER (WHERE regexp_matches(title, '^Q[0-9]+\\s*[:：]')) AS violations FROM q UNION ALL SELECT 'question_source_traceable', count(*) FILTER (WHERE segment = '') FROM q
UNION ALL SELECT 'llm_provenance', count(*) FILTER (WHERE refs = '{{"x":1}}' AND unit_type <> 'entity_card') FROM u UNION ALL SELECT 'golden_regression', count(*) FILTER (WHERE segment <> '' AND hash = 'h5') FROM q
UNION ALL SELECT 'toc_no_questions', count(*) FILTER (WHERE segment <> '' AND nav) FROM q UNION ALL SELECT 'entity_card_not_navigation', count(*) FILTER (WHERE segment <> '' AND nav AND unit_type = 'entity_card') FROM u)
SELECT check_id, violations, violations = 0 AS passed FROM c""")
def unit_checks(t):
    return ontology.quality_checks(*_units(t), "h5")


@query("e2_first_rank", f"""WITH q AS (SELECT item_id, list_distinct(w) AS t, proof FROM (SELECT item_id, {TOK.format('text')} AS w, lower(text) AS proof FROM benchmark)), u AS (SELECT doc_id, n_chars, lower(text) AS text, list_distinct({TOK.format('text')}) AS t FROM documents),
h AS (SELECT item_id, contains(u.text, proof) AS good, row_number() OVER (PARTITION BY item_id ORDER BY n_chars DESC, doc_id) AS rank FROM q JOIN u ON list_has_all(u.t, q.t) WHERE len(q.t) > 0)
SELECT item_id, min(rank) FILTER (WHERE good AND rank <= 10) AS rank FROM q LEFT JOIN h USING (item_id) GROUP BY item_id""")
def first_rank(t):
    """Of each benchmark passage the first rank, among the ten longest documents with all its words, of one that holds it."""
    return _first_rank(t)


def _first_rank(t):
    q = t.benchmark.select("item_id", F.array_distinct(T.tokens(F.col("text"))).alias("t"), F.lower("text").alias("proof"))
    u = t.documents.select(F.col("doc_id").alias("unit_id"), "text", F.col("n_chars").alias("weight"))
    met = sparse.holding_all(q.select(F.col("item_id").alias("query_id"), F.col("t").alias("terms")), u, sparse.tokens).withColumnRenamed("query_id", "item_id")
    top = R.top_per_query(met.join(u.select("unit_id", F.col("weight").alias("score")), "unit_id").withColumnRenamed("item_id", "query_id"), 10)
    placed = R.ranked(top.withColumn("source", F.lit("fts"))).select(F.col("query_id").alias("item_id"), "unit_id", "rank")
    held = placed.join(u.select("unit_id", "text"), "unit_id").join(q.select("item_id", "proof"), "item_id").where(F.contains(F.lower("text"), F.col("proof"))).groupBy("item_id").agg(F.min("rank").alias("rank"))
    return q.select("item_id").join(held, "item_id", "left")


@query("a21_recall_at", f"""WITH q AS (SELECT item_id, list_distinct(w) AS t, proof FROM (SELECT item_id, {TOK.format('text')} AS w, lower(text) AS proof FROM benchmark)), u AS (SELECT doc_id, n_chars, lower(text) AS text, list_distinct({TOK.format('text')}) AS t FROM documents),
h AS (SELECT item_id, contains(u.text, proof) AS good, row_number() OVER (PARTITION BY item_id ORDER BY n_chars DESC, doc_id) AS rank FROM q JOIN u ON list_has_all(u.t, q.t)), f AS (SELECT item_id, min(rank) FILTER (WHERE good AND rank <= 10) AS rank FROM q LEFT JOIN h USING (item_id) GROUP BY item_id)
SELECT count(*) AS questions, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END)::DOUBLE, 9) AS recall_5, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END)::DOUBLE, 9) AS recall_10, count(*) FILTER (WHERE rank IS NULL) AS misses FROM f""")
def recall_at(t):
    d = R.recall_at(_first_rank(t).withColumnRenamed("item_id", "question"))
    return d.select("questions", F.round("recall_5", 9).alias("recall_5"), F.round("recall_10", 9).alias("recall_10"), "misses")


RAW = ('```json\n{"a":1}\n```', '{"a": 1}', "[1,2]", "", "not json", "```\n[1]\n```", None)
EXPECTED = ("json_object", "json_array", "text", "json_object", "xml")


@query("x23_parse_output", "WITH r AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN '```json' || chr(10) || '{\"a\":1}' || chr(10) || '```' WHEN 1 THEN '{\"a\": 1}' WHEN 2 THEN '[1,2]' WHEN 3 THEN '' WHEN 4 THEN 'not json' WHEN 5 THEN '```' || chr(10) || '[1]' || chr(10) || '```' END AS raw, " + _case("event_id", *EXPECTED) + r""" AS want FROM events),
b AS (SELECT *, trim(regexp_replace(regexp_replace(trim(raw), '^```(?:json)?\s*\n?', ''), '\n?```\s*$', '')) AS bare FROM r), k AS (SELECT *, CASE WHEN json_valid(bare) THEN CASE json_type(bare) WHEN 'OBJECT' THEN 'json_object' WHEN 'ARRAY' THEN 'json_array' ELSE 'other' END END AS kind FROM b),
e AS (SELECT *, CASE WHEN want = 'xml' THEN 'unsupported type' WHEN coalesce(raw, '') = '' THEN 'empty' WHEN want = 'text' THEN NULL WHEN kind IS NULL THEN 'no json' WHEN kind <> want THEN 'other type' END AS error FROM k)
SELECT event_id, CASE WHEN error IS NULL THEN 'succeeded' ELSE 'failed' END AS status, error, CASE WHEN error IS NULL THEN CASE WHEN want = 'text' THEN raw ELSE bare END END AS value FROM e""")
def parse_output(t):
    p = ontology.parse_output(_pick(F.col("event_id"), *RAW), _pick(F.col("event_id"), *EXPECTED))
    return t.events.select("event_id", p.alias("p")).select("event_id", "p.*")


REFS = """'[{"type":"' || event_type || '","name":"U' || user_id % 50 || '"},{"type":"k","name":"k' || event_id % 9 || '"}]'"""


def _refs(t):
    return t.events.withColumn("refs", F.concat(F.lit('[{"type":"'), "event_type", F.lit('","name":"U'), F.col("user_id") % 50, F.lit('"},{"type":"k","name":"k'), F.col("event_id") % 9, F.lit('"}]')))


REF = "array<struct<type:string,name:string>>"


@query("f04_contains_entity", f"SELECT event_id FROM (SELECT event_id, {REFS} AS refs FROM events) WHERE json_contains(refs, '{{\"name\":\"U7\"}}') OR json_contains(refs, '{{\"name\":\"k3\"}}')")
def contains_entity(t):
    """Containment of any of several names in an array of JSON objects."""
    return _refs(t).where(F.exists(F.from_json("refs", REF), lambda r: r["name"].isin("U7", "k3"))).select("event_id")


@query("f05_exists_in_array", f"SELECT event_id FROM (SELECT event_id, {REFS} AS refs FROM events) e WHERE EXISTS (SELECT 1 FROM (SELECT unnest(json_extract(e.refs, '$[*]')) AS r) WHERE r->>'$.type' IN ('click', 'error') AND lower(r->>'$.name') IN ('u1', 'u2', 'u3'))")
def exists_in_array(t):
    return _refs(t).where(F.exists(F.from_json("refs", REF), lambda r: r["type"].isin("click", "error") & F.lower(r["name"]).isin("u1", "u2", "u3"))).select("event_id")


@query("f06_section_prefix", r"SELECT page_id FROM pages WHERE lower(trim(split_part(regexp_extract(url, '^https?://[^/]+/([^?]*)', 1), '/', 1))) IN (SELECT lower(split_part(regexp_extract(url, '^https?://[^/]+/([^?]*)', 1), '/', 1)) FROM pages WHERE page_id < 3)")
def section_prefix(t):
    """Pages whose first section is one of those that a search chose (those of the first pages), by a semi-join."""
    path = F.split(F.regexp_extract("url", r"^https?://[^/]+/([^?]*)", 1), "/")
    p = t.pages.select("page_id", assembly.section_prefix(path).alias("prefix"))
    return p.join(p.where("page_id < 3").select("prefix").distinct(), "prefix", "left_semi").select("page_id")


@query("f10_contains_both_ways", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'ar') OR contains('large brushed tin', lower(split_part(p_name, ' ', 1)))")
def contains_both_ways(t):
    return t.part.where(F.contains(F.lower("p_name"), F.lit("ar")) | F.contains(F.lit("large brushed tin"), F.lower(F.split("p_name", " ")[0]))).select("p_partkey")


META = ('{"content_assessment":{"is_navigation":true}}', '{"content_assessment":{"is_navigation":false}}', "{}", "broken", None)


@query("f20_navigation_flags", f"SELECT event_id, coalesce(try_cast(CASE WHEN json_valid(m) THEN m->>'$.content_assessment.is_navigation' END AS BOOLEAN), FALSE) AS navigation FROM (SELECT event_id, {_case('event_id', *META)} AS m FROM events)")
def navigation_flags(t):
    return t.events.select("event_id", ontology.flag(_pick(F.col("event_id"), *META), "is_navigation").alias("navigation"))


@query("x21_json_arrays", f"SELECT event_id, json_array_length(refs)::BIGINT AS n, r->>'$.name' AS name FROM (SELECT event_id, refs, unnest(json_extract(refs, '$[*]')) AS r FROM (SELECT event_id, {REFS} AS refs FROM events))")
def json_arrays(t):
    return _refs(t).select("event_id", F.json_array_length("refs").alias("n"), F.explode(F.from_json("refs", REF)).alias("r")).select("event_id", "n", "r.name")


@query("x18_mention_window", "SELECT doc_id, CASE WHEN p > 0 THEN substr(text, greatest(p - 80, 1), p - greatest(p - 80, 1) + length(lang) + 80) ELSE '' END AS quote FROM (SELECT *, strpos(text, lang) AS p FROM documents)")
def mention_window(t):
    return t.documents.select("doc_id", browse.mention_window(F.col("text"), F.col("lang")).alias("quote"))


@query("x34_weighted_search", f"""WITH f AS (SELECT doc_id, 1.0::DOUBLE AS w, source AS text FROM documents UNION ALL SELECT doc_id, 0.4, lang || ' ' || substr(text, 1, 200) FROM documents UNION ALL SELECT doc_id, 0.2, text FROM documents),
h AS (SELECT doc_id, w, t, count(*) AS n FROM (SELECT doc_id, w, unnest({TOK.format('text')}) AS t FROM f) WHERE t IN ('src3', 'en', 'license', 'version') GROUP BY ALL)
SELECT doc_id AS unit_id, round(score, 9) AS score FROM (SELECT doc_id, sum(least(n, 5) * w / 4.0) AS score FROM h GROUP BY doc_id) ORDER BY round(score, 9) DESC, doc_id LIMIT 50""")
def weighted_search(t):
    q = t.spark.createDataFrame([(0, "src3 en license version")], "query_id long, text string")
    u = t.documents.select(F.col("doc_id").alias("unit_id"), F.col("source").alias("title"), F.concat_ws(" ", "lang", F.substring("text", 1, 200)).alias("search_text"), "text")
    return R.weighted_search(q, u, 50).select("unit_id", "score")


@query("r03_search_terms", f"SELECT conv_id, turn, array_to_string(CASE WHEN len(w) > 0 THEN w ELSE [text] END, ' ') AS words FROM (SELECT *, list_distinct_ordered FROM (SELECT conv_id, turn, text, CASE WHEN turn % 3 = 0 THEN ['alpha', 'beta'] ELSE [] END || CASE WHEN turn % 2 = 0 THEN ['beta', 'gamma', 'delta'] ELSE [] END AS a, list_filter(a, lambda x, i: list_position(a, x) = i) AS list_distinct_ordered, list_filter(a, lambda x, i: list_position(a, x) = i) AS w FROM conversations))")
def search_terms(t):
    none = F.array().cast("array<string>")
    q = t.conversations.select(F.struct("conv_id", "turn").alias("query_id"), "text", F.when(F.col("turn") % 3 == 0, F.array(F.lit("alpha"), F.lit("beta"))).otherwise(none).alias("keywords"), F.when(F.col("turn") % 2 == 0, F.array(F.lit("beta gamma"), F.lit("delta"))).alias("sub_queries"))
    return R.search_terms(q).select("query_id.conv_id", "query_id.turn", F.array_join("words", " ").alias("words"))


@query("r06_dense_units", """WITH p AS (SELECT q.vec_id AS query_id, c.vec_id // 3 AS unit_id, max(list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[])) AS score FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0 AND c.label % 2 = 0 GROUP BY ALL)
SELECT query_id, unit_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS r FROM p) WHERE r <= 20""")
def dense_units(t):
    v = t.embeddings.select(F.floor(F.col("vec_id") / 3).alias("unit_id"), F.when(F.col("label") % 2 == 0, "raw_text").otherwise("entity_card").alias("unit_type"), F.col("embedding").alias("v"))
    q = t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return R.dense_units(q, v, 64, ("raw_text",)).select("query_id", "unit_id", F.round("score", 6).alias("score"))


@query("rr3_model_order", f"""WITH c AS (SELECT conv_id, turn, {_case('turn + conv_id', 'x', 'y', ' ')} AS text, CASE WHEN turn % 4 <> 1 THEN (turn * 7 + conv_id) % 5 END AS s FROM conversations), a AS (SELECT *, CASE WHEN text <> ' ' THEN count(*) FILTER (WHERE text <> ' ') OVER (PARTITION BY conv_id ORDER BY turn) END AS n FROM c)
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN s IS NOT NULL AND n <= 3 THEN 0 ELSE 1 END, CASE WHEN s IS NOT NULL AND n <= 3 THEN -s END, turn) AS place FROM a""")
def model_order(t):
    c = t.conversations.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("unit_id"), _pick(F.col("turn") + F.col("conv_id"), "x", "y", " ").alias("text"), F.col("turn").alias("place"))
    s = t.conversations.where("turn % 4 <> 1").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("unit_id"), ((F.col("turn") * 7 + F.col("conv_id")) % 5).alias("score"))
    return R.rerank_scored(c, s, 3).select(F.col("query_id").alias("conv_id"), F.col("unit_id").alias("turn"), "place")


LABELS = ("conceptual", "factoid", "procedural", "comparative", "troubleshooting", "navigational", "command_usage", "gibberish", None)


@query("qu5_model_intents", f"SELECT event_id, intent, CASE WHEN intent IN ('comparison', 'troubleshooting') OR event_id % 4 = 0 OR event_id % 10 = 3 THEN 'complex' WHEN intent = 'command_usage' AND event_id % 2 = 0 THEN 'simple' ELSE 'medium' END AS complexity FROM (SELECT event_id, coalesce(CASE {_case('event_id', *LABELS)} WHEN 'conceptual' THEN 'concept_lookup' WHEN 'procedural' THEN 'procedure' WHEN 'comparative' THEN 'comparison' WHEN 'troubleshooting' THEN 'troubleshooting' WHEN 'command_usage' THEN 'command_usage' END, 'general') AS intent FROM events)")
def model_intents(t):
    k = F.col("event_id")
    d = t.events.select("event_id", R.model_intent(_pick(k, *LABELS)).alias("intent"))
    return d.withColumn("complexity", R.complexity_of(F.col("intent"), k % 2 == 0, F.when(k % 4 == 0, F.array(F.lit("sub"))), k % 10 == 3))


@query("r12_orchestrated", """WITH plan AS (SELECT c_custkey AS q, CASE c_custkey % 3 WHEN 0 THEN 'simple' WHEN 1 THEN 'medium' ELSE 'complex' END AS complexity, CASE c_custkey % 5 WHEN 0 THEN 'procedure' WHEN 1 THEN 'special' ELSE 'general' END AS intent FROM customer),
routes AS (SELECT q, source, weight, top_k, rerank FROM (SELECT *, CASE WHEN intent = 'procedure' OR complexity = 'complex' THEN 'cascade' ELSE 'score' END AS rerank FROM plan) JOIN (VALUES ('simple', 'entity_exact', 1.5, 20), ('simple', 'lexical_bm25', 1.0, 50), ('medium', 'lexical_bm25', 1.0, 50), ('medium', 'dense_vector', 0.9, 50), ('complex', 'lexical_bm25', 1.0, 50), ('complex', 'dense_vector', 0.9, 50), ('complex', 'entity_exact', 0.7, 20), ('complex', 'entity_graph', 0.6, 20)) v(complexity, source, weight, top_k) USING (complexity) WHERE intent <> 'special'
UNION ALL SELECT q, 'lexical_bm25', 1.0, 3, CASE WHEN complexity = 'complex' THEN 'cascade' ELSE 'score' END FROM plan WHERE intent = 'special'),
c AS (SELECT o_custkey AS q, o_orderkey AS unit_id, o_totalprice AS score, 'lexical_bm25' AS source FROM orders UNION ALL SELECT o_custkey, o_orderkey, -o_totalprice, 'entity_exact' FROM orders WHERE o_orderstatus = 'F'),
k AS (SELECT q, unit_id, score, source, weight, top_k, row_number() OVER (PARTITION BY q, source ORDER BY score DESC, unit_id) AS r FROM c JOIN routes USING (q, source))
SELECT q AS query_id, unit_id, score, source, weight::DOUBLE AS weight FROM k WHERE r <= top_k""")
def orchestrated(t):
    """Two routes work; the dense one has no vectors and the graph one failed."""
    plan = R.route_plan(*_plan(t))
    c = t.orders.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("unit_id"), F.col("o_totalprice").alias("score"), "o_orderstatus")
    return R.orchestrate(plan, {"lexical_bm25": c, "entity_exact": c.where("o_orderstatus = 'F'").withColumn("score", -F.col("score"))})


def _plan(t):
    q = t.customer.select(F.col("c_custkey").alias("query_id"), _pick(F.col("c_custkey"), "procedure", "special", "general", "general", "general").alias("intent"), _pick(F.col("c_custkey"), "simple", "medium", "complex").alias("complexity"))
    return q, t.spark.createDataFrame([("special", "lexical_bm25", None, 3)], "intent string, source string, weight double, top_k int")


@query("fu4_plan", """WITH p AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'simple' WHEN 1 THEN 'medium' ELSE 'complex' END AS complexity, c_custkey % 5 AS k FROM customer)
SELECT c_custkey AS query_id, CASE WHEN k = 1 THEN 1 WHEN complexity = 'complex' THEN 4 ELSE 2 END::BIGINT AS routes, CASE WHEN k = 1 THEN 'identity' ELSE 'weighted_rrf' END AS fusion, CASE WHEN k = 0 OR complexity = 'complex' THEN 'cascade' ELSE 'score' END AS rerank FROM p""")
def plan(t):
    return R.route_plan(*_plan(t)).groupBy("query_id", "fusion", "rerank").agg(F.count("*").alias("routes"))


@query("b02_document_page", "SELECT doc_id, n_chars, count(*) OVER () AS total FROM documents WHERE lang = 'en' AND source IN ('src1', 'src2') ORDER BY n_chars DESC, doc_id LIMIT 15 OFFSET 5")
def document_page(t):
    d = browse.scoped(t.documents.withColumnRenamed("source", "snapshot"), t.documents.where(F.col("source").isin("src1", "src2")).select(F.col("source").alias("snapshot")), F.col("lang") == "en", None)
    return browse.total_and_page(d.select("doc_id", "n_chars"), [F.desc("n_chars"), F.col("doc_id")], 5, 15)


@query("b04_latest_link", "SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def latest_link(t):
    return browse.latest(t.orders, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("b05_segments_of_document", "SELECT c.conv_id, c.turn, c.role FROM conversations c WHERE c.conv_id IN (SELECT conv_id FROM conversations WHERE turn = 0 AND role = 'user') AND c.role <> 'system' ORDER BY c.conv_id, c.turn LIMIT 40")
def segments_of_document(t):
    s = t.conversations.withColumnRenamed("conv_id", "snapshot")
    d = browse.scoped(s, s.where("turn = 0 AND role = 'user'"), F.col("role") != "system")
    return d.orderBy("snapshot", "turn").limit(40).select(F.col("snapshot").alias("conv_id"), "turn", "role")


@query("b07_relations_with_text", "SELECT c.conv_id * 1000 + c.turn AS relation, substr(c.text, 1, 120) AS src_text, substr(d.text, 1, 120) AS dst_text FROM conversations c LEFT JOIN conversations d ON d.conv_id = c.conv_id AND d.turn = c.turn + 1")
def relations_with_text(t):
    s = t.conversations.select(F.expr(KEY).alias("segment"), "text")
    r = s.select(F.col("segment").alias("relation"), F.col("segment").alias("src"), (F.col("segment") + 1).alias("dst"))
    return browse.relations_with_text(r, s).select("relation", "src_text", "dst_text")


EV = "e AS (SELECT user_id AS run, event_id % 20 AS document, event_type AS stage, CASE WHEN value > 50 THEN 'done' ELSE 'failed' END AS status, ts, event_id FROM events)"


def _events(t):
    return t.events.select(F.col("user_id").alias("run"), (F.col("event_id") % 20).alias("document"), F.col("event_type").alias("stage"), F.when(F.col("value") > 50, "done").otherwise("failed").alias("status"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))


@query("b12_run_stages", f"WITH {EV} SELECT run, stage, count(*) AS events, count(*) FILTER (WHERE status = 'failed') AS failed FROM e GROUP BY ALL ORDER BY run, stage")
def run_stages(t):
    return _events(t).groupBy("run", "stage").agg(F.count("*").alias("events"), F.count_if(F.col("status") == "failed").alias("failed")).orderBy("run", "stage")


@query("b13_run_documents", f"WITH {EV}, d AS (SELECT DISTINCT run, document FROM e WHERE stage <> 'error' UNION SELECT DISTINCT run, document + 100 FROM e WHERE document = 3) SELECT d.run, d.document, x.stage, x.status, x.duration_ms FROM d LEFT JOIN (SELECT run, document, arg_max(stage, (ts, event_id)) AS stage, arg_max(status, (ts, event_id)) AS status, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 AS duration_ms FROM e GROUP BY ALL) x ON x.run = d.run AND x.document = d.document")
def run_documents(t):
    e = _events(t)
    d = e.where("stage <> 'error'").select("run", "document").unionByName(e.where("document = 3").select("run", (F.col("document") + 100).alias("document"))).distinct()
    return browse.run_documents(d, e.withColumn("at", F.col("at").cast("timestamp")))


@query("d10_run_outcome", f"WITH {EV} SELECT run, c AS committed, f AS failed, CASE WHEN c = 0 THEN 'failed' WHEN f > 0 THEN 'partial' ELSE 'completed' END AS status FROM (SELECT run, count(*) FILTER (WHERE status = 'done') AS c, count(*) FILTER (WHERE status = 'failed') AS f FROM e GROUP BY run)")
def run_outcome(t):
    return browse.run_outcome(_events(t).select("run", F.when(F.col("status") == "done", "committed").otherwise("failed").alias("status")))


@query("b21_document_status", "SELECT c_custkey AS document, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 100000) THEN 'published' ELSE coalesce((SELECT o_orderpriority FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderkey DESC LIMIT 1), 'uploaded') END AS status FROM customer")
def document_status(t):
    b = t.orders.where("o_totalprice > 100000").select(F.col("o_custkey").alias("document"), F.when(F.col("o_orderstatus") == "P", "active").otherwise("removed").alias("status"))
    r = t.orders.select(F.col("o_custkey").alias("document"), F.col("o_orderpriority").alias("status"), F.col("o_orderkey").alias("run_no"))
    return browse.document_status(t.customer.select(F.col("c_custkey").alias("document")), b, r)


@query("b22_pending_mentions", "SELECT c.conv_id AS run, c.conv_id * 1000 + c.turn AS mention, CASE WHEN p.p_partkey IS NOT NULL THEN p.p_brand END AS canonical, CASE WHEN c.turn % 4 <> 0 AND strpos(c.text, c.role) > 0 THEN substr(c.text, greatest(strpos(c.text, c.role) - 80, 1), strpos(c.text, c.role) - greatest(strpos(c.text, c.role) - 80, 1) + length(c.role) + 80) ELSE '' END AS quote FROM conversations c LEFT JOIN part p ON p.p_partkey = c.conv_id * 3 WHERE c.turn % 2 = 0 AND c.conv_id % 5 <> 1")
def pending_mentions(t):
    k = F.expr(KEY)
    m = t.conversations.select(k.alias("mention"), F.col("conv_id").alias("document"), k.alias("segment"), F.col("role").alias("text"), (F.col("conv_id") * 3).alias("entity"), F.when(F.col("turn") % 2 == 0, "pending").otherwise("auto").alias("status"))
    d = t.conversations.where("conv_id % 5 <> 1").select(F.col("conv_id").alias("run"), F.col("conv_id").alias("document")).distinct()
    return browse.pending_mentions(m, d, t.part.select(F.col("p_partkey").alias("entity"), F.col("p_brand").alias("canonical")), t.conversations.where("turn % 4 <> 0").select(k.alias("segment"), F.col("text").alias("body")))


@query("b23_candidates_by_score", "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN value END AS score FROM events ORDER BY 2 DESC NULLS LAST, event_id LIMIT 100")
def candidates_by_score(t):
    d = t.events.select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("score"))
    return d.orderBy(F.desc_nulls_last("score"), "event_id").limit(100)


@query("b39_quality_summary", f"""WITH {UNITS}, b AS (SELECT unit_id // 1000 % 30 AS build, * FROM u), s AS (SELECT build, count(*) FILTER (WHERE unit_type = 'generated_question') AS questions, count(*) FILTER (WHERE unit_type = 'generated_question' AND title LIKE 'Q%') AS numbered FROM b GROUP BY 1), r AS (SELECT conv_id % 30 AS build, count(*) AS relations FROM conversations WHERE turn = 1 AND conv_id % 4 <> 0 GROUP BY 1)
SELECT build, questions, numbered, coalesce(relations, 0) AS relations, array_to_string(list_filter([CASE WHEN questions = 0 THEN 'no questions' END, CASE WHEN numbered > 0 THEN 'numbered questions' END, CASE WHEN coalesce(relations, 0) = 0 THEN 'no relations' END], lambda x: x IS NOT NULL), ',') AS warnings FROM s LEFT JOIN r USING (build)""")
def quality_summary(t):
    u = _units(t)[0].withColumn("build", F.floor(F.col("unit_id") / 1000) % 30)
    r = t.conversations.where("turn = 1").select((F.col("conv_id") % 30).alias("build"), F.lit("causes").alias("type"), F.when(F.col("conv_id") % 4 != 0, "discourse_llm").otherwise("structure").alias("source"))
    return browse.quality_summary(u, r)


@query("d09_unshared_segments", "WITH h AS (SELECT doc_id, sha256(text) AS h FROM documents), f AS (SELECT h, min(doc_id) AS doc_id FROM h WHERE h NOT IN (SELECT h FROM h WHERE doc_id % 10 = 0) GROUP BY h) SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM f)")
def unshared_segments(t):
    s = t.documents.select(F.col("doc_id").alias("document"), F.sha2("text", 256).alias("hash"))
    return browse.unshared(t.documents.select(F.col("doc_id").alias("document"), "n_chars"), s, s.where("document % 10 = 0")).select(F.col("document").alias("doc_id"), "n_chars")


@query("d12_adopted", "SELECT doc_id AS document, coalesce(CASE WHEN doc_id % 3 = 0 THEN 'kb' || doc_id % 7 END, 'default:' || lang) AS base FROM documents")
def adopted(t):
    d = t.documents.select(F.col("doc_id").alias("document"), F.col("lang").alias("domain"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("kb"), F.col("doc_id") % 7)).alias("base"))
    return browse.adopt_orphans(d, "default").select("document", "base")


@query("a04_batches", "SELECT o_orderdate::DATE AS batch, count(*) AS orders, count(DISTINCT o_custkey) AS customers, bool_or(o_orderstatus = 'P') AS running, bool_and(o_orderstatus = 'F') AS done FROM orders GROUP BY 1")
def batches(t):
    return t.orders.groupBy(F.to_date("o_orderdate").alias("batch")).agg(F.count("*").alias("orders"), F.count_distinct("o_custkey").alias("customers"), F.bool_or(F.col("o_orderstatus") == "P").alias("running"), F.bool_and(F.col("o_orderstatus") == "F").alias("done"))


@query("w09_latest_run_status", "SELECT c_custkey, (SELECT o_orderstatus FROM orders WHERE o_custkey = c_custkey ORDER BY CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate END DESC NULLS LAST, o_orderkey DESC LIMIT 1) AS status FROM customer")
def latest_run_status(t):
    """By the time a run ended; runs that have not ended come last."""
    r = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate")).alias("ended"), "o_orderkey")
    last = browse.latest(r, ["c_custkey"], [F.col("ended"), F.col("o_orderkey")])
    return t.customer.select("c_custkey").join(last.select("c_custkey", F.col("o_orderstatus").alias("status")), "c_custkey", "left")


@query("j18_guarded_insert", "SELECT p_partkey, p_brand FROM part LEFT JOIN supplier ON s_suppkey = p_partkey WHERE s_suppkey IS NULL OR s_acctbal > 0")
def guarded_insert(t):
    """Rows to insert whose owner, if there is one, is in good standing."""
    d = t.part.join(t.supplier, F.col("s_suppkey") == F.col("p_partkey"), "left")
    return d.where("s_suppkey IS NULL OR s_acctbal > 0").select("p_partkey", "p_brand")


@query("j17_attempts", "SELECT o_orderkey AS task, count(*) AS attempts, sum(l_quantity) AS tokens FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY 1")
def attempts(t):
    return t.lineitem.join(t.orders.where("o_orderstatus = 'F'"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_orderkey").alias("task")).agg(F.count("*").alias("attempts"), F.sum("l_quantity").alias("tokens"))
