"""Queries for retrieval, fusion and reranking."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import retrieval as R

TOK = "regexp_extract_all(lower({0}), '[一-鿿]|[0-9A-Za-zÀ-ÖØ-öø-ÿ]+')"
WORDS = ("license", "version", "released", "password", "thand", "hered")


def _lexical(t, k=50):
    q = t.spark.createDataFrame([(0, " ".join(WORDS))], "query_id long, text string")
    return R.full_text(q, t.documents.select(F.col("doc_id").alias("unit_id"), "text"), k)


def _dense(t, k=50):
    v = t.embeddings.select(F.col("vec_id").alias("unit_id"), F.col("embedding").alias("v"))
    q = t.embeddings.where("vec_id = 0").select(F.lit(0).cast("long").alias("query_id"), F.col("embedding").alias("q"))
    return R.dense(q, v, 64, k)


LEX = f"""words AS (SELECT doc_id, unnest({TOK.format('text')}) AS w FROM documents),
hits AS (SELECT doc_id, w, count(*) AS n FROM words WHERE w IN {WORDS} GROUP BY ALL),
lex AS (SELECT 0::BIGINT AS query_id, doc_id AS unit_id, sum(least(n, 5) / {len(WORDS)}.0::DOUBLE) AS score FROM hits GROUP BY doc_id ORDER BY round(score, 9) DESC, unit_id LIMIT 50)"""
DENSE = """dense AS (SELECT 0::BIGINT AS query_id, vec_id AS unit_id, list_cosine_similarity(embedding::DOUBLE[], q0) AS score FROM embeddings, (SELECT embedding::DOUBLE[] AS q0 FROM embeddings WHERE vec_id = 0) WHERE len(embedding) = 64 ORDER BY round(score, 9) DESC, unit_id LIMIT 50)"""


@query("r01_full_text", f"WITH {LEX} SELECT query_id, unit_id, round(score, 9) AS score FROM lex")
def full_text(t):
    return _lexical(t).select("query_id", "unit_id", F.round("score", 9).alias("score"))


@query("r05_dense", f"WITH {DENSE} SELECT query_id, unit_id, round(score, 6) AS score FROM dense")
def dense(t):
    return _dense(t).select("query_id", "unit_id", F.round("score", 6).alias("score"))


@query("hybrid_search", f"""WITH {LEX}, {DENSE}, routes AS (SELECT unit_id, 1.0 / (60 + row_number() OVER (ORDER BY round(score, 9) DESC, unit_id)) AS part FROM lex UNION ALL SELECT unit_id, 0.9 / (60 + row_number() OVER (ORDER BY round(score, 9) DESC, unit_id)) FROM dense)
SELECT unit_id, round(sum(part)::DOUBLE, 8) AS fused FROM routes GROUP BY unit_id ORDER BY fused DESC, unit_id LIMIT 10""")
def hybrid_search(t):
    """The flagship: lexical and dense routes, weighted reciprocal rank fusion, the ten best. Documents and vectors
    share ids here."""
    fused = R.rrf(_lexical(t).unionByName(_dense(t)), {"fts": 1.0, "dense": 0.9})
    return fused.select("unit_id", F.round("fused", 8).alias("fused")).orderBy(F.desc("fused"), "unit_id").limit(10)


DENSE_ALL = """pairs AS (SELECT q.vec_id AS query_id, c.vec_id AS unit_id, list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0 AND len(q.embedding) = 64 AND len(c.embedding) = 64),
dense AS (SELECT query_id, unit_id, score, rk FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, unit_id) AS rk FROM pairs) WHERE rk <= 50)"""


def _dense_all(t, k=50):
    """Every query vector against all rows."""
    q = t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return R.dense(q, t.embeddings.select(F.col("vec_id").alias("unit_id"), F.col("embedding").alias("v")), 64, k)


@query("r05_dense_all", f"WITH {DENSE_ALL} SELECT query_id, unit_id, round(score, 6) AS score FROM dense")
def dense_all(t):
    return _dense_all(t).select("query_id", "unit_id", F.round("score", 6).alias("score"))


@query("r05_dense_scoped", """WITH e AS (SELECT vec_id, label, chr((97 + label % 5)::INT) || '/' || (vec_id % 7) AS section, embedding::DOUBLE[] AS v FROM embeddings WHERE len(embedding) = 64),
q AS (SELECT vec_id AS query_id, CASE vec_id // 100 % 4 WHEN 1 THEN NULL WHEN 2 THEN -1 ELSE label END AS scope, CASE vec_id // 100 % 3 WHEN 0 THEN NULL WHEN 1 THEN section ELSE 'z/' END AS prefix, v FROM e WHERE vec_id % 100 = 0),
p AS (SELECT query_id, vec_id AS unit_id, list_cosine_similarity(e.v, q.v) AS score, CASE WHEN NOT (scope IS NULL OR scope = label) THEN 0 WHEN prefix IS NULL OR starts_with(section, prefix) THEN 2 ELSE 1 END AS met FROM q, e),
m AS (SELECT *, CASE WHEN met = 0 AND max(met) OVER w = 0 THEN 0 ELSE met END AS level, max(met) OVER w AS best FROM p WINDOW w AS (PARTITION BY query_id))
SELECT query_id, unit_id, round(score, 6) AS score FROM m WHERE level = best QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, unit_id) <= 20""")
def dense_scoped(t):
    """Queries with a scope (a label; none, or one that is nowhere) and a section (none, their own, or one that is nowhere)."""
    section = F.concat(F.chr((97 + F.col("label") % 5).cast("int")), F.lit("/"), (F.col("vec_id") % 7).cast("string"))
    e = t.embeddings.select("vec_id", F.col("label").cast("string").alias("scope"), section.alias("section"), F.col("embedding").alias("v"))
    kind = F.floor(F.col("vec_id") / 100)
    scope = F.when(kind % 4 == 1, None).when(kind % 4 == 2, "-1").otherwise(F.col("scope"))
    prefix = F.when(kind % 3 == 0, None).when(kind % 3 == 1, F.col("section")).otherwise("z/")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), scope.alias("scope"), prefix.alias("section"), F.col("v").alias("q"))
    return R.dense(q, e.withColumnRenamed("vec_id", "unit_id"), 64).select("query_id", "unit_id", F.round("score", 6).alias("score"))


#: A query's terms, as SQL over a text.
TERMS = f"CASE WHEN len(list_filter({TOK}, lambda x: length(x) >= 2 OR regexp_matches(x, '[一-鿿]'))) > 0 THEN list_distinct(list_filter({TOK}, lambda x: length(x) >= 2 OR regexp_matches(x, '[一-鿿]'))) ELSE list_distinct({TOK}) END"


@query("hybrid_search_all", f"""WITH {DENSE_ALL}, asked AS (SELECT DISTINCT query_id FROM dense),
terms AS (SELECT query_id, unnest(t) AS w, len(t) AS n FROM (SELECT query_id, {TERMS.format('text')} AS t FROM asked JOIN conversations ON conv_id = query_id // 100 AND turn = 0)),
words AS (SELECT doc_id, w, count(*) AS hits FROM (SELECT doc_id, unnest({TOK.format('text')}) AS w FROM documents) GROUP BY ALL),
lexical AS (SELECT query_id, doc_id AS unit_id, sum(least(hits, 5)) / any_value(n)::DOUBLE AS score FROM words JOIN terms USING (w) GROUP BY ALL),
routes AS (SELECT query_id, unit_id, 1.0 / (60 + rk) AS part FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS rk FROM lexical) WHERE rk <= 50 UNION ALL SELECT query_id, unit_id, 0.9 / (60 + rk) FROM dense),
f AS (SELECT query_id, unit_id, round(sum(part)::DOUBLE, 8) AS fused FROM routes GROUP BY ALL)
SELECT query_id, unit_id, fused FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, unit_id) AS rk FROM f) WHERE rk <= 10""")
def hybrid_search_all(t):
    """The flagship for every query: its vector through the dense route, its words (a conversation's first turn)
    through the lexical one."""
    d = _dense_all(t)
    asked = t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.floor(F.col("vec_id") / 100).alias("conv_id"))
    q = asked.join(t.conversations.where("turn = 0").select("conv_id", "text"), "conv_id").select("query_id", "text")
    lexical = R.full_text(q, t.documents.select(F.col("doc_id").alias("unit_id"), "text"), 50)
    fused = R.rrf(lexical.unionByName(d), {"fts": 1.0, "dense": 0.9}).withColumn("fused", F.round("fused", 8))
    return R.top_per_query(fused.select("query_id", "unit_id", F.col("fused").alias("score")), 10).select("query_id", "unit_id", F.col("score").alias("fused"))


TRIGRAMS = "list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({0}), '[^0-9a-zà-öø-ÿ]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


def _ladder_sql(queries: str, units: str) -> str:
    """queries: (query_id, q); units: (unit_id, title, search_text, text)."""
    return f"""WITH q AS ({queries}), u AS ({units}), qt AS (SELECT query_id, q, {TERMS.format('q')} AS t, {TRIGRAMS.format('q')} AS g FROM q),
fields AS (SELECT unit_id, 1.0::DOUBLE AS w, title AS x FROM u UNION ALL SELECT unit_id, 0.4, search_text FROM u UNION ALL SELECT unit_id, 0.2, text FROM u),
hits AS (SELECT unit_id, w, t, count(*) AS n FROM (SELECT unit_id, w, unnest({TOK.format("coalesce(x, '')")}) AS t FROM fields) GROUP BY ALL),
one AS (SELECT query_id, unit_id, round(sum(least(n, 5) * w) / any_value(m), 9) AS score, 1 AS level FROM hits JOIN (SELECT query_id, unnest(t) AS t, len(t) AS m FROM qt) USING (t) GROUP BY query_id, unit_id),
left2 AS (SELECT * FROM qt WHERE query_id NOT IN (SELECT query_id FROM one)),
grams AS (SELECT unit_id, {TRIGRAMS.format("coalesce(text, '')")} AS ug FROM u),
two AS (SELECT query_id, unit_id, len(list_intersect(ug, g)) / greatest(1, len(list_distinct(ug || g)))::DOUBLE AS score, 2 AS level FROM left2, grams WHERE len(ug) > 0 AND len(g) > 0 AND len(list_intersect(ug, g)) / greatest(1, len(list_distinct(ug || g)))::DOUBLE >= 0.3),
left3 AS (SELECT * FROM left2 WHERE query_id NOT IN (SELECT query_id FROM two)),
three AS (SELECT query_id, unit_id, len(list_filter(t, lambda y: contains(lower(coalesce(text, '')), y))) / len(t)::DOUBLE AS score, 3 AS level FROM left3, u WHERE len(list_filter(t, lambda y: contains(lower(coalesce(text, '')), y))) > 0),
r AS (SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three)
SELECT query_id, unit_id, level::BIGINT AS level, round(score, 9) AS score FROM r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) <= 100"""


def _ladder(q, u):
    return R.full_text_ladder(q, u).select("query_id", "unit_id", "level", F.round("score", 9).alias("score"))


@query("r01_ladder_parts", _ladder_sql(
    """SELECT p_partkey AS query_id, CASE p_partkey // 100 % 4 WHEN 0 THEN p_name WHEN 1 THEN regexp_replace(p_name, '([a-z])( |$)', '\\1\\1\\2', 'g') WHEN 2 THEN substr(p_name, 2, 3) ELSE 'qqq ' || p_partkey END AS q FROM part WHERE p_partkey % 100 = 0""",
    "SELECT p_partkey AS unit_id, p_type AS title, p_brand AS search_text, p_name AS text FROM part"))
def ladder_parts(t):
    """Names of parts as they are, with their words' last letters doubled, a piece of one, and words that are nowhere."""
    kind = F.floor(F.col("p_partkey") / 100) % 4
    asked = F.when(kind == 0, F.col("p_name")).when(kind == 1, F.regexp_replace("p_name", "([a-z])( |$)", "$1$1$2")).when(kind == 2, F.substring("p_name", 2, 3)).otherwise(F.concat(F.lit("qqq "), F.col("p_partkey").cast("string")))
    q = t.part.where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("query_id"), asked.alias("text"))
    return _ladder(q, t.part.select(F.col("p_partkey").alias("unit_id"), F.col("p_type").alias("title"), F.col("p_brand").alias("search_text"), F.col("p_name").alias("text")))


@query("r01_ladder_documents", _ladder_sql(
    """SELECT conv_id * 1000 + turn AS query_id, CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN regexp_replace(text, '([a-z])([ .,]|$)', '\\1qx\\2', 'g') ELSE 'assword' END AS q FROM conversations WHERE conv_id % 100 = 0""",
    "SELECT doc_id AS unit_id, source AS title, lang AS search_text, text FROM documents"))
def ladder_documents(t):
    """Turns of conversations: as they are, with endings that no word has, and a piece of a word."""
    asked = F.when(F.col("turn") % 3 == 0, F.col("text")).when(F.col("turn") % 3 == 1, F.regexp_replace("text", "([a-z])([ .,]|$)", "$1qx$2")).otherwise("assword")
    q = t.conversations.where("conv_id % 100 = 0").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), asked.alias("text"))
    return _ladder(q, t.documents.select(F.col("doc_id").alias("unit_id"), F.col("source").alias("title"), F.col("lang").alias("search_text"), "text"))


BATCH = [(1, "the thand version"), (2, "qqq zzz"), (3, "assword"), (4, "Esndha reedes")]


@query("r01_ladder", _ladder_sql(f"SELECT * FROM (VALUES {','.join(f"({i}::BIGINT, '{x}')" for i, x in BATCH)}) v(query_id, q)", "SELECT item_id AS unit_id, '' AS title, '' AS search_text, text FROM benchmark"))
def ladder(t):
    q = t.spark.createDataFrame(BATCH, "query_id long, text string")
    none = F.lit("")
    return _ladder(q, t.benchmark.select(F.col("item_id").alias("unit_id"), none.alias("title"), none.alias("search_text"), "text"))


@query("r02_tiers", """WITH c AS (SELECT lang, doc_id, n_chars, (source = 'src3')::INT + (source = 'src3' AND n_chars > 30000)::INT AS met FROM documents)
SELECT lang, doc_id, met::BIGINT AS met FROM (SELECT *, max(met) OVER (PARTITION BY lang) AS best FROM c) WHERE met = best""")
def tiers(t):
    """Scope and section, else scope, else all: by language."""
    c = t.documents.select(F.col("lang").alias("query_id"), "doc_id", "source", "n_chars")
    d = R.tiers(c, F.col("source") == "src3", F.col("n_chars") > 30000)
    met = (F.col("source") == "src3").cast("int") + ((F.col("source") == "src3") & (F.col("n_chars") > 30000)).cast("int")
    return d.select(F.col("query_id").alias("lang"), "doc_id", met.alias("met"))


@query("r07_entity_exact", r"""WITH m AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[0-9]{1,3}(?:\.[0-9]{1,3}){3}'))) AS name, n_chars FROM documents), q AS (SELECT min(name) AS a, max(name) AS b FROM m)
SELECT query_id, doc_id AS unit_id, 0.95::DOUBLE AS score FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY n_chars DESC, doc_id) AS r FROM (SELECT 1::BIGINT AS query_id, a AS name FROM q UNION SELECT 2, b FROM q) JOIN m USING (name)) WHERE r <= 20""")
def entity_exact(t):
    found = F.regexp_extract_all("text", F.lit(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"), 0)
    m = t.documents.select(F.col("doc_id").alias("unit_id"), F.explode(F.array_distinct(found)).alias("name"), F.col("n_chars").alias("weight"))
    ends = m.agg(F.min("name").alias("a"), F.max("name").alias("b"))
    q = ends.select(F.explode(F.array(F.struct(F.lit(1).cast("long").alias("query_id"), F.col("a").alias("name")), F.struct(F.lit(2).cast("long").alias("query_id"), F.col("b").alias("name"))))).select("col.*")
    return R.entity_exact(q, m).select("query_id", "unit_id", "score")


ROUTED = """c AS (SELECT lang AS query_id, doc_id AS unit_id, n_chars::DOUBLE AS score, 'long' AS source FROM documents UNION ALL SELECT lang, doc_id, -doc_id, 'new' FROM documents WHERE source <> 'src0'),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, unit_id) AS rk FROM c)"""


def _routed(t):
    long = t.documents.select(F.col("lang").alias("query_id"), F.col("doc_id").alias("unit_id"), F.col("n_chars").cast("double").alias("score"), F.lit("long").alias("source"))
    new = t.documents.where("source <> 'src0'").select(F.col("lang").alias("query_id"), F.col("doc_id").alias("unit_id"), (-F.col("doc_id")).cast("double").alias("score"), F.lit("new").alias("source"))
    return long.unionByName(new)


@query("fu1_rrf", f"WITH {ROUTED} SELECT query_id, unit_id, round(sum(1.0::DOUBLE / (60 + rk)), 9) AS fused, max(score) AS score FROM r GROUP BY ALL")
def fu1(t):
    return R.rrf(_routed(t), wide=True).select("query_id", "unit_id", F.round("fused", 9).alias("fused"), "score")


@query("fu2_weighted_rrf", f"WITH {ROUTED} SELECT query_id, unit_id, round(sum((CASE source WHEN 'long' THEN 1.5 ELSE 0.5 END)::DOUBLE / (60 + rk)), 9) AS fused, string_agg(source, ',' ORDER BY source) AS sources FROM r GROUP BY ALL")
def fu2(t):
    return R.rrf(_routed(t), {"long": 1.5, "new": 0.5}, wide=True).select("query_id", "unit_id", F.round("fused", 9).alias("fused"), F.array_join("sources", ",").alias("sources"))


@query("fu3_identity", f"WITH {ROUTED} SELECT query_id, unit_id, max(score) AS score FROM c GROUP BY ALL")
def fu3(t):
    return R.identity_fusion(_routed(t))


@query("fu4_route_plan", "SELECT lang, source, weight::DOUBLE AS weight, top_k FROM (SELECT DISTINCT lang, CASE lang WHEN 'en' THEN 'complex' WHEN 'de' THEN 'medium' ELSE 'simple' END AS complexity FROM documents) JOIN (VALUES ('simple', 'entity_exact', 1.5, 20::BIGINT), ('simple', 'lexical_bm25', 1.0, 50), ('medium', 'lexical_bm25', 1.0, 50), ('medium', 'dense_vector', 0.9, 50), ('complex', 'lexical_bm25', 1.0, 50), ('complex', 'dense_vector', 0.9, 50), ('complex', 'entity_exact', 0.7, 20), ('complex', 'entity_graph', 0.6, 20)) r(complexity, source, weight, top_k) USING (complexity)")
def fu4(t):
    d = t.documents.select("lang").distinct().withColumn("complexity", F.when(F.col("lang") == "en", "complex").when(F.col("lang") == "de", "medium").otherwise("simple"))
    return d.join(F.broadcast(R.route_table(t.spark)), "complexity").select("lang", "source", "weight", "top_k")


@query("rr1_cascade", f"""WITH {ROUTED}, f AS (SELECT query_id, unit_id, max(score) AS score FROM c GROUP BY ALL), m AS (SELECT doc_id AS unit_id, quality::DOUBLE AS q FROM labels JOIN documents USING (doc_id) WHERE lang IN ('en', 'de'))
SELECT f.query_id, f.unit_id, CASE WHEN f.query_id IN ('en', 'de') THEN coalesce(m.q, 0) ELSE f.score END AS score FROM f LEFT JOIN m USING (unit_id)""")
def rr1(t):
    """Queries for which the model scored anything take its scores, the others keep their own."""
    m = t.labels.join(t.documents.where("lang IN ('en', 'de')").select("doc_id", "lang"), "doc_id").select(F.col("lang").alias("query_id"), F.col("doc_id").alias("unit_id"), F.col("quality").cast("double").alias("score"))
    return R.cascade(R.identity_fusion(_routed(t)), m).select("query_id", "unit_id", "score")


@query("rr2_finish")
def rr2(t):
    """Best unit of each segment, penalties, greedy near-duplicate removal, floor and cut, over what a route gives for
    each source: its 200 best documents."""
    d = t.documents.select(F.col("source").alias("query_id"), F.col("doc_id").alias("unit_id"), F.floor(F.col("doc_id") / 2).alias("segment_id"), F.when(F.col("doc_id") % 7 == 0, "heading").otherwise("paragraph").alias("block_type"), F.col("text"), (1.0 / (1.0 + F.col("n_chars") % 97)).alias("score"))
    return R.rerank_finish(R.top_per_query(d, 200), k=50).select("query_id", "unit_id", F.round("score", 9).alias("score"))


#: What is said after a turn's text, by turn: every intent, command form and scope occurs.
SAID = (" 有区别吗", " 故障", " 操作步骤", " 是什么", " 路径", " add apn_X1 now", " 新增 upf 规则", " 删除", " UDG smf cloudcore", "", " 怎么做，配置!", "")
CMD = r"(?i)(add|mod|del|set|show|lst|dsp|reg|dereg)\s+([a-z][a-z0-9_]*)"


@query("qu2_understanding", rf"""WITH c AS (SELECT conv_id, turn, text || list_extract({list(SAID)}, ((conv_id * 7 + turn) % {len(SAID)} + 1)::INT) AS text FROM conversations),
m AS (SELECT *, regexp_extract(text, '{CMD}', 1) AS v, regexp_extract(text, '{CMD}', 2) AS o, list_filter([{', '.join(f"{{'w': '{w}', 's': '{v}'}}" for w, v in R.VERBS.items())}], lambda x: contains(text, x.w))[1] AS f,
  list_filter(string_split_regex(regexp_replace(text, '{CMD}', '', 'g'), '[\s,，、？?。.！!]+'), lambda x: trim(x) <> '' AND NOT list_contains({list(R.STOP)}, x) AND (length(x) >= 2 OR regexp_matches(x, '[一-鿿]'))) AS k,
  array_to_string(list_filter([{', '.join(f"CASE WHEN regexp_matches(text, '(?i)(^|[^A-Za-z0-9_]){n}($|[^A-Za-z0-9_])') THEN '{n.upper()}' END" for n in sorted(R.PRODUCTS + R.ELEMENTS, key=str.upper))}], lambda x: x IS NOT NULL), ',') AS scope FROM c),
d AS (SELECT *, CASE WHEN v <> '' THEN upper(v) || ' ' || upper(o) WHEN f IS NOT NULL THEN f.s || coalesce(' ' || nullif(upper(regexp_extract(substr(text, strpos(text, f.w) + length(f.w)), '([A-Za-z][A-Za-z0-9_]*)', 1)), ''), '') END AS command FROM m),
i AS (SELECT *, CASE WHEN command IS NOT NULL THEN 'command_usage' {' '.join(f"WHEN {' OR '.join(f"contains(text, '{w}')" for w in words)} THEN '{'general' if name == 'navigational' else name}'" for name, words in R.INTENTS.items())} ELSE 'general' END AS intent FROM d)
SELECT conv_id, turn, command, intent, len(k) AS n_keywords, scope, CASE WHEN intent IN ('comparison', 'troubleshooting') THEN 'complex' WHEN intent = 'command_usage' THEN 'simple' ELSE 'medium' END AS complexity FROM i""")
def understanding(t):
    said = F.element_at(F.array(*map(F.lit, SAID)), ((F.col("conv_id") * 7 + F.col("turn")) % len(SAID) + 1).cast("int"))
    u = R.understand(t.conversations.withColumn("text", F.concat("text", said)))
    scope = F.array_join(F.array_sort(F.concat("products", "elements")), ",")
    return u.select("conv_id", "turn", "command", "intent", F.size("keywords").alias("n_keywords"), scope.alias("scope"), "complexity")


@query("c1_semantic_cache", """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, TIMESTAMP '2024-01-02 00:00:00' - to_hours((vec_id % 48)::INT) AS created_at FROM embeddings),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS entry_id, list_cosine_similarity(q.v, c.v) AS s FROM e q JOIN e c ON q.label = c.label WHERE q.vec_id % 100 = 0 AND c.vec_id % 100 <> 0 AND c.created_at > TIMESTAMP '2024-01-01 00:00:00')
SELECT query_id, entry_id, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, entry_id) AS r FROM p) WHERE r = 1 AND s >= 0.2""")
def cache(t):
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    e = t.embeddings.select("vec_id", F.col("label").alias("scope"), F.col("embedding").alias("v"), (now - F.make_interval(hours=(F.col("vec_id") % 48).cast("int"))).alias("created_at"))
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "scope", F.col("v").alias("q"))
    c = e.where("vec_id % 100 <> 0").withColumnRenamed("vec_id", "entry_id")
    return R.semantic_cache(q, c, now, 64, 24, 0.2).select("query_id", "entry_id", F.round("similarity", 6).alias("similarity"))


@query("r13_multi_query", """WITH q AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'), o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM q)
SELECT conv_id, n AS variant, length(text) AS size FROM o WHERE n <= 2""")
def multi_query(t):
    """A conversation's first user turn as the query, the next two as its variants."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    d = t.conversations.where("role = 'user'").select(F.col("conv_id").alias("query_id"), (F.row_number().over(w) - 1).alias("n"), "text")
    e = R.expand_queries(d.where("n = 0"), d.where("n > 0"))
    return e.select(F.col("query_id").alias("conv_id"), "variant", F.length("text").alias("size"))
