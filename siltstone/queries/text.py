"""Queries for the text functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import SQL, query
from ..functions import text as T
from ..operators import sparse
from ..operators.relational import contained_pairs, settled

TOKENS = "regexp_extract_all(lower(text), '[一-鿿]|[0-9A-Za-zÀ-ÖØ-öø-ÿ]+')"


@query("x01_tokens", f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, coalesce(t[1], '') AS first_token FROM (SELECT doc_id, {TOKENS} AS t FROM documents)")
def tokens(t):
    d = t.documents.select("doc_id", T.tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"), F.coalesce(F.try_element_at("t", F.lit(1)), F.lit("")).alias("first_token"))


@query("x02_token_estimate", f"SELECT doc_id, (len({TOKENS}) - w + round_even(w * 1.5, 0))::BIGINT AS n FROM (SELECT *, len(regexp_extract_all(text, '[一-鿿]')) AS w FROM documents)")
def token_estimate(t):
    return t.documents.select("doc_id", T.token_estimate(F.col("text")).alias("n"))


@query("x03_dedup_form", r"SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(lower(nfc_normalize(text)), '[^\p{L}\p{N}\s]', '', 'g'), '\s+', ' ', 'g'))) AS h FROM documents")
def dedup_form(t):
    return t.documents.select("doc_id", F.sha2(T.dedup_form(F.col("text")), 256).alias("h"))


SIMHASH = f"""
WITH words AS (SELECT doc_id, unnest({TOKENS}) AS w FROM documents),
counted AS (SELECT doc_id, w, count(*) AS n FROM words GROUP BY ALL),
hashed AS (SELECT doc_id, n, ('0x' || substr(md5(w), 17, 16))::UBIGINT AS h FROM counted),
bits AS (SELECT doc_id, i, sum(CASE WHEN (h >> i) & 1 = 1 THEN n ELSE -n END) AS v FROM hashed, range(64) r(i) GROUP BY doc_id, i),
prints AS (SELECT doc_id, sum(CASE WHEN v > 0 THEN CASE WHEN i = 63 THEN -9223372036854775808::HUGEINT ELSE (1::HUGEINT << i::INTEGER) END ELSE 0 END)::BIGINT AS f FROM bits GROUP BY doc_id),
every AS (SELECT d.doc_id, coalesce(p.f, 0) AS f FROM documents d LEFT JOIN prints p USING (doc_id))
"""


@query("x04_simhash", SIMHASH + "SELECT doc_id, f AS fingerprint FROM every")
def simhash(t):
    return t.documents.select("doc_id", T.simhash(T.tokens(F.col("text"))).alias("fingerprint"))


@query("x05_near_fingerprints", SIMHASH + ", d AS (SELECT DISTINCT f FROM every) SELECT a.f AS a, b.f AS b, bit_count(xor(a.f, b.f))::BIGINT AS distance FROM d a JOIN d b ON a.f < b.f AND bit_count(xor(a.f, b.f)) <= 3")
def near_fingerprints(t):
    """Pairs of distinct fingerprints at most 3 bits apart, by keys of three of six blocks; a pair counts at its first key."""
    d = t.documents.select(T.simhash(T.tokens(F.col("text"))).alias("f")).distinct()
    d = settled(d.repartition(t.spark.sparkContext.defaultParallelism))  # few bytes, which grow by their keys
    d = d.select("f", F.explode(T.near_keys(F.col("f"))).alias("key")).select("f", "key.*")
    # merged: the keys are many times the fingerprints, by whose size the optimizer would send them all through the driver
    a, b = d.withColumnRenamed("f", "a").hint("merge"), d.withColumnRenamed("f", "b")
    distance = T.hamming(F.col("a"), F.col("b"))
    pairs = a.join(b, ["choice", "value"]).where((F.col("a") < F.col("b")) & (distance <= 3) & (T.near_choice(F.col("a"), F.col("b")) == F.col("choice")))
    return pairs.select("a", "b", distance.alias("distance"))


@query("x06_set_jaccard", f"""WITH s AS (SELECT doc_id, list_distinct({TOKENS}) AS t FROM documents)
SELECT a.doc_id, round(CASE WHEN len(list_distinct(a.t || b.t)) = 0 THEN 1.0 ELSE len(list_intersect(a.t, b.t)) / len(list_distinct(a.t || b.t))::DOUBLE END, 9) AS jaccard FROM s a JOIN s b ON b.doc_id = a.doc_id + 1""")
def set_jaccard(t):
    s = t.documents.select("doc_id", F.array_distinct(T.tokens(F.col("text"))).alias("t"))
    b = s.select((F.col("doc_id") - 1).alias("doc_id"), F.col("t").alias("u"))
    return s.join(b, "doc_id").select("doc_id", F.round(T.set_jaccard(F.col("t"), F.col("u")), 9).alias("jaccard"))


@query("x07_sentences", r"""SELECT doc_id, len(s) AS n, coalesce(max_len, 0)::BIGINT AS longest FROM (SELECT doc_id, s, list_max(list_transform(s, lambda x: length(x))) AS max_len FROM
(SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([。！？' || chr(10) || '])', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(replace(x, chr(10), ' '))), lambda x: x <> '') AS s FROM documents))""")
def sentences(t):
    d = t.documents.select("doc_id", T.sentences(F.col("text")).alias("s"))
    return d.select("doc_id", F.size("s").alias("n"), F.coalesce(F.array_max(F.transform("s", F.length)), F.lit(0)).alias("longest"))


@query("x09_snapshot_hash", r"""SELECT doc_id, sha256(text) AS raw_hash, sha256(array_to_string(list_filter(list_transform(string_split(regexp_replace(text, chr(13) || chr(10) || '?', chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '[ \t]+$', '')), lambda x: x <> ''), chr(10))) AS snapshot_hash FROM documents""")
def snapshot_hash(t):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("raw_hash"), F.sha2(T.snapshot_form(F.col("text")), 256).alias("snapshot_hash"))


@query("x11_alias_form", r"SELECT p_partkey, lower(regexp_replace(trim('  ' || p_name || '   x'), '\s+', ' ', 'g')) AS alias FROM part")
def alias_form(t):
    return t.part.select("p_partkey", T.alias_form(F.concat(F.lit("  "), "p_name", F.lit("   x"))).alias("alias"))


@query("x12_duplicate_types", r"""WITH n AS (SELECT DISTINCT lower(regexp_replace(p_name, '[\s_-]+.*', '')) AS t FROM part UNION SELECT DISTINCT lower(regexp_replace(p_name, '[\s_-]+', '', 'g')) FROM part)
SELECT a.t AS a, b.t AS b FROM n a JOIN n b ON a.t < b.t AND (contains(a.t, b.t) OR contains(b.t, a.t))""")
def duplicate_types(t):
    """Distinct type names of which one contains the other."""
    first = t.part.select(F.lower(F.regexp_replace("p_name", r"[\s_-]+.*", "")).alias("name"))
    n = first.union(t.part.select(F.lower(F.regexp_replace("p_name", r"[\s_-]+", "")))).distinct()
    return contained_pairs(n).select(F.least("outer", "inner").alias("a"), F.greatest("outer", "inner").alias("b"))


BIGRAMS = "list_distinct(list_transform(range(1, greatest(length({0}), 1)), lambda i: substr({0}, i, 2)))"


@query("x13_bigram_jaccard", f"""WITH s AS (SELECT p_partkey, {BIGRAMS.format('p_name')} AS t FROM part)
SELECT a.p_partkey, round(CASE WHEN len(list_distinct(a.t || b.t)) = 0 THEN 1.0 ELSE len(list_intersect(a.t, b.t)) / len(list_distinct(a.t || b.t))::DOUBLE END, 9) AS jaccard FROM s a JOIN s b ON b.p_partkey = a.p_partkey + 1""")
def bigram_jaccard(t):
    s = t.part.select("p_partkey", T.char_bigrams(F.col("p_name")).alias("t"))
    b = s.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("t").alias("u"))
    return s.join(b, "p_partkey").select("p_partkey", F.round(T.set_jaccard(F.col("t"), F.col("u")), 9).alias("jaccard"))


@query("x14_bigram_overlap", f"SELECT item_id, round(len(list_intersect({BIGRAMS.format('text')}, {BIGRAMS.format(chr(39) + 'the other thing' + chr(39))})) / 11.0::DOUBLE, 9) AS overlap FROM benchmark")
def bigram_overlap(t):
    return t.benchmark.select("item_id", F.round(T.bigram_overlap(F.col("text"), F.lit("the other thing")), 9).alias("overlap"))


@query("x14_bigram_overlap_documents", SQL["x14_bigram_overlap"].replace("benchmark", "documents").replace("item_id", "doc_id"))
def bigram_overlap_documents(t):
    return t.documents.select("doc_id", F.round(T.bigram_overlap(F.col("text"), F.lit("the other thing")), 9).alias("overlap"))


@query("x16_truncate", "SELECT doc_id, sha256(CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END) AS h, substr(text, 1, 120) AS preview FROM documents")
def truncate(t):
    return t.documents.select("doc_id", F.sha2(T.truncate(F.col("text"), 200), 256).alias("h"), F.substring("text", 1, 120).alias("preview"))


@query("x17_context_window", """SELECT doc_id, CASE WHEN p = 0 THEN '' ELSE (CASE WHEN p - 40 > 1 THEN '...' ELSE '' END) || substr(text, greatest(p - 40, 1), least(p + length(n) + 39, length(text)) - greatest(p - 40, 1) + 1) || (CASE WHEN p + length(n) + 39 < length(text) THEN '...' ELSE '' END) END AS quote
FROM (SELECT doc_id, text, n, strpos(text, n) AS p FROM (SELECT doc_id, text, CASE lang WHEN 'en' THEN 'that' WHEN 'de' THEN 'und' WHEN 'fr' THEN 'que' ELSE 'para' END AS n FROM documents))""")
def context_window(t):
    name = F.when(F.col("lang") == "en", "that").when(F.col("lang") == "de", "und").when(F.col("lang") == "fr", "que").otherwise("para")
    return t.documents.select("doc_id", T.context_window(F.col("text"), name).alias("quote"))


@query("x20_json_paths", """SELECT event_id, (props->>'$.k')::BIGINT AS k, json_valid(props) AS valid FROM events""")
def json_paths(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.try_parse_json("props").isNotNull().alias("valid"))


@query("x25_facets", "SELECT doc_id, 'lang=' || lang || ';source=' || source || ';size=' || CASE WHEN n_chars < 1000 THEN 'short' WHEN n_chars < 5000 THEN 'medium' ELSE 'long' END AS facets FROM documents")
def facets(t):
    m = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"), F.lit("size"), F.when(F.col("n_chars") < 1000, "short").when(F.col("n_chars") < 5000, "medium").otherwise("long"))
    return t.documents.select("doc_id", F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("facets"))


@query("x26_row_verbalizer", "SELECT p_partkey, 'p_name为' || p_name || '，p_brand为' || p_brand || '，p_type为' || p_type || '。' AS sentence FROM part")
def row_verbalizer(t):
    cells = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in ("p_name", "p_brand", "p_type")])
    said = F.transform(F.filter(cells, lambda x: F.coalesce(x["v"], F.lit("")) != ""), lambda x: F.concat(x["c"], F.lit("为"), x["v"]))
    return t.part.select("p_partkey", F.concat(F.array_join(said, "，"), F.lit("。")).alias("sentence"))


@query("x33_trigram_similarity", r"""WITH t AS (SELECT item_id, list_distinct(flatten(list_transform(list_filter(string_split_regex(lower(text), '[^0-9a-zà-öø-ÿ]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS g FROM benchmark),
q AS (SELECT g AS q FROM t WHERE item_id = (SELECT min(item_id) FROM t))
SELECT item_id, round(len(list_intersect(g, q)) / len(list_distinct(g || q))::DOUBLE, 9) AS similarity FROM t, q""")
def trigram_similarity(t):
    g = t.benchmark.select("item_id", T.trigrams(F.col("text")).alias("g"))
    q = g.orderBy("item_id").limit(1).select(F.col("g").alias("q"))
    return g.join(F.broadcast(q)).select("item_id", F.round(T.set_jaccard(F.col("g"), F.col("q")), 9).alias("similarity"))


@query("x33_trigram_similarity_documents", SQL["x33_trigram_similarity"].replace("benchmark", "documents").replace("item_id", "doc_id"))
def trigram_similarity_documents(t):
    d = t.documents.select("doc_id", "text")
    q = d.orderBy("doc_id").limit(1).select(T.trigrams(F.col("text")).alias("q"))
    return sparse.set_similarity(d, q, sparse.trigrams).select("doc_id", F.round("similarity", 9).alias("similarity"))


@query("x36_state_token", "SELECT o_orderkey, sha256(o_orderkey::VARCHAR || chr(10) || o_custkey::VARCHAR || chr(10) || o_orderstatus || chr(10) || o_orderpriority) AS token FROM orders")
def state_token(t):
    return t.orders.select("o_orderkey", T.state_token(F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus"), F.col("o_orderpriority")).alias("token"))


@query("x37_title", r"SELECT page_id, coalesce(nullif(trim(regexp_extract(m, '(?m)^# (.+)$', 1)), ''), url) AS title FROM (SELECT page_id, url, '# ' || regexp_extract(html, '<title>([^<]*)</title>', 1) AS m FROM pages)")
def title(t):
    p = t.pages.withColumn("m", F.concat(F.lit("# "), F.regexp_extract("html", "<title>([^<]*)</title>", 1)))
    return p.select("page_id", T.title_of(F.col("m"), F.col("url")).alias("title"))


@query("x39_rule_entities", r"SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[0-9]{1,3}(?:\.[0-9]{1,3}){3}'))) AS entity, 'address' AS kind FROM documents")
def rule_entities(t):
    """Distinct matches of a rule's expression in each document."""
    found = F.regexp_extract_all("text", F.lit(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"), 0)
    return t.documents.select("doc_id", F.explode(F.array_distinct(found)).alias("entity"), F.lit("address").alias("kind"))


@query("x40_dictionary_match", r"SELECT doc_id, regexp_matches(text, '(?i)(^|[^0-9A-Za-zÀ-ÿ])the($|[^0-9A-Za-zÀ-ÿ])') AS has_the, regexp_matches(text, '(?i)(^|[^0-9A-Za-zÀ-ÿ])und($|[^0-9A-Za-zÀ-ÿ])') AS has_und FROM documents")
def dictionary_match(t):
    """Whole-word, case-blind matches of dictionary terms."""
    return t.documents.select("doc_id", *[F.col("text").rlike(f"(?i)(^|[^0-9A-Za-zÀ-ÿ]){w}($|[^0-9A-Za-zÀ-ÿ])").alias(f"has_{w}") for w in ("the", "und")])


@query("x41_epoch", "SELECT event_id, (epoch_us(ts) // 1000)::BIGINT AS ms, strftime(ts, '%Y-%m-%d %H:%M:%S') AS iso FROM events")
def epoch(t):
    """ISO text parsed back to a timestamp, and its milliseconds."""
    iso = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return t.events.select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), iso.alias("iso"))
