"""Queries for predicates, joins, aggregates, windows, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import scoring as S
from ..operators import relational as R

# predicates


@query("f02_scope_semi", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def scope_semi(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey").join(t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")


@query("f03_facet_in", "SELECT doc_id, lang, source FROM documents WHERE lang IN ('de', 'fr') AND source IN ('src1', 'src2', 'src3')")
def facet_in(t):
    return t.documents.where(F.col("lang").isin("de", "fr") & F.col("source").isin("src1", "src2", "src3")).select("doc_id", "lang", "source")


@query("f07_any_token", "SELECT doc_id FROM documents WHERE len(list_intersect(regexp_extract_all(lower(text), '[一-鿿]|[0-9A-Za-zÀ-ÖØ-öø-ÿ]+'), ['license', 'version', 'released'])) > 0")
def any_token(t):
    from ..functions.text import tokens

    return t.documents.where(F.arrays_overlap(tokens(F.col("text")), F.array(*map(F.lit, ("license", "version", "released"))))).select("doc_id")


@query("f09_like_any", "SELECT doc_id FROM documents WHERE text LIKE '%password%' OR text LIKE '%License%' OR text LIKE '%@mail%'")
def like_any(t):
    return t.documents.where(F.col("text").contains("password") | F.col("text").contains("License") | F.col("text").contains("@mail")).select("doc_id")


@query("f11_subtree", "SELECT page_id, url FROM pages WHERE url = 'http://ththre.example.com' OR url LIKE 'http://ththre.example.com/%'")
def subtree(t):
    p = "http://ththre.example.com"
    return t.pages.where((F.col("url") == p) | F.col("url").startswith(p + "/")).select("page_id", "url")


@query("f13_null_safe", "SELECT l.doc_id, l.quality::BIGINT AS quality FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE quality END AS quality FROM labels) l JOIN (SELECT DISTINCT CASE WHEN quality = 1 THEN NULL ELSE quality END AS q FROM labels) r ON l.quality IS NOT DISTINCT FROM r.q")
def null_safe(t):
    l = t.labels.select("doc_id", F.when(F.col("doc_id") % 3 == 0, None).otherwise(F.col("quality")).alias("quality"))
    r = t.labels.select(F.when(F.col("quality") == 1, None).otherwise(F.col("quality")).alias("q")).distinct()
    return l.join(r, F.col("quality").eqNullSafe(F.col("q"))).select("doc_id", "quality")


@query("f14_unfinished", "SELECT a.event_id, a.user_id FROM events a WHERE a.event_type = 'click' AND NOT EXISTS (SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'purchase' AND b.ts > a.ts)")
def unfinished(t):
    """Clicks that no purchase of the same user follows: a purchase follows if the last one is later."""
    last = t.events.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("last"))
    return t.events.where("event_type = 'click'").join(last, "user_id", "left").where("last IS NULL OR last <= ts").select("event_id", "user_id")


@query("f15_dimension_guard", "SELECT vec_id, label::BIGINT AS label FROM embeddings WHERE len(embedding) = 64")
def dimension_guard(t):
    return t.embeddings.where(F.size("embedding") == 64).select("vec_id", "label")


@query("f16_visible", """SELECT s_suppkey, CASE WHEN s_acctbal > 9000 THEN 'public' WHEN s_nationkey = 7 THEN 'owner' ELSE 'member' END AS why FROM supplier s
WHERE s_acctbal > 9000 OR s_nationkey = 7 OR EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = s.s_nationkey AND c.c_mktsegment = 'MACHINERY' AND c.c_acctbal > 9500)""")
def visible(t):
    """Public, owned, or shared through membership."""
    members = t.customer.where("c_mktsegment = 'MACHINERY' AND c_acctbal > 9500").select(F.col("c_nationkey").alias("s_nationkey"))
    d = R.exists_flag(t.supplier, members, "s_nationkey", "member").where("s_acctbal > 9000 OR s_nationkey = 7 OR member")
    return d.select("s_suppkey", F.when(F.col("s_acctbal") > 9000, "public").when(F.col("s_nationkey") == 7, "owner").otherwise("member").alias("why"))


@query("f22_question_pruning", r"SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '^Q[0-9]+[:.]\s*', ''))), lambda x: length(x) >= 5)[1] AS first_question FROM documents")
def question_pruning(t):
    q = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(x, r"^Q[0-9]+[:.]\s*", ""))), lambda x: F.length(x) >= 5)
    return t.documents.select("doc_id", F.try_element_at(q, F.lit(1)).alias("first_question"))


# joins


@query("j02_left_chain", """SELECT o_orderkey, c_name, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey < 20 LEFT JOIN region ON n_regionkey = r_regionkey""")
def left_chain(t):
    d = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    d = d.join(t.nation.where("n_nationkey < 20"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return d.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("o_orderkey", "c_name", "n_name", "r_name")


@query("j03_two_roles", "SELECT c.c_custkey, s.s_suppkey, a.n_name AS customer_nation, b.n_name AS supplier_nation, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c.c_custkey JOIN supplier s ON l_suppkey = s.s_suppkey JOIN nation a ON c.c_nationkey = a.n_nationkey JOIN nation b ON s.s_nationkey = b.n_nationkey GROUP BY ALL")
def two_roles(t):
    a = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("customer_nation"))
    b = t.nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("supplier_nation"))
    c = t.customer.join(a, "c_nationkey").select(F.col("c_custkey"), "customer_nation")
    s = t.supplier.join(b, "s_nationkey").select("s_suppkey", "supplier_nation")
    d = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("s_suppkey")).join(t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey")), "o_orderkey")
    n = d.groupBy("c_custkey", "s_suppkey").agg(F.count("*").alias("lines"))  # before the dimension joins
    return n.join(c, "c_custkey").join(s, "s_suppkey").select("c_custkey", "s_suppkey", "customer_nation", "supplier_nation", "lines")


@query("j05_latest_row", """SELECT c_custkey, o_orderkey, o_orderdate FROM customer LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1) ON c_custkey = o_custkey""")
def latest_row(t):
    o = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate")
    return R.latest_join(t.customer.select("c_custkey"), o, "c_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")])


@query("j06_exists_flag", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS has_pending FROM customer")
def exists_flag(t):
    return R.exists_flag(t.customer.select("c_custkey"), t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "has_pending")


@query("j08_either_end", "WITH e AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem) SELECT node, count(DISTINCT other) AS degree FROM (SELECT 's' || a AS node, 'p' || b AS other FROM e UNION ALL SELECT 'p' || b, 's' || a FROM e) GROUP BY node")
def either_end(t):
    e = t.lineitem.select(F.concat(F.lit("s"), "l_suppkey").alias("a"), F.concat(F.lit("p"), "l_partkey").alias("b")).distinct()
    return R.both_directions(e, "a", "b").groupBy("node").agg(F.count_distinct("other").alias("degree"))


@query("j09_window_join", """SELECT a.conv_id, a.turn AS target, b.turn AS turn, CASE WHEN b.turn < a.turn THEN 'before' WHEN b.turn > a.turn THEN 'after' ELSE 'target' END AS role FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 2 AND a.turn + 2 WHERE a.role = 'assistant'""")
def window_join(t):
    a = t.conversations.where("role = 'assistant'").select("conv_id", F.col("turn").alias("target"))
    d = R.window_join(a, t.conversations.select("conv_id", "turn"), ["conv_id"], "target", "turn", 2)
    return d.select("conv_id", "target", "turn", F.when(F.col("turn") < F.col("target"), "before").when(F.col("turn") > F.col("target"), "after").otherwise("target").alias("role"))


@query("j11_anti", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti(t):
    return t.customer.select("c_custkey", "c_name").join(t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("j12_alias_lookup", "SELECT e.event_id, coalesce(m.canonical, e.event_type) AS canonical, m.canonical IS NOT NULL AS resolved FROM events e LEFT JOIN (VALUES ('buy', 'purchase'), ('click', 'view'), ('signup', 'registration')) m(alias, canonical) ON lower(trim(e.event_type)) = m.alias")
def alias_lookup(t):
    from ..functions.text import alias_form

    m = t.spark.createDataFrame([("buy", "purchase"), ("click", "view"), ("signup", "registration")], "alias string, canonical string")
    d = t.events.join(F.broadcast(m), alias_form(F.col("event_type")) == F.col("alias"), "left")
    return d.select("event_id", F.coalesce("canonical", "event_type").alias("canonical"), F.col("canonical").isNotNull().alias("resolved"))


@query("j13_ordered_pairs", "SELECT p1.p_type AS head, p2.p_type AS tail, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey JOIN part p1 ON a.l_partkey = p1.p_partkey JOIN part p2 ON b.l_partkey = p2.p_partkey WHERE p1.p_type <> p2.p_type GROUP BY ALL")
def ordered_pairs(t):
    """Ordered pairs of types inside an order. Rows combine to counts by (order, type) first, so pairs are of distinct
    types only."""
    c = t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey").groupBy("l_orderkey", "p_type").agg(F.count("*").alias("c"))
    h, l = c.select("l_orderkey", F.col("p_type").alias("head"), F.col("c").alias("x")), c.select("l_orderkey", F.col("p_type").alias("tail"), F.col("c").alias("y"))
    return h.join(l, "l_orderkey").where("head <> tail").groupBy("head", "tail").agg(F.sum(F.col("x") * F.col("y")).alias("n"))


@query("j14_wildcard_pairs", """WITH pairs AS (SELECT DISTINCT o_orderstatus AS h, l_returnflag AS t FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
SELECT h, t, relation FROM pairs JOIN (VALUES ('connects', 'P', 'R'), ('part_of', '*', 'N'), ('any', '*', '*'), ('none', 'Z', '*')) r(relation, rh, rt) ON (rh = '*' OR rh = h) AND (rt = '*' OR rt = t)""")
def wildcard_pairs(t):
    pairs = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("h")).join(t.lineitem.select("l_orderkey", F.col("l_returnflag").alias("t")), "l_orderkey").select("h", "t").distinct()
    rules = t.spark.createDataFrame([("connects", "P", "R"), ("part_of", "*", "N"), ("any", "*", "*"), ("none", "Z", "*")], "relation string, rh string, rt string")
    return pairs.join(F.broadcast(rules), F.expr("(rh = '*' OR rh = h) AND (rt = '*' OR rt = t)")).select("h", "t", "relation")


@query("j20_as_of", """SELECT p.event_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT max(event_id) AS event_id, user_id, ts FROM events WHERE event_type = 'view' GROUP BY user_id, ts) v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def as_of(t):
    v = t.events.where("event_type = 'view'").groupBy("user_id", F.col("ts").alias("view_ts")).agg(F.max("event_id").alias("view_id"))
    return R.latest_not_after(t.events.where("event_type = 'purchase'").select("user_id", "event_id", "ts"), v, ["user_id"], "ts", "view_ts").select("event_id", "view_id")


# aggregates


@query("a02_distinct_totals", "SELECT count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, count(*) AS lines FROM lineitem")
def distinct_totals(t):
    return t.lineitem.agg(F.count_distinct("l_orderkey").alias("orders"), F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"), F.count("*").alias("lines"))


@query("a03_distinct_by_group", "SELECT p_type, count(DISTINCT l_orderkey) AS orders FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type")
def distinct_by_group(t):
    return t.lineitem.select("l_partkey", "l_orderkey").join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey").groupBy("p_type").agg(F.count_distinct("l_orderkey").alias("orders"))


@query("a05_by_status", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def by_status(t):
    return t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("a06_filtered", "SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS errors, round(coalesce(sum(value) FILTER (WHERE event_type = 'purchase'), 0), 4) AS spent, round(avg(value) FILTER (WHERE event_type = 'view'), 6) AS mean_view FROM events GROUP BY user_id")
def filtered(t):
    v = lambda k: F.when(F.col("event_type") == k, F.col("value"))
    return t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.round(F.coalesce(F.sum(v("purchase")), F.lit(0.0)), 4).alias("spent"), F.round(F.avg(v("view")), 6).alias("mean_view"))


@query("a07_set_of", "SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderpriority) FILTER (WHERE o_orderstatus = 'F')), ',') AS priorities FROM orders GROUP BY o_custkey HAVING count(*) FILTER (WHERE o_orderstatus = 'F') > 0")
def set_of(t):
    return t.orders.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("priorities"))


@query("a08_rollup", "SELECT l_returnflag, l_linestatus, l_suppkey, year(l_shipdate)::BIGINT AS y, round(sum(l_quantity), 2) AS qty, count(*) AS n, round(avg(l_discount), 6) AS disc FROM lineitem GROUP BY ALL")
def rollup(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus", "l_suppkey", F.year("l_shipdate").alias("y")).agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.count("*").alias("n"), F.round(F.avg("l_discount"), 6).alias("disc"))


@query("a09_members", "SELECT o_custkey, string_agg(o_orderkey::VARCHAR || ':' || o_orderstatus, ',' ORDER BY o_orderkey) AS members FROM orders GROUP BY o_custkey")
def members(t):
    m = F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus")))
    return t.orders.groupBy("o_custkey").agg(F.array_join(F.transform(m, lambda s: F.concat_ws(":", s["o_orderkey"].cast("string"), s["o_orderstatus"])), ",").alias("members"))


@query("a11_section_shares", """WITH s AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY lang) AS share, sum(n) OVER (PARTITION BY lang) AS total, row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) AS rk FROM s)
SELECT lang, source, round(share, 9) AS share, (share >= 0.6 AND total >= 5) AS hard FROM p WHERE share >= 0.04 AND rk <= 3""")
def section_shares(t):
    """The largest sections of a language that hold a minimal share; hard ones dominate it."""
    w = Window.partitionBy("lang")
    s = t.documents.groupBy("lang", "source").agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(w)).withColumn("share", F.col("n") / F.col("total"))
    s = s.withColumn("rk", F.row_number().over(w.orderBy(F.desc("n"), "source"))).where("share >= 0.04 AND rk <= 3")
    return s.select("lang", "source", F.round("share", 9).alias("share"), ((F.col("share") >= 0.6) & (F.col("total") >= 5)).alias("hard"))


@query("a12_single_source", "SELECT c_nationkey::BIGINT AS c_nationkey, min(c_mktsegment) AS segment FROM customer WHERE c_acctbal > 9900 GROUP BY c_nationkey HAVING count(DISTINCT c_mktsegment) = 1")
def single_source(t):
    d = t.customer.where("c_acctbal > 9900").groupBy("c_nationkey").agg(F.count_distinct("c_mktsegment").alias("k"), F.min("c_mktsegment").alias("segment"))
    return d.where("k = 1").select("c_nationkey", "segment")


@query("a13_duration", "SELECT user_id, event_type, epoch_us(max(ts)) // 1000 - epoch_us(min(ts)) // 1000 AS ms FROM events GROUP BY ALL")
def duration(t):
    m = lambda c: F.unix_millis(c.cast("timestamp"))
    return t.events.groupBy("user_id", "event_type").agg((m(F.max("ts")) - m(F.min("ts"))).alias("ms"))


@query("a14_stage_pivot", "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'purchase') AS purchase, count(*) FILTER (WHERE event_type = 'error') AS error FROM events GROUP BY user_id")
def stage_pivot(t):
    return t.events.groupBy("user_id").agg(*[F.count_if(F.col("event_type") == k).alias(k) for k in ("click", "purchase", "error")])


NPMI_SQL = """WITH m AS (SELECT DISTINCT l_orderkey AS seg, p_brand AS e FROM lineitem JOIN part ON l_partkey = p_partkey), n AS (SELECT count(DISTINCT seg) AS n FROM m),
c AS (SELECT e, count(*) AS c FROM m GROUP BY e), b AS (SELECT x.e AS head, y.e AS tail, count(*) AS n_both FROM m x JOIN m y ON x.seg = y.seg AND x.e < y.e GROUP BY ALL)
SELECT head, tail, n_both, round(CASE WHEN n_both = n THEN 1.0 ELSE greatest(-1.0, least(1.0, ln((n_both / n) / ((h.c / n) * (t.c / n))) / -ln(n_both / n))) END, 9) AS npmi FROM b JOIN c h ON head = h.e JOIN c t ON tail = t.e, n"""


@query("a16_npmi", NPMI_SQL)
def npmi(t):
    from ..operators.graph import cooccurrence

    m = t.lineitem.select("l_orderkey", "l_partkey").join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    d = cooccurrence(m.select(F.col("l_orderkey").alias("segment"), F.col("p_brand").alias("entity")))
    return d.select("head", "tail", "n_both", F.round("npmi", 9).alias("npmi"))


@query("a21_recall", "SELECT round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END), 9) AS recall, count(*) FILTER (WHERE quality = 0) AS misses FROM labels")
def recall(t):
    return t.labels.agg(F.round(F.avg((F.col("quality") == 1).cast("double")), 9).alias("recall"), F.count_if(F.col("quality") == 0).alias("misses"))


@query("a22_count_per_parent", "SELECT n_nationkey::BIGINT AS n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers FROM nation")
def count_per_parent(t):
    c = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    return t.nation.select("n_nationkey").join(c, "n_nationkey", "left").select("n_nationkey", F.coalesce("customers", F.lit(0)).alias("customers"))


@query("a25_success_rate", "SELECT event_type, round(count(*) FILTER (WHERE value > 20) / count(*), 4) AS rate, round(avg(value), 1) AS mean_value FROM events GROUP BY event_type")
def success_rate(t):
    return t.events.groupBy("event_type").agg(F.round(F.count_if(F.col("value") > 20) / F.count("*"), 4).alias("rate"), F.round(F.avg("value"), 1).alias("mean_value"))


# windows and keep-one


@query("w01_window_max", "SELECT o_orderkey, o_orderdate = max(o_orderdate) OVER (PARTITION BY o_custkey) AS is_latest FROM orders")
def window_max(t):
    return t.orders.select("o_orderkey", (F.col("o_orderdate") == F.max("o_orderdate").over(Window.partitionBy("o_custkey"))).alias("is_latest"))


@query("w02_distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def distinct_on(t):
    return R.best_of(t.orders, ["o_custkey"], [F.col("o_totalprice"), -F.col("o_orderkey")], ["o_orderkey", "o_totalprice"])


@query("w04_rank_in_source", "SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rk FROM documents")
def rank_in_source(t):
    return R.spread_rank(t.documents.select("doc_id", "source", "n_chars"), ["source"], "n_chars", "doc_id").select("doc_id", "source", F.col("rank").alias("rk"))


@query("w06_sliding_windows", "WITH s AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations) SELECT conv_id, turn, unnest(CASE WHEN i % 2 = 0 AND i > 0 THEN [i // 2 - 1, i // 2] ELSE [i // 2] END) AS w FROM s")
def sliding_windows(t):
    from ..operators.discourse import overlapping_windows

    return overlapping_windows(t.conversations.select("conv_id", "turn"), ["conv_id"], "turn", 3).select("conv_id", "turn", F.col("window").alias("w"))


@query("w07_neighbours", "SELECT conv_id, turn, lag(role) OVER w AS before, lead(role) OVER w AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def neighbours(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return t.conversations.select("conv_id", "turn", F.lag("role").over(w).alias("before"), F.lead("role").over(w).alias("after"))


@query("w10_status_pick", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 END, ts, event_id) AS rn FROM events) WHERE rn = 1")
def status_pick(t):
    order = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 2).otherwise(3)
    return R.first_per(t.events, ["user_id"], [order, F.col("ts"), F.col("event_id")]).select("user_id", "event_id")


# top-k and sets


@query("t03_multi_key", "SELECT p_partkey, p_size::BIGINT AS p_size, p_retailprice FROM part ORDER BY p_size, p_retailprice DESC, p_partkey LIMIT 50")
def multi_key(t):
    return t.part.orderBy("p_size", F.desc("p_retailprice"), "p_partkey").limit(50).select("p_partkey", "p_size", "p_retailprice")


@query("t05_page", "SELECT doc_id, lang FROM documents ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 20 OFFSET 40")
def page(t):
    return R.page(t.documents.select("doc_id", "lang", "n_chars"), [F.desc_nulls_last("n_chars"), F.col("doc_id")], 40, 20).select("doc_id", "lang")


@query("t06_queue_head", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 1")
def queue_head(t):
    return t.orders.where("o_orderstatus = 'P'").orderBy("o_orderpriority", "o_orderdate", "o_orderkey").limit(1).select("o_orderkey")


@query("u03_reachable", """WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS a, o_custkey AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey), r AS (SELECT b AS node, 1 AS hop FROM e WHERE a = 1 UNION SELECT e2.b, r.hop + 1 FROM r JOIN e e1 ON e1.b = r.node JOIN e e2 ON e1.a = e2.a WHERE r.hop < 2)
SELECT node, min(hop)::BIGINT AS hop FROM r GROUP BY node""")
def reachable(t):
    """Customers that share suppliers, up to two steps away; each step keeps only nodes not met before."""
    e = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("a")).join(t.orders.select("o_orderkey", F.col("o_custkey").alias("b")), "o_orderkey").select("a", "b").distinct()
    first = e.where("a = 1").select(F.col("b").alias("node")).distinct()
    via = e.join(first.select(F.col("node").alias("b")), "b", "left_semi").select("a").distinct()
    second = e.join(via, "a", "left_semi").select(F.col("b").alias("node")).distinct().join(first, "node", "left_anti")
    return first.withColumn("hop", F.lit(1)).unionByName(second.withColumn("hop", F.lit(2)))


@query("u06_intersection", "SELECT c_custkey FROM customer WHERE c_acctbal > 0 INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def intersection(t):
    return t.customer.where("c_acctbal > 0").select("c_custkey").intersect(t.orders.where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")))


@query("u07_difference", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def difference(t):
    return t.customer.select("c_custkey").subtract(t.orders.where("o_totalprice > 300000").select("o_custkey"))


# scores


@query("x28_confidence", "SELECT c_custkey, round(greatest(0, least(1, (c_acctbal / 10000 + 1) / 2)), 9) AS confidence FROM customer")
def confidence(t):
    return t.customer.select("c_custkey", F.round(S.npmi_confidence(F.col("c_acctbal") / 10000), 9).alias("confidence"))


@query("x29_graph_score", "SELECT p_partkey, round(least(1.0, 0.85 * power(0.6, p_size % 4) * (CASE WHEN p_retailprice - 1000 <= 0 THEN 0.01 ELSE (p_retailprice - 1000) / 2000 END) * (CASE WHEN p_type = 'ECONOMY' THEN 1.1 ELSE 1.0 END)), 9) AS score FROM part")
def graph_score(t):
    return t.part.select("p_partkey", F.round(S.graph_score(F.col("p_size") % 4, (F.col("p_retailprice") - 1000) / 2000, F.col("p_type") == "ECONOMY"), 9).alias("score"))


@query("x35_backoff", "SELECT p_partkey, least(power(2, p_size % 12), 300)::DOUBLE AS wait, round(1.0 / (1.0 + p_size % 5), 9) AS expansion FROM part")
def backoff(t):
    return t.part.select("p_partkey", S.backoff(2.0, F.col("p_size") % 12, 300.0).alias("wait"), F.round(S.expansion_score(F.col("p_size") % 5), 9).alias("expansion"))


@query("x42_status", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'published' WHEN o_totalprice < 1000 THEN 'failed' WHEN o_orderstatus = 'O' THEN 'mined' WHEN o_orderpriority = '1-URGENT' THEN 'mining' ELSE 'uploaded' END AS status FROM orders")
def status(t):
    s = F.when(F.col("o_orderstatus") == "F", "published").when(F.col("o_totalprice") < 1000, "failed").when(F.col("o_orderstatus") == "O", "mined").when(F.col("o_orderpriority") == "1-URGENT", "mining").otherwise("uploaded")
    return t.orders.select("o_orderkey", s.alias("status"))
