"""Retrieval over batches of queries: routes, fusion, reranking, query understanding, cache.

A route gives candidates (query_id, unit_id, score, source); fusion and reranking work on unions of routes. Every
order ends in unit_id, so results are the same on every run.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import sparse
from .dense import blocked_top
from .relational import bounded, is_small, settled, spread_rank

RRF_K = 60
CANDIDATE = ["query_id", "unit_id", "score", "source"]
#: Routes, weights and sizes by the query's complexity.
ROUTES = {
    "simple": [("entity_exact", 1.5, 20), ("lexical_bm25", 1.0, 50)],
    "medium": [("lexical_bm25", 1.0, 50), ("dense_vector", 0.9, 50)],
    "complex": [("lexical_bm25", 1.0, 50), ("dense_vector", 0.9, 50), ("entity_exact", 0.7, 20), ("entity_graph", 0.6, 20)],
}
#: Intents that are reranked by the cascade whatever their complexity, and the relations they expand along.
CASCADE = ("troubleshooting", "comparison", "procedure")
EXPANSION = {
    "troubleshooting": ("causes", "results_in", "enables", "conditions", "elaborates", "backgrounds"),
    "comparison": ("contrasts_with", "parallels", "elaborates"),
    "procedure": ("purposes", "enables", "sequences", "conditions", "elaborates"),
}
#: Intents in the order in which they are tried, with the substrings that show them.
INTENTS = {
    "comparison": ("区别", "差异", "对比", "比较", "不同"),
    "troubleshooting": ("故障", "排查", "告警", "错误", "异常", "处理"),
    "procedure": ("步骤", "流程", "操作", "怎么做", "如何操作"),
    "concept_lookup": ("是什么", "什么是", "概念", "介绍", "概述", "原理"),
    "navigational": ("在哪里", "如何找到", "路径"),
}
#: Labels of language models and their internal intents; any other is general.
MODEL_INTENTS = {
    "conceptual": "concept_lookup", "factoid": "general", "procedural": "procedure", "comparative": "comparison", "troubleshooting": "troubleshooting",
    "navigational": "general", "general": "general", "concept_lookup": "concept_lookup", "procedure": "procedure", "comparison": "comparison", "command_usage": "command_usage",
}
#: Commands as verb and object, and the words that stand for a verb.
COMMAND = r"(?i)(ADD|MOD|DEL|SET|SHOW|LST|DSP|REG|DEREG)\s+([A-Z][A-Z0-9_]*)"
VERBS = {
    "新增": "ADD", "添加": "ADD", "创建": "ADD", "修改": "MOD", "更改": "MOD", "编辑": "MOD", "删除": "DEL", "移除": "DEL",
    "查询": "SHOW", "查看": "DSP", "显示": "LST", "设置": "SET", "配置": "SET",
}
#: Network elements and products that narrow a query's scope.
ELEMENTS = ("AMF", "SMF", "UPF", "UDM", "PCF", "NRF", "AUSF", "BSF", "NSSF", "SCP", "UDSF", "UDR")
PRODUCTS = ("UDG", "UNC", "CloudCore")
#: Words that are no keywords.
STOP = (
    "的", "了", "在", "是", "和", "与", "及", "或", "也", "都", "这", "那", "有", "没", "不", "会", "能", "要", "可以",
    "什么", "怎么", "如何", "哪些", "为什么", "吗", "呢", "啊", "个", "一", "到", "把", "被", "让", "给", "从", "对", "等",
    "请问", "帮我", "告诉", "知道", "想", "应该", "需要",
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "do", "does", "did", "has", "have", "had",
    "and", "or", "but", "not", "no", "in", "on", "at", "to", "of", "for", "with", "from", "by", "as",
    "what", "which", "how", "why", "when", "where", "who",
)


def top_per_query(candidates: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "unit_id")
    return candidates.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r")


def terms(query: Column, stop: Sequence[str] = ()) -> Column:
    """Distinct tokens of two characters and more (or one ideograph) that aren't stop words; all tokens if none is
    left."""
    every = F.array_distinct(T.tokens(query))
    kept = F.filter(every, lambda x: ((F.length(x) >= 2) | x.rlike(T.IDEOGRAPH)) & ~x.isin(*stop) if stop else (F.length(x) >= 2) | x.rlike(T.IDEOGRAPH))
    return F.when(F.size(kept) > 0, kept).otherwise(every)


def postings(units: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """token, unit_id, hits: how often a unit (unit_id, text) has a token; of the tokens of wanted (token) only, which are
    picked out before anything is shuffled."""
    every = units.select("unit_id", F.explode(T.tokens(F.col("text"))).alias("token"))
    every = every if wanted is None else every.join(bounded(wanted.select("token").distinct()), "token", "left_semi")
    return every.groupBy("token", "unit_id").agg(F.count("*").alias("hits"))


def full_text(queries: DataFrame, units: DataFrame, k: int = 20, most_hits: int = 5) -> DataFrame:
    """Units that have a term of the query; a term adds its hits (at most most_hits) over the number of terms."""
    q = queries.select("query_id", terms(F.col("text")).alias("terms"))
    found = sparse.term_top(q, units.where(F.col("text").isNotNull()).select("unit_id", F.col("text").alias("t0")), sparse.tokens, [(1, most_hits)], k)
    return found.withColumn("source", F.lit("fts")).select(*CANDIDATE)


#: How much a term counts in each field.
FIELDS = {"title": 1.0, "search_text": 0.4, "text": 0.2}
#: Times this, the weights are whole.
FIELD_SCALE = 5


def weighted_search(queries: DataFrame, units: DataFrame, k: int = 20, most_hits: int = 5) -> DataFrame:
    """Like full_text over several fields: a term adds its hits (at most most_hits) in each field, times the field's
    weight, over the number of terms, to nine decimals. units: unit_id and the columns of FIELDS."""
    q = queries.select("query_id", terms(F.col("text")).alias("terms"))
    u = units.select("unit_id", *[F.col(c).alias(f"t{i}") for i, c in enumerate(FIELDS)])
    found = sparse.term_top(q, u, sparse.tokens, [(round(w * FIELD_SCALE), most_hits) for w in FIELDS.values()], k, FIELD_SCALE, 9)
    return found.withColumn("source", F.lit("fts")).select(*CANDIDATE)


def search_terms(queries: DataFrame) -> DataFrame:
    """query_id, words: the keywords and the words of the sub-queries, in order and once each; the whole text if there
    are none. queries: query_id, text, keywords, sub_queries (arrays)."""
    parts = F.flatten(F.transform(F.coalesce("sub_queries", F.array().cast("array<string>")), lambda s: F.split(s, r"\s+")))
    words = F.array_distinct(F.filter(F.concat(F.coalesce("keywords", F.array().cast("array<string>")), parts), lambda w: F.trim(w) != ""))
    return queries.select("query_id", F.when(F.size(words) > 0, words).otherwise(F.array("text")).alias("words"))


def trigram_sets(units: DataFrame) -> DataFrame:
    """unit_id, grams, n: the distinct trigrams of each text and their number; texts without any are left out."""
    return units.select("unit_id", T.trigrams(F.col("text")).alias("grams")).withColumn("n", F.size("grams")).where("n > 0")


def trigram_index(sets: DataFrame) -> DataFrame:
    """gram, n, unit_id: the inverted index of trigram sets. Write it, and pass what is read again, to serve many batches."""
    return sets.select(F.explode("grams").alias("gram"), "n", "unit_id")


def similar_texts(queries: DataFrame, sets: DataFrame, threshold: float = 0.3, index: DataFrame | None = None) -> DataFrame:
    """query_id, unit_id, score: units whose trigrams have at least this Jaccard similarity with the query's text.

    A text of m trigrams is that similar to sets of threshold * m to m / threshold trigrams only, and shares one of any
    m - ceil(threshold * m) + 1 of its own with each: its rarest ones are looked up in the index, by size, and only what is found
    there is compared as a whole."""
    q = queries.select("query_id", T.trigrams(F.col("text")).alias("q")).withColumn("m", F.size("q")).where("m > 0")
    ends = q.agg(F.min("m"), F.max("m")).first()
    t, slack = F.lit(threshold), F.lit(1e-9)
    some = sets.where(F.col("n").between(int(threshold * (ends[0] or 0)), int((ends[1] or 0) / threshold) + 1))
    index = trigram_index(some) if index is None else index
    own = q.select("query_id", "m", F.explode("q").alias("gram"))
    small = is_small(own)  # what is made of some of its rows is small then, too
    send = F.broadcast if small else (lambda df: df)
    frequency = index.join(send(own.select("gram").distinct()), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("f"))
    rarest = F.row_number().over(Window.partitionBy("query_id").orderBy(F.coalesce("f", F.lit(0)), "gram"))
    asked = own.join(send(frequency), "gram", "left").withColumn("r", rarest).where(F.col("f").isNotNull() & (F.col("r") <= F.col("m") - F.ceil(t * F.col("m") - slack) + 1))
    fits = (F.col("n") >= t * F.col("m") - slack) & (F.col("n") * t <= F.col("m") + slack)
    met = index.join(send(asked.select("query_id", "m", "gram")), "gram").where(fits).select("query_id", "unit_id").distinct()
    both = sets.join(met, "unit_id").join(send(q), "query_id")
    shared = F.size(F.array_intersect("grams", "q"))
    return both.select("query_id", "unit_id", (shared / (F.col("n") + F.col("m") - shared)).alias("score")).where(F.col("score") >= threshold)


def similar_top(queries: DataFrame, units: DataFrame, threshold: float = 0.3, k: int = 20) -> DataFrame:
    """query_id, unit_id, score: of the units whose trigrams have at least this Jaccard similarity with the query's text, each
    query's k most similar ones; found by products of tiles, without an index."""
    q = queries.select("query_id", T.trigrams(F.col("text")).alias("terms"))
    return sparse.term_top(q, units.select("unit_id", F.col("text").alias("t0")), sparse.trigrams, [(1, 1)], k, jaccard=threshold)


def containing_units(queries: DataFrame, units: DataFrame, k: int = 20) -> DataFrame:
    """query_id, unit_id, score: the share of the query's terms that stand somewhere in the unit's text, inside words too, if any
    does; each query's k best. A term lies in a text where it lies in one of its words, so pieces of the text's distinct words
    are looked up, of the lengths that terms have."""
    q = queries.select("query_id", terms(F.col("text")).alias("terms"))
    lengths = sorted(r.n for r in q.select(F.explode("terms").alias("t")).select(F.length("t").alias("n")).distinct().collect())
    return sparse.term_top(q, units.select("unit_id", F.col("text").alias("t0")), sparse.parts(lengths), [(1, 1)], k)


def full_text_ladder(queries: DataFrame, units: DataFrame, threshold: float = 0.3, k: int = 20, recall: int = 5) -> DataFrame:
    """query_id, unit_id, score, level: weighted terms (1), for queries without any hit the trigram similarity of the texts
    (2), and for those still without one the share of terms that the text contains (3); the first k * recall of each
    query. queries: query_id, text; units: unit_id and the columns of FIELDS."""
    most = k * recall
    plain = units.select("unit_id", F.coalesce("text", F.lit("")).alias("text"))
    levels = [
        lambda rest: weighted_search(rest, units, most),
        lambda rest: similar_top(rest, plain, threshold, most),
        lambda rest: containing_units(rest, plain, most),
    ]
    out, rest = None, queries
    for level, search in enumerate(levels, 1):
        found = settled(search(rest).select("query_id", "unit_id", "score", F.lit(level).alias("level")))
        out = found if out is None else out.unionByName(found)
        rest = settled(rest.join(found.select("query_id").distinct(), "query_id", "left_anti"))
        if rest.isEmpty():
            break
    return out


def dense(query_vectors: DataFrame, vectors: DataFrame, dimension: int, k: int = 20) -> DataFrame:
    """Greatest cosine among vectors of the dimension, for a batch of query vectors (query_id, q; scope and section if the
    queries have them). vectors: unit_id, v, and scope and section likewise. Queries whose filters leave nothing drop
    them, the section first."""
    filters = [c for c in ("scope", "section") if c in query_vectors.columns and c in vectors.columns]
    absent = {c: F.lit(None).cast("string") for c in ("scope", "section") if c not in filters}
    q = query_vectors.select("query_id", F.col("q").alias("v"), *filters).withColumns(absent)
    u = vectors.select("unit_id", "v", *filters).withColumns(absent)
    return blocked_top(q, u, dimension, k, relax=bool(filters)).withColumn("source", F.lit("dense"))


def entity_exact(queries: DataFrame, mentions: DataFrame, k: int = 20) -> DataFrame:
    """Units that mention one of the query's names, at a constant score, heavier units first. queries: query_id, name;
    mentions: unit_id, name, weight."""
    q = queries.select("query_id", T.alias_form(F.col("name")).alias("form")).distinct()
    d = mentions.withColumn("form", T.alias_form(F.col("name"))).join(bounded(q), "form").groupBy("query_id", "unit_id").agg(F.max("weight").alias("weight"))
    r = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("weight"), "unit_id"))
    return d.withColumn("r", r).where(F.col("r") <= k).select("query_id", "unit_id", F.lit(0.95).alias("score"), F.lit("entity").alias("source"))


def ranked(candidates: DataFrame, wide: bool = False) -> DataFrame:
    """Adds rank within (query, source), from 1. Lists of a bounded size take a window; wide ones, of any size, are ranked
    in bins that many tasks share."""
    if wide:
        return spread_rank(candidates, ["query_id", "source"], "score", "unit_id")
    return candidates.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "source").orderBy(F.desc("score"), "unit_id")))


def rrf(candidates: DataFrame, weights: Mapping[str, float] | None = None, k: int = RRF_K, wide: bool = False) -> DataFrame:
    """query_id, unit_id, score (best original), fused (sum of weight / (k + rank)), sources; by fused, then unit."""
    w = F.lit(1.0)
    if weights:
        w = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("source")], F.lit(1.0))
    d = ranked(candidates, wide).withColumn("part", w / (F.lit(k) + F.col("rank")))
    return d.groupBy("query_id", "unit_id").agg(F.max("score").alias("score"), F.sum("part").alias("fused"), F.array_sort(F.collect_set("source")).alias("sources"))


def identity_fusion(candidates: DataFrame) -> DataFrame:
    """The best score of each unit."""
    return candidates.groupBy("query_id", "unit_id").agg(F.max("score").alias("score"))


def expand_queries(queries: DataFrame, variants: DataFrame, most: int = 2, sub_queries: DataFrame | None = None, most_subs: int = 4) -> DataFrame:
    """The queries, their first `most` variants and, after these, their first `most_subs` sub-queries as one pool; variants
    and sub_queries: query_id, n (from 1), text."""
    own = queries.select("query_id", F.lit(0).alias("variant"), "text")
    out = own.unionByName(variants.where(F.col("n") <= most).select("query_id", F.col("n").cast("int").alias("variant"), "text"))
    if sub_queries is None:
        return out
    return out.unionByName(sub_queries.where(F.col("n") <= most_subs).select("query_id", (F.col("n") + most).cast("int").alias("variant"), "text"))


def pooled(candidates: DataFrame) -> DataFrame:
    """What a query's variants and sub-queries found as the query's own candidates, before fusion: of each route a unit's best
    score. candidates: query_id, variant, unit_id, score, source."""
    return candidates.groupBy("query_id", "unit_id", "source").agg(F.max("score").alias("score")).select(*CANDIDATE)


def query_entities(queries: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """query_id, type, name, normalized: every match of a domain's rules (type, pattern; type unknown if null), and the
    command unless a rule found it under its name."""
    text = F.coalesce("text", F.lit(""))
    command = queries.select("query_id", F.lit("command").alias("type"), command_of(text).alias("name")).where("name IS NOT NULL")
    if rules is None:
        return command.withColumn("normalized", F.col("name"))
    fine = bounded(rules.where(F.trim(F.coalesce("pattern", F.lit(""))) != "").select(F.coalesce("type", F.lit("unknown")).alias("type"), "pattern"))
    met = queries.select("query_id", text.alias("text")).join(fine)
    found = met.select("query_id", "type", F.explode(F.expr("regexp_extract_all(text, pattern, 0)")).alias("name"))
    rest = command.join(found.select("query_id", "name").distinct(), ["query_id", "name"], "left_anti").select("query_id", "type", "name")
    return found.unionByName(rest).withColumn("normalized", F.upper("name"))


def tiers(candidates: DataFrame, *conditions: Column) -> DataFrame:
    """Filter relaxation: of each query's candidates those that meet the longest prefix of conditions that any of them
    meets."""
    met = F.lit(0)
    so_far = F.lit(True)
    for c in conditions:
        so_far = so_far & F.coalesce(c, F.lit(False))
        met = met + so_far.cast("int")
    d = candidates.withColumn("__met", met)
    best = d.groupBy("query_id").agg(F.max("__met").alias("__met"))  # combines before the shuffle, whatever a query's size
    return d.join(best, ["query_id", "__met"]).select(*candidates.columns)


def cascade(candidates: DataFrame, model: DataFrame | None = None, llm: DataFrame | None = None) -> DataFrame:
    """Scores of the first reranker that has any for the query: model, then language model, then the fused score.
    model and llm: query_id, unit_id, score."""
    out = candidates
    score = F.col("score")
    for i, df in reversed([(1, model), (2, llm)]):
        if df is not None:
            out = out.join(df.select("query_id", "unit_id", F.col("score").alias(f"__s{i}")), ["query_id", "unit_id"], "left")
            # which queries have any score is an aggregate of the scores that met a candidate
            has = out.where(F.col(f"__s{i}").isNotNull()).select("query_id").distinct().withColumn(f"__h{i}", F.lit(True))
            out = out.join(has, "query_id", "left")
            score = F.when(F.col(f"__h{i}"), F.coalesce(F.col(f"__s{i}"), F.lit(0.0))).otherwise(score)
    return out.withColumn("score", score).select(*candidates.columns)


def rerank_finish(candidates: DataFrame, near: float = 0.9, least: float = 0.01, k: int = 10) -> DataFrame:
    """Keeps the best unit of a segment, halves headings and the like, removes near duplicates of better units, drops
    weak ones and cuts to k. candidates: query_id, unit_id, segment_id, block_type, text, score.

    The near-duplicate step is greedy (a unit is compared with kept ones only), so a query's candidates are one group:
    they are what its routes gave, which the routes' sizes bound."""
    w = Window.partitionBy("query_id", "segment_id").orderBy(F.desc("score"), "unit_id")
    d = candidates.withColumn("__r", F.row_number().over(w)).where("segment_id IS NULL OR __r = 1").drop("__r")
    d = d.withColumn("score", F.col("score") * F.when(F.col("block_type").isin("heading", "toc", "link"), 0.5).otherwise(1.0))

    def greedy(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "unit_id"], ascending=[False, True], kind="stable")
        kept: list[set[str]] = []
        mask = []
        for text in rows["text"].fillna(""):
            g = {text[i : i + 2] for i in range(len(text) - 1)}
            fine = not any(len(g & h) > near * len(g | h) for h in kept if g and h)
            mask.append(fine)
            if fine:
                kept.append(g)
        return rows[mask]

    d = d.groupBy("query_id").applyInPandas(greedy, d.schema).where(F.col("score") >= least)
    return top_per_query(d, k)


def semantic_cache(queries: DataFrame, cache: DataFrame, now: Column, dimension: int, hours: int = 24, threshold: float = 0.92) -> DataFrame:
    """query_id, entry_id, similarity of the nearest live entry of the same scope, where it is near enough. queries:
    query_id, scope, q; cache: entry_id, scope, v, created_at."""
    live = cache.where(F.col("created_at") > now - F.expr(f"INTERVAL {int(hours)} HOURS"))
    none = F.lit(None).cast("string")
    asked = queries.select("query_id", "scope", none.alias("section"), F.col("q").alias("v"))
    there = live.select(F.col("entry_id").alias("unit_id"), "scope", none.alias("section"), "v")
    best = blocked_top(asked, there, dimension, 1)
    return best.select("query_id", F.col("unit_id").alias("entry_id"), F.col("score").alias("similarity")).where(F.col("similarity") >= threshold)


def command_of(text: Column) -> Column:
    """The query's command as VERB OBJECT: written out, else by the first of VERBS that occurs, with the first name after
    it if there is one; null without a command."""
    verb, object_ = (F.upper(F.regexp_extract(text, COMMAND, i)) for i in (1, 2))
    said = F.lit(None).cast("string")
    for word, short in reversed(VERBS.items()):
        after = F.substring(text, F.position(F.lit(word), text) + len(word), F.length(text))
        name = F.upper(F.regexp_extract(after, "([A-Za-z][A-Za-z0-9_]*)", 1))
        said = F.when(F.contains(text, F.lit(word)), F.when(name != "", F.concat(F.lit(short + " "), name)).otherwise(short)).otherwise(said)
    return F.when(verb != "", F.concat(verb, F.lit(" "), object_)).otherwise(said)


def named(text: Column, names: Sequence[str]) -> Column:
    """The names that stand in the text as words, in capitals, sorted."""
    found = [F.when(text.rlike(rf"(?i)(?<![A-Za-z0-9_]){n}(?![A-Za-z0-9_])"), n.upper()) for n in sorted(names, key=str.upper)]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def understand(queries: DataFrame) -> DataFrame:
    """Adds command, intent, keywords, products, elements and complexity, by rule. A command decides the intent; then the
    first of INTENTS that shows. Keywords are words without commands and stop words, of two characters or one ideograph.
    Complexity depends on the intent alone here, since rules find no sub-queries and no need of comparison."""
    text = F.coalesce("text", F.lit(""))
    shown = F.lit("general")
    for name, words in reversed(INTENTS.items()):
        any_of = F.lit(False)
        for w in words:
            any_of = any_of | F.contains(text, F.lit(w))
        shown = F.when(any_of, name).otherwise(shown)
    words = F.split(F.regexp_replace(text, COMMAND, ""), r"[\s,，、？?。.！!]+")
    keywords = F.filter(words, lambda x: (F.trim(x) != "") & ~x.isin(*STOP) & ((F.length(x) >= 2) | x.rlike(T.IDEOGRAPH)))
    out = queries.withColumn("command", command_of(text)).withColumn("keywords", keywords).withColumn("products", named(text, PRODUCTS)).withColumn("elements", named(text, ELEMENTS))
    out = out.withColumn("intent", model_intent(F.when(F.col("command").isNotNull(), "command_usage").otherwise(shown)))
    return out.withColumn("complexity", complexity_of(F.col("intent"), F.col("command").isNotNull()))


def model_intent(label: Column) -> Column:
    """The internal intent of a label."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in MODEL_INTENTS.items() for x in kv])[label], F.lit("general"))


def complexity_of(intent: Column, has_command: Column, sub_queries: Column | None = None, compares: Column | None = None) -> Column:
    many = (F.coalesce(F.size(sub_queries), F.lit(0)) > 0 if sub_queries is not None else F.lit(False)) | (F.coalesce(compares, F.lit(False)) if compares is not None else F.lit(False))
    return F.when(intent.isin("comparison", "troubleshooting") | many, "complex").when((intent == "command_usage") & has_command, "simple").when(intent == "navigational", "simple").otherwise("medium")


def route_table(spark) -> DataFrame:
    rows = [(c, s, w, k) for c, routes in ROUTES.items() for s, w, k in routes]
    return spark.createDataFrame(rows, "complexity string, source string, weight double, top_k int")


def route_plan(queries: DataFrame, policy: DataFrame | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """query_id, source, weight, top_k, fusion, rerank: the routes of each query (query_id, intent, complexity, and
    needs_comparison if there is such a column). A policy (intent, source, weight, top_k) takes the table's place for the
    intents it names; an unknown complexity counts as medium. A missing weight is 1, a missing size 50; one route alone needs
    no fusion. An override (intent, rerank) that isn't blank decides how an intent is reranked; else the cascade serves its own
    intents, complex queries and those that need a comparison."""
    spark = queries.sparkSession
    compares = F.coalesce(F.col("needs_comparison"), F.lit(False)) if "needs_comparison" in queries.columns else F.lit(False)
    q = queries.select("query_id", "intent", compares.alias("compares"), F.when(F.col("complexity").isin(*ROUTES), F.col("complexity")).otherwise("medium").alias("complexity"))
    table = F.broadcast(route_table(spark))
    if policy is None:
        routed = q.join(table, "complexity")
    else:
        own = bounded(policy.select("intent", "source", F.coalesce("weight", F.lit(1.0)).alias("weight"), F.coalesce("top_k", F.lit(50)).alias("top_k")))
        ruled = bounded(policy.select("intent").distinct())
        routed = q.join(own, "intent").unionByName(q.join(ruled, "intent", "left_anti").join(table, "complexity"))
    n = F.count("*").over(Window.partitionBy("query_id"))
    rerank = F.when(F.col("intent").isin(*CASCADE) | (F.col("complexity") == "complex") | F.col("compares"), "cascade").otherwise("score")
    if overrides is not None:
        said = overrides.where(F.trim(F.coalesce("rerank", F.lit(""))) != "").groupBy("intent").agg(F.max("rerank").alias("__rerank"))
        routed = routed.join(bounded(said), "intent", "left")
        rerank = F.coalesce("__rerank", rerank)
    return routed.select("query_id", "source", "weight", "top_k", F.when(n > 1, "weighted_rrf").otherwise("identity").alias("fusion"), rerank.alias("rerank"))


def orchestrate(plan: DataFrame, routes: Mapping[str, DataFrame]) -> DataFrame:
    """Candidates of all planned routes, each cut to its size for the query, with the route as their source and the
    plan's weight. A planned route that is absent from routes (a search that failed, or one without a query vector)
    gives nothing and stops no other. routes: query_id, unit_id, score."""
    parts = []
    for name, found in routes.items():
        own = plan.where(F.col("source") == name).select("query_id", "weight", "top_k")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "unit_id"))
        met = found.select("query_id", "unit_id", "score").join(own, "query_id").withColumn("__r", rank).where("__r <= top_k")
        parts.append(met.select("query_id", "unit_id", "score", F.lit(name).alias("source"), "weight"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rerank_scored(candidates: DataFrame, scores: DataFrame, most: int = 200) -> DataFrame:
    """query_id, unit_id, place: a model's order. The first `most` candidates with a text are asked; those that got a score
    come first, by it, and all others follow in their own order. candidates: query_id, unit_id, text, place; scores:
    query_id, unit_id, score. A language model is asked for fewer (20), and shown the first 200 characters."""
    has_text = F.trim(F.coalesce("text", F.lit(""))) != ""
    asked = F.when(has_text, F.sum(has_text.cast("int")).over(Window.partitionBy("query_id").orderBy("place", "unit_id")))
    d = candidates.withColumn("__n", asked).join(scores.select("query_id", "unit_id", F.col("score").alias("__s")), ["query_id", "unit_id"], "left")
    scored = F.col("__s").isNotNull() & (F.col("__n") <= most)
    w = Window.partitionBy("query_id").orderBy(F.when(scored, 0).otherwise(1), F.when(scored, -F.col("__s")), "place", "unit_id")
    return d.select("query_id", "unit_id", F.row_number().over(w).alias("place"))


def dense_units(query_vectors: DataFrame, vectors: DataFrame, dimension: int, kinds: Sequence[str] = (), k: int = 20) -> DataFrame:
    """Dense search over units with several embeddings: of the wanted kinds, the nearest embedding counts for its unit.
    vectors: unit_id, unit_type, v; query_vectors: query_id, q."""
    fine = vectors.where(F.col("unit_type").isin(*kinds)) if kinds else vectors
    return dense(query_vectors, fine, dimension, k).select(*CANDIDATE)


def recall_at(ranked_hits: DataFrame, ks: Sequence[int] = (5, 10)) -> DataFrame:
    """questions, recall_K for each K, misses: over the first rank at which a question found its evidence (null: never).
    ranked_hits: question, rank; several rows of a question count by their least rank."""
    first = ranked_hits.groupBy("question").agg(F.min("rank").alias("rank"))
    at = [F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"recall_{k}") for k in ks]
    return first.agg(F.count("*").alias("questions"), *at, F.count_if(F.col("rank").isNull()).alias("misses"))
