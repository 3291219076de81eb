"""Hand-computed cases for the operators that SQL doesn't cover."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.functions import scoring
from siltstone.operators import assembly, discourse, graph, ontology, relational, retrieval, segment, state, units
from siltstone.sources import html, records


def test_npmi(spark):
    d = spark.createDataFrame([(0.5, 0.5, 0.0), (0.0, 0.5, 0.1), (0.5, 0.5, 0.25), (1.0, 1.0, 1.0), (0.5, 0.5, 0.4)], "h double, t double, b double")
    got = [r[0] for r in d.select(scoring.npmi(F.col("h"), F.col("t"), F.col("b"))).collect()]
    assert got[:2] == [-1.0, -1.0] and got[2] == pytest.approx(0, abs=1e-9) and got[3] == 1.0 and got[4] > 0


def test_segments():
    p = segment.Policy(merge_below=5, chunk_below=5, most=12)
    got = segment.segment_text("# Top\n\nintro words here now please\n\n## Sub\n\nshort\n\n- a b c d e f\n- g\n\n```\nx = 1\n```\n\n" + "word " * 8 + "。" + "more " * 8, p)
    assert all(s.path[:1] == ["Top"] for s in got) and all(s.tokens <= 12 for s in got)
    words = [w for s in got for w in s.text.split() if w.isalpha()]
    assert words.count("word") == 8 and words.count("more") == 8 and "short" in words
    assert [s.kind for s in segment.walk("a\n\nb\n| x |\n> q")] == ["paragraph", "table", "blockquote"]


def kinds(segments):
    return [s.kind for s in segments]


def test_merging_within_a_section():
    """A small paragraph takes the list or table after it; small segments join what is before; tables and code take nothing."""
    table = "| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |"
    merge = lambda text, **p: segment.merge_small(segment.walk(text), segment.Policy(**p))
    assert kinds(merge(f"small one\n\n{table}\n\nsmall two", merge_below=10, most=1000, table_alone=5)) == ["paragraph", "table", "paragraph"]
    assert kinds(merge(f"small one\n\n{table}")) == ["table"]
    assert kinds(merge(f"{table}\n\nsmall two")) == ["table", "paragraph"]
    assert kinds(merge("small one\n\n```\nx = 1\n```\n\nsmall two")) == ["paragraph", "code", "paragraph"]
    assert kinds(merge("- a\n- b\n\nsmall two\n\n> said")) == ["list"]
    assert kinds(merge("> said\n\nsmall two")) == ["blockquote"]  # of equal ranks the earlier
    assert kinds(merge("small one\n\n<table><tr><td>x</td></tr></table>")) == ["html_table"]
    assert kinds(merge(f"{'long ' * 120}\n\n{table}")) == ["paragraph", "table"]
    assert kinds(merge("one\n\n## s\n\ntwo\n\n## t\n\nthree")) == ["paragraph"] * 3
    assert kinds(merge("one\n\n## s\n\ntwo")) == ["paragraph"]  # the only section at the top owns what precedes it


def test_orphans_join_the_nearest_ancestor():
    long = "long " * 140
    got = segment.absorb_orphans(segment.walk(f"# A\n\n{long}\n\n## B\n\nsmall\n\n## C\n\n{long}"), segment.Policy())
    assert [(s.path, s.tokens) for s in got] == [(["A"], 141), (["A", "C"], 140)] and got[0].text.endswith("\n\nsmall")
    full = segment.absorb_orphans(segment.walk(f"# A\n\n{'long ' * 512}\n\n## B\n\nsmall"), segment.Policy())
    assert len(full) == 2  # no room
    many = "# A\n\n" + long + "\n\n" + "\n\n".join(f"## S{k}\n\n### T\n\nword {k}" for k in range(20_000))
    assert len(segment.absorb_orphans(segment.walk(many), segment.Policy())) < 20_000  # and in time


def test_lead_ins_join_what_follows():
    p = segment.Policy()
    got = segment.lead_forward(segment.walk("# A\n\nthree parts:\n\n## B\n\n- one\n\n# C\n\nrest\n\n## D\n\n| x |"), p)
    assert [(s.kind, s.path) for s in got] == [("list", ["A", "B"]), ("paragraph", ["C"]), ("table", ["C", "D"])]


def test_large_segments_split_at_paragraphs_then_sentences():
    p = segment.Policy(most=6)
    got = segment.split_large(segment.Segment("paragraph", [], "a b c\n\nd e f\n\ng h。i j k l m。n\n\no"), p)
    assert [s.text for s in got] == ["a b c\n\nd e f", "g h。", "i j k l m。n", "o"]


def test_entity_cards_skip_but_do_not_mark(spark):
    m = spark.createDataFrame([("d", 0, k, "t", n) for k, n in enumerate("abcd")] + [("d", 1, 0, "t", "a"), ("d", 1, 1, "t", "d")], "document string, segment_index int, position int, type string, name string")
    got = sorted((r.segment_index, r.title) for r in units.entity_cards(m).collect())
    assert got == [(0, "a"), (0, "b"), (0, "c"), (1, "d")]


def test_html_spans_are_numbers():
    assert html.span("²", 10) == html.span("x", 10) == html.span(None, 10) == html.span("0", 10) == 1 and html.span(" 7 ", 5) == 5
    assert html.to_markdown("<table><tr><th colspan='²'>a</th></tr></table>").startswith("| a |")
    assert html.to_markdown("<table><tr><td colspan=150>a</td></tr></table>").count("a") == 150


def test_declared_charsets():
    page = "<meta charset='gb2312'>你好镕"
    assert records.decoded(page.encode("gb18030")) == page and records.decoded("é".encode()) == "é"
    assert records.decoded(b"\xff ok") == "\ufffd ok" and records.decoded(None) is None
    assert records.decoded(b"<meta charset=nothing-known>\xc3\xa9") == "<meta charset=nothing-known>é"


def test_html():
    page = "<h1>T</h1><script>x</script><p>a <b>b</b> c</p><ul><li>Item A</li><li>Item B</li></ul><table><tr><th>x</th><th>y</th></tr><tr><td rowspan=2>1</td><td>2</td></tr><tr><td>3</td></tr><tr><td colspan=2>w</td></tr></table>"
    got = html.to_markdown(page)
    assert got.startswith("# T\n\na **b** c") and "- Item A\n- Item B" in got
    assert "| x | y |\n| --- | --- |\n| 1 | 2 |\n| 1 | 3 |\n| w | w |" in got
    assert html.to_markdown("") == "" and html.to_markdown(None) == ""


def test_rerank_is_greedy(spark):
    rows = [("q", 1, "s1", "paragraph", "abcdefghij", 0.9), ("q", 2, "s2", "paragraph", "abcdefghij", 0.8), ("q", 3, "s1", "paragraph", "zzzzyyyy", 0.7), ("q", 4, "s4", "heading", "other text", 0.5), ("q", 5, "s5", "paragraph", "weak", 0.001), ("q", 6, "s6", "paragraph", "edge", 0.01)]
    d = spark.createDataFrame(rows, "query_id string, unit_id int, segment_id string, block_type string, text string, score double")
    got = sorted((r.unit_id, r.score) for r in retrieval.rerank_finish(d).collect())
    assert got == [(1, 0.9), (4, 0.25), (6, 0.01)]


def test_weighted_rrf(spark):
    d = spark.createDataFrame([("q", "u1", 0.9, "bm25"), ("q", "u2", 0.8, "dense"), ("q", "u1", 0.1, "dense")], "query_id string, unit_id string, score double, source string")
    got = {r.unit_id: r for r in retrieval.rrf(d, {"bm25": 1.5, "dense": 0.5}).collect()}
    assert got["u1"].fused == pytest.approx(1.5 / 61 + 0.5 / 62) and got["u1"].sources == ["bm25", "dense"] and got["u2"].fused == pytest.approx(0.5 / 61)


def test_spread_rank_is_the_window_rank(spark):
    rng = np.random.default_rng(5)
    rows = [(None if i % 7 == 0 else f"k{i % 3}", None if i % 11 == 0 else float(rng.integers(0, 9)) if i % 2 else 1e6, i) for i in range(400)]
    rows += [("one", 5.0, 900), ("none", None, 901), ("none", None, 902)]
    d = spark.createDataFrame(rows, "k string, score double, id int")
    from pyspark.sql import Window

    want = d.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy(F.desc_nulls_last("score"), "id")))
    got = relational.spread_rank(d, ["k"], "score", "id", 5)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_roles(spark):
    s = spark.createDataFrame([("d", i) for i in range(3)], "document string, segment int")
    for src, dst, kind, want in ((0, 1, "elaborates", ["nucleus", "satellite", "standalone"]), (1, 0, "elaborates", ["nucleus", "satellite", "standalone"]), (0, 1, "causes", ["satellite", "nucleus", "standalone"]), (1, 0, "concedes", ["satellite", "nucleus", "standalone"]), (0, 1, "contrasts_with", ["nucleus", "nucleus", "standalone"])):
        r = spark.createDataFrame([("d", src, dst, kind)], "document string, src int, dst int, type string")
        assert [x.role for x in discourse.roles(s, r).orderBy("segment").collect()] == want


def test_induction(spark):
    """Members by name, support over documents, and the least support that the entities allow."""
    e = spark.createDataFrame([(1, "UPF", 2, 5), (2, "smf", 1, 2), (3, "lone", 1, 1)], "entity int, name string, document_count int, mention_count int")
    p = spark.createDataFrame([("nf", ["  upf ", "SMF", "nobody"]), ("weak", ["lone"]), (" ", ["upf"])], "type_name string, members array<string>")
    assert [tuple(r) for r in ontology.induce_types(e, p).collect()] == [("nf", 3, 7, [1, 2])]
    one = e.withColumn("document_count", F.lit(1))
    assert {r.type_name for r in ontology.induce_types(one, p).collect()} == {"nf", "weak"}


def test_merge_retype_and_delete(spark):
    e = spark.createDataFrame([(1, "t", "a", 9, 9), (2, "t", "b", 9, 9), (3, "u", "a", 9, 9)], "entity int, type string, name string, mention_count long, document_count long")
    m = spark.createDataFrame([(10, 1, 7, "auto"), (11, 2, 7, "human"), (12, 2, 8, "pending")], "mention int, entity int, document int, status string")
    g = spark.createDataFrame([(1, 3), (2, 3)], "head int, tail int")
    left, moved, edges = ontology.merge_entities(e, m, g, spark.createDataFrame([(2, 1), (1, 1)], "dropped int, kept int"))
    assert sorted((r.entity, r.mention_count, r.document_count) for r in left.collect()) == [(1, 2, 1), (3, 9, 9)]
    assert {r.entity for r in moved.collect()} == {1} and [tuple(r) for r in edges.collect()] == [(1, 3)]
    plan = ontology.retype_plan(e, spark.createDataFrame([(1, "u"), (2, "u"), (3, "u")], "entity int, new_type string"))
    assert sorted((r.entity, r.type, r.merge_into) for r in plan.collect()) == [(1, "t", 3), (2, "u", None)]
    rest = ontology.delete_entities(e, m, g, spark.createDataFrame([(2,)], "entity int"))
    assert [d.count() for d in rest] == [2, 1, 1]


def test_promotion_without_candidates_changes_nothing(spark):
    t = spark.createDataFrame([(1, "node_type", "x", "concept", "active")], "version int, kind string, name string, layer string, status string")
    assert [tuple(r) for r in ontology.promote(t, t.select("kind", "name", "layer").where("false")).collect()] == [(1, "node_type", "x", "concept", "active")]


def test_edges_need_npmi(spark):
    weak = [(s, "A", "t") for s in (0, 1, 2)] + [(s, "B", "t") for s in (2, 3, 4)]
    strong = [(9, "SMF", "t"), (9, "N4", "t")]
    rules = spark.createDataFrame([("connects", "*", "*")], "relation_type string, head_type string, tail_type string")
    m = spark.createDataFrame(weak + strong, "segment int, entity string, type string")
    assert {(r.head, r.tail) for r in graph.edges(m, rules).collect()} == {("SMF", "N4"), ("N4", "SMF")}


def test_recall_paths_are_simple(spark):
    e = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.8), ("c", "a", 0.4)], "head string, tail string, confidence double")
    got = {(r.node, r.hop): r.confidence for r in graph.recall(spark.createDataFrame([("a",)], "seed string"), e).collect()}
    assert got == {("b", 1): 0.9, ("c", 2): pytest.approx(0.72)}
    assert graph.neighbours(spark.createDataFrame([("a",)], "seed string"), e).count() == 2


def test_window_join_equals_pairs(spark):
    rng = np.random.default_rng(0)
    rows = [("k", int(p)) for p in np.unique(rng.integers(-20, 40, 30))]
    a, b = spark.createDataFrame(rows, "k string, at int"), spark.createDataFrame(rows, "k string, position int")
    got = sorted((r.at, r.position) for r in relational.window_join(a, b, ["k"], "at", "position", 3).collect())
    assert got == sorted((x, y) for _, x in rows for _, y in rows if abs(x - y) <= 3)


def test_publish_keeps_one_active(spark):
    r = spark.createDataFrame([("b1", "main", "active", "1"), ("b2", "test", "active", "1")], "build string, channel string, status string, at string")
    got = {(x.build, x.status) for x in state.publish(r, "b3", "main", "2").collect()}
    assert got == {("b1", "retired"), ("b2", "active"), ("b3", "active")}
    f = spark.createDataFrame([("a/b",), ("a/b/c",), ("a/bc",)], "path string")
    assert [x.path for x in state.move_subtree(f, "a/b", "z").collect()] == ["z", "z/c", "a/bc"]


def test_groups_and_relations(spark):
    f = spark.createDataFrame([("i1", "s1"), ("i2", "s1"), ("i3", "s2")], "item_id string, snapshot string")
    r = spark.createDataFrame([(1, "i1", "i2"), (2, "i2", "x"), (1, "i1", "i2")], "relation_id int, src string, dst string")
    assert [x.relation_id for x in assembly.inner_relations(r, f).collect()] == [1]
    assert {(x.snapshot, x["items"], x.relations) for x in assembly.groups(f, r).collect()} == {("s1", 2, 2), ("s2", 1, 0)}


def test_archives_stay_inside(spark):
    import io
    import zipfile

    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("a/b.txt", "x")
        z.writestr("../evil.txt", "y")
    d = spark.createDataFrame([("p.zip", bytearray(raw.getvalue())), ("bad.zip", bytearray(b"no"))], "path string, content binary")
    assert [(r.path, r.member, bytes(r.content)) for r in records.unpack(d).collect()] == [("p.zip", "a/b.txt", b"x")]


def test_as_of_of_one_table_read_twice(spark):
    """The bins of the times are carried through the union of two reads of a table, whatever filters they have."""
    path = "/root/testdata/sf0.1/events.parquet"
    view = spark.read.parquet(path).where("event_type = 'view'").groupBy("user_id", F.col("ts").alias("view_ts")).agg(F.max("event_id").alias("view_id"))
    bought = spark.read.parquet(path).where("event_type = 'purchase'").select("user_id", "event_id", "ts")
    got = relational.latest_not_after(bought, view, ["user_id"], "ts", "view_ts")
    assert got.count() == bought.count()


def test_suggestions_of_equal_names(spark):
    """Mentions of one text and entities of one name are not paired each with each (that would be 900 million rows)."""
    n = 30_000
    m = spark.range(n).select(F.col("id").alias("mention"), F.lit("Name").alias("text"), F.lit("t").alias("type"))
    e = spark.range(n).select(F.col("id").alias("entity"), F.lit("a name").alias("name"), F.lit("t").alias("type"), (F.col("id") % 7).alias("mention_count"))
    got = ontology.suggest(m, e)
    assert got.count() == 5 * n and sorted(r.entity for r in got.where("mention = 3").collect()) == [6, 13, 20, 27, 34]
