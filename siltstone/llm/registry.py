"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import digests
from .licenses import scan_licenses
from .lines import dedup_lines
from .nearest import nearest
from .ngram_join import ngram_join
from .packing import pack_documents
from .phrases import collocations
from .pieces import digest_documents
from .pii import find_pii
from .quality import quality_rules
from .secrets import scan_secrets
from .token_files import token_files
from .whitening import whiten


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(_table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents WHERE doc_id IS NOT NULL),
sets AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END) AS s FROM words),
grams AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM sets UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, l.component_id FROM sets s JOIN least l ON s.doc_id = l.x
"""


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(_table(spark, sf_dir, "documents")).withColumn("spans", spans_text())


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, ord, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(a) AS line, unnest(range(len(a))) AS ord
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents WHERE doc_id IS NOT NULL))),
common AS (
  SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT l.*, c.k IS NOT NULL AND l.doc_id <> c.keeper AS gone FROM lines l LEFT JOIN common c ON l.k = c.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY ord) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(_table(spark, sf_dir, "documents"))


def spans_text(column: str = "spans"):
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents")).drop("spans")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_table(spark, sf_dir, "documents")).withColumn("spans", spans_text())


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(_table(spark, sf_dir, "documents"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(_table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
worded AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
runs AS (
  SELECT lang, w, s, unnest(range(1, len(w) - s + 2)) AS i FROM worded, (VALUES (1), (2), (3)) t(s) WHERE len(w) >= s),
f AS MATERIALIZED (SELECT lang, s, list_slice(w, i, i + s - 1) AS p, count(*) AS a FROM runs GROUP BY ALL HAVING count(*) >= 10),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang),
cuts AS (
  SELECT c.lang, c.p, c.s, c.a, k, x.a AS l, y.a AS r, (c.a::HUGEINT * c.a * 1000000) // (x.a::HUGEINT * y.a) AS score
  FROM (SELECT *, unnest(range(1, s)) AS k FROM f WHERE s > 1) c
  JOIN f x ON x.lang = c.lang AND x.p = list_slice(c.p, 1, k) JOIN f y ON y.lang = c.lang AND y.p = list_slice(c.p, k + 1, c.s)),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
longer AS (
  SELECT lang, p, max(a) AS most FROM (
    SELECT lang, list_slice(p, 1, 2) AS p, a FROM f WHERE s = 3 UNION ALL SELECT lang, list_slice(p, 2, 3), a FROM f WHERE s = 3) GROUP BY ALL),
ranked AS (
  SELECT c.lang, array_to_string(c.p, ' ') AS phrase, c.a, c.l, c.r, c.score FROM scored c LEFT JOIN longer g ON g.lang = c.lang AND g.p = c.p
  WHERE g.most IS NULL OR 100 * g.most < 50 * c.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM ranked JOIN total USING (lang) QUALIFY rank <= 2000
"""


# What SQL can say of operators that it can't state as a whole: their exact columns, as queries of their own.

TEXTS = "d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents WHERE doc_id IS NOT NULL)"


def base_pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


BASE_PII_SQL = rf"""
WITH {TEXTS},
m AS (SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS n_email, regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ips,
  list_transform(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda x: reverse(regexp_replace(x, '[^0-9]', '', 'g'))) AS cards, list_transform(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g'))) AS phones FROM d)
SELECT doc_id, n_email, len(list_filter(ips, lambda x: len(list_filter(string_split(x, '.'), lambda y: coalesce(try_cast(y AS HUGEINT) > 255, true))) = 0)) AS n_ip,
  len(list_filter(cards, lambda x: length(x) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(x) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(x, i, 1)::INT ELSE 2 * substr(x, i, 1)::INT - CASE WHEN substr(x, i, 1)::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0)) AS n_card,
  len(list_filter(phones, lambda n: n BETWEEN 10 AND 15)) AS n_phone FROM m
"""


def base_license_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


BASE_LICENSE_SQL = rf"""
WITH {TEXTS},
w AS (SELECT row, doc_id, list_filter(string_split_regex(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM d),
p AS (SELECT * FROM (VALUES (['under', 'the', 'mit', 'license'], 'mit'), (['apache', 'license', 'version', '2'], 'apache-2'), (['cc', 'by', 'nc'], 'cc-by-nc')) v(phrase, label)),
h AS (SELECT row, label, unnest(list_filter(range(len(w) - len(phrase) + 1), lambda i: list_slice(w, i + 1, i + len(phrase)) = phrase)) AS pos FROM w, p WHERE len(w) >= len(phrase)),
g AS (SELECT row, count(*) AS n, min(pos) AS a, max(pos) AS b, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM h GROUP BY row)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, b AS last_word, coalesce(labels, '') AS base_labels FROM w LEFT JOIN g USING (row)
"""


def base_secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


BASE_SECRET_SQL = rf"""
WITH {TEXTS}
SELECT doc_id, len(list_filter(regexp_extract_all(t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 6)) AS n_assign,
  len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS n_access, len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 24)) AS n_hex FROM d
"""


def base_quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


BASE_QUALITY_SQL = rf"""
WITH {TEXTS},
w AS (SELECT row, doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
k AS (SELECT row, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' '))) AS g FROM w WHERE len(w) > 2),
g AS (SELECT row, unnest(list(i)) AS i FROM k GROUP BY row, g HAVING count(*) > 1),
r AS (SELECT row, count(DISTINCT pos) AS n FROM (SELECT row, unnest([i, i + 1, i + 2]) AS pos FROM g) GROUP BY row)
SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
  coalesce(n, 0) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(n, 0) > 50 * len(w) AS base_failed FROM w LEFT JOIN r USING (row)
"""


def base_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_whitening(spark, sf_dir).where("component = 1").select("vec_id", "n", "deviation")


BASE_DEVIATION_SQL = """
WITH x AS (SELECT vec_id, unnest(range(len(embedding))) AS k, floor(64 * unnest(embedding)::DOUBLE)::BIGINT + 1000000 AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT k, sum(x) AS s, count(*) AS n FROM x GROUP BY k)
SELECT vec_id, any_value(n) AS n, sum((n * x - s) * (n * x - s))::BIGINT AS deviation FROM x JOIN s USING (k) GROUP BY vec_id
"""


def queries() -> dict:
    return {
        "op1_ngram_join": op1_ngram_join,
        "op2_pii": op2_pii,
        "op3_line_dedup": op3_line_dedup,
        "op4_pieces": op4_pieces,
        "op5_license_scan": op5_license_scan,
        "op6_secret_scan": op6_secret_scan,
        "op7_token_files": op7_token_files,
        "op8_nearest": op8_nearest,
        "op9_packing": op9_packing,
        "op10_quality_rules": op10_quality_rules,
        "op11_byte_bpe": op11_byte_bpe,
        "op12_whitening": op12_whitening,
        "op13_phrases": op13_phrases,
        "base_pii_counts": base_pii_counts,
        "base_license_words": base_license_words,
        "base_secret_counts": base_secret_counts,
        "base_quality_counts": base_quality_counts,
        "base_deviations": base_deviations,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_join": OP1_SQL, "op3_line_dedup": OP3_SQL, "op13_phrases": OP13_SQL, "base_pii_counts": BASE_PII_SQL, "base_license_words": BASE_LICENSE_SQL,
        "base_secret_counts": BASE_SECRET_SQL, "base_quality_counts": BASE_QUALITY_SQL, "base_deviations": BASE_DEVIATION_SQL,
    }
