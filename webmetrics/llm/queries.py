"""Queries of the operators in this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontamination, exact_dedup, language_id, line_dedup, manifest_sql, merkle, ngram_join, packing, pii, quality, secrets, toxicity, warc
from .common import remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def _written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@_query
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read(spark, sf_dir, "documents"))


ORACLE["op1_exact_dedup"] = r"""
WITH normal AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY body ORDER BY points DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY body ORDER BY points DESC, doc_id) AS kept,
       sha256(body) AS text_sha256
FROM normal
"""


@_query
def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@_query
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


@_query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 4) == 2
    model = language_id.fit(docs, ~held_out)
    return language_id.predict(docs, model).withColumn("held_out", held_out)


@_query
def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["layers"] == "")
    counts = [_count(base, kind) for kind in secrets.KINDS]
    added = (F.size("spans") - F.size(base)).cast("long").alias("n_added")
    return found.select("doc_id", *counts, F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"), added)


@_query
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@_query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held_out = remainder("doc_id", 3) == 1
    model = toxicity.fit(docs, labels, ~held_out)
    return toxicity.score(docs, model).withColumn("held_out", held_out)


@_query
def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(read(spark, sf_dir, "documents"))


@_query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE["op2_line_dedup"] = r"""
WITH broken AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS bodies FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL
),
line AS (
  SELECT doc_id, unnest(bodies) AS body, unnest(range(len(bodies))) AS line FROM broken
),
bag AS (
  SELECT doc_id, line, list_sort(list_distinct(list_filter(string_split_regex(lower(body), '[\x20\x09\x0B-\x0D]+'), lambda w: w <> ''))) AS words
  FROM line
),
sets AS (
  SELECT words, len(words) AS n, min((doc_id, line)) AS place FROM bag WHERE len(words) >= 5 GROUP BY words
),
word AS (SELECT place, n, unnest(words) AS w FROM sets),
freq AS (SELECT w, count(*) AS f FROM word GROUP BY w),
rare AS (
  SELECT place, n, w FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY f, w) AS r FROM word JOIN freq USING (w))
  WHERE r <= n - (80 * n + 99) // 100 + 1
),
pair AS (
  SELECT DISTINCT a.place AS a, b.place AS b FROM rare a JOIN rare b ON a.w = b.w AND a.place < b.place
  WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
),
alike AS (
  SELECT words FROM (
    SELECT y.words, x.n + y.n AS n, len(list_intersect(x.words, y.words)) AS shared
    FROM pair p JOIN sets x ON p.a = x.place JOIN sets y ON p.b = y.place
  ) WHERE 100 * shared >= 80 * (n - shared)
),
gone AS (
  SELECT b.doc_id, b.line FROM bag b JOIN sets s ON b.words = s.words
  WHERE (b.doc_id, b.line) <> s.place OR b.words IN (SELECT words FROM alike)
),
rest AS (
  SELECT l.doc_id, string_agg(l.body, chr(10) ORDER BY l.line) FILTER (g.line IS NULL) AS text, count(g.line) AS removed
  FROM line l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.line = g.line GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN r.removed > 0 THEN coalesce(r.text, '') ELSE d.text END AS text,
       CAST(coalesce(r.removed, 0) AS INTEGER) AS removed_lines
FROM documents d LEFT JOIN rest r ON d.doc_id = r.doc_id
"""


@_query
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(read(spark, sf_dir, "documents"))
    base = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    terms = F.transform("terms", lambda s: F.struct(F.lit(pii.TERM).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    counts = [_count(base, kind) for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(_written(base), 256).alias("base_sha256"), _written(F.concat(base, terms)).alias("spans"), F.size("terms").cast("long").alias("n_terms"))


@_query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(read(spark, sf_dir, "documents"))


ORACLE["op12_merkle_manifest"] = manifest_sql.AUDIT


@_query
def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


ORACLE["op13_warc"] = r"""
WITH body AS (
  SELECT page_id, strlen(coalesce(html, '')) AS size, sha256(coalesce(html, '')) AS digest FROM pages
),
held AS (
  SELECT *, CASE WHEN size >= 100 THEN min(page_id) OVER (PARTITION BY digest) ELSE page_id END AS holder FROM body
)
SELECT page_id, size AS payload_bytes, digest AS payload_digest,
       CASE WHEN holder = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN holder <> page_id THEN holder END AS refers_to
FROM held
"""


@_query
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


ORACLE["op11_phrase_collocations"] = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS body
  FROM documents
),
bag AS (SELECT lang, list_filter(string_split_regex(body, '[ 	]+'), lambda w: w <> '') AS words FROM piece),
sizes AS (SELECT lang, sum(len(words)) AS n FROM bag GROUP BY lang),
gram AS (
  SELECT lang, list_slice(words, b, b + k - 1) AS g
  FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS b FROM bag, (VALUES (1), (2), (3), (4)) AS size (k))
),
often AS (SELECT lang, g, count(*) AS f FROM gram GROUP BY lang, g HAVING count(*) >= 30),
candidate AS (SELECT lang, g, f AS a FROM often WHERE len(g) >= 2),
inside AS (
  SELECT lang, list_slice(g, b, b + k - 1) AS g, max(a) AS longest
  FROM (SELECT lang, g, a, k, unnest(range(1, len(g) - k + 2)) AS b FROM candidate, (VALUES (2), (3)) AS size (k) WHERE k < len(g))
  GROUP BY ALL
),
cut AS (
  SELECT c.lang, c.g, c.a, c.k, x.f AS l, y.f AS r, CAST((2000000::HUGEINT * c.a) // (x.f + y.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, len(g))) AS k FROM candidate) c
  JOIN often x ON x.lang = c.lang AND x.g = list_slice(c.g, 1, c.k) JOIN often y ON y.lang = c.lang AND y.g = list_slice(c.g, c.k + 1, len(c.g))
),
worst AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
ranked AS (
  SELECT w.*, array_to_string(w.g, ' ') AS phrase,
         row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, a DESC, encode(array_to_string(w.g, ' '))) AS rank
  FROM worst w LEFT JOIN inside i ON i.lang = w.lang AND i.g = w.g
  WHERE i.longest IS NULL OR 100 * i.longest < 80 * w.a
)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""
