"""The queries of the corpus operators, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.fingerprints import edited_fingerprints
from siftline.llm.html_text import extract_text
from siftline.llm.importance import importance_resample
from siftline.llm.mixing import MIX_SQL, mix
from siftline.llm.ngram_join import jaccard_components
from siftline.llm.packing import pack_documents
from siftline.llm.quality import quality_scores
from siftline.llm.staging import documents
from siftline.llm.suffix_dedup import repeated_passages
from siftline.llm.topk import top_inner_products
from siftline.llm.toxicity import toxicity_scores
from siftline.llm.url_filter import filter_urls
from siftline.llm.vector_codes import vector_codes
from siftline.llm.word_bpe import encoded_digests


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that stand in several documents: a row per document and span."""
    return repeated_passages(documents(spark, sf_dir), min_words=50)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4-word shingles, similarity of 0.85 or more."""
    return jaccard_components(documents(spark, sf_dir), k=4, percent=85)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return quality_scores(docs, _table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages")).select("page_id", "url", "text")


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return toxicity_scores(docs, _table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op7_exact_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op8_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))


#: The block list that the query applies: kind, pattern, action, date.
BLOCK_LIST = (
    ("domain", "example.org", "watch", "2023-06-01"),
    ("domain", "spam-farm.example.org", "block", "2023-11-01"),
    ("domain", "cheap-pills.example.com", "block", "2024-01-15"),
    ("domain", "cheap-pills.example.com", "remove", "2024-06-01"),
    ("domain", "cheap-pills.example.com", "block", "2024-09-01"),
    ("host", "www.casino-win.example.org", "block", "2024-02-01"),
    ("domain", "casino-win.example.org", "watch", "2024-05-01"),
    ("domain", "free-bets.example.com", "block", "2024-03-10"),
    ("host", "m.free-bets.example.com", "allow", "2024-07-01"),
    ("domain", "ads-track.example.org", "block", "2023-01-01"),
    ("prefix", "ads-track.example.org/en", "allow", "2024-04-01"),
    ("prefix", "ads-track.example.org/en", "remove", "2024-10-01"),
    ("domain", "example.org", "remove", "2024-11-01"),
)


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages carry no fetch time, so page n counts as fetched n mod 366 days after 2024-01-01."""
    entries = spark.createDataFrame(list(BLOCK_LIST), "kind string, pattern string, action string, day string")
    entries = entries.select("kind", "pattern", "action", F.to_date("day").alias("listed_at"))
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int"))
    captures = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("capture_id"), "url", fetched.alias("fetched_at"))
    return filter_urls(captures, entries).withColumnRenamed("capture_id", "page_id")


def op11_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(_table(spark, sf_dir, "embeddings"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


_LISTED = ", ".join(f"('{k}', '{p}', '{a}', DATE '{d}')" for k, p, a, d in BLOCK_LIST)
URL_SQL = rf"""
WITH entries(kind, pattern, action, listed_at) AS (VALUES {_LISTED}),
intervals AS (
  SELECT kind || ':' || pattern AS pattern, action, listed_at AS valid_from,
         lead(listed_at) OVER (PARTITION BY kind, pattern ORDER BY listed_at, action) AS valid_to FROM entries
), active AS (SELECT * FROM intervals WHERE action <> 'remove'),
captures AS (
  SELECT page_id, url, (DATE '2024-01-01' + (page_id % 366)::INTEGER)::DATE AS fetched_at,
         lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host, lower(regexp_extract(url, '^[a-z]+://[^/?#]*/*([^?#]*)', 1)) AS path
  FROM pages
), matched AS (
  SELECT c.page_id, a.pattern, a.action,
         CASE WHEN a.pattern LIKE 'domain:%' THEN len(string_split(a.pattern, '.')) WHEN a.pattern LIKE 'host:%' THEN 100 ELSE 200 + len(string_split(a.pattern, '/')) - 1 END AS rank
  FROM captures c JOIN active a ON c.fetched_at >= a.valid_from AND (a.valid_to IS NULL OR c.fetched_at < a.valid_to) AND (
    (a.pattern LIKE 'domain:%' AND ('.' || c.host) LIKE '%.' || substr(a.pattern, 8)) OR a.pattern = 'host:' || c.host
    OR (a.pattern LIKE 'prefix:%' AND (c.host || '/' || c.path || '/') LIKE substr(a.pattern, 8) || '/%'))
)
SELECT c.page_id, c.url, c.fetched_at, c.host, count(m.pattern)::BIGINT AS n_active, arg_max(m.pattern, m.rank) AS pattern,
       coalesce(arg_max(m.action, m.rank), 'allow') AS action
FROM captures c LEFT JOIN matched m USING (page_id) GROUP BY ALL
"""

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"words AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\x20\x09-\x0D]+') AS w FROM documents)"

#: Every window of 50 words compared with all others by its MD5; runs of repeated ones are spans.
PASSAGE_SQL = f"""
WITH {_WORDS}, windows AS (
  SELECT doc_id, unnest([md5(array_to_string(w[i:i + 49], ' ')) FOR i IN range(1, len(w) - 48)]) AS t, unnest(range(0, len(w) - 49)) AS place FROM words WHERE len(w) >= 50
), held AS (
  SELECT doc_id, place, min(doc_id) OVER (PARTITION BY t) AS least, max(doc_id) OVER (PARTITION BY t) AS most FROM windows
), marked AS (
  SELECT *, coalesce(place > lag(place) OVER (PARTITION BY doc_id ORDER BY place) + 50, true) AS new FROM held WHERE least < most
), numbered AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY place) AS span FROM marked)
SELECT doc_id, min(place)::BIGINT AS start_word, (max(place) + 50)::BIGINT AS end_word, (max(place) + 50 - min(place))::BIGINT AS n_words, NOT bool_or(doc_id > least) AS first_holder
FROM numbered GROUP BY doc_id, span
"""

#: All pairs that share a shingle, and what they reach.
JACCARD_SQL = f"""
WITH RECURSIVE {_WORDS}, shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN [array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words
), size AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared s JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * s.n >= 85 * (x.n + y.n - s.n)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(x, y) AS (SELECT a, b FROM sides UNION SELECT r.x, s.b FROM reach r JOIN sides s ON r.y = s.a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(least(d.doc_id, (SELECT min(y) FROM reach WHERE x = d.doc_id)), d.doc_id) AS component_id
FROM documents d LEFT JOIN size USING (doc_id)
"""

#: Every query against every row.
TOP_SQL = """
WITH v AS (
  SELECT vec_id::BIGINT AS id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (SELECT q.id AS query_id, c.id AS vec_id, list_dot_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.id <> c.id WHERE q.id % 50 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM scored QUALIFY rank <= 5
"""

def _codes_sql(rounds: int = 4, width: int = 16) -> str:
    """A table of codebooks and one of assignments for each round; a distance and its entry are one number, the lesser the better."""
    out = [
        """k AS MATERIALIZED (SELECT vec_id::BIGINT AS id, label::BIGINT AS label, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)""",
        "v AS MATERIALIZED (SELECT id, label, p, x[p * len(x) // 4 + 1:(p + 1) * len(x) // 4] AS v FROM k, range(4) t(p))",
        "b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY id) - 1 AS e, v FROM v QUALIFY e < 256)",
    ]
    far = "(list_dot_product(v.v, v.v) - 2 * list_dot_product(v.v, b.v) + list_dot_product(b.v, b.v))::BIGINT"
    mean = "[" + ", ".join(f"floor(sum(v[{i}]) / count(*))" for i in range(1, width + 1)) + "]"
    for r in range(rounds + 1):
        out.append(f"a{r} AS MATERIALIZED (SELECT id, label, v.p, any_value(v.v) AS v, min({far} * 256 + e) AS m FROM v JOIN b{r} b ON b.p = v.p GROUP BY id, label, v.p)")
        if r < rounds:
            out.append(f"b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.v, b.v) AS v FROM b{r} b LEFT JOIN (SELECT p, m % 256 AS e, {mean} AS v FROM a{r} GROUP BY ALL) n ON n.p = b.p AND n.e = b.e)")
    return f"""WITH {", ".join(out)}, c AS (SELECT id, label, string_agg(printf('%02x', m % 256), '' ORDER BY p) AS code, sum(m // 256)::BIGINT AS error FROM a{rounds} GROUP BY id, label)
SELECT id AS vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string([x::BIGINT FOR x IN v], ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256 FROM c"""


def _crc_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8, half a byte at a time, the lower half first."""
    table = []
    for c in range(16):
        for _ in range(4):
            c = (c >> 1) ^ 0xEDB88320 if c & 1 else c >> 1
        table.append(c)
    halves = f"[strpos('0123456789ABCDEF', n) - 1 FOR n IN string_split(regexp_replace(hex({text}), '(.)(.)', '\\2\\1', 'g'), '')]"
    return f"xor(list_reduce(list_prepend(4294967295, {halves}), lambda c, n: xor(c >> 4, {table}[(xor(c, n) & 15) + 1])), 4294967295)"


def _features_sql(table: str, name: str) -> str:
    runs = "w || [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] || [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]"
    return f"SELECT {name} AS id, unnest({runs}) AS f FROM (SELECT {name}, regexp_extract_all({_FOLDED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table})"


#: Twenty words have 57 features.
RESAMPLING_SQL = f"""
WITH d AS MATERIALIZED ({_features_sql("documents", "doc_id")}), b AS MATERIALIZED ({_features_sql("benchmark", "item_id")}),
crc AS MATERIALIZED (SELECT f, ({_crc_sql("f")})::BIGINT % 10000 AS k FROM (SELECT f FROM d UNION SELECT f FROM b)),
s AS (SELECT k, count(*) AS s FROM d JOIN crc USING (f) GROUP BY k), t AS (SELECT k, count(*) AS t FROM b JOIN crc USING (f) GROUP BY k),
g AS MATERIALIZED (
  SELECT k, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM d) + 10000) / ((s + 1)::DOUBLE * ((SELECT count(*) FROM b) + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (k)
), w AS (SELECT id AS doc_id, count(*) AS n, sum(gain) AS weight FROM d JOIN crc USING (f) JOIN g USING (k) GROUP BY id),
e AS (SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, ('0x' || sha256('42:' || doc_id)[1:8])::BIGINT AS h FROM documents LEFT JOIN w USING (doc_id)),
o AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0)))::BIGINT AS score FROM e),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM o WHERE n_features >= 57 QUALIFY rank <= 5 * count(*) OVER () // 100)
SELECT doc_id, n_features, weight, score, rank::BIGINT AS rank FROM o LEFT JOIN r USING (doc_id)
"""

QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_array_dedup, op2_ngram_jaccard_join, op3_quality_classifier, op4_html_extraction, op5_document_fingerprints,
        op6_toxicity, op7_exact_topk_search, op8_mixing_sources, op9_packing, op10_url_filters,
        op11_bpe_encoding, op12_vector_codes, op13_importance_resampling,
    )
}
ORACLES = {
    "op1_suffix_array_dedup": PASSAGE_SQL,
    "op2_ngram_jaccard_join": JACCARD_SQL,
    "op7_exact_topk_search": TOP_SQL,
    "op8_mixing_sources": MIX_SQL,
    "op10_url_filters": URL_SQL,
    "op12_vector_codes": _codes_sql(),
    "op13_importance_resampling": RESAMPLING_SQL,
}
