"""The queries of the ten operators over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, embedding_dedup, hard_negatives, language_id, license_scan, minhash, mixing, repeated_bytes, substring_dedup, token_alignment, token_count, url_filter, warc
from .common import Scratch

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
BYTE_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"

# The rules of the URL query.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


def warc_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_archives(table(spark, sf_dir, "pages"), Scratch(spark, "warc"))
    rows = warc.read_archives(index)
    return rows.select(warc.page_number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_number(F.col("refers_to")).alias("refers_to"))


def url_filter_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


def substring_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    every, changed = substring_dedup.duplicate_passages(table(spark, sf_dir, "documents"), window=50)
    rows = every.join(changed.select("doc_id", "text_key", "n_removed", F.sha2("kept_text", 256).alias("kept")), ["doc_id", "text_key"], "left")
    return rows.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept", "digest").alias("kept_sha256"))


def mixing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"), weights=(1.0, 2.0, 3.0), total=1.0, most=3.0)
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def minhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def decontaminate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def token_count_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), VOCABULARY)


def held_out(docs: DataFrame) -> DataFrame:
    """doc_id with held_out: whether its checksum falls into the fold that is not learned from."""
    return docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)))


def language_id_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(held_out(docs).where(~F.col("held_out")).select("doc_id", "text", "lang"), floors=False)
    return held_out(language_id.identify(docs, model)).select("doc_id", "held_out", "lang_pred", "score")


def license_scan_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def hard_negatives_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0, positives=5, negatives=5, low=80, high=100, scale=256.0)


def repeated_bytes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    every, changed = repeated_bytes.repeated_bytes(table(spark, sf_dir, "documents"), length=200)
    rows = every.select("doc_id", "digest", "n_bytes", F.sha2("text", 256).alias("whole"))
    changed = changed.select("digest", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept"))
    none = F.lit(0).cast("long")
    return rows.join(changed, "digest", "left").select("doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept", "whole").alias("kept_sha256"))


def token_alignment_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.cross_tokenizer_links(table(spark, sf_dir, "documents"), token_alignment.Tokenizers.load(BYTE_VOCABULARY, VOCABULARY))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_dedup": embedding_dedup_query,
    "op2_warc": warc_query,
    "op3_url_filter": url_filter_query,
    "op4_substring_dedup": substring_dedup_query,
    "op5_mixing": mixing_query,
    "op6_minhash": minhash_query,
    "op7_decontaminate": decontaminate_query,
    "op8_token_count": token_count_query,
    "op9_language_id": language_id_query,
    "op10_license_scan": license_scan_query,
    "op11_hard_negatives": hard_negatives_query,
    "op12_repeated_bytes": repeated_bytes_query,
    "op13_token_alignment": token_alignment_query,
}

ORACLE_SQL: dict[str, str] = {
    "op1_embedding_dedup": r"""
WITH RECURSIVE good AS (
  SELECT DISTINCT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.93
), reach AS (
  SELECT DISTINCT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), component AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT c.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, c.vec_id = component_id AS kept
FROM component c LEFT JOIN degree d ON c.vec_id = d.vec_id
""",
    "op2_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, sha1(payload) AS h, max(page_id) OVER (PARTITION BY payload) AS response FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(h, (i // 4 * 5 + 1)::INTEGER, 5))::BIGINT >> (15 - i % 4 * 5)::INTEGER) & 31) + 1)::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN page_id < response THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < response THEN response END AS refers_to
FROM d
""",
    "op3_url_filter": r"""
WITH parts AS (
  SELECT page_id, url,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), cut AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fit AS (
  SELECT page_id, host, path, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC NULLS LAST, length(h) DESC) AS k
  FROM cut LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM fit WHERE k = 1
""",
    "op4_substring_dedup": r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
windows AS (
  SELECT doc_id, s, array_to_string(words[s:s + 49], ' ') AS part
  FROM w, LATERAL (SELECT unnest(range(1, len(words) - 48)) AS s) AS r WHERE len(words) >= 50
), firsts AS (SELECT part, min(doc_id) AS least FROM windows GROUP BY part),
gone AS (
  SELECT DISTINCT doc_id, i FROM (SELECT x.doc_id, unnest(range(x.s, x.s + 50)) AS i FROM windows x JOIN firsts f ON x.part = f.part WHERE x.doc_id > f.least)
), removed AS (SELECT doc_id, list(i) AS places FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(len(places), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN places IS NULL THEN words ELSE list_filter(words, lambda x, i: NOT list_contains(places, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN removed r ON w.doc_id = r.doc_id
""",
    "op5_mixing": r"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, source_size * 3.0::DOUBLE AS cap,
    (sum(source_size) OVER ())::DOUBLE AS given FROM sources
), line AS (
  SELECT *, (given - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM weighed
), levels AS (SELECT *, max(CASE WHEN lev <= cap / weight THEN lev END) OVER () AS level FROM line),
targets AS (SELECT source, source_size, least(cap, coalesce(level * weight, cap)) AS target,
  ('0x' || substr(md5(coalesce('s' || source, 'n') || ':7'), 1, 5))::BIGINT::DOUBLE / 1048576 AS start FROM levels),
placed AS (
  SELECT doc_id, size, source_size, target, start, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS each,
    (row_number() OVER (PARTITION BY s.source ORDER BY size, doc_id NULLS LAST))::DOUBLE AS place
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  least(floor(place * each + start) - floor((place - 1) * each + start), 3)::BIGINT * size AS taken
FROM placed
""",
    "op6_minhash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, shingle FROM (
    SELECT doc_id, array_to_string(words[i:i + 2], ' ') AS shingle FROM w, LATERAL (SELECT unnest(range(1, len(words) - 1)) AS i) AS r WHERE len(words) >= 3
    UNION ALL SELECT doc_id, array_to_string(words, ' ') FROM w WHERE len(words) BETWEEN 1 AND 2)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
half AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
component AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN component c ON d.doc_id = c.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
""",
    "op11_hard_negatives": r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, n.id AS negative_id, positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same AND 80 * positive_score <= 100 * n.score AND n.score <= positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.id)
QUALIFY row_number() OVER w <= 5
""",
    "op12_repeated_bytes": r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, encode(coalesce(text, '')) AS h FROM documents),
windows AS (
  SELECT k, w.s AS s, w.part AS part
  FROM (SELECT k, unnest(list_transform(range(0, octet_length(h) - 199), lambda s: {'s': s, 'part': md5(array_slice(h, s + 1, s + 200))})) AS w FROM d WHERE octet_length(h) >= 200)
), twice AS (SELECT part FROM windows GROUP BY part HAVING count(*) > 1),
found AS (SELECT w.k, s FROM windows w JOIN twice t ON w.part = t.part),
gaps AS (SELECT k, s, coalesce(s > lag(s) OVER (PARTITION BY k ORDER BY s) + 200, TRUE) AS gap FROM found),
numbered AS (SELECT k, s, sum(gap::INTEGER) OVER (PARTITION BY k ORDER BY s) AS run FROM gaps),
spans AS (SELECT k, run, min(s) AS a, max(s) + 200 AS z FROM numbered GROUP BY k, run),
ends AS (SELECT k, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY k)
SELECT doc_id, octet_length(h)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(CASE WHEN a IS NULL THEN h ELSE list_reduce(list_transform(range(0, len(a) + 1),
    lambda i: array_slice(h, CASE WHEN i = 0 THEN 1 ELSE z[i] + 1 END, CASE WHEN i = len(a) THEN octet_length(h) ELSE a[i + 1] END)), lambda x, y: x || y) END) AS kept_sha256
FROM d LEFT JOIN ends ON d.k = ends.k
""",
}
