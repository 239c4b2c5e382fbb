"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import langid, matroska, neardup, packing, pieces, pii, quality, search, urlfilter, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_matroska_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.store_texts(table(spark, sf_dir, "documents"))


def op2_warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).drop("url")


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes < 100 OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN payload_bytes < 100 OR page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM f
"""


def op3_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_all(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op5_streaming_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_texts(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.fit(docs))


def op8_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_all(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def list_events(pages: DataFrame) -> DataFrame:
    """Dated list events made from the hosts and first path segments of the pages: the hash of an entry says whether it
    is listed, where, and when it is added, removed and added again."""
    url = F.col("url")
    host, path = F.lower(F.regexp_extract(url, urlfilter.HOST, 1)), F.regexp_extract(url, urlfilter.PATH, 1)
    first = F.split(path, "/").getItem(1)
    hosts = pages.select(host.alias("key")).filter("key <> ''").distinct()
    sites = hosts.select(F.explode(F.array("key", F.regexp_extract("key", r"([^.]+\.[^.]+\.[^.]+)$", 1))).alias("key")).filter("key <> ''").distinct()
    paths = pages.filter(F.size(F.split(path, "/")) >= 2).select(F.concat(host, F.lit("/"), first).alias("key")).filter((host != "") & (first != "")).distinct()
    entries = sites.select(F.lit("host").alias("kind"), "key").unionByName(paths.select(F.lit("path").alias("kind"), "key"))
    x = F.conv(F.substring(F.md5("key"), 1, 6), 16, 10).cast("long")
    entries = entries.withColumn("x", x).filter("(kind = 'host' AND x % 3 = 0) OR (kind = 'path' AND x % 4 = 1)")
    one = lambda action, day: F.struct(F.lit(action).alias("action"), day.cast("long").alias("day"))
    x = F.col("x")
    dated = F.array(one("add", x % 300), one("remove", x % 300 + 20 + x % 90), one("add", x % 300 + 150 + x % 40))
    return entries.select(F.concat(F.lit("list"), (x % 7).cast("string")).alias("list"), "kind", "key", F.explode(dated).alias("e")).select("list", "kind", "key", "e.action", "e.day")


def op9_temporal_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", (F.col("page_id") * 37 % 365).alias("fetched"))
    return urlfilter.evaluate(pages, list_events(pages)).drop("url")


OP9_SQL = """
WITH p AS (SELECT page_id, url, page_id * 37 % 365 AS fetched, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages),
hosts AS (SELECT DISTINCT host AS key FROM p WHERE host <> ''),
sites AS (SELECT key FROM hosts UNION SELECT regexp_extract(key, '([^.]+\\.[^.]+\\.[^.]+)$', 1) FROM hosts),
paths AS (SELECT DISTINCT host || '/' || string_split(path, '/')[2] AS key FROM p WHERE host <> '' AND string_split(path, '/')[2] <> ''),
entries AS (SELECT 'host' AS kind, key, ('0x' || substr(md5(key), 1, 6))::BIGINT AS x FROM sites WHERE key <> '' UNION ALL
  SELECT 'path', key, ('0x' || substr(md5(key), 1, 6))::BIGINT FROM paths),
listed AS (SELECT *, 'list' || (x % 7)::VARCHAR AS list FROM entries WHERE (kind = 'host' AND x % 3 = 0) OR (kind = 'path' AND x % 4 = 1)),
active AS (SELECT list, kind, key, x % 300 AS since, x % 300 + 20 + x % 90 AS until FROM listed UNION ALL
  SELECT list, kind, key, x % 300 + 150 + x % 40, 1000000 FROM listed),
keys AS (SELECT page_id, fetched, 'host' AS kind, array_to_string(string_split(host, '.')[len(string_split(host, '.')) - n + 1:], '.') AS key
    FROM p, range(1, 12) r(n) WHERE host <> '' AND n <= len(string_split(host, '.')) UNION ALL
  SELECT page_id, fetched, 'path', host || '/' || string_split(path, '/')[2] FROM p WHERE host <> '' AND string_split(path, '/')[2] <> ''),
hits AS (SELECT page_id, count(*) AS n_hits, string_agg(DISTINCT list, ',' ORDER BY list) AS lists
  FROM keys JOIN active USING (kind, key) WHERE since <= fetched AND fetched < until GROUP BY page_id)
SELECT page_id, fetched, coalesce(n_hits, 0) AS n_hits, lists FROM p LEFT JOIN hits USING (page_id)
"""


def op10_block_max_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return search.top_k(docs, docs.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_matroska_media": op1_matroska_media,
    "op2_warc_records": op2_warc_records,
    "op3_language_crf": op3_language_crf,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_streaming_viterbi": op5_streaming_viterbi,
    "op6_order_minhash": op6_order_minhash,
    "op7_personal_data": op7_personal_data,
    "op8_quality_crf": op8_quality_crf,
    "op9_temporal_url_filter": op9_temporal_url_filter,
    "op10_block_max_wand": op10_block_max_wand,
}
ORACLE_SQL: dict[str, str] = {"op2_warc_records": OP2_SQL, "op9_temporal_url_filter": OP9_SQL}
