"""One query for each operator, with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, cotraining, packing, quality_rules, simhash, suffix_dedup, token_count, token_store, topk, warc
from .common import table
from .vocab import public


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of each document: three words, three bits."""
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, bits=3)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents as binary shards, read back by key."""
    return token_store.digests(token_store.write(table(spark, sf_dir, "documents"), public("byte_bpe_50k.json")))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of each document."""
    docs = table(spark, sf_dir, "documents")
    return quality_rules.apply(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence and offset of each piece of at most 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), public("word_bpe_49k.json"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document, and whether they are over 512."""
    out = token_count.count(table(spark, sf_dir, "documents"), public("byte_bpe_50k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > 512)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without passages of 200 bytes that occur elsewhere."""
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op7_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both views' probabilities, the combined one and the verdict of each document."""
    docs = table(spark, sf_dir, "documents")
    return cotraining.score(docs, cotraining.train(docs, table(spark, sf_dir, "labels")))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the archives of all pages."""
    return warc.read(warc.write(table(spark, sf_dir, "pages"))).drop("url")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 highest scores of each row whose id is divisible by 100, against all rows."""
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of ids and decoded bytes of each document."""
    return bpe_codec.round_trip(table(spark, sf_dir, "documents"), public("byte_bpe_50k.tiktoken"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_token_store, op3_quality_rules, op4_packing, op5_token_counts, op6_suffix_dedup, op7_cotraining, op8_warc, op9_topk, op10_bpe_codec)}


#: Equal payloads of at least 100 bytes revisit the smallest page_id.
OP8_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""


#: Texts as hexadecimal digits, two a byte; windows of 200 bytes that start more than once, and what they leave.
OP6_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents),
w AS (SELECT doc_id, i, md5(substring(hx, 2 * i + 1, 400)) AS m FROM (SELECT doc_id, hx, unnest(range(CAST(length(hx) / 2 AS BIGINT) - 199)) AS i FROM d WHERE length(hx) >= 400)),
r AS (SELECT m FROM w GROUP BY m HAVING count(*) > 1),
c AS (SELECT doc_id, i FROM w WHERE m IN (SELECT m FROM r)),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM c),
n AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM g),
s AS (SELECT doc_id, n, min(i) AS a, max(i) + 200 AS b FROM n GROUP BY doc_id, n),
k AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS lo, a AS hi, a, b FROM s),
t AS (SELECT d.doc_id, string_agg(substring(hx, 2 * lo + 1, 2 * (hi - lo)), '' ORDER BY a) || substring(any_value(hx), 2 * max(b) + 1) AS kept, sum(b - a) AS removed, count(*) AS spans FROM d JOIN k ON k.doc_id = d.doc_id GROUP BY d.doc_id)
SELECT d.doc_id, CAST(length(hx) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, hx))) AS kept_sha256
FROM d LEFT JOIN t ON t.doc_id = d.doc_id
"""

OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    """Where SQL can say it; the others are tested against the libraries, brute force or held-out rows."""
    return {"op6_suffix_dedup": OP6_SQL, "op8_warc": OP8_SQL, "op9_topk": OP9_SQL}
