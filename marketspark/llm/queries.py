"""The ten operators' queries over the tables documents, pages, labels and conversations."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketspark.llm import bpe, exact_dedup, merkle, minhash, packing, quality, quotes, sharding, url_filter, warc
from marketspark.llm.common import new_table_path

RULES = tuple(
    url_filter.Rule(verdict, target)
    for verdict, target in (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
)
#: Below nearly every page of the test tables, so that records are really segmented.
SEGMENT_BYTES = 1024
POLICY = url_filter.UrlPolicy(RULES)


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file; the folder is the environment's TOKENIZERS_DIR if that is set."""
    folder = os.environ.get("TOKENIZERS_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op3_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), POLICY).select("page_id", "host", "path", "rule", "verdict")


def op4_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quotes.linked_messages(table(spark, sf_dir, "conversations"))
    return out.select(F.col("conv").cast("long").alias("conv_id"), "turn", "role", "text", "parent_turn", "root_turn", "depth", "quotes", "position")


def op5_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_with_next(table(spark, sf_dir, "documents"))


def op6_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.archive_round_trip(table(spark, sf_dir, "pages"), new_table_path(spark, "warc"), segment_bytes=SEGMENT_BYTES)
    return out.filter(F.when(F.col("verified"), True).otherwise(F.raise_error("a WARC record fails its verification").cast("boolean"))).drop("verified")


def op7_icws_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op9_tree_merge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op10_vector_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 40)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_rule_ensemble,
        op2_best_fit_packing,
        op3_url_vocabulary,
        op4_quotation_linking,
        op5_merkle_fingerprints,
        op6_warc_segments,
        op7_icws_near_dedup,
        op8_bpe_transducer,
        op9_tree_merge_dedup,
        op10_vector_sharding,
    )
}


def _url_sql() -> str:
    def hits(terms):
        return " + ".join(f"CAST(regexp_matches(words, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') AS INT)" for t in terms)

    rules = sorted(RULES, key=lambda r: (-len(r.target), r.verdict))
    fit = " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.target}'" for r in rules)
    verdicts = " ".join(f"WHEN '{r.target}' THEN '{r.verdict}'" for r in rules)
    up = exact_dedup.UPPER
    return f"""
WITH cut AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{up}', '{up.lower()}') AS host,
                 regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut),
ruled AS (SELECT *, host || translate(path, '{up}', '{up.lower()}') AS words, CASE {fit} END AS rule FROM parts)
SELECT page_id, host, path, rule, CASE rule {verdicts} ELSE
  CASE WHEN ({hits(POLICY.strict)}) >= 1 OR ({hits(POLICY.soft)}) >= {POLICY.soft_needed} THEN 'block' ELSE 'allow' END END AS verdict
FROM ruled"""


ORACLE_SQL: dict[str, str] = {
    "op3_url_vocabulary": _url_sql(),
    "op6_warc_segments": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, lower(sha1(b)) AS payload_digest FROM p),
k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS best FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < best THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < best THEN best END AS refers_to
FROM k""",
    "op9_tree_merge_dedup": f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{exact_dedup.UPPER}', '{exact_dedup.UPPER.lower()}')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)""",
}
