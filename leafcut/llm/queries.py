"""The registered queries of this subpackage, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafcut.llm.bloom_cascade import url_verdicts
from leafcut.llm.brown_lm import brown_scores
from leafcut.llm.content_sort import content_sort_dedup
from leafcut.llm.ordinal_toxicity import fit_toxicity, toxicity_scores
from leafcut.llm.phrase_automata import remove_recurring
from leafcut.llm.rule_ensemble import quality_scores
from leafcut.llm.shared import Scratch, read
from leafcut.llm.simhash_anchors import simhash_groups
from leafcut.llm.spaced_seeds import contaminated
from leafcut.llm.vector_packing import pack_documents
from leafcut.llm.warc_chunks import warc_round_trip

# Host and path of each rule, and its verdict.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return brown_scores(docs, F.crc32(F.col("doc_id").cast("string")) % 7 != 2)


def op2_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity_scores(docs, fit_toxicity(docs, read(spark, sf_dir, "labels")))


def op4_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), tokenizer_path(), tokens=4096)


def op5_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(read(spark, sf_dir, "documents"), shingle=3, max_bits=2)


def op6_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    scored, _ = quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), ~held_out, threshold=0.3)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def op7_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(read(spark, sf_dir, "pages"), Scratch(spark, "warc"))


def op8_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_recurring(read(spark, sf_dir, "documents"), window=20)


def op9_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort_dedup(read(spark, sf_dir, "documents"), keep="largest")


def op10_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, URL_RULES))} AS t(host, path, verdict)")
    return url_verdicts(read(spark, sf_dir, "pages"), rules)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_brown_lm": op1_brown_lm,
    "op2_spaced_seeds": op2_spaced_seeds,
    "op3_ordinal_toxicity": op3_ordinal_toxicity,
    "op4_vector_packing": op4_vector_packing,
    "op5_simhash_anchors": op5_simhash_anchors,
    "op6_rule_ensemble": op6_rule_ensemble,
    "op7_warc_chunks": op7_warc_chunks,
    "op8_phrase_automata": op8_phrase_automata,
    "op9_content_sort": op9_content_sort,
    "op10_bloom_cascade": op10_bloom_cascade,
}

ORACLE_SQL: dict[str, str] = {
    "op7_warc_chunks": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
            FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN first_id END AS refers_to, TRUE AS intact
        FROM f""",
    "op10_bloom_cascade": r"""
        WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        s AS (
            SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
            FROM u),
        rules(h, p, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block'))
        SELECT page_id, any_value(host) AS host, any_value(path) AS path, arg_max(h || p, length(h || p)) AS rule,
               coalesce(arg_max(v, length(h || p)), 'allow') AS verdict
        FROM s LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
        GROUP BY page_id""",
    "op9_content_sort": """
        SELECT doc_id,
               max(doc_id) OVER w AS keep_id,
               count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW w AS (PARTITION BY coalesce(text, ''))""",
}
