"""Registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trolley.llm import (decontaminate, hard_negatives, html_extract, langid, line_dedup, periodic, quality, secrets,
                         sentencepiece_bpe, simhash, urlfilter, warc, winnow)
from trolley.llm.common import table


def piece_model() -> str:
    """The vocabulary file of the pipeline; a parameter of the operator, never copied here."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(decontaminate.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(line_dedup.dedup_lines(table(spark, sf_dir, "documents")))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sentencepiece_bpe.encode_decode(table(spark, sf_dir, "documents"), piece_model())
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "agrees")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = warc.new_archive(spark)
    warc.write_archive(table(spark, sf_dir, "pages"), root)
    return warc.read_archive(spark, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.report(secrets.scan(docs, secrets.train(docs)))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.report(periodic.detect(periodic.plant(table(spark, sf_dir, "documents"))))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.prepared(table(spark, sf_dir, "embeddings").withColumn("label", label))
    return hard_negatives.mine(rows, rows.where("vec_id % 50 = 0"))


def op13_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = winnow.with_next(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", "edited_sha256", winnow.as_text("hashes", "positions").alias("fingerprint"),
                      winnow.as_text("edited_hashes", "edited_positions").alias("edited_fingerprint"), "near_edited", "near_next")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_line_dedup": op2_line_dedup,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_language": op4_language,
    "op5_warc": op5_warc,
    "op6_urlfilter": op6_urlfilter,
    "op7_secrets": op7_secrets,
    "op8_html": op8_html,
    "op9_simhash": op9_simhash,
    "op10_quality": op10_quality,
    "op11_periodic": op11_periodic,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_winnow": op13_winnow,
}
SQL: dict[str, str] = {
    "op5_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS payload FROM pages
        ), d AS (
            SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest
            FROM p
        ), f AS (
            SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM f""",
    "op6_urlfilter": """
        WITH u AS (
            SELECT page_id,
                   translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
            FROM pages
        ), r(action, rule_host, rule_path) AS (
            VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'),
                   ('allow', 'org', '/fr/')
        ), fit AS (
            SELECT page_id, action, rule_host || rule_path AS rule
            FROM u JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
        ), best AS (
            SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action
            FROM fit GROUP BY page_id
        )
        SELECT u.page_id, host, path, rule,
               coalesce(action, CASE WHEN regexp_matches(host,
                   '(^|[.])([^.]*-)?(adult|bets|casino|gambling|pills|porn|spam|xxx)(-[^.]*)?[.]') THEN 'block' ELSE 'allow' END) AS verdict
        FROM u LEFT JOIN best USING (page_id)""",
    "op12_hard_negatives": """
        WITH e AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE CAST(label AS BIGINT) END AS label,
                   list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
            FROM (SELECT DISTINCT * FROM embeddings)
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), pairs AS (
            SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
                   CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
            FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
        ), p AS (
            SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
        )
        SELECT p.anchor_id, positive_id,
               CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
               other_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
             AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
        QUALIFY rank <= 3""",
}
