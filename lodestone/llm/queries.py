"""The registered queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hmm, langid
from .common import new_folder, read, staged
from .decontaminate import contamination, with_matches
from .exact_dedup import exact_groups
from .mixing import mix
from .near_dedup import near_classes
from .sharding import sharded
from .token_counts import TokenLedger, changes, word_counts
from .token_files import token_round_trip
from .warc import archive_round_trip


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return contamination(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(read(spark, sf_dir, "documents")).select("doc.doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(read(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches: all documents come; those labelled toxic go; those of low quality are
    counted again without their cell bars; and the first batch comes once more, to no effect."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    counted = staged(word_counts(docs, ("doc_id", "source", "lang"), blank="|"), "counted")
    toxic, poor = labels.where("toxic = 1").select("doc_id"), labels.where("toxic = 0 and quality = 0").select("doc_id")
    ledger = TokenLedger(spark, new_folder(spark, "ledger"))
    ledger.commit("1-all", changes(counted, F.col("counts")))
    ledger.commit("2-toxic", changes(toxic, None))
    ledger.commit("3-poor", changes(counted.join(poor, "doc_id", "left_semi"), F.col("bare")))
    ledger.commit("1-all", changes(counted, F.col("counts")))
    return ledger.totals()


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.fit(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op10_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.scores(read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_source_mix,
        op2_exact_dedup,
        op3_decontamination,
        op4_shards,
        op5_near_dedup,
        op6_token_files,
        op7_warc,
        op8_token_counts,
        op9_language_id,
        op10_hmm_scores,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op2_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_LOWER} AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)""",
    "op3_decontamination": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        windows AS (
            SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
            FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM windows),
        places AS (
            SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
        hits AS (SELECT doc_id, item_id, n, i FROM places JOIN windows USING (n, win)),
        hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
        hit_items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
            FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)""",
    "op7_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, octet_length(encode(h)) AS n, sha256(h) AS digest, min(page_id) OVER (PARTITION BY h) AS first FROM p)
        SELECT page_id, n AS payload_bytes, digest AS payload_digest,
               CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
        FROM d""",
    "op8_token_counts": rf"""
        WITH fate AS (SELECT doc_id, max(toxic) AS toxic, max(CASE WHEN toxic = 0 AND quality = 0 THEN 1 ELSE 0 END) AS poor FROM labels GROUP BY doc_id),
        d AS (
            SELECT source, lang, CASE WHEN poor = 1 THEN replace(coalesce(text, ''), '|', ' ') ELSE coalesce(text, '') END AS t
            FROM documents LEFT JOIN fate USING (doc_id) WHERE coalesce(toxic, 0) = 0),
        n AS (
            SELECT source, lang, 'words-1' AS version, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS n FROM d
            UNION ALL
            SELECT source, lang, 'words-2', len(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM d)
        SELECT source, lang, version, count(*) AS n_docs, sum(n)::BIGINT AS n_tokens FROM n GROUP BY ALL""",
}
