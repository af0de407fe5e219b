"""Registered queries of this package and their DuckDB SQL, where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsift.session import shared_dir

from . import (arc_convert, bpe_tree, cap_filters, chat_format, gray_index, hilbert_codes, license_scan, line_crf, link_graph,
               mixing, subword_lang, token_scan, vantage_tree)

MIX = {"source": 0.5, "lang": {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}, "topic": 0.8}
MIX_RATE = 0.5
MIX_SEED = 7
MIX_SWEEPS = 12
#: The end-of-document id that the vocabulary leaves free.
END_ID = 50256
#: A text that holds the template's own control strings.
HOSTILE = "\\### Assistant: </turn> ok"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def bpe_files() -> dict:
    """Rank file and pattern of the public byte-level vocabulary."""
    import public_tokenizers

    return {"rank_path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def op1_license_scan(spark, sf):
    return license_scan.scan_documents(table(spark, sf, "documents"))


def op2_arc_to_warc(spark, sf):
    return arc_convert.archive_pages(table(spark, sf, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_token_counts(spark, sf):
    path = shared_dir(spark, "llm", "tokens")
    return token_scan.token_counts(table(spark, sf, "documents"), path, end_id=END_ID, **bpe_files())


def op4_source_mix(spark, sf):
    out = mixing.mix(table(spark, sf, "documents"), MIX, rate=MIX_RATE, seed=MIX_SEED, sweeps=MIX_SWEEPS)
    return out.withColumns({c: F.round(c, 6) for c in ("factor", "probability")})


def op5_chat_format(spark, sf):
    own = spark.createDataFrame([(-7, k, r, HOSTILE) for k, r in enumerate(("user", "assistant"))],
                                "conv_id long, turn long, role string, text string")
    given = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.format_conversations(given.unionByName(own))


def op6_host_trust(spark, sf):
    return link_graph.judge_urls(table(spark, sf, "pages"))


def op7_quality_rules(spark, sf):
    docs = table(spark, sf, "documents")
    return line_crf.judge_lines(docs, line_crf.train_on_labels(docs, table(spark, sf, "labels")))


def op8_vector_caps(spark, sf):
    return cap_filters.near_vectors(table(spark, sf, "embeddings"))


def op9_simhash_groups(spark, sf):
    out = gray_index.near_duplicates(table(spark, sf, "documents"), shingle=3, distance=3)
    return out.select("doc_id", gray_index.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op10_byte_bpe(spark, sf):
    return bpe_tree.token_digests(table(spark, sf, "documents"), **bpe_files())


def op11_subword_language(spark, sf):
    docs = table(spark, sf, "documents")
    held = subword_lang.held_out("doc_id")
    model = subword_lang.train_on_languages(docs, usable=~held)
    return subword_lang.identify(docs, model, carry={"held_out": held})


def op12_vantage_clusters(spark, sf):
    return vantage_tree.cluster(table(spark, sf, "embeddings"), dims=64, scale=256, k=40, rounds=5, salt="2")


def op13_hilbert_codes(spark, sf):
    return hilbert_codes.compress(table(spark, sf, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)


QUERIES = {q.__name__: q for q in (
    op1_license_scan, op2_arc_to_warc, op3_token_counts, op4_source_mix, op5_chat_format, op6_host_trust,
    op7_quality_rules, op8_vector_caps, op9_simhash_groups, op10_byte_bpe, op11_subword_language, op12_vantage_clusters,
    op13_hilbert_codes)}

_WARC_SQL = f"""
WITH d AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
           FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= {arc_convert.REVISIT_BYTES}
             THEN min(page_id) OVER (PARTITION BY payload_bytes, payload_digest) END AS m FROM d),
g AS (SELECT *, m IS NOT NULL AND page_id IS DISTINCT FROM m AS again FROM f)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN m END AS refers_to FROM g"""

_CHAT_SQL = f"""
WITH given AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '{HOSTILE}'), (-7, 1, 'assistant', '{HOSTILE}')),
sized AS (SELECT *, len(replace(replace(replace(text, '\\', '\\\\'), '###', '\\h'), '</turn>', '\\t'))
    + len(replace(replace(replace(replace(replace(replace(role, '\\', '\\\\'), '###', '\\h'), '</turn>', '\\t'),
      ':', '\\c'), chr(10), '\\n'), chr(13), '\\r')) + 15 AS chars FROM given)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars, false AS rewritten FROM sized GROUP BY conv_id"""

ORACLE_SQL = {
    "op2_arc_to_warc": _WARC_SQL,
    "op5_chat_format": _CHAT_SQL,
    "op6_host_trust": link_graph.judge_sql(),
    "op4_source_mix": mixing.mix_sql(MIX, rate=MIX_RATE, seed=MIX_SEED, sweeps=MIX_SWEEPS),
}
