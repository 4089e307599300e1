"""Queries of this subpackage over the driver's tables, and their DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import chat, decontam, fingerprint, language, licenses, linededup, neardup, packing, quality, toxicity
from .work import table


def op1_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op2_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op3_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.fit(docs))


def op4_fingerprints(spark, sf_dir):
    return fingerprint.edited_pairs(table(spark, sf_dir, "documents"))


def op5_decontamination(spark, sf_dir):
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_near_duplicates(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=3, num=85, den=100)


def op7_chat_format(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    return chat.format_table(rows.unionByName(more))


def op8_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark, sf_dir):
    """The digest of each cleaned text: length and SHA-256, with the number of lines taken out."""
    out = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_removed", F.length("text").cast("bigint").alias("chars_left"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op10_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
with d as (select doc_id, coalesce(text, '') as text from documents),
n as (select *, coalesce(lead(text) over (order by doc_id nulls first, text), first_value(text) over (order by doc_id nulls first, text)) as next_text from d),
e as (select *, length(text)::bigint as n_chars, left(text, (length(text) - length(text) // 2)::int) || left(next_text, (length(text) // 2)::int) as edited from n)
select doc_id, n_chars, sha256(edited) as edited_sha256 from e"""

OP7_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e as (select *, regexp_replace(text, '(\\|### |</turn>|<\|)', '\\\1', 'g') as escaped from t)
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length(escaped) + length(role) + 14)::bigint as formatted_chars, 0::bigint as n_attachments, 0::bigint as expanded_tokens
from e group by conv_id"""

QUERIES = {
    "op1_quality": op1_quality,
    "op3_language": op3_language,
    "op5_decontamination": op5_decontamination,
    "op6_near_duplicates": op6_near_duplicates,
    "op9_line_dedup": op9_line_dedup,
    "op2_toxicity": op2_toxicity,
    "op4_fingerprints": op4_fingerprints,
    "op7_chat_format": op7_chat_format,
    "op8_packing": op8_packing,
    "op10_license_scan": op10_license_scan,
}

ORACLES = {"op7_chat_format": OP7_SQL, "op10_license_scan": licenses.scan_sql()}
