"""The queries opN_<name> and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import public_tokenizers

from relspark.llm import chat, jaccard_join, media, mixing, nearest, quality, segmentation, sharding, token_counts, token_output
from relspark.llm.common import fresh_path, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_mixing(spark, sf_dir):
    return mixing.mix_sizes(read_table(spark, sf_dir, "documents"))


#: {docs} stands for a table with doc_id, source, text.
MIX_SQL = r"""
sizes AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM {docs}),
by_source AS (SELECT k, sum(size)::HUGEINT AS source_size FROM sizes GROUP BY k),
weighed AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY k) - 1) % 3 + 1)::INT]::HUGEINT AS w FROM by_source),
sums AS (SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS ws,
    coalesce(sum(source_size) OVER b, 0) AS size_before, coalesce(sum(w) OVER b, 0) AS w_before FROM weighed
    WINDOW b AS (ORDER BY source_size::DOUBLE / w::DOUBLE, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
filled AS (SELECT *, (3 * total - 4 * size_before) * w >= 4 * source_size * (ws - w_before) AS is_full FROM sums),
targets AS (SELECT k, source_size, CASE WHEN is_full THEN (2 * source_size)::DOUBLE ELSE (w * (3 * total - 4 * full_size))::DOUBLE / (2 * (ws - full_w))::DOUBLE END AS target
    FROM (SELECT *, sum(CASE WHEN is_full THEN source_size ELSE 0 END) OVER () AS full_size, sum(CASE WHEN is_full THEN w ELSE 0 END) OVER () AS full_w FROM filled)),
rates AS (SELECT *, floor(rate) AS whole, target - floor(rate) * source_size::DOUBLE AS need
    FROM (SELECT *, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0.0::DOUBLE END AS rate FROM targets)),
drawn AS (SELECT s.*, r.source_size, r.target, r.whole, r.need, 1::BIGINT << ((CASE WHEN size > 0 THEN length(to_binary(size)) ELSE 0 END + 1) // 2)::INT AS w,
    (('0x' || substr(md5('mix-1|' || coalesce(s.doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
    FROM sizes s JOIN rates r USING (k)),
classes AS (SELECT k, w, any_value(need) AS need, sum(size)::HUGEINT AS words FROM drawn GROUP BY k, w),
certain AS (SELECT *, words > 0 AND need > 0 AND (need - coalesce(sum(words) OVER (h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE) * w::DOUBLE
    >= (sum(w * words) OVER (h ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS is_certain FROM classes WINDOW h AS (PARTITION BY k ORDER BY w DESC)),
shares AS (SELECT k, min(w) FILTER (is_certain) AS full_w, any_value(need) - coalesce(sum(words) FILTER (is_certain), 0)::DOUBLE AS open_need,
    (sum(w * words) FILTER (NOT is_certain))::DOUBLE AS open_words FROM certain GROUP BY k),
chances AS (SELECT d.*, s.open_need, w >= coalesce(full_w, w + 1) AS is_certain,
    CASE WHEN w < coalesce(full_w, w + 1) THEN coalesce(open_need / nullif(open_words, 0), 0) * w::DOUBLE ELSE 0 END AS p FROM drawn d JOIN shares s USING (k)),
ranked AS (SELECT *, x / (1.0::DOUBLE + x) AS rank_key FROM (SELECT *, CASE WHEN p > 0 THEN (u / (1.0::DOUBLE - u)) / (p / (1.0::DOUBLE - p)) END AS x FROM chances)),
cums AS (SELECT *, sum(size) OVER (PARTITION BY k, p > 0 ORDER BY rank_key, coalesce(doc_id::VARCHAR, '')) AS cum,
    sum(size) OVER (PARTITION BY k, p > 0, rank_key, doc_id) AS own FROM ranked),
mixed AS (SELECT *, (whole + CASE WHEN is_certain OR p > 0 AND 2 * cum - own <= 2 * open_need THEN 1 ELSE 0 END)::BIGINT AS copies FROM cums)
"""
ORACLE_SQL["op1_mixing"] = "WITH " + MIX_SQL.format(docs="documents") + """
SELECT doc_id, source, size, source_size::BIGINT AS source_size, target, copies, (size * copies)::BIGINT AS taken FROM mixed"""


@query
def op7_chat_formatting(spark, sf_dir):
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    out = chat.format_paths(chat.reply_paths(chat.from_turns(rows.unionByName(more)), branches=1))
    turns = chat.read_back(F.col("formatted"))
    out = out.withColumns({"_turns": turns, "_loss": chat.loss_text(F.col("formatted"), F.col("loss_spans"))})
    return out.select(
        F.col("conv").alias("conv_id"), F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"), F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE_SQL["op7_chat_formatting"] = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(t, r)),
e AS (SELECT *, length(replace(replace(replace(replace(role, '\', '\s'), '<', '\l'), '[', '\b'), chr(10), '\n')) AS role_chars,
    length(replace(replace(replace(text, '\', '\s'), '<', '\l'), '[', '\b')) AS text_chars FROM c)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(12 + role_chars + 1 + text_chars + 11)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""


@query
def op10_sharding(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = sharding.external_shuffle(docs, fresh_path(spark, "shards"))
    return out.select("doc_id", sharding.text_size(F.col("text")).alias("size"), sharding.text_crc32(F.col("text")).alias("text_crc32"), "law", "shard", "slot", "grown_shard")


@query
def op2_token_counts(spark, sf_dir):
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op8_token_output(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    tokens = token_output.write_token_ids(docs, fresh_path(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_output.digests(tokens)


@query
def op3_quality_classifier(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return quality.score(docs, quality.learn(docs, read_table(spark, sf_dir, "labels")))


@query
def op6_media_columns(spark, sf_dir):
    return media.digests(media.extract(media.store(read_table(spark, sf_dir, "documents"), fresh_path(spark, "media"))))


@query
def op5_jaccard_join(spark, sf_dir):
    return jaccard_join.near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


@query
def op4_sentencepiece(spark, sf_dir):
    return segmentation.segment(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op9_nearest_neighbours(spark, sf_dir):
    return nearest.nearest(read_table(spark, sf_dir, "embeddings"))
