"""The pN_ queries of the training-data operators, over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..cluster import keep, load
from . import conversations, language, lookalike, messages, packing, personal, replies, scans, tokens, truncation


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return replies.defects(load(spark, d, "ai_messages"), language.fit(load(spark, d, "documents")))


def _p2_records(spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, str]]:
    rows = lookalike.records(load(spark, d, "annotations"), load(spark, d, "search_hits"), load(spark, d, "page_ocr_cache"))
    return rows, lookalike.rules(lookalike.count_characters(rows, ["text"]))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.look_alike_pairs(*_p2_records(spark, d))


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of p2_found as classes: a row for each record, with its representative."""
    return lookalike.look_alike_classes(*_p2_records(spark, d))


def p2_forms(spark: SparkSession, d: str) -> DataFrame:
    rows, to = _p2_records(spark, d)
    return lookalike.unify(rows, "text", "form", to).drop("text")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.noisy_lines(load(spark, d, "page_ocr_cache"), load(spark, d, "books"))


def p3_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return scans.paragraphs(load(spark, d, "page_ocr_cache"), load(spark, d, "books"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return replies.truncated_messages(load(spark, d, "ai_messages"))


def p4_shares(spark: SparkSession, d: str) -> DataFrame:
    """For each action_type, spelled one way, null as its own: messages, those cut off, and their share."""
    rows = messages.heads(load(spark, d, "ai_messages")).select("id", "action_type")
    cut_off = p4_found(spark, d).withColumn("cut_off", F.lit(1))
    sums = rows.join(cut_off, "id", "left").groupBy("action_type").agg(F.count("*").alias("messages"), F.sum(F.coalesce("cut_off", F.lit(0))).alias("truncated"))
    return sums.withColumn("share", F.round(F.col("truncated") / F.col("messages"), 6))


def p4_evidence(spark: SparkSession, d: str) -> DataFrame:
    """What tells of each message that it was cut off; replies that only give their prompt back are still among them."""
    return truncation.judgements(load(spark, d, "ai_messages"))


def p4_copies(spark: SparkSession, d: str) -> DataFrame:
    """Messages that a longer one begins with, whether cut off or not: the comparison of whole values alone."""
    return truncation.whole_prefixes(load(spark, d, "ai_messages"))


def p4_limits(spark: SparkSession, d: str) -> DataFrame:
    return truncation.length_limits(load(spark, d, "ai_messages"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.judge(load(spark, d, "ai_threads"), load(spark, d, "ai_messages")).where("NOT ok").select("thread_id")


def p5_conversations(spark: SparkSession, d: str) -> DataFrame:
    return conversations.rebuild(load(spark, d, "ai_threads"), load(spark, d, "ai_messages"))


def p5_corrected(spark: SparkSession, d: str) -> DataFrame:
    """The conversations that are whole once the replies' clock is corrected, by up to an hour."""
    return conversations.rebuild(load(spark, d, "ai_threads"), load(spark, d, "ai_messages"), conversations.TOLERANCE)


def p5_clocks(spark: SparkSession, d: str) -> DataFrame:
    """The least-squares offset of the replies' clock in each thread, and, with null thread_id, in all of them."""
    rows = keep(messages.heads(load(spark, d, "ai_messages")).where("thread_id IS NOT NULL"))
    triples = keep(conversations.constraints(rows))
    every = conversations.clocks(triples, []).select(F.lit(None).cast("long").alias("thread_id"), "bounds", "violated", "offset_s")
    return conversations.clocks(triples, ["thread_id"]).unionByName(every)


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(load(spark, d, "documents"))


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_texts(load(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.pieces(load(spark, d, "documents")).select("doc_id", "kind", "found_text").distinct()


def p8_masked(spark: SparkSession, d: str) -> DataFrame:
    return personal.mask(load(spark, d, "documents"))


def queries() -> dict:
    own = [
        p1_found, p3_found, p3_paragraphs, p4_found, p4_shares, p4_evidence, p4_copies, p4_limits, p2_found, p2_classes, p2_forms, p5_found, p5_conversations, p5_corrected, p5_clocks, p6_ids, p7_pack,
        p8_found, p8_masked
    ]
    return {f.__name__: f for f in own}


# Each message once, its earliest row, with what the rule of whole conversations asks of it.
_MESSAGES = r"""WITH m AS (SELECT * FROM (SELECT id, thread_id, lower(regexp_replace(role, '^[\s\p{Z}\p{C}]+|[\s\p{Z}\p{C}]+$', '', 'g')) AS role, lower(regexp_replace(action_type, '^[\s\p{Z}\p{C}]+|[\s\p{Z}\p{C}]+$', '', 'g')) AS action_type, content, created_at, coalesce(trim(image_path) <> '', false) AS image,
lower(regexp_replace(content, '(?s)<!--.*?-->|<[^<>]*>|&[a-z]+;|[\s\p{Z}\p{C}\p{P}\p{M}\p{Sm}\p{Sk}\p{Sc}\x{3164}\x{115F}\x{1160}]', '', 'g')) AS rest, row_number() OVER (PARTITION BY id ORDER BY created_at NULLS LAST, thread_id) AS rn FROM ai_messages WHERE id IS NOT NULL) WHERE rn = 1 AND thread_id IS NOT NULL),
k AS (SELECT *, coalesce(rest <> '' AND rest NOT IN ({words}), false) AS readable, row_number() OVER (PARTITION BY thread_id, role = 'system' ORDER BY created_at, id) AS turn FROM m),
t AS (SELECT thread_id, bool_and(created_at IS NOT NULL AND coalesce(role, '') IN ('user', 'assistant', 'system')) AND count(*) FILTER (WHERE role <> 'system') > 0 AND count(*) FILTER (WHERE role <> 'system') % 2 = 0
AND coalesce(bool_and(CASE WHEN turn % 2 = 1 THEN role = 'user' AND (readable OR image) ELSE role = 'assistant' AND readable END) FILTER (WHERE coalesce(role, '') <> 'system'), false) AND thread_id IN (SELECT id FROM ai_threads) AS ok FROM k GROUP BY 1)""".replace("{words}", ", ".join(f"'{w}'" for w in messages.NO_VALUE_WORDS))


def oracle_sql() -> dict[str, str]:
    """SQL for what it can express: the rule of problem 5.  The other operators are tested against brute force, round trips or held-out cases."""
    return {
        "p4_copies": r"WITH m AS (SELECT DISTINCT id, trim(content, ' ') AS c FROM ai_messages WHERE id IS NOT NULL AND trim(content, ' ') <> ''), v AS (SELECT DISTINCT c FROM m), "
        r"p AS (SELECT DISTINCT a.c FROM v a JOIN v b ON starts_with(b.c, a.c) AND length(b.c) > length(a.c) AND regexp_matches(substr(b.c, length(a.c) + 1), '^ ?[\p{L}\p{N}]')) SELECT DISTINCT id FROM m JOIN p USING (c)",
        "p4_limits": r"WITH s AS (SELECT nullif(lower(regexp_replace(action_type, '^[\s\p{Z}\p{C}]+|[\s\p{Z}\p{C}]+$', '', 'g')), '') AS source, length(trim(content, ' ' || chr(9) || chr(10) || chr(13) || chr(8203) || chr(12288) || chr(160))) AS length FROM ai_messages), "
        "c AS (SELECT source, length, count(*) AS texts FROM s WHERE length > 0 GROUP BY ALL), "
        "u AS (SELECT *, (sum(texts) OVER (PARTITION BY source ORDER BY length RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING) - texts) / 20.0 AS usual FROM c) SELECT source, length, texts, usual FROM u WHERE texts > usual + 5 * sqrt(usual + 1)",
        "p5_found": _MESSAGES + " SELECT thread_id FROM t WHERE NOT ok UNION SELECT id FROM ai_threads WHERE id NOT IN (SELECT thread_id FROM t)",
        "p5_conversations": _MESSAGES + " SELECT thread_id, row_number() OVER (PARTITION BY thread_id ORDER BY created_at, id) - 1 AS turn, id, role, nullif(action_type, '') AS action_type, created_at, content FROM m WHERE thread_id IN (SELECT thread_id FROM t WHERE ok)",
    }
