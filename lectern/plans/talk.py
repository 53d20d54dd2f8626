"""Queries on conversations and event streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..cluster import load
from ..functions import text as T
from ..operators import conversations as C
from ..streaming import events as E

_ROLE = "CASE WHEN lower(trim(role, ' ')) IN ('user','assistant','system') THEN lower(trim(role, ' ')) ELSE 'user' END"
_ACT = "CASE WHEN lower(trim(action_type, ' ')) IN ('translate','explain','search','chat','vision') THEN lower(trim(action_type, ' ')) END"
_M = f"""WITH m AS (SELECT id, thread_id, {_ROLE} AS role, content, image_path, {_ACT} AS action_type, created_at FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at NULLS LAST, thread_id, role, content) AS rn FROM ai_messages) WHERE rn = 1)"""


def _m(s, d):
    return C.messages(load(s, d, "ai_messages"))


def thread_list(s, d):
    t = C.thread_summaries(load(s, d, "ai_threads"), _m(s, d))
    return t.select("id", "title", "book_id", "action", "messages", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated")).orderBy(F.desc("updated"), F.desc("id"))


def thread_messages(s, d):
    return _m(s, d).orderBy("thread_id", "created_at", "id").select("id", "thread_id", "role", "action_type", T.minute(F.col("created_at")).alias("at"), F.when(F.col("image_path").isNotNull(), F.concat(F.lit("/data/"), "image_path")).alias("image"))


def message_counts(s, d):
    return _m(s, d).groupBy("thread_id").agg(F.count("*").alias("messages"), F.count_if(T.has_text(F.col("content"))).alias("with_text"))


def history_without_last(s, d):
    return C.without_last(_m(s, d).where("created_at IS NOT NULL")).select("thread_id", "id", "role")


def assistant_inherits_action(s, d):
    return C.inherited_actions(_m(s, d).where("created_at IS NOT NULL"))


def window_without_book(s, d):
    return C.window_of(load(s, d, "ai_threads"), None).select("id", "title")


def chat_request_messages(s, d):
    h = C.request_history(_m(s, d).where("created_at IS NOT NULL"), "chat")
    return h.select(
        "thread_id", F.size("messages").cast("long").alias("n"), F.array_join(F.transform("messages", lambda m: F.substring(m["role"], 1, 1)), "").alias("roles"),
        F.md5(F.array_join(F.transform("messages", lambda m: F.coalesce(m["content"], F.lit("-"))), "|")).alias("digest")
    )


def responses_instructions(s, d):
    i = C.instructions(_m(s, d).where("created_at IS NOT NULL"))
    return i.select("thread_id", "instructions", F.size("items").cast("long").alias("items"))


def prompt_compose(s, d):
    a = F.coalesce("action_type", F.lit("chat"))
    return _m(s, d).where("role = 'user'").select("id", C.system_prompt(a).alias("prompt"), F.md5(C.wrap_untrusted(a, F.coalesce("content", F.lit("")))).alias("input"))


def error_texts(s, d):
    whole = F.md5(T.error_text(F.concat(F.lit("Exception:"), F.coalesce("content", F.lit("")))))
    return _m(s, d).select("id", whole.alias("digest"), F.md5(T.http_error(F.lit(500), F.col("content"))).alias("shown"))


def thread_titles(s, d):
    return load(s, d, "ai_threads").select("id", T.blank_to(F.col("title"), "untitled").alias("title"), T.responses_endpoint(F.concat(F.lit("https://host/"), F.col("action_type"), F.lit("/v1//")), "https://host").alias("endpoint"))


def sse_decode(s, d):
    framed = _m(s, d).where("role = 'assistant'").select("id", E.as_event(F.col("content")).alias("event"))
    return framed.select("id", E.chat_delta(F.col("event")).alias("delta")).where("delta IS NOT NULL").select("id", F.md5("delta").alias("digest"))


def sse_transcript(s, d):
    """The messages of each thread as one stream of chunks, decoded and joined in order; system messages stand for failures, the first of which ends the stream."""
    m = _m(s, d).where("created_at IS NOT NULL")
    e = m.select("thread_id", "created_at", "id", F.when(F.col("role") == "system", E.failed_event(F.col("content"))).otherwise(E.delta_event(F.col("content"))).alias("event"))
    t = E.transcripts(e, "thread_id", ["created_at", "id"])
    return t.select("thread_id", F.md5("transcript").alias("digest"), "failed")


_TEMPLATES = " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in C.TEMPLATES.items())
QUERIES = {
    "thread_list": (
        thread_list,
        _M + """, s AS (SELECT thread_id, count(*) AS messages, max(created_at) AS last_at, arg_max(action_type, (coalesce(created_at, TIMESTAMP '0001-01-01'), id)) FILTER (WHERE action_type IS NOT NULL) AS last_action FROM m GROUP BY 1)
SELECT t.id, t.title, t.book_id, coalesce(s.last_action, CASE WHEN lower(trim(t.action_type, ' ')) IN ('translate','explain','search','chat','vision') THEN lower(trim(t.action_type, ' ')) ELSE 'chat' END) AS action, coalesce(s.messages, 0) AS messages, strftime(CASE WHEN s.last_at > t.updated_at OR t.updated_at IS NULL THEN s.last_at ELSE t.updated_at END, '%Y-%m-%d %H:%M:%S') AS updated FROM ai_threads t LEFT JOIN s ON t.id = s.thread_id""",
    ),
    "thread_messages": (
        thread_messages, _M + " SELECT id, thread_id, role, action_type, strftime(created_at, '%Y-%m-%d %H:%M') AS at, CASE WHEN image_path IS NOT NULL THEN '/data/' || image_path END AS image FROM m"
    ),
    "message_counts": (
        message_counts, _M + r" SELECT thread_id, count(*) AS messages, count(*) FILTER (WHERE length(regexp_replace(content, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) > 0) AS with_text FROM m GROUP BY 1"
    ),
    "history_without_last": (
        history_without_last,
        _M + " SELECT thread_id, id, role FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY created_at DESC, id DESC) AS rn FROM m WHERE created_at IS NOT NULL) WHERE rn > 1"
    ),
    "assistant_inherits_action": (
        assistant_inherits_action,
        _M + """, u AS (SELECT *, max(CASE WHEN role = 'user' THEN k END) OVER (PARTITION BY thread_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS uk FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY created_at, id) AS k FROM m WHERE created_at IS NOT NULL))
SELECT a.id, b.action_type AS action FROM u a LEFT JOIN u b ON a.thread_id = b.thread_id AND a.uk = b.k WHERE a.role = 'assistant'""",
    ),
    "window_without_book": (window_without_book, "SELECT id, title FROM ai_threads WHERE book_id IS NULL ORDER BY id LIMIT 1"),
    "chat_request_messages": (
        chat_request_messages,
        _M + " SELECT thread_id, count(*) AS n, string_agg(substr(role, 1, 1), '' ORDER BY created_at, id) AS roles, md5(string_agg(coalesce(content, '-'), '|' ORDER BY created_at, id)) AS digest FROM m WHERE created_at IS NOT NULL GROUP BY 1"
    ),
    "responses_instructions": (
        responses_instructions,
        _M + " SELECT thread_id, coalesce(string_agg(coalesce(content, ''), chr(10) ORDER BY created_at, id) FILTER (WHERE role = 'system'), '') AS instructions, count(*) FILTER (WHERE role <> 'system') AS items FROM m WHERE created_at IS NOT NULL GROUP BY 1"
    ),
    "prompt_compose": (
        prompt_compose,
        _M + f""", a AS (SELECT id, coalesce(action_type, 'chat') AS a, coalesce(content, '') AS c FROM m WHERE role = 'user')
SELECT id, CASE WHEN a = 'translate' THEN '' ELSE '{C.ROLE_PROMPT}' || chr(10) || chr(10) END || CASE a {_TEMPLATES} END AS prompt, md5(CASE WHEN a IN ('translate','explain','search') THEN '<text>' || chr(10) || c || chr(10) || '</text>' ELSE c END) AS input FROM a""",
    ),
    "error_texts": (
        error_texts,
        _M + " SELECT id, md5(coalesce(content, '')) AS digest, md5('HTTP 500: ' || substr(coalesce(content, ''), 1, 600)) AS shown FROM m",
    ),
    "thread_titles": (
        thread_titles,
        r"SELECT id, coalesce(nullif(regexp_replace(title, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), ''), 'untitled') AS title, 'https://host/' || action_type || '/responses' AS endpoint FROM ai_threads"
    ),
    "sse_decode": (sse_decode, _M + " SELECT id, md5(content) AS digest FROM m WHERE role = 'assistant' AND content <> ''"),
    "sse_transcript": (
        sse_transcript,
        _M + """, e AS (SELECT *, min(CASE WHEN role = 'system' THEN k END) OVER (PARTITION BY thread_id) AS stop FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY created_at, id) AS k FROM m WHERE created_at IS NOT NULL))
SELECT thread_id, md5(coalesce(string_agg(CASE WHEN content <> '' AND (stop IS NULL OR k < stop) THEN content END, '' ORDER BY k), '') || coalesce(max(CASE WHEN k = stop THEN chr(10) || chr(10) || '> ' || coalesce(content, 'failed') END), '')) AS digest, bool_or(role = 'system') AS failed FROM e GROUP BY 1""",
    ),
}
