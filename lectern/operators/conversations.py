"""Conversation store: threads, histories and the requests made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import decode
from ..ordering import fill_forward
from .tables import latest

# Our own wording of prompts, by template.
TEMPLATES = {
    "translate": "Translate the text into the reader's language and give the translation only.",
    "explain": "Explain the passage to the reader in plain words.",
    "search": "Answer from the search results below and name their numbers.",
    "chat": "Answer the reader's question about the book.",
    "vision": "Describe what the picture shows.",
}
ROLE_PROMPT = "You help a reader with a document."
# Our own wording of the roles that a reader may choose; "general" is the one without a choice, "custom" is the reader's own.
ROLE_TEMPLATES = {
    "general": ROLE_PROMPT,
    "academic": "You help a researcher with a paper: weigh its method and evidence and keep its terms.",
    "novel": "You read a novel along with someone: talk about people, plot and style, and give nothing away.",
    "tech": "You advise on technical documentation: be exact and lead with what to do.",
    "language": "You teach a language by its texts: explain hard words and forms as they come.",
    "historical": "You study sources: tell what is attested, when and by whom, from what was said later.",
    "legal": "You explain legal texts: keep to the wording of clauses and give no legal advice.",
    "classical": "You explain old writing: put it into today's words first, then explain its grammar.",
    "ai": "You explain work on machine learning: models, training and where they fall short.",
}
UNTRUSTED = ("<text>\n", "\n</text>")


def messages(df: DataFrame) -> DataFrame:
    """Each message once, its earliest row, with decoded role (unknown: user) and action (unknown: null)."""
    first = df.groupBy("id").agg(F.min(F.struct(F.col("created_at").isNull(), "created_at", "thread_id", "role", "content", "image_path", "action_type")).alias("m"))
    role, action = decode.one_of(decode.tidy(F.col("m.role")), decode.ROLES, "user"), decode.one_of(decode.tidy(F.col("m.action_type")), decode.ACTIONS, None)
    return first.select("id", "m.thread_id", role.alias("role"), "m.content", "m.image_path", action.alias("action_type"), "m.created_at")


def thread_summaries(threads: DataFrame, messages: DataFrame) -> DataFrame:
    """Threads with number of messages, latest activity and latest action that is not null; sums are built before the shuffle."""
    sums = messages.groupBy(F.col("thread_id").alias("id")).agg(
        F.count("*").alias("messages"), F.max("created_at").alias("last_at"), F.max(F.when(F.col("action_type").isNotNull(), F.struct("created_at", "id", "action_type")))["action_type"].alias("last_action")
    )
    joined = threads.join(sums, "id", "left")
    action = F.coalesce("last_action", decode.one_of(decode.tidy(F.col("action_type")), decode.ACTIONS, "chat"))
    return joined.select("id", "title", "book_id", action.alias("action"), F.coalesce("messages", F.lit(0)).alias("messages"), F.greatest("updated_at", "last_at").alias("updated_at"))


def without_last(messages: DataFrame) -> DataFrame:
    """Histories without their newest message."""
    newest = messages.groupBy("thread_id").agg(F.max(F.struct("created_at", "id"))["id"].alias("_newest"))
    return messages.join(newest, "thread_id").where("id <> _newest").drop("_newest")


def inherited_actions(messages: DataFrame) -> DataFrame:
    """(id, action): of each assistant message the action of the user message last before it, null if that has none."""
    asked = messages.withColumn("_own", F.when(F.col("role") == "user", F.struct("action_type")))
    filled = fill_forward(asked, "thread_id", ["thread_id", "created_at", "id"], "_own", "_asked")
    return filled.where("role = 'assistant'").select("id", F.col("_asked.action_type").alias("action"))


def window_of(threads: DataFrame, book_id: int | None) -> DataFrame:
    """A book's thread, or for null the first without a book."""
    return threads.where(F.col("book_id").eqNullSafe(F.lit(book_id))).orderBy("id").limit(1)


def wrap_untrusted(action: Column, text: Column) -> Column:
    return F.when(action.isin("translate", "explain", "search"), F.concat(F.lit(UNTRUSTED[0]), text, F.lit(UNTRUSTED[1]))).otherwise(text)


def system_prompt(action: Column, overrides: Column | None = None) -> Column:
    """The role's prompt and the action's, an override in its place if it says anything; a translation goes without the role."""
    base = F.create_map(*(F.lit(x) for kv in TEMPLATES.items() for x in kv))
    own = F.coalesce(F.nullif(F.trim(overrides[action]), F.lit("")), base[action]) if overrides is not None else base[action]
    return F.when(action == "translate", own).otherwise(F.concat_ws("\n\n", F.lit(ROLE_PROMPT), own))


def request_history(messages: DataFrame, action: str) -> DataFrame:
    """(thread_id, messages): what a request sends along, in order; of a translation the system messages alone."""
    own = messages.where("role = 'system'") if action == "translate" else messages
    return own.groupBy("thread_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("created_at", "id", "role", "content"))), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def instructions(messages: DataFrame) -> DataFrame:
    """(thread_id, instructions, items): system messages in one text by line breaks, the rest as items."""
    sorted_ = F.sort_array(F.collect_list(F.struct("created_at", "id", "role", "content")))
    grouped = messages.groupBy("thread_id").agg(sorted_.alias("m"))
    text = F.array_join(F.transform(F.filter("m", lambda x: x["role"] == "system"), lambda x: F.coalesce(x["content"], F.lit(""))), "\n")
    return grouped.select(
        "thread_id", text.alias("instructions"), F.transform(F.filter("m", lambda x: x["role"] != "system"), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("items")
    )


def latest_threads(df: DataFrame) -> DataFrame:
    return latest(df, ["id"], ["updated_at"])


def role_template(chosen: Column, custom: Column | None = None, overrides: Column | None = None) -> Column:
    """The text of a chosen role: the reader's own for "custom", an override in place of a built-in one if it says anything, nothing for unknown ones."""
    known = F.create_map(*(F.lit(x) for kv in ROLE_TEMPLATES.items() for x in kv))
    changed = F.nullif(F.trim(overrides[chosen]), F.lit("")) if overrides is not None else F.lit(None).cast("string")
    own = F.coalesce(F.trim(custom), F.lit("")) if custom is not None else F.lit("")
    return F.when(chosen == "custom", own).otherwise(F.coalesce(changed, known[chosen], F.lit("")))


def merged_threads(loaded: DataFrame, local: DataFrame) -> DataFrame:
    """Loaded threads and those that are only here, which are not stored yet."""
    return loaded.unionByName(local, allowMissingColumns=True)
