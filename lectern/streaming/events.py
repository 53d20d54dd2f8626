"""Server-sent events: framing, decoding and transcripts; the same expressions serve batches and streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def data_of(event: Column) -> Column:
    """What the first data line of an event holds."""
    return F.nullif(F.trim(F.regexp_extract(event, r"(?m)^data:(.*)$", 1)), F.lit(""))


def chat_delta(event: Column) -> Column:
    """The text chunk of a chat event; null for the end mark, events of a role alone, and what can't be read."""
    data = data_of(event)
    return F.when(data != "[DONE]", F.nullif(F.get_json_object(data, "$.choices[0].delta.content"), F.lit("")))


def typed_delta(event: Column) -> Column:
    """(text, error) of a typed event: a text delta, a failure with its message, else both null."""
    data = data_of(event)
    kind = F.get_json_object(data, "$.type")
    text = F.when(kind == "response.output_text.delta", F.nullif(F.get_json_object(data, "$.delta"), F.lit("")))
    error = F.when(kind == "response.failed", F.coalesce(F.get_json_object(data, "$.error.message"), F.lit("failed")))
    return F.struct(text.alias("text"), error.alias("error"))


def as_event(content: Column) -> Column:
    """A chunk as a chat event."""
    return F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("delta"))).alias("choices"))))


def delta_event(content: Column) -> Column:
    return F.concat(F.lit("data: "), F.to_json(F.struct(F.lit("response.output_text.delta").alias("type"), content.alias("delta"))))


def failed_event(message: Column) -> Column:
    return F.concat(F.lit("data: "), F.to_json(F.struct(F.lit("response.failed").alias("type"), F.struct(message.alias("message")).alias("error"))))


def transcripts(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, transcript, failed): the chunks of a stream in order up to its first failure, which is quoted behind them and ends it."""
    d = typed_delta(F.col("event"))
    rows = events.select(key, F.struct(*order, d["text"].alias("text"), d["error"].alias("error")).alias("c"))
    failure = F.min(F.when(F.col("c.error").isNotNull(), F.struct(*(F.col(f"c.{o}") for o in order), F.col("c.error").alias("error"))))
    ends = rows.groupBy(F.col(key).alias("_key")).agg(failure.alias("_end"))
    before = F.struct(*(F.col(f"c.{o}") for o in order)) < F.struct(*(F.col(f"_end.{o}") for o in order))
    said = rows.join(ends, F.col(key).eqNullSafe(F.col("_key"))).where(F.col("_end").isNull() | before | F.col("c.error").isNotNull())
    g = said.groupBy(key).agg(F.sort_array(F.collect_list(F.when(F.col("c.error").isNull(), F.col("c")))).alias("c"), F.max("_end.error").alias("error"))
    text = F.array_join(F.transform("c", lambda x: F.coalesce(x["text"], F.lit(""))), "")
    return g.select(key, F.concat(text, F.coalesce(F.concat(F.lit("\n\n> "), F.col("error")), F.lit(""))).alias("transcript"), F.col("error").isNotNull().alias("failed"))


def finished(log: DataFrame, key: str, seq: str) -> DataFrame:
    """(key, how, chunks, answer): each stream finished once, by the first of its done, error and cancel events; an answer that was cancelled or broke off is kept as far as it came.

    ``log`` has (key, seq, event, chunk); what comes after the end is left out, and a stream without one is still open.
    """
    ends = log.groupBy(F.col(key).alias("_key")).agg(F.min(F.when(F.col("event").isin("done", "error", "cancel"), F.struct(F.col(seq).alias("at"), F.col("event").alias("how")))).alias("_end"))
    said = log.join(ends, F.col(key).eqNullSafe(F.col("_key"))).where(F.col("_end").isNull() | (F.col(seq) <= F.col("_end.at")))
    chunk = F.when(F.col("event") == "chunk", F.struct(F.col(seq), F.col("chunk")))
    g = said.groupBy(key).agg(F.sort_array(F.collect_list(chunk)).alias("c"), F.max("_end.how").alias("how"))
    return g.select(key, F.coalesce("how", F.lit("open")).alias("how"), F.size("c").cast("long").alias("chunks"), F.array_join(F.transform("c", lambda x: x["chunk"]), "").alias("answer"))


def split_frames(buffer: str) -> tuple[list[str], str]:
    """Whole events of a buffer, and what remains; a blank line ends an event."""
    *whole, rest = buffer.replace("\r\n", "\n").split("\n\n")
    return [e for e in whole if e.strip()], rest


def framed(chunks: DataFrame, key: str) -> DataFrame:
    """A stream of (key string, seq long, chunk string) as (key, n, event): whole events, in order; the unfinished rest is kept as state between batches."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(keys, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rest, n = state.get if state.exists else ("", 0)
        rows = pd.concat(list(frames)).sort_values("seq")
        events, rest = split_frames(rest + "".join(rows["chunk"]))
        state.update((rest, n + len(events)))
        yield pd.DataFrame({key: [keys[0]] * len(events), "n": range(n, n + len(events)), "event": events})

    return chunks.groupBy(key).applyInPandasWithState(step, f"{key} string, n long, event string", "rest string, n long", "append", GroupStateTimeout.NoTimeout)
