"""Structured Streaming: debounced progress, incremental indexing and page states; every query ends by itself under ``availableNow``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import search
from ..operators.tables import latest
from ..ordering import with_neighbour


def debounced(changes: DataFrame, key: str = "book_id", time: str = "ts", quiet: str = "800 milliseconds", late: str = "1 minute") -> DataFrame:
    """The last change of each burst, once nothing has followed it for ``quiet``; changes later than ``late`` are left out."""
    cols = [c for c in changes.columns if c not in (key, time)]
    burst = changes.withWatermark(time, late).groupBy(key, F.session_window(time, quiet))
    return burst.agg(F.max_by(F.struct(time, *cols), F.struct(time, *cols)).alias("m"), F.count("*").alias("changes")).select(key, "m.*", "changes")


def last_of_bursts(df: DataFrame, key: str, time: str, tie: str, quiet: float) -> DataFrame:
    """Of a batch the rows after which nothing of their key follows for ``quiet`` seconds: what a debounced field hands on."""
    laid = with_neighbour(df, [key, time, tie], [key, time], before=False)
    gap = F.timestamp_diff("MICROSECOND", F.col(time), F.col(f"next_{time}")) / 1e6
    return laid.where(F.col(f"next_{key}").isNull() | (F.col(f"next_{key}") != F.col(key)) | (gap > quiet)).drop(f"next_{key}", f"next_{time}")


def first_of_bursts(df: DataFrame, key: str, time: str, tie: str, quiet: float) -> DataFrame:
    """Of a batch the rows before which nothing of their key came for ``quiet`` seconds: what a throttled one lets through."""
    laid = with_neighbour(df, [key, time, tie], [key, time], before=True)
    gap = F.timestamp_diff("MICROSECOND", F.col(f"prev_{time}"), F.col(time)) / 1e6
    return laid.where(F.col(f"prev_{key}").isNull() | (F.col(f"prev_{key}") != F.col(key)) | (gap > quiet)).drop(f"prev_{key}", f"prev_{time}")


def index_incrementally(pages: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Keeps a postings table below ``folder`` for a stream of (book_id, page, source, original_text, seq).

    Each batch appends the postings of its pages' latest texts, with their seq; ``current`` reads the latest of each page, so tokens of an
    older text disappear, and a batch that is written again after a failure replaces its own part.
    """

    def write(batch: DataFrame, number: int) -> None:
        new = latest(batch, ["book_id", "page"], ["seq"])
        post = search.postings(new).join(new.select("book_id", "page", "seq"), ["book_id", "page"])
        empty = new.select(F.lit("").alias("token"), "book_id", "page", F.array().cast("array<int>").alias("positions"), "seq")
        post.unionByName(empty).withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(16)).cast("int")).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/batch={number}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(df: DataFrame) -> DataFrame:
    """Of appended postings those of each page's latest text."""
    newest = df.where("token = ''").groupBy("book_id", "page").agg(F.max("seq").alias("seq"))
    return df.where("token <> ''").join(newest, ["book_id", "page", "seq"], "left_semi").select("token", "book_id", "page", "positions")


def page_states(log: DataFrame) -> DataFrame:
    """(book_id, page, phase) after each batch that touches a page, from a stream of (book_id, page, seq, event); the phase is kept as state."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    results = {"scanned": "success", "scanned_empty": "empty", "failed": "error"}
    checks = {"check_text": "hasText", "check_cached": "success", "check_no_text": "prompt"}

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        phase = state.get[0] if state.exists else ""
        for event in pd.concat(list(frames)).sort_values("seq")["event"]:
            if event in checks:
                phase = phase or checks[event]
            elif event == "scan":
                phase = "scanning"
            elif event in results and phase == "scanning":
                phase = results[event]
            elif event == "dismiss" and phase:
                phase = "dismissed"
        state.update((phase,))
        yield pd.DataFrame({"book_id": [key[0]], "page": [key[1]], "phase": [phase]})

    return log.groupBy("book_id", "page").applyInPandasWithState(step, "book_id long, page long, phase string", "phase string", "update", GroupStateTimeout.NoTimeout)
