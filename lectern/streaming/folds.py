"""State machines over ordered events; each step is one expression, the fold runs inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _step(state: Column, event: Column) -> Column:
    """The next phase of a page: a check decides only where nothing is known, a scan starts unless one runs, its result counts only while it does."""
    return (
        F.when(
            event.isin("check_text", "check_no_text", "check_cached"),
            F.when(state == "", F.when(event == "check_text", "hasText").when(event == "check_cached", "success").otherwise("prompt")).otherwise(state)
        )
        .when(event == "scan", F.lit("scanning"))
        .when(
            event.isin("scanned", "scanned_empty", "failed"),
            F.when(state == "scanning", F.when(event == "scanned", "success").when(event == "scanned_empty", "empty").otherwise("error")).otherwise(state)
        )
        .when(event == "dismiss", F.when(state == "", "").otherwise("dismissed"))
        .otherwise(state)
    )


def scan_states(log: DataFrame) -> DataFrame:
    """(book_id, page, phase, events) from (book_id, page, seq, event): the phase of each page after its events in order."""
    g = log.groupBy("book_id", "page").agg(F.sort_array(F.collect_list(F.struct("seq", "event"))).alias("e"))
    return g.select("book_id", "page", F.aggregate("e", F.lit(""), lambda s, x: _step(s, x["event"])).alias("phase"), F.size("e").cast("long").alias("events"))


def replay_edits(log: DataFrame) -> DataFrame:
    """(log_id, applied, redoable): edits in force after edits, undos and redos in order; a new edit clears what could be redone."""
    empty = F.array().cast("array<bigint>")
    start = F.struct(empty.alias("done"), empty.alias("undone"))

    def step(s: Column, x: Column) -> Column:
        done, undone = s["done"], s["undone"]
        n, m = F.size(done), F.size(undone)
        new_done = F.when(x["op"] == "edit", F.array_append(done, x["edit"])).when((x["op"] == "undo") & (n > 0), F.slice(done, 1, F.greatest(n - 1, F.lit(0)))).when((x["op"] == "redo") & (m > 0), F.array_append(done, F.get(undone, m - 1))).otherwise(done)
        new_undone = F.when(x["op"] == "edit", empty).when((x["op"] == "undo") & (n > 0), F.array_append(undone, F.get(done, n - 1))).when((x["op"] == "redo") & (m > 0), F.slice(undone, 1, F.greatest(m - 1, F.lit(0)))).otherwise(undone)
        return F.struct(new_done.alias("done"), new_undone.alias("undone"))

    g = log.groupBy("log_id").agg(F.sort_array(F.collect_list(F.struct("seq", "op", "edit"))).alias("e"))
    out = g.select("log_id", F.aggregate("e", start, step).alias("s"))
    return out.select("log_id", F.array_join("s.done", ",").alias("applied"), F.size("s.undone").cast("long").alias("redoable"))
