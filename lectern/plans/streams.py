"""Queries that fold ordered events, as batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..cluster import load
from ..streaming import folds


def scan_states(s, d):
    """Events as a scan log: books are users, pages the event's number within 50."""
    kind = F.create_map(*(F.lit(x) for kv in {"view": "check_no_text", "click": "scan", "signup": "scanned", "error": "failed", "purchase": "dismiss"}.items() for x in kv))[F.col("event_type")]
    log = load(s, d, "events").select(F.col("user_id").alias("book_id"), (F.col("event_id") % 50).alias("page"), F.col("event_id").alias("seq"), kind.alias("event"))
    return folds.scan_states(log)


def edit_log_replay(s, d):
    op = F.when(F.col("event_type") == "error", "undo").when(F.col("event_type") == "signup", "redo").otherwise("edit")
    log = load(s, d, "events").select(F.col("user_id").alias("log_id"), F.col("event_id").alias("seq"), op.alias("op"), F.col("event_id").alias("edit"))
    return folds.replay_edits(log)


# Fixed shape of the state of an edit log in SQL.
_STATE = "{{'done': {}, 'undone': {}, 'op': '', 'edit': 0::BIGINT}}"
_NONE = "[]::BIGINT[]"
QUERIES = {
    "scan_states": (
        scan_states,
        """WITH g AS (SELECT user_id AS book_id, event_id % 50 AS page, list(CASE event_type WHEN 'view' THEN 'check_no_text' WHEN 'click' THEN 'scan' WHEN 'signup' THEN 'scanned' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'dismiss' END ORDER BY event_id) AS e FROM events GROUP BY ALL)
SELECT book_id, page, list_reduce(list_prepend('', e), lambda s, x: CASE WHEN x = 'check_no_text' THEN CASE WHEN s = '' THEN 'prompt' ELSE s END WHEN x = 'scan' THEN 'scanning' WHEN x = 'scanned' THEN CASE WHEN s = 'scanning' THEN 'success' ELSE s END
WHEN x = 'failed' THEN CASE WHEN s = 'scanning' THEN 'error' ELSE s END WHEN x = 'dismiss' THEN CASE WHEN s = '' THEN '' ELSE 'dismissed' END ELSE s END) AS phase, len(e) AS events FROM g""",
    ),
    "edit_log_replay": (
        edit_log_replay,
        f"""WITH g AS (SELECT user_id AS log_id, list({{'done': {_NONE}, 'undone': {_NONE}, 'op': CASE event_type WHEN 'error' THEN 'undo' WHEN 'signup' THEN 'redo' ELSE 'edit' END, 'edit': event_id}} ORDER BY event_id) AS e FROM events GROUP BY 1),
r AS (SELECT log_id, list_reduce(list_prepend({_STATE.format(_NONE, _NONE)}, e), lambda s, x: CASE WHEN x.op = 'edit' THEN {_STATE.format('list_append(s.done, x.edit)', _NONE)}
WHEN x.op = 'undo' AND len(s.done) > 0 THEN {_STATE.format('s.done[1:len(s.done) - 1]', 'list_append(s.undone, s.done[len(s.done)])')}
WHEN x.op = 'redo' AND len(s.undone) > 0 THEN {_STATE.format('list_append(s.done, s.undone[len(s.undone)])', 's.undone[1:len(s.undone) - 1]')} ELSE s END) AS s FROM g)
SELECT log_id, array_to_string(s.done, ',') AS applied, len(s.undone) AS redoable FROM r""",
    ),
}
