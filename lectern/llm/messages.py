"""What the conversation operators share: cleaned roles, actions and times of message rows, and whether a text has anything to read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Words that stand for "no value", as they remain once blanks, marks and letter case are gone.
NO_VALUE_WORDS = ["null", "none", "nil", "nan", "na", "undefined", "void", "empty", "nocontent", "novalue", "noanswer", "noresponse", "nodata", "blank",
                  "leer", "keininhalt", "vide", "aucuncontenu", "vacío", "vacio", "sincontenido", "无", "空", "无内容", "暂无", "暂无内容"]

_NOT_READABLE = r"(?s)<!--.*?-->|<[^<>]*>|&[a-z]+;|[\s\p{Z}\p{C}\p{P}\p{M}\p{Sm}\p{Sk}\p{Sc}ㅤᅟᅠ]"


#: More letters and figures than any word for "no value" has, before any markup: seen at the beginning of nearly every text, whatever its length.
_SURELY = r"^(?:[^<&\p{L}\p{N}]*+[\p{L}\p{N}]){%d}" % (max(map(len, NO_VALUE_WORDS)) + 1)


def readable(content: Column) -> Column:
    """False for null, blanks, invisible characters, bare markup and words standing for no value; never null."""
    rest = F.lower(F.regexp_replace(content, _NOT_READABLE, ""))
    return F.when(content.rlike(_SURELY), True).otherwise(F.coalesce((rest != "") & ~rest.isin(NO_VALUE_WORDS), F.lit(False)))


def tidy(word: Column) -> Column:
    """Lower case, without blanks at either end; blank becomes null."""
    trimmed = F.lower(F.regexp_replace(word, r"^[\s\p{Z}\p{C}]+|[\s\p{Z}\p{C}]+$", ""))
    return F.when(trimmed != "", trimmed)


def seconds(time: Column) -> Column:
    """Seconds since 1970 of a wall clock time, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), time.cast("timestamp_ntz")) / 1e6


def _tie() -> Column:
    """Tells rows of one id and time apart, all the same where they are equal."""
    return F.xxhash64("content", "role", "action_type", "image_path")


def heads(messages: DataFrame) -> DataFrame:
    """One row for each message id, from its earliest row: id, thread_id, role, action_type, created_at, readable, image (has an image_path), tie.

    Replayed rows have the id of another row; of several the one with the earliest created_at counts, a null time last; further ties go to the
    smaller thread_id, then to the smaller ``tie``, by which ``contents`` finds the same row.  Rows without id are left out.  No text leaves the map side.
    """
    image = F.coalesce(F.trim("image_path") != "", F.lit(False))
    row = F.struct(
        F.col("created_at").isNull().alias("_late"), "created_at", "thread_id", _tie().alias("tie"), tidy(F.col("role")).alias("role"), tidy(F.col("action_type")).alias("action_type"),
        readable(F.col("content")).alias("readable"), image.alias("image")
    )
    first = messages.where("id IS NOT NULL").groupBy("id").agg(F.min(row).alias("m"))
    return first.select("id", "m.thread_id", "m.role", "m.action_type", "m.created_at", "m.readable", "m.image", "m.tie")


def contents(messages: DataFrame, ids: DataFrame, cols: list[str | Column]) -> DataFrame:
    """``ids`` (with id, each once, created_at and tie, which is dropped) joined with ``cols`` of the rows that count in ``heads``."""
    texts = messages.select(F.col("id").alias("_id"), F.col("created_at").alias("_at"), _tie().alias("_tie"), *cols)
    found = ids.join(texts, (F.col("id") == F.col("_id")) & F.col("created_at").eqNullSafe(F.col("_at")) & (F.col("tie") == F.col("_tie")))
    return found.drop("_id", "_at", "_tie", "tie").dropDuplicates(["id"])
