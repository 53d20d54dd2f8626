"""Texts that stop before they are complete.

What ends without a stop is decided against the corpus: its last words are looked up among all texts by fixed-length prefixes (``continuation``), and
whole texts are sorted and compared with the longer ones that begin like them.  A text was cut off if the others go on where it ends, all the more
where its length is a limit of its source.  Marks of a break (a broken character, an ellipsis, an appended notice) and structures left open (code,
tables, emphasis, formulas, quotations, an announced number of points), which no longer copy can show, are judged by the text's own end.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..cluster import keep
from ..ordering import with_neighbour
from .continuation import end_of, evidence
from .messages import NO_VALUE_WORDS, tidy

COMPLETE, CUT, OPEN, ITEM = "complete", "cut", "open", "item"
#: A text complete by its own end, which is a letter: only its longer whole copies can say otherwise.
LETTER = "letter"
#: The part of the sorted values that are whole texts.
TEXT = 1
#: Whole texts are first sifted by this many slots of their beginnings, of which at most all are sent to the tasks; the sort after them is exact.
SLOTS = 1 << 18
#: Lengths of the prefixes by which whole texts are looked up before they are sorted.
HEADS = (1, 2, 4, 8, 16, 32, 64, 128)

# Words of notices that clients append to a message whose transfer broke off.
NOTICE_WORDS = ["error", "closed", "lost", "timeout", "timed out", "interrupted", "truncated", "cut off", "aborted", "disconnected", "limit", "continue", "stopped",
                "fehler", "abgebrochen", "unterbrochen", "verbindung", "erreur", "interromp", "interrup", "coupé", "connexion", "conexión", "cortad", "中断", "截断", "超时", "断开", "错误", "续"]
# Number words that announce so many points, by number.
NUMBER_WORDS = {2: ["two", "zwei", "deux", "dos", "两", "二"], 3: ["three", "drei", "trois", "tres", "三"], 4: ["four", "vier", "quatre", "cuatro", "四"],
                5: ["five", "fünf", "cinq", "cinco", "五"], 6: ["six", "sechs", "seis", "六"], 7: ["seven", "sieben", "sept", "siete", "七"]}

_EDGE = "​‌‍⁠﻿­ \t\r\n 　"
_NOTICE = re.compile(r"^(?:[>⚠❌\[(（【—–*-]+\s*)+.*?(?:" + "|".join(map(re.escape, NOTICE_WORDS)) + r").*$", re.I)
_STOP = re.compile(r"[.!?。！？؟]$")
_CLOSERS = "\"'“”’«»›)）]】}」』*_~` 　"
_ITEM = re.compile(r"^\s*(?:[-*•+]|\d{1,3}[.)、])\s+(.*)$")
_LINK = re.compile(r"https?://[\w.-]+\.\w{2,}/\S*[\w/]$")
_ELLIPSIS = re.compile(r"(?:…|\.{3,}|。{3,})$")
_SYMBOL_END = re.compile(r"[\U0001F000-\U0001FAFF☀-➿️]$")
_HAN = re.compile(r"[一-鿿]")
_ANNOUNCED = re.compile(
    r"\b(" + "|".join(w for ws in NUMBER_WORDS.values() for w in ws if w.isascii() or not _HAN.match(w)) + r"|\d)\s+(?:points?|punkte?n?|puntos?|things|reasons|steps|parts)\b|([两二三四五六七])(?:点|条|个要点|个方面|步)",
    re.I
)
_BY_WORD = {w: n for n, ws in NUMBER_WORDS.items() for w in ws}


def _unclosed(text: str) -> bool:
    """A quotation or bracket opened and never closed after; a quotation mark that serves both ends closes what is open."""
    for opener, closers in (("“", "”"), ("„", "“”"), ("«", "»"), ("「", "」"), ("（", "）"), ("(", ")"), ("[", "]"), ("{", "}")):
        at = text.rfind(opener)
        if opener == "“" and at >= 0 and text.rfind("„", 0, at) > text.rfind("“", 0, at):
            continue  # it closes a low quotation mark
        if at >= 0 and not any(c in text[at + 1 :] for c in closers):
            return True
    return False


def last_part(text: str) -> str:
    """What follows the last sentence end, line break or colon."""
    line = text.rstrip(_EDGE).rsplit("\n", 1)[-1]
    line = re.split(r"[.!?。！？][”»“\")）]*\s+|[。！？]|[:：]\s*[“„«]?\s*", line)[-1]
    item = _ITEM.match(line)
    return (item.group(1) if item else line).strip(_EDGE)


def without_notice(text: str) -> str:
    """The text without notices of a broken transfer behind it, and without blanks at its end."""
    lines = text.rstrip(_EDGE).split("\n")
    while len(lines) > 1 and _NOTICE.match(lines[-1].strip()):
        lines = "\n".join(lines[:-1]).rstrip(_EDGE).split("\n")
    return "\n".join(lines)


def closed(text: str) -> bool:
    """Whether the text's end leaves nothing to look up: a stop, a mark, the end of a table, code or a link."""
    last = text.rsplit("\n", 1)[-1].strip()
    return not last or not last[-1].isalnum() or last.startswith("|") or text.count("```") > 0 or bool(_LINK.search(text))


def judge_end(text: str | None, asked: bool = False) -> tuple[str, str]:
    """(COMPLETE | CUT | OPEN | ITEM, what has to be looked up if OPEN or, of a list, ITEM).  ``asked``: a message of a user, which may be mere search words."""
    text = (text or "").strip(_EDGE)
    if not text:
        return COMPLETE, ""
    bare = without_notice(text)
    noticed, text, lines = bare != text, bare, bare.split("\n")
    last = lines[-1].strip()
    if text.endswith("�"):
        return CUT, ""
    fences = text.count("```")
    if fences % 2:
        return CUT, ""
    if fences and last.endswith("```"):
        return COMPLETE, ""
    if last.count("$$") % 2 or last.count("**") % 2:
        return CUT, ""
    items = [m.group(1) for m in map(_ITEM.match, lines) if m]
    said = _ANNOUNCED.search(lines[0]) if lines[0].rstrip().endswith((":", "：")) else None
    if said:
        word = (said.group(1) or said.group(2)).lower()
        if len(items) < (_BY_WORD.get(word) or (int(word) if word.isdigit() else 0)):
            return CUT, ""
    if last.startswith("|"):
        rows = [x.strip() for x in lines if x.strip().startswith("|")]
        whole = last.endswith("|") and last.count("|") >= rows[0].count("|") and not re.fullmatch(r"[|\s:-]+", last)
        return (COMPLETE if whole and len(rows) > 1 else CUT), ""
    if _ELLIPSIS.search(text.rstrip(_CLOSERS)):
        return CUT, ""
    if _unclosed(text):
        return CUT, ""
    if text[-1] in ":：,，;；、(（\\=":
        return CUT, ""
    bare = text.rstrip(_CLOSERS)
    if not bare or _STOP.search(bare) or _SYMBOL_END.search(text) or _LINK.search(text) and len(text) > 12:
        return COMPLETE, ""
    if len(bare) < len(text) and text[-1] not in "*_~`":
        return COMPLETE, ""  # a quotation or bracket, closed
    tail = last_part(text)
    if _ITEM.match(lines[-1]) and items:
        if any(_STOP.search(x.strip()) for x in items[:-1]):
            return CUT, ""
        return (CUT, "") if noticed else (COMPLETE, "") if _HAN.search(tail) else (ITEM, tail)
    body = text[: len(text) - len(tail)].rstrip()
    if body and (_STOP.search(body.rstrip(_CLOSERS)) and "\n" not in text[len(body) :] and not (asked and body[-1] in "?？")):
        return CUT, ""  # running text after a full stop in the same line
    if noticed:
        return CUT, ""
    if asked and "\n" not in text and body == "":
        return COMPLETE, ""
    return OPEN, tail


def letters_first(value: Column) -> Column:
    """A key of the order in which letters and digits stand before a blank and a blank before all else, so the first of several longer copies goes on with a letter if any does."""
    return F.regexp_replace(F.regexp_replace(value, r"([^\p{L}\p{N} ])", "\U0010FFFE$1"), " ", "\U0010FFFD")


def says_something(text: str) -> bool:
    """Not mere marks, nor a word that stands for "no value"."""
    rest = re.sub(r"[\W_]", "", text).lower()
    return rest != "" and rest not in NO_VALUE_WORDS


def heads_of(text: str) -> list[int]:
    """Slots of a text's prefixes of the lengths in HEADS, as far as it has them."""
    return [zlib.crc32(text[:n].encode("utf-8", "replace")) % SLOTS for n in HEADS if n <= len(text)]


#: Blanks that don't count for a text's length.
BLANKS = " \t\r\n\u200b\u3000\u00a0"
#: Standard deviations by which a length must be more frequent than those beside it to be a limit.
LIMIT = 5.0
#: Neighbouring lengths by which the usual number of texts of a length is told, on either side.
BESIDE = 10
#: An end was cut off if at most this share of its occurrences elsewhere are closed; at a length limit of its source, at most AT_LIMIT.
CLOSING, AT_LIMIT = 0.05, 0.25


def length_limits(messages: DataFrame, text_col: str = "content", source_col: str = "action_type") -> DataFrame:
    """(source, length, texts, usual double): lengths that far more texts of a source have than the lengths beside them, at which its texts may have been cut.

    Sources are spelled one way, null is one of its own.  Lengths are characters without blanks at either end; null and empty texts have none.
    """
    size = F.length(F.btrim(F.col(f"`{text_col}`"), F.lit(BLANKS)))
    counts = messages.select(tidy(F.col(f"`{source_col}`")).alias("source"), size.alias("length")).where("length > 0").groupBy("source", "length").agg(F.count("*").alias("texts"))
    near = W.partitionBy("source").orderBy("length").rangeBetween(-BESIDE, BESIDE)
    usual = (F.sum("texts").over(near) - F.col("texts")) / (2.0 * BESIDE)
    return counts.withColumn("usual", usual).where(F.col("texts") > F.col("usual") + LIMIT * F.sqrt(F.col("usual") + 1))


def longer_copies(values: DataFrame) -> DataFrame:
    """(part, value, inside, letter) of the ``values`` (part, value, own) with own = 1 of which a longer one of the same part is a copy that goes on with a
    word: whether inside the last word, and with a letter.  All values are sorted, letters first, so the first longer copy tells for all."""
    both = values.groupBy("part", "value").agg(F.max("own").alias("own")).withColumn("place", letters_first(F.col("value")))
    laid = with_neighbour(both, ["part", "place"], ["part", "value"], before=False)
    rest = F.expr("substring(next_value, length(value) + 1)")
    longer = laid.where("own = 1 AND next_part = part AND startswith(next_value, value)").where(rest.rlike(r"^ ?[\p{L}\p{N}]"))
    return longer.select("part", "value", rest.rlike(r"^[\p{L}\p{N}]").alias("inside"), rest.rlike(r"^\p{L}").alias("letter"))


def whole_prefixes(messages: DataFrame, text_col: str = "content", id_col: str = "id") -> DataFrame:
    """(id_col): texts, blanks at either end aside, that a longer text begins with and goes on after with a word, each id once; null and empty texts are none."""
    texts = messages.select(F.col(f"`{id_col}`").alias("id"), F.trim(f"`{text_col}`").alias("value")).where("id IS NOT NULL AND value <> ''")
    longer = longer_copies(texts.select(F.lit(TEXT).alias("part"), "value", F.lit(1).alias("own")))
    return texts.join(longer.select("value"), "value", "left_semi").select(F.col("id").alias(id_col)).distinct()


def judgements(messages: DataFrame, text_col: str = "content", role_col: str = "role", id_col: str = "id", source_col: str = "action_type") -> DataFrame:
    """(id_col, evidence): texts that stop before they are complete, each id once, and what tells so, the first of

    copy: a longer text begins with the whole of it; fragment: its last word is known, where it stands, only as the beginning of longer ones;
    goes_on: its last words go on elsewhere and are hardly ever closed; mark: its own end shows the break, leaves something open, or lacks the stop that
    its other sentences have.

    Null, empty and blank texts, complete titles, search words, lists, tables, code and links are no cases; nor are texts that several ids
    have, unless inside a word.  Repeated rows count once; rows with a null id are left out; a missing ``source_col`` or a null is one source.
    """
    source = tidy(F.col(f"`{source_col}`")) if source_col in messages.columns else F.lit(None).cast("string")
    asked = F.coalesce(F.lower(F.trim(F.col(f"`{role_col}`"))) == "user", F.lit(False))
    texts = messages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), asked.alias("asked"), source.alias("source")).where("id IS NOT NULL AND text IS NOT NULL")
    kind = texts.schema["id"].dataType.simpleString()
    schema = f"id {kind}, source string, size int, state string, item boolean, text_hash long, contexts array<long>, word string, whole string"

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for i, (text, asked) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                own = text.strip(_EDGE)
                state = judge_end(own, asked)[0]
                letter = state == COMPLETE and own[-1:].isalpha()
                bare = without_notice(own)
                end = end_of(bare) if not closed(bare) else None
                if state == COMPLETE and not letter and end is None:
                    continue
                rows.append(i)
                whole = own if (state in (OPEN, ITEM) or letter) and says_something(own) else None
                item = bool(_ITEM.match(bare.rsplit("\n", 1)[-1]))
                out.append((len(bare), LETTER if letter else state, item, xxhash.xxh64_intdigest(bare.encode("utf-8", "replace")) - (1 << 63), *(end or (None, None)), whole))
            cols, ids = list(zip(*out)) or [()] * 7, pa.array(rows, type=pa.int32())
            kinds = [pa.int32(), pa.string(), pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(ids), batch.column(3).take(ids), *(pa.array(c, type=k) for c, k in zip(cols, kinds))],
                names=["id", "source", "size", "state", "item", "text_hash", "contexts", "word", "whole"]
            )

    judged = keep(texts.mapInArrow(judge, schema))
    row = F.struct("text_hash", "source", "size", "state", "item", "contexts", "word")  # of an id with several texts one counts, always the same
    known = judged.where("word IS NOT NULL").groupBy("id").agg(F.min(row).alias("r")).select("id", "r.*")
    copies = known.groupBy("text_hash").agg((F.count("*") > 1).alias("repeated"))
    limits = length_limits(messages.withColumn("_source", source), text_col, "_source").select(F.col("source").alias("_s"), F.col("length").alias("size"), F.lit(AT_LIMIT).alias("limit"))
    told = known.select("id", "source", "size", "state", "item", "text_hash").join(evidence(texts, known, without_notice), "id").join(copies, "text_hash")
    told = told.join(limits, (told["size"] == limits["size"]) & F.col("source").eqNullSafe(F.col("_s")), "left")
    by_end = F.when(F.col("fragment"), "fragment").when(F.col("seen") & ~F.col("repeated") & ~F.col("item") & (F.col("closing") <= F.coalesce("limit", F.lit(CLOSING))), "goes_on")
    found = told.select("id", by_end.alias("evidence")).where("evidence IS NOT NULL")
    shown = judged.where(f"state = '{CUT}'").join(known.join(copies.where("repeated"), "text_hash").select("id"), "id", "left_anti").select("id", F.lit("mark").alias("evidence"))
    both = found.unionByName(shown).unionByName(_whole_copies(texts, judged).withColumn("evidence", F.lit("copy")))
    rank = F.array_position(F.array(*map(F.lit, ("copy", "fragment", "goes_on", "mark"))), F.col("evidence"))
    return both.groupBy("id").agg(F.min_by("evidence", rank).alias("evidence")).withColumnRenamed("id", id_col)


def _whole_copies(texts: DataFrame, judged: DataFrame) -> DataFrame:
    """(id): ``judged`` texts that are not closed and of which a longer text is a copy; values are sifted by their beginnings before they are sorted."""
    open_ = judged.where("whole IS NOT NULL").select("id", "state", F.lit(TEXT).alias("part"), F.col("whole").alias("value"))
    ends = open_.select("part", "value").distinct()

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sorted({heads_of(v)[-1] for v in batch.column(0).to_pylist()}), type=pa.int32())], names=["slot"])

    begun = frozenset(r.slot for r in ends.select("value").mapInArrow(slots, "slot int").distinct().collect())  # at most SLOTS

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [t.strip(_EDGE) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([t for t in own if not begun.isdisjoint(heads_of(t))], type=pa.string())], names=["value"])

    others = texts.select("text").mapInArrow(sift, "value string").select(F.lit(TEXT).alias("part"), "value", F.lit(0).alias("own"))
    longer = longer_copies(others.unionByName(ends.withColumn("own", F.lit(1))))
    cut_off = open_.join(longer, ["part", "value"]).where(f"state = '{OPEN}' OR state = '{ITEM}' AND inside OR state = '{LETTER}' AND letter")
    return cut_off.select("id").distinct()


def truncated(messages: DataFrame, text_col: str = "content", role_col: str = "role", id_col: str = "id") -> DataFrame:
    """(id_col): the ids of texts that stop before they are complete, each once; see ``judgements``."""
    return judgements(messages, text_col, role_col, id_col).select(id_col)
