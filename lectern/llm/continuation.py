"""How texts go on elsewhere after the words with which a text ends.

The last words of an end are looked up in all texts by fixed-length prefixes: the word itself, and the one, two and three tokens before it, as hashes.
For each of these contexts the corpus tells how often the word goes on into another one, how often something closes it (a mark, a line's end), and
how often only longer words that begin with it stand there.  An end that others go on after, and hardly ever stop at, was cut off.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..cluster import keep

#: Tokens of an end that are compared at most: a word and what stands before it.
LEVELS = 4
#: Contexts are first sifted by this many slots, of which at most all are sent to the tasks; the join after them is by 64-bit hashes.
SLOTS = 1 << 20
#: Weight of what fewer tokens tell, in occurrences, when more tokens are judged.
WEIGHT = 1.0
#: Longer words must be so many times as frequent as the word itself for the word to be a fragment of one.
FRAGMENT = 50
#: Lengths of the prefixes by which words are joined.
HEADS = (1, 2, 4)

_TOKEN = re.compile(r"[㐀-鿿]|[^\W㐀-鿿]+(?:['’-][^\W㐀-鿿]+)*|\n+|[^\w\s]")
_DIGITS = re.compile(r"\d+")
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_ALONE = np.uint64(1)
_START, _END = "^", "$"


def tokens(text: str) -> list[str]:
    """Words, ideographs one by one, marks and line breaks; numbers are all alike."""
    return _TOKEN.findall(_DIGITS.sub("0", text))


def _hash(token: str) -> int:
    return xxhash.xxh64_intdigest(token.encode("utf-8", "replace"))


def _contexts(h: np.ndarray) -> list[np.ndarray]:
    """For hashes of tokens: of each place from the fourth on, hashes of the 0, 1, 2 and 3 tokens before it."""
    out = [np.full(max(len(h) - 3, 0), _ALONE)]
    with np.errstate(over="ignore"):
        for k, mix in enumerate(_MIX, 1):
            before = h[3 - k : len(h) - k] * mix
            out.append(before + _ALONE if k == 1 else out[-1] ^ (before + np.uint64(k)))
    return out


def end_of(text: str) -> tuple[list[int], str] | None:
    """(hashes of the contexts, from none to three tokens, as signed numbers; the last word), or None if the text does not end with a word."""
    last = [_START] * 3 + tokens(text)
    if not last[-1][0].isalnum():
        return None
    h = np.array([_hash(t) for t in last[-4:]], dtype=np.uint64)
    return [int(c[0].astype(np.int64)) for c in _contexts(h)], last[-1]


def counted(texts: list[str], wanted: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """(context, word, times it goes on, times it is closed) of all words in contexts whose slot is wanted; a text's last word is left out."""
    flat: list[str] = []
    for t in texts:
        flat += [_START] * 3
        flat += tokens(t)
        flat.append(_END)
    codes, names = pd.factorize(np.array(flat, dtype=object))
    h = np.array([_hash(t) for t in names], dtype=np.uint64)
    is_word = np.array([t[0].isalnum() for t in names], dtype=bool)
    ended = np.array([t == _END for t in names], dtype=bool)
    at = codes[3:-1] if len(codes) > 4 else codes[:0]
    following = codes[4:]
    use = is_word[at] & ~ended[following]
    go = is_word[following]
    contexts, words, ons, closes = [], [], [], []
    for level, context in enumerate(_contexts(h[codes])):
        context = context[: len(at)]
        mine = use if level == 0 else use & wanted[(context % np.uint64(SLOTS)).astype(np.int64)]
        c, w, g = context[mine], at[mine], go[mine]
        order = np.lexsort((w, c))
        c, w, g = c[order], w[order], g[order]
        if not len(c):
            continue
        first = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (w[1:] != w[:-1])])
        n = np.diff(np.r_[first, len(c)])
        on = np.add.reduceat(g.astype(np.int64), first)
        contexts.append(c[first])
        words += [names[i] for i in w[first]]
        ons.append(on)
        closes.append(n - on)
    if not contexts:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), [], none, none
    return np.concatenate(contexts), words, np.concatenate(ons), np.concatenate(closes)


def evidence(texts: DataFrame, ends: DataFrame, strip) -> DataFrame:
    """(id, closing double, fragment boolean, seen boolean) for each row of ``ends``: the share of occurrences of its last word, in the longest context
    known, that are closed; whether it is only known as the beginning of longer words; whether it is known at all.

    ``texts`` has a column text, of which ``strip`` (a plain function) takes off what was appended; ``ends`` has (id, text_hash, contexts array<long>,
    word).  Other texts that end likewise, with nothing behind, count as closing; copies of the same text don't.
    """
    levels = ends.select("id", "text_hash", "word", F.posexplode("contexts").alias("level", "context"))
    own = levels.groupBy("context", "word").agg((F.count_distinct("text_hash") - 1).alias("finals"))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(0).to_numpy().astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(hashes % np.uint64(SLOTS)).astype(np.int32))], names=["slot"])

    wanted = np.zeros(SLOTS, dtype=bool)
    wanted[[r.slot for r in levels.where("level > 0").select("context").mapInArrow(slots, "slot int").distinct().collect()]] = True  # at most SLOTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            context, words, on, closed = counted([strip(t) for t in batch.column(0).to_pylist()], wanted)
            yield pa.RecordBatch.from_arrays([pa.array(context.astype(np.int64)), pa.array(words, type=pa.string()), pa.array(on), pa.array(closed)], names=["context", "longer", "on", "closed"])

    grams = texts.select("text").mapInArrow(run, "context long, longer string, on long, closed long")
    grams = keep(grams.groupBy("context", "longer").agg(F.sum("on").alias("on"), F.sum("closed").alias("closed")))
    usual = grams.where(F.col("context") == int(_ALONE)).agg(F.sum("closed") / F.sum(F.col("on") + F.col("closed"))).first()[0] or 0.0

    head = lambda c: F.element_at(F.filter(F.array(*map(F.lit, HEADS)), lambda n: n <= F.length(c)), -1)
    mine = own.withColumn("n", head("word")).withColumn("head", F.substring("word", F.lit(1), F.col("n")))
    theirs = grams.withColumn("n", F.explode(F.filter(F.array(*map(F.lit, HEADS)), lambda n: n <= F.length("longer")))).withColumn("head", F.substring("longer", F.lit(1), F.col("n")))
    both = mine.join(theirs, ["context", "n", "head"]).where(F.startswith("longer", "word"))
    same = F.col("longer") == F.col("word")
    inside = ~same & F.substring("longer", F.length("word") + 1, F.lit(1)).rlike(r"\p{L}")
    sums = both.groupBy("context", "word").agg(*(F.sum(F.when(when, what).otherwise(0)).alias(out) for out, when, what in (("on", same, F.col("on")), ("closed", same, F.col("closed")), ("longer", inside, F.col("on") + F.col("closed")))))
    told = levels.join(own, ["context", "word"]).join(sums, ["context", "word"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    level = F.struct("level", zero("on").alias("on"), (zero("closed") + F.col("finals")).alias("closed"), zero("longer").alias("longer"))
    runs = told.groupBy("id").agg(F.sort_array(F.collect_list(level)).alias("levels"))  # LEVELS rows of each id

    def fold(acc: Column, x: Column) -> Column:
        n = x["on"] + x["closed"]
        return F.struct(
            F.when(n > 0, (x["closed"] + WEIGHT * acc["closing"]) / (n + WEIGHT)).otherwise(acc["closing"]).alias("closing"),
            F.when(n + x["longer"] > 0, x["longer"] > FRAGMENT * n).otherwise(acc["fragment"]).alias("fragment"),
            (acc["seen"] | (n > 0)).alias("seen"),
        )

    start = F.struct(F.lit(float(usual)).alias("closing"), F.lit(False).alias("fragment"), F.lit(False).alias("seen"))
    return runs.select("id", F.aggregate("levels", start, fold).alias("v")).select("id", "v.closing", "v.fragment", "v.seen")
