"""Language of texts in en, de, fr, es and zh: each word votes by character n-grams, each ideograph for zh.

The model is naive Bayes over the n-grams of words, fitted on a bounded sample of labelled documents (SAMPLE rows, those with the
smallest hashes of their ids, so the sample is the same wherever and whenever it is drawn).
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame, functions as F

LANGUAGES = ("en", "de", "fr", "es", "zh")
LATIN = LANGUAGES[:4]
SAMPLE = 2000
_WORD = re.compile(r"[㐀-鿿]+|[^\W\d_㐀-鿿]+(?:['’][^\W\d_㐀-鿿]+)*")


def _grams(word: str) -> set[str]:
    padded = f"^{word.lower()}$"
    return {padded} | {padded[i : i + n] for n in (2, 3, 4) for i in range(len(padded) - n + 1)}


def words(text: str) -> list[str]:
    """Words; ideographs in a row make one."""
    return _WORD.findall(text)


def ideographs(word: str) -> bool:
    return "㐀" <= word[0] <= "鿿"


class Model:
    """``of(text)`` is the language of most of the text, None if nothing tells it."""

    def __init__(self, labelled: list[tuple[str, str]], least: int = 3):
        counts = {lang: Counter() for lang in LATIN}
        for text, lang in labelled:
            if lang in counts:
                for w, n in Counter(words(text)).items():
                    if not ideographs(w):
                        for g in _grams(w):
                            counts[lang][g] += min(n, 3)
        kept = {g for c in counts.values() for g, n in c.items() if n >= least}
        totals = {lang: sum(c.values()) + len(kept) or 1 for lang, c in counts.items()}
        self.weights = {g: tuple(math.log((counts[lang][g] + 1) / totals[lang]) for lang in LATIN) for g in kept}
        self.cache: dict[str, tuple[float, ...]] = {}

    def __getstate__(self):
        return {"weights": self.weights, "cache": {}}

    def vote(self, word: str) -> tuple[float, ...]:
        got = self.cache.get(word)
        if got is None:
            found = [self.weights[g] for g in _grams(word) if g in self.weights]
            if found:
                sums = [sum(x) for x in zip(*found)]
                top = max(sums)
                odds = [math.exp(max(s - top, -50) / max(1, len(found) ** 0.5)) for s in sums]
                got = tuple(o / sum(odds) for o in odds)
            else:
                got = (0.0,) * len(LATIN)
            if len(self.cache) > 200_000:
                self.cache.clear()
            self.cache[word] = got
        return got

    def shares(self, text: str) -> dict[str, float]:
        en = de = fr = es = zh = 0.0
        vote = self.cache.get
        for w in _WORD.findall(text):
            if ideographs(w):
                zh += 0.5 * len(w)
            else:
                v = vote(w) or self.vote(w)
                en, de, fr, es = en + v[0], de + v[1], fr + v[2], es + v[3]
        return dict(zip(LANGUAGES, (en, de, fr, es, zh)))

    def of(self, text: str) -> str | None:
        total = self.shares(text)
        best = max(LANGUAGES, key=total.get)
        return best if total[best] > 0 else None


def fit(documents: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` labelled rows (text, lang, doc_id) of ``documents``; lang in any spelling that begins with the code."""
    code = F.lower(F.substring(F.trim("lang"), 1, 2))
    rows = documents.select("text", code.alias("lang"), F.xxhash64("doc_id").alias("_h")).where("text IS NOT NULL").where(F.col("lang").isin(*LATIN))
    hashes = rows.select("_h").orderBy("_h").limit(sample).collect()  # the texts of the sample alone reach the driver
    chosen = rows.where(F.col("_h") <= hashes[-1]._h).collect() if hashes else []
    return Model([(r.text, r.lang) for r in sorted(chosen, key=lambda r: (r._h, r.text))[:sample]])
