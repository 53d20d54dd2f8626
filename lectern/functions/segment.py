"""Segmentation of text into words: a dictionary for ideographs, rules for the rest; the tokenizer of the index is exchangeable."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, functions as F

Tokenizer = Callable[[str], list[str]]
_RUN = re.compile(r"[一-鿿㐀-䶿]+|[^\W_]+(?:['’-][^\W_]+)*")
_HAN = re.compile(r"[一-鿿㐀-䶿]")


class DictionarySegmenter:
    """The most probable division of each run of ideographs into dictionary words; unknown stretches fall into pairs of characters.

    ``words`` maps words to frequencies.  Other runs of letters and digits are kept whole.
    """

    def __init__(self, words: dict[str, float] | None = None, longest: int = 8):
        words = words or {}
        total = sum(words.values()) or 1.0
        self.cost = {w: -math.log(n / total) for w, n in words.items() if n > 0}
        self.unknown = max(self.cost.values(), default=10.0) + 5.0
        self.longest = min(longest, max(map(len, self.cost), default=1))

    def _run(self, run: str) -> list[str]:
        n = len(run)
        best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
        for i in range(n):
            for j in range(i + 1, min(n, i + self.longest) + 1):
                word = run[i:j]
                cost = self.cost.get(word, self.unknown if j == i + 1 else math.inf)
                if best[i] + cost < best[j]:
                    best[j], back[j] = best[i] + cost, i
        cuts, at = [n], n
        while at:
            at = back[at]
            cuts.append(at)
        parts = [run[a:b] for a, b in zip(cuts[::-1], cuts[::-1][1:])]
        out: list[str] = []
        loose = ""
        for p in [*parts, None]:
            if p is not None and len(p) == 1 and p not in self.cost:
                loose += p
                continue
            out += [loose] if len(loose) == 1 else [loose[k : k + 2] for k in range(len(loose) - 1)]
            loose = ""
            if p is not None:
                out.append(p)
        return [w for w in out if w]

    def __call__(self, text: str) -> list[str]:
        out: list[str] = []
        for run in _RUN.findall(text):
            out += self._run(run) if _HAN.match(run) else [run]
        return out


def segmented(text: Column, tokenizer: Tokenizer) -> Column:
    """Tokens joined by blanks, in Arrow batches; null stays null, a blank text gives an empty one."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: None if t is None else " ".join(tokenizer(t)), na_action="ignore")

    return run(text)
