"""A hidden Markov model of the lines of a page: its states are the parts of a page, its observations classes of layout features.

The model starts from plain beliefs about pages (BELIEFS), without any labelled line.  It then labels all pages by Viterbi and counts its
probabilities anew, until the labels settle.  A page is a short string of codes, so a round reads one byte a line, and all pages of a
batch are decoded at once.  Counts are whole numbers, so the result does not depend on the order of partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

HEAD, NUMBER, TITLE, BODY, TABLE = STATES = ("head", "number", "title", "body", "table")
#: The features of a line and their classes.
FEATURES = (("top", "first", "within", "bottom"), ("left", "middle", "inset"), ("numbered", "figures", "title", "short", "text"), ("unknown", "doubtful", "sure"))
_SIZES = tuple(len(f) for f in FEATURES)
CODES = int(np.prod(_SIZES))

# Beliefs to start from: each state's shares of the classes of each feature, in the order of STATES and FEATURES; how pages begin; what follows what.
BELIEFS = (
    ((60, 2, 2, 36), (30, 1, 1, 68), (5, 90, 4, 1), (1, 9, 88, 2), (1, 5, 92, 2)),
    ((5, 35, 60), (5, 70, 25), (5, 35, 60), (97, 1, 2), (2, 8, 90)),
    ((2, 1, 60, 32, 5), (93, 4, 1, 1, 1), (1, 1, 20, 73, 5), (1, 1, 1, 15, 82), (15, 80, 1, 3, 1)),
    ((1, 1, 1), (1, 1, 1), (1, 1, 1), (1, 1, 1), (1, 1, 1)),
)
STARTS = (35, 25, 10, 29, 1)
STEPS = ((2, 20, 10, 63, 5), (20, 2, 10, 63, 5), (2, 2, 2, 92, 2), (2, 3, 1, 92, 2), (1, 2, 1, 36, 60))
#: Rounds of labelling after which the model is taken as it is; it settles after two or three.
ROUNDS = 20
#: What is added to each count.
SMOOTH = 0.5


def code(seen: tuple[str, ...]) -> int:
    """The number of a line's classes, one of each feature."""
    out = 0
    for classes, value in zip(FEATURES, seen):
        out = out * len(classes) + classes.index(value)
    return out


def _classes() -> list[np.ndarray]:
    left, out = np.arange(CODES), []
    for n in reversed(_SIZES):
        out.append(left % n)
        left = left // n
    return out[::-1]


_CLASS_OF = _classes()


def _padded(pages: list[bytes]) -> np.ndarray:
    """Pages as rows of codes, with -1 behind their ends."""
    out = np.full((len(pages), max(map(len, pages), default=0)), -1, dtype=np.int16)
    for i, p in enumerate(pages):
        out[i, : len(p)] = np.frombuffer(p, dtype=np.uint8)
    return out


class LineModel:
    """Shares of first states, of transitions, and of each feature's classes given the state."""

    def __init__(self, start, step, emit):
        shares = lambda x: (lambda a: a / a.sum(axis=-1, keepdims=True))(np.asarray(x, dtype=float))
        self.start, self.step = np.log(shares(start)), np.log(shares(step))
        self.emit = sum(np.log(shares(e))[:, c] for e, c in zip(emit, _CLASS_OF)).T

    @classmethod
    def believed(cls) -> LineModel:
        return cls(STARTS, STEPS, BELIEFS)

    @classmethod
    def counted(cls, counts: np.ndarray) -> LineModel:
        """From the counts of ``count``."""
        n = len(STATES)
        start, step, seen = counts[:n], counts[n : n + n * n].reshape(n, n), counts[n + n * n :].reshape(n, CODES)
        emit = [np.stack([np.bincount(c, weights=row, minlength=size) for row in seen]) for c, size in zip(_CLASS_OF, _SIZES)]
        return cls(start + SMOOTH, step + SMOOTH, [e + SMOOTH for e in emit])

    def label(self, pages: list[bytes]) -> list[bytes]:
        """The most probable states of each page's lines, as places in STATES."""
        seen = _padded(pages)
        if not seen.size:
            return [b""] * len(pages)
        rows, width = seen.shape
        score = self.start + self.emit[np.maximum(seen[:, 0], 0)]
        back = np.zeros((rows, width, len(STATES)), dtype=np.uint8)
        same = np.arange(len(STATES), dtype=np.uint8)
        for t in range(1, width):
            live = (seen[:, t] >= 0)[:, None]
            ways = score[:, :, None] + self.step
            back[:, t] = np.where(live, ways.argmax(axis=1), same)
            score = np.where(live, ways.max(axis=1) + self.emit[np.maximum(seen[:, t], 0)], score)
        at, every = score.argmax(axis=1), np.arange(rows)
        path = np.empty((rows, width), dtype=np.uint8)
        for t in range(width - 1, -1, -1):
            path[:, t] = at
            at = back[every, t, at]
        return [path[i, : len(p)].tobytes() for i, p in enumerate(pages)]


def count(pages: list[bytes], labels: list[bytes]) -> np.ndarray:
    """Whole counts of first states, transitions, and codes by state, in one row."""
    n = len(STATES)
    out = np.zeros(n + n * n + n * CODES, dtype=np.int64)
    pages, labels = [p for p in pages if p], [x for x in labels if x]
    if not pages:
        return out
    ends = np.cumsum([len(p) for p in pages])
    seen = np.frombuffer(b"".join(pages), dtype=np.uint8).astype(np.int64)
    state = np.frombuffer(b"".join(labels), dtype=np.uint8).astype(np.int64)
    first = np.zeros(len(seen), dtype=bool)
    first[0], first[ends[:-1]] = True, True
    out[:n] = np.bincount(state[first], minlength=n)
    out[n : n + n * n] = np.bincount((state[:-1] * n + state[1:])[~first[1:]], minlength=n * n)
    out[n + n * n :] = np.bincount(state * CODES + seen, minlength=n * CODES)
    return out


def fit(pages: DataFrame, rounds: int = ROUNDS) -> LineModel:
    """The model of all pages, which have a column ``codes`` (binary).  What reaches the driver is a row of counts, whatever the corpus."""
    model, before = LineModel.believed(), None

    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], model: LineModel = model) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1, dtype=np.int64)
            for batch in batches:
                own = batch.column(0).to_pylist()
                total = total + count(own, model.label(own))
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, type=pa.int32()), pa.array(total[at], type=pa.int64())], names=["at", "n"])

        n = len(STATES)
        now = np.zeros(n + n * n + n * CODES, dtype=np.int64)
        for r in pages.select("codes").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
            now[r["at"]] = r["n"]
        if not now.any() or before is not None and (now == before).all():
            break
        model, before = LineModel.counted(now), now
    return model
