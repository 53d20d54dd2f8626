"""Encoding of a corpus with a public byte-level BPE vocabulary by merge replay.

The text of a task's rows is split into words, each distinct word is kept once, and all of them lie behind each other in one
array of token ids.  An inverted index maps each mergeable token pair to the word positions where it stands.  Merges are then
applied in rank order, each to all of its positions at once; only the two neighbours of a merged position enter the index anew.
Words already replayed by the task are looked up.  Rows never leave their task, so there is no shuffle, and the cost grows with
the distinct words of a block, not with the number of their repetitions.
"""

from __future__ import annotations

import base64
import heapq
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

TOKENIZER_DIR = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k"

# Fixed value: the pattern that splits text into words before merging (public, part of the vocabulary's definition).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

BLOCK_CHARS = 4_000_000
CACHE_WORDS = 400_000


class MergeReplay:
    """The merges of one vocabulary; ``encode_words`` replays them over a block of distinct words."""

    def __init__(self, folder: str, name: str = TOKENIZER):
        with open(os.path.join(folder, f"{name}.json"), encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, merges = model["vocab"], model["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        self.left, self.right, self.made = left.astype(np.int32), right.astype(np.int32), made
        key = left << 20 | right
        order = np.argsort(key)
        self.keys, self.ranks = key[order], order.astype(np.int32)
        self.byte_ids = np.zeros(256, dtype=np.int32)
        with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
            for line in f:
                token, rank = line.split()
                raw = base64.b64decode(token)
                if len(raw) == 1:
                    self.byte_ids[raw[0]] = int(rank)

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, -1 where there is none."""
        key = a.astype(np.int64) << 20 | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words behind each other, and the number of ids of each word."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        n = int(sizes.sum())
        if not n:
            return np.empty(0, np.int32), sizes
        tok = self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
        ends = np.cumsum(sizes)
        nxt = np.arange(1, n + 1, dtype=np.int64)
        prv = np.arange(-1, n - 1, dtype=np.int64)
        some = sizes > 0
        nxt[ends[some] - 1] = -1
        prv[(ends - sizes)[some]] = -1

        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def note(at: np.ndarray, rank: np.ndarray) -> None:
            hit = rank >= 0
            at, rank = at[hit], rank[hit]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            firsts = rank[np.concatenate(([0], cuts))]
            for r, part in zip(firsts.tolist(), np.split(at, cuts)):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(queue, r)

        inner = np.flatnonzero(nxt >= 0)
        note(inner, self.rank_of(tok[inner], tok[inner + 1]))
        while queue:
            r = heapq.heappop(queue)
            parts = index.pop(r)
            at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            a, b = self.left[r], self.right[r]
            at = at[tok[at] == a]
            after = nxt[at]
            ok = after >= 0
            at, after = at[ok], after[ok]
            ok = tok[after] == b
            at, after = at[ok], after[ok]
            if not len(at):
                continue
            if a == b and len(at) > 1:  # in a run of equal tokens every other position merges, from the left
                at = np.sort(at)
                after = nxt[at]
                chained = np.concatenate(([False], at[1:] == after[:-1]))
                number = np.arange(len(at))
                start = np.maximum.accumulate(np.where(chained, 0, number))
                even = (number - start) % 2 == 0
                at, after = at[even], after[even]
            beyond = nxt[after]
            tok[at] = self.made[r]
            tok[after] = -1
            nxt[at] = beyond
            there = beyond >= 0
            prv[beyond[there]] = at[there]
            before = prv[at]
            has = before >= 0
            before = before[has]
            note(before, self.rank_of(tok[before], np.full(len(before), self.made[r])))
            start, then = at[there], beyond[there]
            note(start, self.rank_of(np.full(len(start), self.made[r]), tok[then]))

        alive = tok >= 0
        upto = np.concatenate(([0], np.cumsum(alive)))
        return tok[alive], upto[ends] - upto[ends - sizes]


@lru_cache(maxsize=2)
def replay(folder: str, name: str) -> MergeReplay:
    return MergeReplay(folder, name)


class BlockEncoder:
    """Encodes blocks of texts, remembering the words of earlier blocks; forgetting them changes time, not results."""

    def __init__(self, folder: str, name: str):
        self.model = replay(folder, name)
        self.split = regex.compile(WORD_PATTERN).findall
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.flat, self.sizes = [], []

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids behind each other, and the number of ids of each text."""
        if len(self.number) > CACHE_WORDS:
            self.forget()
        number, known = self.number, len(self.number)
        rows, row_words = [], np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            if text:
                words = self.split(text)
                row_words[i] = len(words)
                rows.append(np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words)))
        fresh = [w.encode("utf-8") for w, k in zip(reversed(number), range(len(number) - known))][::-1]
        if fresh:
            flat, sizes = self.model.encode_words(fresh)
            self.flat.append(flat)
            self.sizes.append(sizes)
        if not rows:
            return np.empty(0, np.int32), row_words
        self.flat, self.sizes = [np.concatenate(self.flat)], [np.concatenate(self.sizes)]
        flat, sizes = self.flat[0], self.sizes[0]
        starts = np.cumsum(sizes) - sizes
        seq = np.concatenate(rows)
        lens = sizes[seq]
        ends = np.cumsum(lens)
        ids = flat[np.arange(ends[-1]) + np.repeat(starts[seq] - (ends - lens), lens)]
        upto = np.concatenate(([0], ends))
        last = np.cumsum(row_words)
        return ids, upto[last] - upto[last - row_words]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """The batches' rows cut into blocks of about BLOCK_CHARS characters (a longer text is a block of its own)."""
    for batch in batches:
        keys, texts, begin, chars = batch.column(0), batch.column(1).to_pylist(), 0, 0
        for i, text in enumerate(texts):
            chars += len(text or "")
            if chars >= BLOCK_CHARS or i == len(texts) - 1:
                yield keys.slice(begin, i + 1 - begin), texts[begin : i + 1]
                begin, chars = i + 1, 0


def _field(df: DataFrame, col: str):
    return df.select(F.col(f"`{col}`")).schema[0]


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZER_DIR, name: str = TOKENIZER) -> DataFrame:
    """(id_col, ids array<int>): the token ids of each row's text, without special tokens.

    One row for each row of ``df``; repeated rows come out repeatedly with equal ids, a null id keeps its row.  Null and empty
    texts give an empty list.  The spelling of a special token is ordinary text.  Blank texts are encoded as they are.  Only the
    two named columns are read, others may have any name.  An empty table gives an empty table.
    """
    schema = f"`{id_col}` {_field(df, id_col).dataType.simpleString()}, ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = BlockEncoder(folder, name)
        for keys, texts in _blocks(batches):
            ids, sizes = coder.encode(texts)
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, type=pa.int32()))
            yield pa.RecordBatch.from_arrays([keys, lists], names=[id_col, "ids"])

    return df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, schema)


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZER_DIR, name: str = TOKENIZER) -> DataFrame:
    """(id_col, n_tokens long): as ``encode``, but the number of ids alone."""
    schema = f"`{id_col}` {_field(df, id_col).dataType.simpleString()}, n_tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = BlockEncoder(folder, name)
        for keys, texts in _blocks(batches):
            _, sizes = coder.encode(texts)
            yield pa.RecordBatch.from_arrays([keys, pa.array(sizes, type=pa.int64())], names=[id_col, "n_tokens"])

    return df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, schema)
