"""Filling containers of a fixed capacity with texts sized in tokens.

Sizes are whole numbers up to the capacity, so the instance is the histogram of sizes: at most ``capacity`` numbers, whatever the
corpus.  The plan is made on that histogram, first by Martello and Toth's dominance reduction, which fixes containers that are
provably part of some best packing, then by best fit in falling order of size for what remains.  A plan is a list of
container patterns with multiplicities; each text finds its container from its rank among the texts of its size.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..cluster import cut, salt, shuffle_width
from .tokens import TOKENIZER, TOKENIZER_DIR, count_tokens

CAPACITY = 2048


class _Sizes:
    """Counts by size, with the sizes that occur in rising order."""

    def __init__(self, counts: dict[int, int]):
        self.count = {s: n for s, n in counts.items() if n > 0}
        self.sorted = sorted(self.count)

    def take(self, size: int, n: int) -> None:
        self.count[size] -= n
        if not self.count[size]:
            del self.count[size]
            del self.sorted[bisect.bisect_left(self.sorted, size)]

    def smallest(self, n: int, without: int) -> list[int]:
        """The n smallest items besides one item of size ``without``."""
        out: list[int] = []
        for s in self.sorted:
            out += [s] * min(n - len(out), self.count[s] - (s == without))
            if len(out) >= n:
                break
        return out

    def largest_upto(self, room: int, without: int) -> int | None:
        i = bisect.bisect_right(self.sorted, room) - 1
        if i >= 0 and self.sorted[i] == without and self.count[without] < 2:
            i -= 1
        return self.sorted[i] if i >= 0 else None

    def best_pair(self, room: int, without: int) -> int:
        """The largest sum of two items that is at most ``room``, besides one item of size ``without``; 0 if there is none."""
        free = [s for s in self.sorted if self.count[s] - (s == without) > 0]
        lo, hi, best = 0, bisect.bisect_right(free, room) - 1, 0
        while lo <= hi:
            total = free[lo] + free[hi]
            if lo == hi and self.count[free[lo]] - (free[lo] == without) < 2:
                break
            if total <= room:
                best = max(best, total)
                lo += 1
            else:
                hi -= 1
        return best


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[dict[int, int], int]], dict[int, int]]:
    """Containers that dominate all others with the same largest item, as (pattern, number), and the counts that remain.

    For an item j: alone, if nothing fits beside it; with the item that fills it exactly; with the largest that fits, if no two
    fit beside j, or if no three do and no two that fit are larger together.
    """
    sizes, fixed, skipped = _Sizes(counts), [], []

    def fix(j: int, k: int | None) -> None:
        if k is None:
            n = sizes.count[j]
            fixed.append(({j: 1}, n))
            sizes.take(j, n)
        elif j == k:
            n = sizes.count[j] // 2
            fixed.append(({j: 2}, n))
            sizes.take(j, 2 * n)
        else:
            n = min(sizes.count[j], sizes.count[k])
            fixed.append(({j: 1, k: 1}, n))
            sizes.take(j, n)
            sizes.take(k, n)

    pending = list(reversed(sizes.sorted))
    for j in pending:
        while sizes.count.get(j):
            room = capacity - j
            k = sizes.largest_upto(room, j)
            if k is None or k == room:
                fix(j, k)
                continue
            low = sizes.smallest(3, j)
            if len(low) < 2 or low[0] + low[1] > room:
                fix(j, k)
                continue
            if (len(low) < 3 or sum(low) > room) and k >= sizes.best_pair(room, j):
                fix(j, k)
                continue
            break
    return fixed, sizes.count


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit in falling order of size, for all items of a size at once; the result equals placing them one by one."""
    groups: dict[int, list[tuple[dict[int, int], int]]] = {}
    rooms: list[int] = []

    def put(room: int, pattern: dict[int, int], n: int) -> None:
        if n:
            if room not in groups:
                groups[room] = []
                bisect.insort(rooms, room)
            groups[room].append((pattern, n))

    for s in sorted(counts, reverse=True):
        left = counts[s]
        while left:
            i = bisect.bisect_left(rooms, s)
            if i == len(rooms):
                each = capacity // s
                put(capacity - each * s, {s: each}, left // each)
                if left % each:
                    put(capacity - left % each * s, {s: left % each}, 1)
                break
            room = rooms[i]
            pattern, n = groups[room].pop()
            if not groups[room]:
                del groups[room], rooms[i]
            each = room // s
            full = min(n, left // each)
            put(room - each * s, pattern | {s: each}, full)
            left -= full * each
            n -= full
            if n and left:  # fewer than ``each`` are left
                put(room - left * s, pattern | {s: left}, 1)
                left, n = 0, n - 1
            put(room, pattern, n)
    return [g for room in groups.values() for g in room]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Container patterns, each as {size: items}, with the number of containers of each."""
    whole = counts.get(capacity, 0)
    fixed, rest = reduce_by_dominance({s: n for s, n in counts.items() if 0 < s < capacity}, capacity)
    return [({capacity: 1}, whole)] * (whole > 0) + fixed + best_fit(rest, capacity)


def _slots(patterns: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each size: the first rank, first container and items a container of each pattern that holds it."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    rank: dict[int, int] = {}
    first = 0
    for pattern, n in patterns:
        for s, each in pattern.items():
            rows.setdefault(s, []).append((rank.get(s, 0), first, each))
            rank[s] = rank.get(s, 0) + each * n
        first += n
    return {s: tuple(np.array(x, dtype=np.int64) for x in zip(*r)) for s, r in rows.items()}


def pack(sizes: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens", capacity: int = CAPACITY) -> DataFrame:
    """(container long, id_col, part int, n_tokens long): where each item, or each part of an item above the capacity, goes.

    An item up to the capacity is one row with part 0.  A longer one is cut into full containers and a rest, parts 0, 1, ...;
    no other item is cut.  Items of size 0 or null take no space and go to container 0.  Rows with equal ids are separate items.
    Container numbers begin at 0; the sum of a container is at most the capacity.  An empty table gives an empty table.

    Only the histogram of sizes, at most ``capacity`` rows, reaches the driver.  Ranks within a size are counted in salted
    groups, so a size that a third of all items share is not ranked by one task.
    """
    spark = sizes.sparkSession
    size = F.greatest(F.coalesce(F.col(f"`{size_col}`").cast("long"), F.lit(0)), F.lit(0))
    rest = F.when(size <= capacity, size).otherwise(F.pmod(size, F.lit(capacity)))
    parts = F.when(size <= capacity, F.lit(1)).otherwise(F.ceil(size / capacity)).cast("int")
    items = sizes.select(F.col(f"`{id_col}`").alias("_id"), size.alias("_size"), parts.alias("_parts"), rest.alias("_rest"))
    items = items.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    items = items.select("_id", F.col("_part"), F.when((F.col("_parts") == 1) | ((F.col("_part") == F.col("_parts") - 1) & (F.col("_rest") > 0)), F.col("_rest")).otherwise(capacity).alias("_n"))
    width = shuffle_width(spark)
    items = cut(items.withColumn("_salt", salt(width, "_id", "_part")))

    by_salt = items.groupBy("_n", "_salt").count()
    counts = {r._n: r["count"] for r in by_salt.groupBy("_n").agg(F.sum("count").alias("count")).collect()}
    slots = _slots(plan({s: n for s, n in counts.items() if s}, capacity))

    before = by_salt.select("_n", "_salt", (F.sum("count").over(W.partitionBy("_n").orderBy("_salt")) - F.col("count")).alias("_before"))
    number = F.row_number().over(W.partitionBy("_n", "_salt").orderBy("_id", "_part")) - 1
    ranked = items.withColumn("_number", number).join(before, ["_n", "_salt"]).select("_id", "_part", "_n", (F.col("_number") + F.col("_before")).alias("_rank"))
    kind = sizes.select(F.col(f"`{id_col}`")).schema[0].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rank = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            out = np.zeros(len(n), dtype=np.int64)
            order = np.argsort(n, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(n[order])) + 1):
                if len(at) and n[at[0]]:
                    start, first, each = slots[int(n[at[0]])]
                    i = np.searchsorted(start, rank[at], side="right") - 1
                    out[at] = first[i] + (rank[at] - start[i]) // each[i]
            yield pa.RecordBatch.from_arrays([pa.array(out), *batch.columns[:3]], names=["container", id_col, "part", "n_tokens"])

    return ranked.mapInArrow(place, f"container bigint, `{id_col}` {kind}, part int, n_tokens bigint")


def pack_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, folder: str = TOKENIZER_DIR, name: str = TOKENIZER) -> DataFrame:
    """``pack`` over the token counts of texts; null and empty texts have size 0."""
    return pack(count_tokens(df, id_col, text_col, folder, name), id_col, "n_tokens", capacity)
