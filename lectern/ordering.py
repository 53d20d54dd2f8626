"""Order-dependent steps without a task that holds a whole group: neighbours in a total order, and ranks within groups.

A window over one key puts all rows of that key into one task.  Here rows are range partitioned by key and order together, so a key with a third of all
rows lies in as many partitions as its size asks for; what crosses a partition's edge is one row or one count of each partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from .cluster import cut, shuffle_width


def total_order(df: DataFrame, order: list) -> DataFrame:
    """``df`` sorted by ``order`` over all its partitions, written to the checkpoint folder so that every later step sees the same partitions."""
    return cut(df.repartitionByRange(shuffle_width(df.sparkSession), *order).sortWithinPartitions(*order))


def with_neighbour(df: DataFrame, order: list, cols: list[str], before: bool) -> DataFrame:
    """``df`` with columns next_<c> (or prev_<c> if ``before``) of the row that follows (precedes) in the total order; null at the end.

    The order should be total; rows that tie stand in any order.  The driver learns one row of each partition.
    """
    laid = total_order(df, order)
    names = [("prev_" if before else "next_") + c for c in cols]
    types = [laid.schema[c].dataType for c in cols]

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            if batch.num_rows and (before or kept is None):
                kept = batch.slice(batch.num_rows - 1 if before else 0, 1)
        if kept is not None:
            part = pa.array([TaskContext.get().partitionId()], type=pa.int32())
            yield pa.RecordBatch.from_arrays([part, *kept.columns], names=["_part", *cols])

    edge_schema = T.StructType([T.StructField("_part", T.IntegerType()), *(T.StructField(c, t) for c, t in zip(cols, types))])
    found = {r["_part"]: [r[c] for c in cols] for r in laid.select(*cols).mapInArrow(edges, edge_schema).collect()}

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        beyond = max((p for p in found if p < part), default=None) if before else min((p for p in found if p > part), default=None)
        far = found[beyond] if beyond is not None else [None] * len(cols)
        held, last = None, far

        def emit(batch: pa.RecordBatch, edge: list) -> pa.RecordBatch:
            out = []
            for c, value in zip(cols, edge):
                column = batch.column(c)
                one = value if isinstance(value, pa.Array) else pa.array([value], type=column.type)
                parts = [one, column.slice(0, batch.num_rows - 1)] if before else [column.slice(1), one]
                out.append(pa.concat_arrays(parts))
            return pa.RecordBatch.from_arrays([*batch.columns, *out], names=[*batch.schema.names, *names])

        for batch in batches:
            if not batch.num_rows:
                continue
            if before:
                yield emit(batch, last)
                last = [batch.column(c).slice(batch.num_rows - 1) for c in cols]
            else:
                if held is not None:
                    yield emit(held, [batch.column(c).slice(0, 1) for c in cols])
                held = batch
        if held is not None:
            yield emit(held, far)

    schema = T.StructType([*laid.schema.fields, *(T.StructField(n, t) for n, t in zip(names, types))])
    return laid.mapInArrow(shift, schema)


def rank_in_groups(df: DataFrame, groups: list[str], order: list, out: str = "rank") -> DataFrame:
    """``df`` with the 0-based place of each row among the rows of its group, in the given order, which should be total."""
    laid = total_order(df, [*groups, *order])
    at = F.monotonically_increasing_id()
    laid = laid.select("*", F.shiftright(at, 33).cast("int").alias("_part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"))
    spans = laid.groupBy(*groups, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = F.sum("_n").over(W.partitionBy(*groups).orderBy("_part")) - F.col("_n")
    spans = spans.select(*(F.col(g).alias(f"_g_{g}") for g in groups), F.col("_part").alias("_p"), (earlier - F.col("_first")).alias("_shift"))
    same = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in groups]
    joined = laid.join(spans, [F.col("_part") == F.col("_p"), *same])
    return joined.withColumn(out, F.col("_at") + F.col("_shift")).drop("_part", "_at", "_p", "_shift", *(f"_g_{g}" for g in groups))


def fill_forward(df: DataFrame, group: str, order: list, col: str, out: str) -> DataFrame:
    """``df`` with ``out``: the last value of ``col`` that is not null, up to each row in the order of its group; null where there is none.

    Within a partition a window finds it; the driver carries over one value of each partition.
    """
    laid = total_order(df, order)
    at = F.monotonically_increasing_id()
    laid = laid.select("*", F.shiftright(at, 33).cast("int").alias("_part"), at.alias("_at"))
    local = F.last(col, ignorenulls=True).over(W.partitionBy("_part", group).orderBy("_at").rowsBetween(W.unboundedPreceding, 0))
    near = laid.withColumn("_near", local)
    edges = laid.groupBy("_part").agg(F.min_by(group, "_at").alias("head"), F.max_by(group, "_at").alias("tail"), F.max(F.struct(F.when(F.col(col).isNotNull(), F.col("_at")).alias("at"), F.col(group).alias("g"), F.col(col).alias("v"))).alias("last"))
    carried, group_now, value = [], None, None
    for e in sorted(edges.collect(), key=lambda e: e._part):
        carried.append((e._part, group_now, value if group_now == e.head else None))
        if e.tail != e.head or group_now != e.head:
            value = None
        if e.last.at is not None and e.last.g == e.tail:
            value = e.last.v
        group_now = e.tail
    schema = T.StructType([T.StructField("_p", T.IntegerType()), T.StructField("_g", laid.schema[group].dataType), T.StructField("_carried", laid.schema[col].dataType)])
    carry = F.broadcast(df.sparkSession.createDataFrame([c for c in carried if c[2] is not None], schema))  # one row of each partition at most
    joined = near.join(carry, (F.col("_part") == F.col("_p")) & (F.col(group) == F.col("_g")), "left")
    return joined.withColumn(out, F.coalesce("_near", "_carried")).drop("_part", "_at", "_near", "_p", "_g", "_carried")
