"""Changes to immutable tables: inserts, last-writer-wins, row updates, deletes with their cascades, and the checks of keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; aggregated before the shuffle, so a key with many versions isn't gathered in one task.

    A null in ``order`` counts as earliest; rows that tie in it are decided by their other columns.
    """
    rest = [c for c in df.columns if c not in keys]
    names = order + [c for c in rest if c not in order]
    best = df.groupBy(*keys).agg(F.max(F.struct(*(F.col(f"`{c}`") for c in names))).alias("_row"))
    return best.select(*keys, *(F.col(f"_row.`{c}`").alias(c) for c in rest)).select(*df.columns)


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``changes`` over ``table``: the latest change of a key replaces its row."""
    new = latest(changes, keys, order)
    return table.join(new.select(*keys), keys, "left_anti").unionByName(new)


def insert(table: DataFrame, rows: DataFrame, unique: list[str] | None = None) -> DataFrame:
    """``rows`` added; with ``unique``, those whose key is there already, and all but one of equal new ones, are left out."""
    if unique:
        rows = rows.dropDuplicates(unique).join(table.select(*unique), unique, "left_anti")
    return table.unionByName(rows)


def update(table: DataFrame, changes: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Columns of the rows whose key is in ``changes`` set to its values, nulls included."""
    new = changes.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in cols), F.lit(True).alias("_hit"))
    joined = table.join(new, F.col(key) == F.col("_key"), "left")
    return joined.select(*(F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c) for c in table.columns))


def delete(table: DataFrame, gone: DataFrame, key: str, foreign: str = "id") -> DataFrame:
    return table.join(gone.select(F.col(foreign).alias(key)), key, "left_anti").select(*table.columns)


def set_null(table: DataFrame, gone: DataFrame, key: str, foreign: str = "id") -> DataFrame:
    """The reference to deleted rows put to null."""
    dead = gone.select(F.col(foreign).alias("_gone")).distinct()
    joined = table.join(dead, F.col(key) == F.col("_gone"), "left")
    return joined.withColumn(key, F.when(F.col("_gone").isNull(), F.col(key))).select(*table.columns)


def cascade(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame) -> dict[str, DataFrame]:
    """Each table without the rows that refer to deleted ones."""
    return {name: delete(df, gone, key) for name, (df, key) in tables.items()}


def duplicates(table: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand more than once: what a unique constraint would have refused."""
    return table.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def next_position(table: DataFrame, col: str) -> DataFrame:
    return table.agg((F.coalesce(F.max(col), F.lit(-1)) + 1).cast("long").alias("next_position"))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
