"""Web search results as rows of JSON payloads; requests themselves are made elsewhere, no network is used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

RESULT = "struct<data:struct<webPages:struct<value:array<struct<name:string,url:string,snippet:string>>>>>"


def results(payload: Column) -> Column:
    return F.coalesce(F.from_json(payload, RESULT)["data"]["webPages"]["value"], F.array().cast("array<struct<name:string,url:string,snippet:string>>"))


def readable(df: DataFrame, payload_col: str = "payload") -> DataFrame:
    """``df`` with ``results``: a numbered list of name, address and snippet; null where there is none."""
    lines = F.transform(results(F.col(payload_col)), lambda r, i: F.concat_ws("\n", F.concat((i + 1).cast("string"), F.lit(". "), F.coalesce(r["name"], F.lit(""))), r["url"], r["snippet"]))
    return df.withColumn("results", F.nullif(F.array_join(lines, "\n\n"), F.lit("")))
