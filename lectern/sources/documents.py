"""Document sources: files read as bytes, their pages extracted by an exchangeable function, and outlines."""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import decode

#: (bytes, path) -> the text of each page
Extractor = Callable[[bytes, str], list[str]]
PAGES = "original_path string, page long, text string, error string"


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(original_path, size, modified, content, file_type): files below a path; the content is read only where it is used."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return df.select(F.col("path").alias("original_path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content", decode.type_of_path(F.col("path")).alias("file_type"))


def plain_pages(content: bytes, path: str) -> list[str]:
    """Pages of a text file, divided by form feeds."""
    return content.decode("utf-8", errors="replace").split("\f")


def simple_pdf_pages(content: bytes, path: str) -> list[str]:
    """Texts of an uncomplicated PDF: strings shown in each content stream.  Fonts with encodings of their own need another extractor."""
    if not content.startswith(b"%PDF"):
        raise ValueError("not a PDF file")
    pages = []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", content, re.S):
        raw = m.group(1)
        try:
            raw = zlib.decompress(raw)
        except zlib.error:
            pass
        if b"BT" not in raw:
            continue
        shown = io.StringIO()
        for s in re.finditer(rb"\(((?:\\.|[^\\()])*)\)\s*(?:Tj|')|\[((?:\\.|[^\]])*)\]\s*TJ|(T\*|Td|TD|ET)", raw):
            if s.group(3):
                shown.write("\n")
            else:
                pieces = [s.group(1)] if s.group(1) is not None else re.findall(rb"\(((?:\\.|[^\\()])*)\)", s.group(2))
                shown.write("".join(re.sub(rb"\\(.)", rb"\1", p).decode("latin-1") for p in pieces))
        pages.append(re.sub(r"\n+", "\n", shown.getvalue()).strip())
    return pages


def page_texts(df: DataFrame, extractor: Extractor) -> DataFrame:
    """(original_path, page, text, error): a row for each page, 0-based; a file that fails gives one row with its error and the job goes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    out += [(path, i, t, None) for i, t in enumerate(extractor(content or b"", path))]
                except Exception as e:  # noqa: BLE001
                    out.append((path, None, None, f"{type(e).__name__}: {e}"[:600]))
            cols = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.string()))], names=["original_path", "page", "text", "error"])

    return df.select("original_path", "content").mapInArrow(run, PAGES)


def outline(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(the columns of ``df`` but the text, node, depth, title): headings of marked-up text, # to ######, as a flat list in order."""
    lines = F.filter(
        F.transform(F.split(text_col, "\n"), lambda t, i: F.struct(i.alias("node"), F.length(F.regexp_extract(t, r"^(#{1,6})\s", 1)).alias("depth"), F.trim(F.regexp_replace(t, r"^#{1,6}\s+", "")).alias("title"))),
        lambda h: h["depth"] > 0
    )
    return df.withColumn("_h", F.explode(lines)).select(*(c for c in df.columns if c != text_col), "_h.node", "_h.depth", "_h.title")


def outline_tree(flat: DataFrame, key: str) -> DataFrame:
    """(key, node, depth, title, parent): each heading with the last one before it that is less deep."""
    heads = flat.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("node", "depth", "title"))).alias("h"))
    rows = heads.select(key, "h", F.explode("h").alias("x"))
    above = F.filter("h", lambda p: (p["node"] < F.col("x.node")) & (p["depth"] < F.col("x.depth")))
    return rows.select(key, "x.node", "x.depth", "x.title", F.try_element_at(F.transform(above, lambda p: p["node"]), F.lit(-1)).alias("parent"))
