"""One consistent form for texts that look the same and differ in their characters.

Look-alike classes are the components of a union-find over strings: single characters and short sequences that render alike (wide
and narrow forms, ligatures, radicals that repeat an ideograph, letters shared by alphabets, composed and decomposed accents, kinds of blank and
hyphen, and, alike to nothing at all, invisible characters).  Links are transitive.  Each class is represented by its most frequent
member in the corpus; a multi-pattern automaton rewrites every other member to it, longest match first.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from ..cluster import keep

# Letters of other alphabets that are drawn like a Latin letter, each before the Latin letters at the same places.
LOOK_ALIKE_LETTERS = (
    ("АВЕЅІЈКМНОРСТХҮԌԚԜҺӀ", "ABESIJKMHOPCTXYGQWHI"),  # Cyrillic capitals
    ("аеѕіјорсухһԁԛԝӏѵ", "aesijopcyxhdqwlv"),  # Cyrillic small letters
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX"),  # Greek capitals
    ("ονυϲϳ", "ovucj"),  # Greek small letters
    ("ɡɑ", "ga"),  # phonetic letters
    ("օսցհո", "oughn"),  # Armenian small letters
    ("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᎽᏀᏃᏒᏔᏕᏙᏚᏞᏟᏢᏦᏴ", "DRTAJEWMHYGZRWSVSLCPKB"),  # Cherokee letters
    ("ⲀⲂⲈⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬ", "ABEHIKMNOPCTYX"),  # Coptic capitals
    ("ⲟⲣⲥ", "opc"),  # Coptic small letters
    ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"),  # Lisu letters
)
HYPHENS = "‐‑"
#: Compatibility forms that show no difference to a reader; raised, lowered, circled and fractional forms do.
SAME_LOOK_TAGS = {"<wide>", "<narrow>", "<noBreak>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>"}


class UnionFind:
    def __init__(self):
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.parent.setdefault(x, x)
        root = x
        while self.parent[root] != root:
            root = self.parent[root]
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def union(self, a: str, b: str) -> None:
        self.parent[self.find(a)] = self.find(b)

    def classes(self) -> list[list[str]]:
        out: dict[str, list[str]] = {}
        for x in self.parent:
            out.setdefault(self.find(x), []).append(x)
        return list(out.values())


def _links(c: str) -> Iterable[str]:
    """What the character ``c`` looks like."""
    kind = unicodedata.category(c)
    if kind == "Cf" or "︀" <= c <= "️" or c in "͏ᅟᅠㅤ":
        yield ""
    elif kind == "Zs":
        yield " "
    elif c in HYPHENS:
        yield "-"
    else:
        parts = unicodedata.decomposition(c).split()
        tag = parts.pop(0) if parts and parts[0][0] == "<" else ""
        drawn = "".join(chr(int(p, 16)) for p in parts)
        if drawn and (tag in SAME_LOOK_TAGS or not tag or tag == "<compat>" and (kind[0] == "L" or "⺀" <= c <= "⿟")):
            yield unicodedata.normalize("NFD", drawn) if not tag else drawn


def rules(counts: dict[str, int]) -> dict[str, str]:
    """From the characters of a corpus and their counts: every member of a look-alike class to the class's representative.

    The representative is the most frequent member; a sequence is taken to be as frequent as its rarest character, ties go to the
    shorter and then the smaller one.  The class of invisible characters is represented by the empty string.
    """
    pairs = {a: b for others, latin in LOOK_ALIKE_LETTERS for a, b in zip(others, latin)}
    weight = lambda s: min((counts.get(c, 0) for c in s), default=1 << 62)

    def represent(classes: UnionFind) -> dict[str, str]:
        best = [(members, min(members, key=lambda s: (-weight(s), len(s), s))) for members in classes.classes()]
        return {m: b for members, b in best for m in members if m != b}

    classes, sequences = UnionFind(), []
    for c in counts:
        for other in [*_links(c), *([pairs[c]] if c in pairs else [])]:
            if len(other) < 2:
                classes.union(c, other)
            else:
                sequences.append((c, other))
    single = represent(classes)
    for c, other in sequences:  # a sequence of characters that have a representative themselves is linked as it will be read
        classes.union(c, "".join(single.get(x, x) for x in other))
    return represent(classes)


class Rewriter:
    """Applies rules; a text without any of their characters is returned at once."""

    def __init__(self, to: dict[str, str]):
        self.single = {ord(a): b for a, b in to.items() if len(a) == 1}
        several = {a.translate(self.single): b for a, b in to.items() if len(a) > 1}
        self.automaton = ahocorasick.Automaton() if several else None
        for a, b in several.items():
            self.automaton.add_word(a, (len(a), b))
        if several:
            self.automaton.make_automaton()
        self.odd = frozenset(map(chr, self.single))
        self.ascii = all(c > 127 for c in self.single) and all(not a.isascii() for a in several)
        self.lasts = frozenset(a[-1] for a in several)
        self.marked = regex.compile(r"\p{M}")

    def __call__(self, text: str) -> str:
        if self.ascii and text.isascii():
            return text.strip()
        if not self.odd.isdisjoint(text):
            text = text.translate(self.single)
        if not self.lasts.isdisjoint(text):
            out, done = [], 0
            for end, (size, new) in self.automaton.iter_long(text):
                out += text[done : end + 1 - size], new
                done = end + 1
            text = "".join(out) + text[done:]
        if not text.isascii() and self.marked.search(text):
            text = unicodedata.normalize("NFC", text)
        return text.strip()


def count_characters(df: DataFrame, cols: list[str]) -> dict[str, int]:
    """Counts of all characters in the text columns; at most as many as there are code points, so they fit on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0x110000, dtype=np.int64)
        for batch in batches:
            for column in batch.columns:
                text = "".join(t for t in column.to_pylist() if t)
                if text:
                    total += np.bincount(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32), minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["c", "n"])

    found = df.select(*cols).mapInArrow(run, "c long, n long").groupBy("c").agg(F.sum("n").alias("n"))
    return {chr(r.c): r.n for r in found.collect()}


def unify(df: DataFrame, text_col: str, out_col: str, to: dict[str, str]) -> DataFrame:
    """``df`` with ``out_col``: the text in its one consistent form, blanks at either end removed.

    Texts that look the same get equal forms: width of letters, kinds of blank and hyphen, invisible characters, ligatures, composed accents
    and letters of other alphabets make no difference; case, accents, raised figures and other punctuation do.  Null stays null, an
    empty or blank text gives an empty form, rows are kept with their repetitions, and other columns are left alone; if one
    is named ``out_col`` it is replaced.
    """
    schema = df.drop(out_col).withColumn(out_col, F.lit(None).cast("string")).schema
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewrite = Rewriter(to)
        for batch in batches:
            forms = [None if t is None else rewrite(t) for t in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forms, type=pa.string())], names=names)

    return df.drop(out_col).mapInArrow(run, schema)


def records(annotations: DataFrame, search_hits: DataFrame, page_ocr_cache: DataFrame) -> DataFrame:
    """(key, book_id, page, text): marked words, snippets and scanned lines as records of one shape; rows without text are left out."""
    marks = annotations.select(F.concat(F.lit("a:"), "id").alias("key"), "book_id", "page", "text")
    hits = search_hits.select(F.concat(F.lit("h:"), "hit_id").alias("key"), "book_id", "page", F.col("snippet").alias("text"))
    lines = page_ocr_cache.select("book_id", "page", "ocr_mode", F.posexplode("result.lines.text").alias("line_no", "text"))
    lines = lines.select(F.concat_ws(":", F.lit("o"), "book_id", "page", "ocr_mode", "line_no").alias("key"), "book_id", "page", "text")
    return reduce(DataFrame.unionByName, [marks, hits, lines]).where("text IS NOT NULL")


def _formed(rows: DataFrame, to: dict[str, str]) -> DataFrame:
    """(_g, _h, _t, key): fingerprints of each record's place and form, 128 bits, and of its text, 64; written once, as texts are rewritten in Python."""
    prints = [F.xxhash64("book_id", "page", "form").alias("_g"), F.xxhash64("form", "page", F.lit(1)).alias("_h"), F.xxhash64("text").alias("_t")]
    return keep(unify(rows, "text", "form", to).where("book_id IS NOT NULL AND page IS NOT NULL").select(*prints, "key"))


def _mixed(formed: DataFrame) -> DataFrame:
    """The records of ``formed`` whose group has several texts; equal ones are aggregated on the map side, however many."""
    mixed = formed.groupBy("_g", "_h").agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi")).where("_lo <> _hi").select("_g", "_h")
    return formed.join(mixed, ["_g", "_h"], "left_semi").distinct()


def look_alike_classes(rows: DataFrame, to: dict[str, str]) -> DataFrame:
    """(key, class): each record that looks like one of other characters on its page, with the least key of those that look alike; one row for each record."""
    some = _mixed(_formed(rows, to))
    least = some.groupBy("_g", "_h").agg(F.min("key").alias("class"))
    return some.join(least, ["_g", "_h"]).select("key", "class").distinct()


def look_alike_pairs(rows: DataFrame, to: dict[str, str]) -> DataFrame:
    """(key_a, key_b), key_a < key_b: records of one book and page whose forms are equal and whose texts are not.

    ``rows`` has (key, book_id, page, text).  Repeated rows count once; a null book or page pairs with nothing.  Forms are compared by
    fingerprints of 128 bits, texts of one form by 64.  Groups in which all texts are equal are left out by a map-side aggregate,
    whatever their size; of the rest, differing texts are paired first and their keys put in after, so that only pairs of the
    result are ever made.
    """
    group = ["_g", "_h"]
    some = _mixed(_formed(rows, to))
    texts = some.select(*group, "_t").distinct()
    pairs = texts.withColumnRenamed("_t", "_ta").join(texts.withColumnRenamed("_t", "_tb"), group).where("_ta < _tb")
    a = some.select(*group, F.col("_t").alias("_ta"), F.col("key").alias("_a"))
    b = some.select(*group, F.col("_t").alias("_tb"), F.col("key").alias("_b"))
    both = pairs.join(a, [*group, "_ta"]).join(b, [*group, "_tb"]).where("_a <> _b")
    return both.select(F.least("_a", "_b").alias("key_a"), F.greatest("_a", "_b").alias("key_b")).distinct()
