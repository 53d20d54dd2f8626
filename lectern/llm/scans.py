"""Noise in text from scanned pages: furniture, broken words and misread characters, and continuous paragraphs without them.

Lines are labelled by a hidden Markov model over each page (``linemodel``): states are the parts of a page, observations are classes of layout
features and of the scanner's confidence; its probabilities are estimated from all pages.  What a scanner takes for what is learned from the
corpus (``confusions``).  A word is misread if a word of the same confusion skeleton is so much more frequent that this one is no more than its
misreadings would be; two fragments at a line's end and the next one's beginning are one word if the corpus knows them joined rather than apart.

Pages stay whole from step to step: a line is a place in its page's arrays until a result needs a row for it.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..cluster import keep
from ..ordering import fill_forward
from . import confusions, linemodel
from .confusions import CONFUSIONS, Confusions, is_gram  # noqa: F401
from .linemodel import BODY, HEAD, NUMBER, STATES, TABLE, TITLE, LineModel
from .lookalike import Rewriter, rules

HYPHENS = "-‐‑­¬"
#: The largest share of a word's occurrences that is read wrongly, for each of its letters, and of an ideograph's in its context.
LETTER_ERRORS, HAN_ERRORS = 0.012, 0.25
#: A word is more than the misreadings of another one if chance makes it so frequent at most once in exp(DOUBT) times.
DOUBT = 3.0
#: Of two fragments that are known joined one is hardly ever a word: this many times less than what they are joined.
HARDLY = 20
#: How far an indented line begins behind the margin, as a share of the page's width.
INDENT = 0.015
#: Below this confidence a line's reading is doubtful.
DOUBTFUL = 0.8
#: A line of fewer characters than this share of the page's usual ones is short.
SHORT_LINE = 0.8
#: Slots by which words are sifted before they are joined.
SLOTS = 1 << 20

_MISREAD_IN_WORD = re.compile(
    r"(?<=[A-Za-zÀ-ÿ])[0-9!@{}|$#%&*+=<>^~\\\[\]`´°(]+(?=[A-Za-zÀ-ÿ])|(?<![\w])[0-9@{|$(!]+(?=[a-zà-ÿ]{2})|(?<=[A-Za-zÀ-ÿ]{2})[0-9@{|$]+(?![\w])"
    r"|(?<!\w)[lIOSBZ|]\d{2,}(?!\w)|(?<!\w)\d+[lIOSBZ|](?=\d)|(?<!\w)\d{2,}[lIOSBZ|](?!\w)"
)
_SIGN_IN_WORD = re.compile(r"[a-zà-ÿ][!{@|]")
_SPLIT_ACCENT = re.compile(r"[a-zà-ÿ][:`´¨][a-zà-ÿ]|\d\?[,;.]")
_TOKEN = re.compile(r"[^\s,.;:，。；：、“”\"()«»„？?…—/]+(?:\([^\s,.;:()]+)?")
_ELIDED = re.compile(r"^[A-Za-z]{1,2}['’](?=\w{2})")
_LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿœŒ]")
_HAN = re.compile(r"[一-鿿]")
_NUMBERED = re.compile(
    r"^(?:page|seite|página|pág\.?|s\.|p\.|pg\.?|第)?[\s\-–—·.\[\]()|*~]*(?:[\dlIO|!o]{1,5}|[ivxlcdm!1]{1,8})[\s\-–—·.\[\]()|*~]*(?:页|頁)?"
    r"(?:\s*(?:/|of|von|de|sur|共|out of)\s*[\dlIOo|!]{1,5}\s*[页頁]?)?[\s\-–—·.\[\]()|*~]*$",
    re.I,
)
_FIGURES = re.compile(r"^[\d\s.,%+\-–lIO|]+$")
_WORD_END = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿœŒ0-9!@{}|$#'’`´°(\-]*[A-Za-zÀ-ÖØ-öø-ÿœŒ0-9!@{|`´°])([-‐‑­¬]?)\s*$")
_WORD_START = re.compile(r"^\s*([A-Za-zÀ-ÖØ-öø-ÿœŒ0-9!@{}|$#'’`´°(]+(?:-[A-Za-zÀ-ÖØ-öø-ÿœŒ]+)*)")
_CLOSED = re.compile(r"[.!?。！？][”»“\"’')）]*$")

#: Singular letters and signs that look alike are read as the Latin one; frequent characters represent their classes.
_READ = None

KEY = ["book_id", "page", "ocr_mode"]


def slot(word: str) -> int:
    return zlib.crc32(word.encode()) % SLOTS


def _reader() -> Rewriter:
    global _READ
    if _READ is None:
        blocks = (
            (32, 127, 1000), (0xA0, 0x250, 20), (0x3001, 0x3040, 20), (0x4E00, 0xA000, 20), (0x250, 0x590, 1), (0x1D00, 0x2600, 1), (0x2E80, 0x3001, 1), (0xFB00, 0xFB07, 1), (0xFE00, 0xFE10, 1),
            (0xFEFF, 0xFFEF, 1)
        )
        _READ = Rewriter(rules({chr(i): weight for first, end, weight in blocks for i in range(first, end)}))
    return _READ


def plain(text: str) -> str:
    """The line with look-alike characters in one form; a hyphen of any kind at its end stays."""
    text = text.rstrip()
    tail = text[-1] if text and text[-1] in "­¬" else ""
    return _reader()(text[: len(text) - len(tail)]) + tail


def word_end(text: str) -> re.Match | None:
    """The word at a line's end (group 1) and the hyphen behind it (group 2); neither holds a blank, so only what follows the last one is looked at."""
    last = text.rstrip().rsplit(None, 1)
    return _WORD_END.search(last[-1]) if last else None


def _fold(text: str) -> str:
    return re.sub(r"[^a-zà-ÿœ一-鿿]+", " ", text.lower()).strip()


def _repeats(text: str, title: str) -> bool:
    """Whether a line is the title, with or without the page's number beside it."""
    bare = re.sub(r"^\s*\d{1,4}\s{2,}|\s{2,}\d{1,4}\s*$", "", text)
    return len(bare) < 2 * len(title) + 6 and SequenceMatcher(None, _fold(bare), title, autojunk=False).ratio() > 0.85


def observe(line: dict, page: dict, title: str, text: str | None = None) -> tuple[str, str, str, str]:
    """The classes of a line's place, of its margin, of its text (``plain``) and of its confidence, relative to the page's body."""
    text = plain(line["text"] or "") if text is None else text
    y, x, w = line["y"] or 0.0, line["x"] or 0.0, line["w"] or 0.0
    gap, top = page["leading"], page["usual_top"]
    place = "top" if y < min(top, page["top"]) - 0.6 * gap else "bottom" if y > page["bottom"] + 0.4 * gap or y > 0.925 and abs(x - page["left"]) > 0.1 else "first" if y < top + 0.9 * gap or y < page["top"] else "within"
    inset = x - page["left"]
    margin = "left" if inset < 0.09 else "middle" if abs(x + w / 2 - 0.5) < 0.07 and w < 0.3 else "inset"
    if _NUMBERED.match(text) and any(c.isdigit() or c in "ivxlcdmIVXLCDM!|" for c in text):
        kind = "numbered" if not (_FIGURES.match(text) and margin == "inset" and place in ("within", "first")) else "figures"
    elif _FIGURES.match(text):
        kind = "figures"
    elif title and (margin != "left" or place != "within") and _repeats(text, title):
        kind = "title"
    elif len(text) < SHORT_LINE * page["usual_length"] and not re.search(r"[.;,。；，]", text):
        kind = "short"
    else:
        kind = "text"
    confidence = line["confidence"]
    return place, margin, kind, "unknown" if confidence is None else "doubtful" if confidence < DOUBTFUL else "sure"


def layout(lines: list[dict], usual_top: float = 0.1, lengths: list[int] | None = None) -> dict:
    """Left margin, first and last line, leading and usual length of the lines of a page's body: of those at the margin that most lines share.

    ``usual_top`` is where the bodies of most pages begin: a chapter's title stands there and pushes the body down, a running head stands above.
    """
    xs = sorted(x["x"] or 0.0 for x in lines)
    counts = Counter(round(x / 0.02) for x in xs)
    left = min(k for k, n in counts.items() if n >= 0.5 * max(counts.values())) * 0.02
    body = [i for i, x in enumerate(lines) if abs((x["x"] or 0.0) - left) < 0.09]
    ys = sorted(lines[i]["y"] or 0.0 for i in body) or [0.1, 0.9]
    steps = sorted(b - a for a, b in zip(ys, ys[1:]) if b > a)
    near = [x for x in xs if abs(x - left) < 0.09]
    long = sorted(lengths[i] for i in body) if lengths and body else [0]
    return {
        "left": left, "margin": near[len(near) // 4] if near else left, "top": ys[0], "bottom": ys[-1], "leading": steps[len(steps) // 2] if steps else 0.03, "usual_top": usual_top,
        "usual_length": long[3 * len(long) // 4]
    }


def _clean_title(title: str | None) -> str:
    return _fold(re.sub(r"\.(?:pdf|png|jpe?g|tiff?|webp|bmp|gif)\s*$", "", (title or "").strip(), flags=re.I))


def line_dicts(column: pa.Array) -> list[list[dict] | None]:
    """A column of lists of structs as Python values, field by field, which is faster than value by value."""
    values = column.values
    fields = [(f.name, values.field(f.name).to_pylist()) for f in values.type]
    names = [n for n, _ in fields]
    rows = [dict(zip(names, v)) for v in zip(*(v for _, v in fields))]
    ends = column.offsets.to_pylist()
    return [rows[a:b] if ok else None for a, b, ok in zip(ends, ends[1:], column.is_valid().to_pylist())]


def _usual_top(scans: DataFrame) -> float:
    """Where the bodies of most pages begin."""

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([layout(v)["top"] for v in line_dicts(batch.column(0)) if v], type=pa.float64())], names=["top"])

    places = F.transform("result.lines", lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y")))
    known = scans.where("book_id IS NOT NULL AND page IS NOT NULL").select(places.alias("_lines"))
    return known.mapInArrow(tops, "top double").agg(F.percentile_approx("top", 0.5, 1000)).first()[0] or 0.1


#: Bits of a line's layout: it begins a paragraph by being indented; it ends one by being short.
INDENTED, CLOSING = 1, 2
PAGES = "book_id long, page long, ocr_mode string, codes binary, edges binary, texts array<string>"


def observed(scans: DataFrame, books: DataFrame) -> DataFrame:
    """Each page with lines once read: the code of each line's classes, how it stands to paragraphs, and its text in plain characters."""
    usual_top = _usual_top(scans)
    titles = books.where("id IS NOT NULL").groupBy("id").agg(F.min("title").alias("_title"))
    lines = F.transform("result.lines", lambda x: F.struct(*(x[c].alias(c) for c in ("text", "x", "y", "w", "confidence"))))
    pages = scans.where("book_id IS NOT NULL AND page IS NOT NULL").select(*KEY, lines.alias("_lines"))
    pages = pages.join(titles, F.col("book_id") == F.col("id"), "left").select(*KEY, "_lines", "_title")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, codes, edges, texts = [], [], [], []
            for i, (lines, title) in enumerate(zip(line_dicts(batch.column(3)), batch.column(4).to_pylist())):
                if not lines:
                    continue
                own = [plain(x["text"] or "") for x in lines]
                page, name = layout(lines, usual_top, [len(t) for t in own]), _clean_title(title)
                kept.append(i)
                codes.append(bytes(linemodel.code(observe(x, page, name, t)) for x, t in zip(lines, own)))
                indented = [INDENT < (x["x"] or 0.0) - page["margin"] < 0.09 for x in lines]
                closing = [len(t) < SHORT_LINE * page["usual_length"] and bool(_CLOSED.search(t)) for t in own]
                edges.append(bytes(a * INDENTED + b * CLOSING for a, b in zip(indented, closing)))
                texts.append(own)
            rows = pa.array(kept, type=pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).take(rows) for k in range(3)), pa.array(codes, type=pa.binary()), pa.array(edges, type=pa.binary()), pa.array(texts, type=pa.list_(pa.string()))],
                names=[x.split()[0] for x in PAGES.split(", ")]
            )

    return pages.mapInArrow(run, PAGES)


ENDS = "book_id long, page long, ocr_mode string, line_no int, part byte, tail string, mark string, next string, next_no int"
#: Parts of ENDS: a line's end within its page's running text, the last line's end, and the first line's beginning.
WITHIN, LAST, FIRST = 0, 1, 2


def line_ends(pages: DataFrame, model: LineModel) -> DataFrame:
    """Lines of running text that may end inside a word, with the first word of the next such line of the page, and each page's first word.

    tail: the last word; mark: the hyphen behind it; next, next_no: the word that follows and its line.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        body_state = STATES.index(BODY)
        for batch in batches:
            at, out = [], []
            for row, (states, texts) in enumerate(zip(model.label(batch.column(3).to_pylist()), batch.column(4).to_pylist())):
                body = [i for i, s in enumerate(states) if s == body_state and texts[i]]
                for i, n in zip(body, [*body[1:], None]):
                    start = _WORD_START.match(texts[n]) if n is not None else None
                    end = word_end(texts[i])
                    if end and _LETTERS.search(end.group(1)):
                        at.append(row)
                        out.append((i, WITHIN if n is not None else LAST, end.group(1), end.group(2), start.group(1) if start else None, n))
                if body:
                    start = _WORD_START.match(texts[body[0]])
                    at.append(row)
                    out.append((body[0], FIRST, None, None, start.group(1) if start else None, None))
            cols = list(zip(*out)) if out else [()] * 6
            kinds = [pa.int32(), pa.int8(), pa.string(), pa.string(), pa.string(), pa.int32()]
            rows = pa.array(at, type=pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(rows) for k in range(3)), *(pa.array(c, type=k) for c, k in zip(cols, kinds))], names=[x.split()[0] for x in ENDS.split(", ")])

    return pages.select(*KEY, "codes", "texts").mapInArrow(run, ENDS)


def run_on(ends: DataFrame) -> DataFrame:
    """(KEY, line_no, tail, mark, next, next_page, next_mode, next_no): ends with the word that follows: on the page, or on the book's next page in the same mode, else in another."""
    heads = ends.where(f"part = {FIRST}").select("book_id", (F.col("page") - 1).alias("page"), F.col("ocr_mode").alias("next_mode"), "next", F.col("line_no").alias("next_no"))
    last = ends.where(f"part = {LAST}").select(*KEY, "line_no", "tail", "mark")
    near = last.join(heads, ["book_id", "page"], "left")
    order = F.struct((~F.col("ocr_mode").eqNullSafe(F.col("next_mode"))).alias("other"), "next_mode", "next_no", "next")
    found = near.groupBy(*KEY, "line_no", "tail", "mark").agg(F.min(F.when(F.col("next_no").isNotNull(), order)).alias("n"))
    over = found.select(*KEY, "line_no", "tail", "mark", "n.next", F.when(F.col("n").isNotNull(), F.col("page") + 1).alias("next_page"), "n.next_mode", "n.next_no")
    on_page = ends.where(f"part = {WITHIN}").select(*KEY, "line_no", "tail", "mark", "next", F.col("page").alias("next_page"), F.col("ocr_mode").alias("next_mode"), "next_no")
    return on_page.unionByName(over)


def _word_of(token: str) -> tuple[int, str] | None:
    """Where the word of a token begins, and the word: without quotes and hyphens at its ends and without an elided article; None if it has no Latin letter."""
    if token.isascii() and token.isalpha():
        return 0, token
    if not _LETTERS.search(token) or _HAN.search(token):
        return None
    bare = token.lstrip("'’-‐‑­¬")
    at = len(token) - len(bare)
    bare = bare.rstrip("'’-‐‑­¬")
    elided = _ELIDED.match(bare)
    return (at + elided.end(), bare[elided.end() :]) if elided else (at, bare)


def token_spans(text: str) -> list[tuple[int, str]]:
    """Words with Latin letters, and where they begin."""
    return [(m.start() + w[0], w[1]) for m in _TOKEN.finditer(text) if (w := _word_of(m.group()))]


def tokens_of(text: str) -> list[str]:
    return [w[1] for t in _TOKEN.findall(text) if (w := _word_of(t))]


def han_grams(text: str, which: re.Pattern | None = None) -> list[tuple[int, str]]:
    """Every ideograph (or sign between two of them), or of ``which`` those alone, with its neighbours, or the nearest two at a line's end, marked by its place, and where it stands."""
    n = len(text)
    if n < 3:
        return []
    han = ["一" <= c <= "鿿" for c in text]
    out = []
    for i in range(n) if which is None else [m.start() for m in which.finditer(text)]:
        sign = text[i] in "-="
        if (han[i] or sign) and (0 < i < n - 1 or not sign):
            at = min(max(i - 1, 0), n - 3)
            if han[at] + han[at + 1] + han[at + 2] + sign >= 2:
                out.append((i, f"{i - at}{text[at : at + 3]}"))
    return out


def words_of(pages: DataFrame, model: LineModel, joins: DataFrame) -> DataFrame:
    """(word, n), n 0 for words seen at the edges of lines alone: whole words within lines of running text and, of broken ones, the joined; compounds also by their parts."""
    told = bytes(s in (BODY, TITLE) for s in STATES)
    body_state = STATES.index(BODY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for states, texts in zip(model.label(batch.column(0).to_pylist()), batch.column(1).to_pylist()):
                for s, text in zip(states, texts):
                    if not told[s]:
                        continue
                    own = tokens_of(text)
                    open_end = s == body_state and bool(own) and bool(word_end(text))
                    inner = own[1 : -1 if open_end else None]
                    counts.update(inner)
                    for w in inner:
                        if "-" in w:
                            counts.update(p for p in w.split("-") if p)
                    for w in own[:1] + (own[-1:] if open_end else []):
                        counts[w] += 0
                    if _HAN.search(text):
                        counts.update(g for _, g in han_grams(text))
            if len(counts) > 500_000:
                yield out(counts)
                counts = Counter()
        yield out(counts)

    def out(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), type=pa.string()), pa.array(list(counts.values()), type=pa.int64())], names=["word", "n"])

    inner = pages.select("codes", "texts").mapInArrow(run, "word string, n long")
    joined = joins.where("mark <> '' AND next IS NOT NULL").select(F.concat("tail", "next").alias("word"), F.lit(1).cast("long").alias("n"))
    return inner.unionByName(joined).groupBy("word").agg(F.sum("n").alias("n"))


_LISTED = None


def _listed() -> Confusions:
    global _LISTED
    if _LISTED is None:
        _LISTED = Confusions(confusions.listed())
    return _LISTED


def skeleton(word: str) -> str:
    """``Confusions.skeleton`` by the shapes alike for the eye."""
    return _listed().skeleton(word)


def explains(word: str, right: str) -> bool:
    """``Confusions.explains`` by the shapes alike for the eye."""
    return _listed().explains(word, right)


def no_more_than_misread(word: Column, n: Column, m: Column) -> Column:
    """Whether ``n`` occurrences of a word, beside ``m`` of another, are no more than the other's misreadings (the Chernoff bound of the binomial tail)."""
    gram = word.rlike(r"^[012].?.?[㐀-鿿]")
    most = F.when(gram, F.lit(HAN_ERRORS)).otherwise(F.least(F.lit(0.3), F.length(word) * LETTER_ERRORS))
    share = n / (n + m)
    beyond = (n + m) * (share * F.log(share / most) + (1 - share) * F.log((1 - share) / (1 - most)))
    return (share <= most) | (beyond <= DOUBT)


def misread_words(words: DataFrame, table: Confusions | None = None) -> DataFrame:
    """(word, right): words that a more frequent word of the same confusion skeleton explains, each with the most frequent one that does.

    A word with a sign inside is no word, however frequent.
    """
    table = table or _listed()

    def shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([table.skeleton(w) for w in batch.column(0).to_pylist()], type=pa.string())], names=["word", "n", "skeleton"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep_ = [table.explains(w, r) for w, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield batch.filter(pa.array(keep_, type=pa.bool_()))

    shaped = words.where(F.length("word") > 1).select("word", F.greatest("n", F.lit(1).cast("long")).alias("n")).mapInArrow(shape, "word string, n long, skeleton string")
    others = shaped.select("skeleton", F.col("word").alias("right"), F.col("n").alias("m"))
    odd = F.col("word").rlike(r"^[^0-9].*[0-9!@{|`$(]|^[0-9][a-zA-Z]")
    both = shaped.join(others, "skeleton").where("right <> word AND m > n").where(odd | no_more_than_misread(F.col("word"), F.col("n"), F.col("m")))
    return both.select("word", "right", "m").mapInArrow(check, "word string, right string, m long").groupBy("word").agg(F.max_by("right", F.struct("m", "right")).alias("right"))


def broken_words(joins: DataFrame, words: DataFrame) -> DataFrame:
    """(tail, mark, next, broken): whether the two fragments are one word.

    With a hyphen they are, unless the compound with its own hyphen is known better than the joined word.  Without one they are if the joined
    word is known and one of the fragments is hardly ever a word.
    """
    cases = joins.select("tail", "mark", "next").distinct()
    a, b = F.regexp_extract("tail", r"([^-]*)$", 1), F.regexp_extract("next", r"^([^-]*)", 1)
    cases = cases.select("tail", "mark", "next", F.lower(a).alias("_a"), F.lower(b).alias("_b")).withColumn("_ab", F.concat("_a", "_b"))
    known = words.where("n > 0").select(F.lower("word").alias("_w"), "n").groupBy("_w").agg(F.sum("n").alias("n"))
    bare = cases.where("mark = '' AND next IS NOT NULL").join(known.select(F.col("_w").alias("_ab"), F.col("n").alias("_joined")), "_ab")
    marked = cases.where("mark <> ''").withColumn("_joined", F.lit(None).cast("long"))
    pieces = F.when(F.col("mark") == "", F.array("_a", "_b")).otherwise(F.array("_ab", F.concat("_a", F.lit("-"), "_b")))
    pairs = bare.select(*marked.columns).unionByName(marked).select("tail", "mark", "next", "_joined", F.posexplode(pieces).alias("_k", "_w"))
    counted = pairs.join(known, "_w", "left").groupBy("tail", "mark", "next", "_joined").agg(*(F.max(F.when(F.col("_k") == k, F.coalesce("n", F.lit(0)))).alias(f"_n{k}") for k in (0, 1)))
    apart = (F.col("mark") == "") & (F.least("_n0", "_n1") * HARDLY <= F.col("_joined"))
    whole = (F.col("mark") != "") & (F.coalesce("_n1", F.lit(0)) <= F.coalesce("_n0", F.lit(0)))
    return counted.where(apart | whole).select("tail", "mark", "next", F.lit(True).alias("broken"))


def _case() -> Column:
    return F.concat_ws("\0", "tail", "mark", F.coalesce("next", F.lit("\1")))


class Scans:
    """The labelled pages of a corpus and what its words tell about them; each step is written out once."""

    def __init__(self, scans: DataFrame, books: DataFrame):
        self.pages = keep(observed(scans, books))
        self.model = linemodel.fit(self.pages)
        joins = run_on(keep(line_ends(self.pages, self.model))).withColumn("next", F.when(F.col("next") != "", F.col("next")))
        words = keep(words_of(self.pages, self.model, joins))
        self.table = confusions.learn(words)
        self.wrong = keep(misread_words(words, self.table))
        hit = joins.withColumn("_case", _case()).join(broken_words(joins, words).select(_case().alias("_case")), "_case", "left_semi")
        self.broken = keep(hit.drop("_case"))

    def lines(self) -> DataFrame:
        """(KEY, line_no, at, word, kind): noisy lines by their kinds, and words of running text that may be misread, where they stand (kind null unless no word is like that).

        Words are sifted by slots of which the misread ones fill at most SLOTS; what is left is to be joined with them.
        """

        def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(sorted({slot(w) for w in batch.column(0).to_pylist()}), type=pa.int32())], names=["slot"])

        filled = bytearray(SLOTS)
        for r in self.wrong.select("word").mapInArrow(slots, "slot int").distinct().collect():  # at most SLOTS
            filled[r.slot] = 1
        taken, table, model = bytes(filled), self.table, self.model
        furniture = {STATES.index(HEAD): "running_head", STATES.index(NUMBER): "page_number"}
        running = bytes(s in (BODY, TITLE, TABLE) for s in STATES)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict[str, tuple[bool, bool]] = {}
            for batch in batches:
                rows, out = [], []
                if len(known) > 300_000:
                    known.clear()
                for row, (states, texts, begun, cut_short) in enumerate(zip(model.label(batch.column(3).to_pylist()), *(batch.column(k).to_pylist() for k in (4, 5, 6)))):
                    begun, cut_short, found = set(begun or ()), set(cut_short or ()), []
                    for i, (s, text) in enumerate(zip(states, texts)):
                        if i in cut_short:
                            found.append((i, None, None, "hyphen"))
                        if s in furniture:
                            found.append((i, None, None, furniture[s]))
                        if not running[s]:
                            continue
                        if _SPLIT_ACCENT.search(text):
                            found.append((i, None, None, "misread"))
                        own = tokens_of(text)[1 if i in begun else 0 : -1 if i in cut_short else None]
                        doubt = False
                        for w in own:
                            says = known.get(w)
                            if says is None:
                                says = known[w] = (bool(taken[slot(w)]), bool(_MISREAD_IN_WORD.search(w) or _SIGN_IN_WORD.search(w)))
                            doubt = doubt or says[0] or says[1]
                        spans = token_spans(text)[1 if i in begun else 0 : -1 if i in cut_short else None] if doubt else []
                        if _HAN.search(text):
                            spans += [(at, w) for at, w in han_grams(text, table.doubtful) if taken[slot(w)]]
                        for at, w in spans:
                            says = known.get(w) or (True, False)
                            if says[0] or says[1]:
                                found.append((i, at, w, "misread" if says[1] else None))
                    rows += [row] * len(found)
                    out += found
                cols = list(zip(*out)) if out else [()] * 4
                ids = pa.array(rows, type=pa.int32())
                kinds = [pa.int64(), pa.int32(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(ids) for k in range(3)), *(pa.array(c, type=k) for c, k in zip(cols, kinds))], names=[*KEY, "line_no", "at", "word", "kind"])

        begun = self.broken.where("next_no IS NOT NULL").select("book_id", F.col("next_page").alias("page"), F.col("next_mode").alias("ocr_mode"), F.col("next_no").alias("begun"), F.lit(None).cast("int").alias("ended"))
        ended = self.broken.select(*KEY, F.lit(None).cast("int").alias("begun"), F.col("line_no").alias("ended"))
        marks = begun.unionByName(ended).groupBy(*KEY).agg(F.collect_set("begun").alias("begun"), F.collect_set("ended").alias("ended"))
        mode = F.coalesce("ocr_mode", F.lit("\0"))
        marks = marks.select(F.col("book_id").alias("_b"), F.col("page").alias("_p"), mode.alias("_m"), "begun", "ended")
        both = self.pages.join(marks, (F.col("book_id") == F.col("_b")) & (F.col("page") == F.col("_p")) & (mode == F.col("_m")), "left")
        return both.select(*KEY, "codes", "texts", "begun", "ended").mapInArrow(run, "book_id long, page long, ocr_mode string, line_no long, at int, word string, kind string")

    def noise(self) -> DataFrame:
        """(KEY, line_no, kind): see ``noisy_lines``."""
        key = [*KEY, "line_no"]
        wrong = self.wrong.select("word", F.lit(True).alias("hit"))
        own = self.lines().join(wrong, "word", "left").where("kind IS NOT NULL OR hit").select(*key, F.coalesce("kind", F.lit("misread")).alias("kind"))

        odd_end = F.col("tail").rlike(r"[A-Za-zÀ-ÿ][0-9!@{|`$(]")
        joined = self.broken.withColumn("word", F.concat("tail", "next")).join(self.wrong, "word", "left")
        left = F.when(odd_end | (F.col("right").isNotNull() & ~F.expr("startswith(right, tail)")), F.struct(*key))
        right = F.when(
            F.col("next_no").isNotNull() & ~F.expr("endswith(right, next)"),
            F.struct("book_id", F.col("next_page").alias("page"), F.col("next_mode").alias("ocr_mode"), F.col("next_no").cast("long").alias("line_no"))
        )
        broken = joined.withColumn("line_no", F.col("line_no").cast("long")).select(F.explode(F.array_compact(F.array(left, right))).alias("v")).select(*(F.col(f"v.{c}") for c in key), F.lit("misread").alias("kind"))
        return own.unionByName(broken)

    def paragraphs(self) -> DataFrame:
        """(book_id, page, line_no, text): see ``paragraphs``."""
        model, key = self.model, [*KEY, "line_no"]
        chosen = self.pages.groupBy("book_id", "page").agg(F.max_by(F.struct("ocr_mode", "codes", "edges", "texts"), F.struct("ocr_mode", F.xxhash64("texts"))).alias("p"))  # high_precision before fast

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept, body_state = {STATES.index(s): s for s in (BODY, TITLE, TABLE)}, STATES.index(BODY)
            for batch in batches:
                rows, out = [], []
                for row, (states, edges, texts) in enumerate(zip(model.label(batch.column(3).to_pylist()), batch.column(4).to_pylist(), batch.column(5).to_pylist())):
                    closed = False
                    for i, (s, edge, text) in enumerate(zip(states, edges, texts)):
                        if s in kept and text:
                            rows.append(row)
                            out.append((i, kept[s], text, bool(edge & INDENTED) or closed))
                            if s == body_state:
                                closed = bool(edge & CLOSING)
                cols = list(zip(*out)) if out else [()] * 4
                ids, kinds = pa.array(rows, type=pa.int32()), [pa.int64(), pa.string(), pa.string(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(ids) for k in range(3)), *(pa.array(c, type=k) for c, k in zip(cols, kinds))], names=[*key, "state", "text", "begins"])

        lines = chosen.select("book_id", "page", "p.ocr_mode", "p.codes", "p.edges", "p.texts").mapInArrow(run, "book_id long, page long, ocr_mode string, line_no long, state string, text string, begins boolean")
        fixes = self.lines().where("word IS NOT NULL").join(self.wrong, "word").groupBy(*key).agg(F.array_sort(F.collect_set(F.struct("at", "word", "right"))).alias("fixes"))
        over = self.broken.withColumn("word", F.concat("tail", "next")).join(self.wrong, "word", "left").groupBy(*KEY, F.col("line_no").cast("long").alias("line_no"))
        over = over.agg(F.lit(True).alias("broken"), F.max(F.when(F.col("right").isNotNull(), F.struct("tail", "next", "right"))).alias("over"))
        for more in (fixes, over):
            mode = F.coalesce("ocr_mode", F.lit("\0"))
            more = more.withColumnsRenamed({c: f"_{c}" for c in key})
            on = (F.col("book_id") == F.col("_book_id")) & (F.col("page") == F.col("_page")) & (mode == F.coalesce("_ocr_mode", F.lit("\0"))) & (F.col("line_no") == F.col("_line_no"))
            lines = lines.join(more, on, "left").drop(*(f"_{c}" for c in key))
        flow = lines.where(f"state = '{BODY}'").drop("ocr_mode")
        begin = F.when(F.col("begins"), F.struct("page", "line_no"))
        laid = fill_forward(flow.withColumn("begin", begin), "book_id", ["book_id", "page", "line_no"], "begin", "start")
        apart = lines.where(f"state <> '{BODY}'").drop("ocr_mode").withColumn("start", F.struct("page", "line_no")).withColumn("begin", F.col("start"))
        first = F.struct(F.lit(-1).cast("long").alias("page"), F.lit(0).cast("long").alias("line_no"))
        both = laid.unionByName(apart).withColumn("start", F.coalesce("start", first))
        parts = F.sort_array(F.collect_list(F.struct("page", "line_no", "text", F.coalesce("broken", F.lit(False)).alias("broken"), "fixes", "over")))
        grouped = both.groupBy("book_id", "state", "start").agg(parts.alias("parts"))

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                parts = batch.column(1).to_pylist()
                first = [p[0] for p in parts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([p["page"] for p in first], type=pa.int64()), pa.array([p["line_no"] for p in first], type=pa.int64()), pa.array([assemble(p) for p in parts], type=pa.string())],
                    names=["book_id", "page", "line_no", "text"]
                )

        return grouped.select("book_id", "parts").mapInArrow(join, "book_id long, page long, line_no long, text string")


def put_right(text: str, fixes: list[dict] | None) -> str:
    """The text with each misread word replaced where it stands; of words that overlap the first counts."""
    out, done = [], 0
    for fix in fixes or []:
        at, word, right = fix["at"], fix["word"], fix["right"]
        if is_gram(word):
            place = int(word[0]) + 1
            word, right = word[place], right[place]
        if at >= done and text.startswith(word, at):
            out += text[done:at], right
            done = at + len(word)
    return "".join(out) + text[done:]


def assemble(parts: list[dict]) -> str:
    """The lines of a paragraph as continuous text: broken words joined, misread ones put right where they stand, those that are both as one."""
    out, skip = [], 0
    for i, p in enumerate(parts):
        text, over, begins = p["text"], p["over"], skip
        end, skip = len(text.rstrip()), 0
        if p["broken"]:
            end = len(text[:end].rstrip(HYPHENS))
        following = parts[i + 1]["text"] if i + 1 < len(parts) else ""
        lead = len(following) - len(following.lstrip())
        whole = ""
        if p["broken"] and over and text[:end].endswith(over["tail"]) and following.startswith(over["next"], lead):
            end, whole, skip = end - len(over["tail"]), over["right"], lead + len(over["next"])
        fixes = [{**f, "at": f["at"] - begins} for f in p["fixes"] or [] if f["at"] >= begins]
        line = put_right(text[begins:end], fixes).lstrip() + whole if begins == 0 else put_right(text[begins:end], fixes) + whole
        out.append(line)
        if not p["broken"] and line:
            out.append("" if _HAN.search(line[-1]) or line[-1] in "，。；：、！？" else " ")
    return "".join(out).strip()


def paragraphs(scans: DataFrame, books: DataFrame) -> DataFrame:
    """(book_id, page, line_no, text): each book as continuous paragraphs, in the order of the page and line where they begin.

    Of a page scanned in several modes one is taken, high_precision before fast.  Furniture is left out, words broken across lines and pages are
    joined, misread words are put right, and lines follow each other with a blank (between ideographs without).  A paragraph begins at
    an indented line, or below a short one that ends a sentence, and goes on across pages; chapter titles and lines of tables stand apart.  A
    paragraph is one value, which one task puts together.  Input as in ``noisy_lines``; repeated pages count once.
    """
    return Scans(scans, books).paragraphs()


def noisy_lines(scans: DataFrame, books: DataFrame) -> DataFrame:
    """(book_id, page, ocr_mode, line_no, kind): one row for each noisy line and kind: running_head, page_number, hyphen or misread.

    ``scans`` has (book_id, page, ocr_mode, result.lines), ``books`` (id, title); other columns are not read.  Pages without lines,
    lines without text and rows without book or page have no noise; a book without title is read by its layout alone.  Repeated rows come out
    once.  An empty table gives an empty table.
    """
    return Scans(scans, books).noise().distinct()
