"""What a scanner takes for what, learned from the words of a corpus.

A word that differs from a much more frequent one in one or two characters at one place is evidence for a confusion of what stands there.  Chance
alone gives such evidence for a few words; a confusion gives it for a good share of all frequent words that have the printed characters.  Shapes that
are alike for the eye (CONFUSIONS, LOOK_ALIKE_HAN) count as prior evidence, which a corpus that has seen enough can overrule.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .lookalike import UnionFind

# Shapes alike for the eye, the character as it is printed before the characters as they are read.
CONFUSIONS = [("m", "rn"), ("d", "cl"), ("w", "vv"), ("k", "lc"), ("u", "ii"), ("ü", "ii"), ("n", "ri"), ("ñ", "fi"), ("è", "e`"), ("é", "e´"), ("h", "b"),
              ("e", "c"), ("t", "f"), ("y", "v"), ("i", "!"), ("a", "@"), ("o", "0"), ("O", "0"), ("l", "1"), ("I", "l"), ("I", "1"), ("g", "9"), ("q", "9"),
              ("f", "{"), ("é", "6"), ("ó", "6"), ("B", "8"), ("ß", "B"), ("S", "5"), ("s", "5"), ("Z", "2"), ("z", "2"), ("c", "("), ("l", "|"), ("i", "|"),
              ("A", "4"), ("s", "$"), ("i", "í"), ("l", "!"), ("o", "°"), ("rn", "m"), ("cl", "d")]
# Ideographs alike for the eye, in groups.
LOOK_ALIKE_HAN = ["没役", "述迷", "闭闲闹", "了丁", "一-", "间问闻", "本木", "水氺", "小尒", "的旳", "图囹", "日曰", "册删", "版板", "未末", "己已巳", "土士", "人入",
                  "天夫无", "千干于", "大太犬", "王玉", "目自", "石右", "田由甲申", "刀力刁", "又叉", "儿几", "贝见", "午牛", "体休", "买卖", "没设", "候侯", "治冶",
                  "名各", "时吋", "门们", "在左", "有冇", "中巾", "书韦", "个介", "为力", "从丛", "会云", "住往", "今令", "并井", "开升", "心必", "把扒", "找我", "拔拨",
                  "析折", "晴睛", "暖暧", "查杳", "楼搂", "清情", "狼狠", "画田", "官宫", "密蜜", "崇祟", "巨臣", "币巾", "延廷", "思恩", "戊戌戍", "斤斥", "春舂",
                  "毫豪", "洒酒", "浅线", "海悔", "渡度", "灯打", "竟竞", "简筒", "粟栗", "萧肃", "辨辩", "遗遣", "部陪", "铜钢", "陈阵", "难推", "风凤", "鸟乌",
                  "里黑", "口囗", "曲由", "历厉", "厂广", "记纪", "识织", "读续", "果杲", "东乐", "年牟", "上土", "下卞", "生主", "用甩", "多夕", "先失", "城域",
                  "场扬", "处外", "夜液", "写与", "沿沼", "流硫"]
#: Words of fewer letters tell nothing about confusions, as many true ones differ in one letter.
TELLING = 5
#: A word is evidence if another is this many times as frequent; only words seen as often can have such evidence.
MUCH = 20
#: Weight of prior evidence, in words, and the least share of frequent words with evidence; for ideographs, where two neighbours leave much open, more without a prior.
PRIOR, SHARE, HAN_SHARE = 10, 0.15, 0.4

HAN = re.compile(r"[㐀-鿿]")
_LATIN = re.compile(r"^[^\W\d_]")


def is_gram(word: str) -> bool:
    """An ideograph with its neighbours, in three characters behind the place (0, 1 or 2) of the one in question."""
    return len(word) == 4 and word[0] in "012" and bool(HAN.search(word))


class Confusions:
    """A table of (printed, read), the surest first."""

    def __init__(self, pairs: Iterable[tuple[str, str]]):
        pairs = list(pairs)
        latin = [p for p in pairs if not HAN.search(p[0] + p[1])]
        self.directed = sorted(latin, key=lambda p: -len(p[1]))
        classes, spread = UnionFind(), {}
        for a, b in ((a.lower(), b.lower()) for a, b in latin):
            if len(a) == len(b) == 1:
                classes.union(a, b)
            elif len(a) < len(b):
                spread.setdefault(a, b)
            elif len(b) == 1:
                spread.setdefault(b, a)
        for c in map(chr, range(0xE0, 0x180)):
            if (base := unicodedata.normalize("NFD", c)[0]) != c:
                classes.union(c, base)

        def expand(c: str, above: str = "") -> str:
            return "".join(expand(x, above + c) for x in spread[c]) if c in spread and c not in above else classes.find(c)

        letters = {*spread, *(x for s in spread.values() for x in s), *classes.parent}
        self.forms = {ord(c): expand(c) for c in letters if len(c) == 1}
        han = UnionFind()
        self.ideographs = {p for p in pairs if HAN.search(p[0] + p[1])}
        for a, b in self.ideographs:
            han.union(a, b)
        self.han = {c: han.find(c) for c in list(han.parent)}
        self.doubtful = re.compile("[" + "".join(map(re.escape, self.han)) + "]") if self.han else re.compile("(?!)")

    def skeleton(self, word: str) -> str:
        """Equal for words that a scanner may take for each other."""
        if is_gram(word):
            at = int(word[0]) + 1
            return word[:at] + self.han.get(word[at], word[at]) + word[at + 1 :]
        return word.lower().translate(self.forms)

    def explains(self, word: str, right: str) -> bool:
        """Whether the word differs from the right one by confusions only, the right one being printed and the word read."""
        if word == right:
            return False
        if HAN.search(word):
            at = int(word[0]) + 1
            return is_gram(right) and (right[at], word[at]) in self.ideographs and right[:at] + word[at] + right[at + 1 :] == word
        i = j = 0
        while i < len(word) and j < len(right):
            if word[i] == right[j]:
                i, j = i + 1, j + 1
                continue
            for printed, read in self.directed:
                if right.startswith(printed, j) and word.startswith(read, i):
                    i, j = i + len(read), j + len(printed)
                    break
            else:
                return False
        return i == len(word) and j == len(right)


def listed() -> list[tuple[str, str]]:
    """The prior evidence as a table."""
    return CONFUSIONS + [(a, b) for g in LOOK_ALIKE_HAN for a in g for b in g if a != b]


def _gaps(word: str) -> Iterator[tuple[str, str]]:
    """(the word with a gap of one or two characters, what stands there)."""
    if is_gram(word):
        if word[0] == "1":
            yield f"{word[1]}\0{word[3]}", word[2]
    elif len(word) >= TELLING and _LATIN.match(word):
        for n in (1, 2):
            for i in range(len(word) - n + 1):
                if len(word) - n >= TELLING - 1:
                    yield f"{word[:i]}\0{word[i + n :]}", word[i : i + n]


def _single_place(a: str, b: str) -> bool:
    return len(a) + len(b) < 4 and (len(a) == len(b) or a[0] != b[0] and a[-1] != b[-1])


def evidence(words: DataFrame) -> DataFrame:
    """(printed, read, seen, chances): frequent words with ``printed`` that also occur, rarely, with ``read`` in its place, and all frequent words with it.

    ``words`` has (word, n).  Words with the same gap differ in two characters at most, so their number is bounded by the alphabet.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                rows = [(gap, mid, n) for w, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) if n for gap, mid in _gaps(w)]
                cols = list(zip(*rows)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], type=pa.string()), pa.array(cols[1], type=pa.string()), pa.array(cols[2], type=pa.int64())], names=["gap", "mid", "n"])

    gaps = words.select("word", "n").mapInArrow(split, "gap string, mid string, n long")
    gap = W.partitionBy("gap")
    ranked = gaps.withColumn("top", F.max(F.struct("n", "mid")).over(gap)).where(f"top.n >= {MUCH}")
    ranked = ranked.withColumn("common", F.count_if(MUCH * F.col("n") > F.col("top.n")).over(gap)).where("common = 1")  # else it is open which of several was misread
    found = ranked.where(f"mid <> top.mid AND top.n >= {MUCH} * n").select(F.col("top.mid").alias("printed"), F.col("mid").alias("read"), F.replace("gap", F.lit("\0"), F.col("top.mid")).alias("right"))
    seen = found.distinct().groupBy("printed", "read").agg(F.count("*").alias("seen"))
    have = ranked.where("mid = top.mid").select(F.col("mid").alias("printed"), F.replace("gap", F.lit("\0"), F.col("mid")).alias("right")).distinct()
    return seen.join(have.groupBy("printed").agg(F.count("*").alias("chances")), "printed")


def learn(words: DataFrame, prior: list[tuple[str, str]] | None = None, weight: float = PRIOR, share: float = SHARE) -> Confusions:
    """The confusions of a corpus from its ``words`` (word, n), with prior evidence worth ``weight`` words for each pair in ``prior``.

    Only pairs whose share of evidence is at least ``share`` reach the driver, for each printed character a few, whatever the corpus.
    """
    prior = listed() if prior is None else prior
    found = {}
    counted = evidence(words)
    spark = words.sparkSession
    expected = spark.createDataFrame(sorted(set(prior)), "printed string, read string").withColumn("_p", F.lit(1))
    both = counted.join(expected, ["printed", "read"], "full")
    chances = counted.groupBy("printed").agg(F.max("chances").alias("_chances"))
    rate = (F.coalesce("seen", F.lit(0)) + weight * F.coalesce("_p", F.lit(0))) / (F.coalesce("_chances", F.lit(0)) + weight)
    least = F.when(F.col("_p").isNull() & F.col("printed").rlike("[㐀-鿿]"), HAN_SHARE).otherwise(share)
    rows = both.join(chances, "printed", "left").withColumn("rate", rate).where(F.col("rate") >= least).select("printed", "read", "rate")
    for r in rows.collect():
        if _single_place(r.printed, r.read):
            found[r.printed, r.read] = r.rate
    return Confusions(sorted(found, key=lambda p: (-found[p], p)))
