"""Personal information in free text, found behind its disguises and replaced by placeholders.

A text passes two transducers that remember where each character came from.  The first folds widths, digits and look-alike letters of other
alphabets and leaves out invisible characters; the second writes spelled digits as digits and spelled or bracketed "at" and "dot" as signs.  Identifiers
are then detected in the plain result, and their spans are mapped back to the characters of the source.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .lookalike import LOOK_ALIKE_LETTERS

KINDS = ("email", "phone", "identity", "address", "name")

# Spelled digits, from 0 to 9.
DIGIT_WORDS = [
    "zero oh null zéro cero 零 〇", "one eins un une uno 一 壹", "two zwei zwo deux dos 二 贰", "three drei trois tres 三 叁", "four vier quatre cuatro 四 肆", "five fünf cinq cinco 五 伍", "six sechs seis 六 陆",
    "seven sieben sept siete 七 柒", "eight acht huit ocho 八 捌", "nine neun neuf nueve 九 玖"
]
# Words for the signs of an e-mail address.
AT_WORDS, DOT_WORDS = ["at", "ät", "arobase", "arroba", "chez", "艾特"], ["dot", "punkt", "point", "punto", "点"]
# What stands directly before a name: titles, and labels or phrases.
TITLES = ["Mr", "Mrs", "Ms", "Miss", "Mx", "Dr", "Prof", "Sir", "Herr", "Herrn", "Frau", "Mme", "Mlle", "Monsieur", "Madame", "señora?", "Sra?", "don", "doña"]
LABELS = ["dear", "hello", "hi", "contact", "name", "signed(?: by)?", "sender", "from", "to", "attn", "author", "borrower", "returned by", "lent to", "issued to", "sent by", "written by", "my neighbour", "my friend", "my colleague",
          "liebe", "lieber", "kontakt", "gezeichnet", "absender", "empfänger", "unterschrift", "wurde an", "mein nachbar", "meine nachbarin", "von herrn", "cher", "chère", "expéditeur", "destinataire", "signé", "prêté à", "nom", "mon voisin", "ma voisine",
          "querid[oa]", "estimad[oa]", "contacto", "firmado", "remite", "remitente", "destinatario", "prestado a", "nombre", "mi vecin[oa]"]
# Phrases with which people give their own names, greetings after which they sign, and what they are called by; of the last two, names begin with capitals.
PHRASES = ["my name is", "i am called", "ich heiße", "ich heisse", "mein name ist", "je m['’]appelle", "mon nom est", "me llamo", "mi nombre es", "我叫", "我的名字是"]
GREETINGS = [
    "(?:kind |best |warm )?regards", "best wishes", "yours (?:sincerely|faithfully|truly)", "sincerely", "mit freundlichen grüßen", "viele grüße", "hochachtungsvoll", "cordialement", "bien à vous",
    "(?:un )?saludos?(?: cordial(?:es)?)?", "atentamente"
]
CALLED = ["authors?", "writer", "poet", "historian", "autor(?:in|a)?", "dichter(?:in)?", "schriftsteller(?:in)?", "auteure?", "écrivaine?", "poète", "escritora?", "poeta"]
#: Of these labels only with a colon or a mark behind them: alone they are ordinary words.
ONLY_WITH_COLON = {
    "name", "sender", "from", "to", "attn", "author", "borrower", "nom", "nombre", "hello", "hi", "signed(?: by)?", "unterschrift", "contact", "contacto", "empfänger", "destinataire", "destinatario",
    "remitente"
}
# Words that begin an ordinary phrase and no name.
NO_NAME = "the a an this that these those his her its our your my me you him them it us all some any each every which who what der die das den dem des ein eine einen einem einer sein ihr dieser diese dieses le la les un une des du de ce cette ces son sa ses el los las una unos este esta esto su sus lo al del".split()
CHINESE_LABELS = ["联系人", "寄件人", "收件人", "借书人", "借给了?", "(?:签名|署名|姓名|作者|负责人)(?=[:：])"]
CHINESE_TITLES = ["女士", "先生", "小姐", "教授", "博士", "老师", "同学"]
# Chinese surnames of two characters.
DOUBLE_SURNAMES = "欧阳 太史 端木 上官 司马 东方 独孤 南宫 万俟 闻人 夏侯 诸葛 尉迟 公羊 赫连 澹台 皇甫 宗政 濮阳 公冶 太叔 申屠 公孙 慕容 仲孙 钟离 长孙 宇文 司徒 鲜于 司空 闾丘 子车 亓官 司寇 巫马 公西 颛孙 壤驷 公良 漆雕 乐正 宰父 谷梁 拓跋 夹谷 轩辕 令狐 段干 百里 呼延 东郭 南门 羊舌 微生 左丘 西门 第五".split()

# The longest local part, label and domain of an e-mail address (RFC 5321, RFC 1035); words of names and places have up to 60 letters after the first.

#: Latin letters, digits and _: what \w is without other scripts, in which words are not set apart.
_A = r"A-Za-zÀ-ÖØ-öø-ÿœŒ0-9_"
_D = rf"(?<![{_A}.+/-])"
_GAP = r"[ \n]"
#: Words for streets that stand behind a street's name, before it, or at its end.
STREET_AFTER = r"(?:Street|St\.?|Lane|Ln\.?|Road|Rd\.?|Row|Avenue|Ave\.?|Drive|Dr\.?|Way|Close|Court|Ct\.?|Place|Pl\.?|Square|Sq\.?|Terrace|Crescent|Boulevard|Blvd\.?|Gardens|Hill|Park|Walk|Quay|Mews)"
STREET_BEFORE_FR = r"(?:rue|avenue|av\.|quai|impasse|boulevard|bd|place|chemin|allée|route|cours|passage|square|ruelle|sentier)"
STREET_BEFORE_ES = r"(?:Calle|C/|Avenida|Avda\.?|Av\.|Plaza|Pza\.?|Paseo|Pº|Camino|Carretera|Ctra\.?|Ronda|Travesía|Callejón)"
STREET_END_DE = r"(?:straße|strasse|str\.|gasse|weg|platz|allee|ufer|damm|ring|steig|markt|hof|chaussee|pfad|stieg)"
_TOWN = r"\p{Lu}[\p{Latin}'’-]{1,60}(?:" + _GAP + r"\p{Lu}[\p{Latin}'’-]{1,60}){0,2}"
_TOWN_LAST = r"\p{Lu}[\p{Latin}'’-]{1,60}(?:" + _GAP + r"(?:am|an der|an|bei|im|sur|sous|les|de|del|la|el|lès)" + _GAP + r"\p{Lu}[\p{Latin}'’-]{1,60})?"
_PLACE = r"\p{L}[\p{L}'’.-]{0,60}(?:" + _GAP + r"\p{L}[\p{L}'’.-]{0,60}){0,4}?"
_SEP = r",?[ \n]{1,2}"
_CODE = r"(?:[A-Z]{1,2}\d{1,2}[A-Z]?" + _GAP + r"\d[A-Z]{2}|[A-Z]{2}" + _GAP + r"\d{5}(?:-\d{4})?)(?![A-Za-z0-9])"

ADDRESS = [
    rf"(?<![{_A}/])(?:(?:Flat|Apt\.?|Apartment|Unit|Suite|Room){_GAP}\w{{1,5}}{_SEP})?\d{{1,5}}[A-Za-z]?{_GAP}(?:\p{{L}}[\p{{L}}'’-]{{0,60}}{_GAP}){{1,4}}?{STREET_AFTER}{_SEP}{_TOWN}{_SEP}{_CODE}",
    rf"(?<![{_A}])(?:P\.?{_GAP}?O\.?{_GAP}?Box|Postfach|B\.?P\.?|Apartado){_GAP}\d{{1,6}}{_SEP}(?:{_TOWN}{_SEP}{_CODE}|\d{{5}}{_GAP}{_TOWN_LAST})",
    rf"(?<![{_A}])\p{{Lu}}[\p{{L}}-]{{0,60}}(?:{_GAP}\p{{Lu}}[\p{{L}}-]{{0,60}})?(?i:{STREET_END_DE}|{_GAP}{STREET_END_DE}){_GAP}\d{{1,4}}{_GAP}?[a-z]?,?[ \n]{{1,2}}(?:D-)?\d{{5}}{_GAP}{_TOWN_LAST}",
    rf"(?<![{_A}/])\d{{1,4}}(?:{_GAP}(?:bis|ter|quater))?,?{_GAP}(?i:{STREET_BEFORE_FR}){_GAP}{_PLACE}{_SEP}(?:F-)?\d{{5}}{_GAP}{_TOWN_LAST}",
    rf"(?<![{_A}])(?i:{STREET_BEFORE_ES}){_GAP}?{_PLACE},?{_GAP}(?:n\.?[ºo°]{_GAP}?)?\d{{1,4}}(?:,{_GAP}(?:\d{{1,2}}\.?[ºªo°]?{_GAP}?\p{{L}}{{0,4}}|bajo|[aá]tico|entlo\.?|izda\.?|dcha\.?)){{0,2}}{_SEP}\d{{5}}{_GAP}{_TOWN_LAST}",
    r"(?:(?![寄到至在往于从住请的])\p{Han}){2,4}?(?:省(?:(?![寄到至在往于从住请的])\p{Han}){2,4}?)?[市县州](?:\p{Han}{1,4}[区县镇乡])?\p{Han}{1,6}(?:路|街|大道|巷|弄|道|胡同)\d{1,5}号(?:院)?(?:\d{1,4}(?:号楼|栋|幢|座))?(?:\d{1,4}单元)?(?:\d{1,5}[室房]|\d{1,3}楼)?",
]
IDENTITY = [
    _D + r"[A-Z]{2}[ \n]?\d{2}[ \n]?\d{2}[ \n]?\d{2}[ \n]?[A-D](?![A-Za-z0-9])",
    _D + r"(?:000|666|9\d\d|\d{3})([- \n])\d{2}\1\d{4}(?![\d-]|[./]\d)",
    _D + r"[12][ \n]?\d{2}[ \n]?\d{2}[ \n]?\d{2}[ \n]?\d{3}[ \n]?\d{3}[ \n]?\d{2}(?![\d-])",
    _D + r"\d{6}[ \n]?(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])[ \n]?\d{3}[\dXx](?![\dA-Za-z])",
    _D + r"(?:\d{2}\.\d{3}\.\d{3}|\d{8})[- ]?[A-HJ-NP-TV-Z](?![A-Za-z0-9])",
    _D + r"[XYZ][- ]?\d{7}[- ]?[A-Z](?![A-Za-z0-9])",
    _D + r"[CFGHJKLMNPRTVWXYZ]0{3}[CFGHJKLMNPRTVWXYZ0-9]{4,6}(?![A-Za-z0-9])",
]
_EXT = r"(?:,?[ \n]{0,2}(?i:ext\.?|extension|x|poste|durchwahl|dw\.?|int\.?|anexo|转|分机)[ \n]?\d{1,6})?"
_P = rf"(?<![{_A}+./-])"
PHONE = [
    _P + r"(?:\+|00)[1-9]\d{0,2}(?:[ \n.-]?\(0\))?(?:[ \n./-]?\(?\d{1,8}\)?){1,6}",
    _P + r"\(0\d{1,5}\)[ \n/-]?\d{2,8}(?:[ \n-]\d{2,6}){0,2}",
    _P + r"(?:1[ \n.-]?)?(?:\([2-9]\d{2}\)[ \n]?|[2-9]\d{2}[ \n.-])[2-9]\d{2}[ \n.-]\d{4}",
    _P + r"1[2-9]\d{2}[2-9]\d{6}",
    _P + r"1[3-9]\d{9}",
    _P + r"0\d(?:[ \n.-]?\d{2}){4}",
    _P + r"0\d{1,4}[ \n/-]\d{3,8}(?:[ \n-]\d{1,6}){0,2}",
    _P + r"[5-9]\d{2}(?:[ \n]\d{2}){3}",
    _P + r"[5-9]\d{2}(?:[ \n]\d{3}){2}",
]
# Words before a number that is no phone number, unless it has a country prefix.
NO_PHONE = [
    "order", "ref", "reference", "isbn", "issn", "invoice", "shelfmark", "bestellung", "bestellnummer", "auftrag", "rechnung", "signatur", "commande", "facture", "cote", "pedido", "factura",
    "signatura", "订单", "订单号", "编号"
]
_NO_PHONE = re.compile(rf"(?<![^\W_])(?:{'|'.join(NO_PHONE)})[ \n]?(?:no\.?|nr\.?|n[.º°o]{{1,2}}|#)?[ \n.:：#]*$", re.I)
#: Characters before a number in which such a word is looked for.
_NEAR = 30
_PHONE_END = r"(?![\d]|[.,/-]\d|/\p{L}|-\p{L})"

_EMAIL = regex.compile(rf"(?<![{_A}.+%@-])" + r"[A-Za-z0-9_](?:[A-Za-z0-9._%+-]{0,63})[ \n]?@[ \n]?[A-Za-z0-9][A-Za-z0-9-]{0,62}(?:\.[A-Za-z0-9][A-Za-z0-9-]{0,62}){0,125}\.(?!(?i:png|jpe?g|gif|svg|webp|pdf|txt|csv|bmp|tiff?)(?![A-Za-z]))[A-Za-z]{2,}(?![A-Za-z0-9])")
#: What a text must have for a pattern to match, which is seen faster than the pattern.
_FIVE, _CODED, _SIX, _THREE_FOUR = (re.compile(p) for p in (r"\d{5}", r"\d[A-Z]{2}|\d{5}", r"\d(?:\D{0,3}\d){5}", r"\d{3}\)?[ \n.-]?\d{3}[ \n.-]\d{4}"))
_NEEDS = {ADDRESS[0]: _CODED, ADDRESS[1]: _CODED, ADDRESS[2]: _FIVE, ADDRESS[3]: _FIVE, ADDRESS[4]: _FIVE, ADDRESS[5]: re.compile("[路街道巷弄同]\\d"), PHONE[2]: _THREE_FOUR, IDENTITY[6]: re.compile("000")}
_FOUND = [
    (kind, regex.compile(p), _NEEDS.get(p, _SIX)) for kind, ps in (("address", ADDRESS), ("identity", IDENTITY)) for p in ps
] + [("phone", regex.compile(p + _PHONE_END + _EXT), _NEEDS.get(p, _SIX)) for p in PHONE]

_W = r"\p{Latin}[\p{Latin}'’]{1,60}"
_LAST = rf"{_W}(?:-{_W})?"
_INITIAL = r"\p{Lu}\."
_S = r"[ \n]{1,2}"
LATIN_NAME = rf"(?<![\p{{Latin}}'’-])(?:{_INITIAL}(?:{_S}?{_INITIAL})*{_S}{_LAST}|{_LAST},{_S}(?:{_INITIAL}(?:{_S}{_INITIAL})*|{_W}(?:{_S}{_INITIAL})*)|{_W}(?:{_S}{_INITIAL})*{_S}{_LAST})(?![\p{{Latin}}'’-])"
#: What stands before a name, in lower case, up to the name's first letter.
_BEFORE = "|".join(
    [
        rf"(?:{'|'.join(TITLES)})\.?[ \n]{{1,2}}".lower(), r"m\.[ \n]{1,2}", rf"(?:{'|'.join(PHRASES)})[ \n]?", rf"(?:{'|'.join(LABELS)})[ \n]?[:：][ \n]?",
        rf"(?:{'|'.join(x for x in LABELS if x not in ONLY_WITH_COLON)})[ \n]{{1,2}}", r"(?:kontakt|contacto?)[ \n]", r"(?:signed|gezeichnet|signé|firmado)[ \n][“\"«„][ \n]?",
        r"(?:form|formular|formulaire|formulario)[ \n]\d+[ \n]?\|[ \n]?"
    ]
)
_BEFORE_CAPITALS = re.compile(rf"(?<![^\W\d_])(?=((?:{'|'.join(GREETINGS)})[,!]?[ ]?\n+|(?:{'|'.join(CALLED)})[ \n]))")
_BEFORE_NAME = re.compile(rf"(?<![^\W\d_])(?<![-‐‑­¬]\n)(?=({_BEFORE}))")
_NAME = regex.compile(LATIN_NAME)
#: One of these is in all greetings and words by which people are called.
_CALLED_HINT = re.compile("regards|wishes|yours|sincerely|grüße|hochachtung|cordialement|bien à|saludo|atentamente|aut[hoe]|writer|poet|poète|histor|dichter|schriftst|écriv|escrit")
_C_AFTER = rf"(?:{'|'.join(CHINESE_LABELS)})[:：]?[ \n]?"
_C_NAMED = regex.compile(rf"(?:{_C_AFTER}(?P<name>{LATIN_NAME}))|(?P<name>{LATIN_NAME})[ \n]?(?:{'|'.join(CHINESE_TITLES)})")
_HAN_NAME = rf"(?:(?:{'|'.join(DOUBLE_SURNAMES)})\p{{Han}}{{1,2}}|\p{{Han}}{{2,3}})"
_C_CLOSED = regex.compile(
    rf"(?:{'|'.join(CHINESE_LABELS)})[:：]?[ \n]?(?P<name>{_HAN_NAME})(?=[，,。；;：、\s（(\]]|$)|(?:^|(?<=[\s。，；！？：\]】）)、\d.A-Za-z]))(?P<name>{_HAN_NAME})(?={'|'.join(CHINESE_TITLES)})", regex.M
)
_C_OPEN = regex.compile(rf"(?:签名|署名)[:：][ \n]?(?P<name>(?:{'|'.join(DOUBLE_SURNAMES)}|\p{{Han}})\p{{Han}}{{1,2}})")
_NO_NAME = set(NO_NAME)

_SIGN = "|".join(sorted(map(regex.escape, AT_WORDS), key=len, reverse=True))
_POINT = "|".join(sorted(map(regex.escape, DOT_WORDS), key=len, reverse=True))
_DIGIT_OF = {w: str(d) for d, ws in enumerate(DIGIT_WORDS) for w in ws.split()}
_SPELLED = "|".join(sorted((w for w in _DIGIT_OF if w.isalpha() and not regex.match(r"\p{Han}|〇", w)), key=len, reverse=True))
_EDITS = [
    (regex.compile(rf"[ \n]?[\[({{<][ \n]?(?i:{_SIGN}|@)[ \n]?[\])}}>][ \n]?"), "@"),
    (regex.compile(rf"(?<=[A-Za-z0-9])[ \n]?[\[({{<][ \n]?(?i:{_POINT}|\.)[ \n]?[\])}}>][ \n]?(?=[A-Za-z0-9])"), "."),
    (regex.compile(rf"(?<=[A-Za-z0-9_])[ \n](?i:{_SIGN})[ \n](?=[A-Za-z0-9-]{{1,63}}(?:[ \n](?i:{_POINT})[ \n]|\.[a-z])[A-Za-z0-9])"), "@"),
    (regex.compile(rf"(?<=@[A-Za-z0-9.-]{{1,60}})[ \n](?i:{_POINT})[ \n](?=[A-Za-z0-9])"), "."),
    (regex.compile(r"(?<=[A-Za-z0-9_])@[ \n](?=[A-Za-z0-9-]{1,63}\.)"), "@"),
]
#: An address of which the signs are spoken, whatever their number.
_SPOKEN = regex.compile(
    rf"(?<![{_A}.])[A-Za-z0-9_+%-]+(?:(?:[ \n](?i:{_POINT})[ \n]|\.)[A-Za-z0-9_+%-]+)*(?:[ \n](?i:{_SIGN})[ \n]|@)[A-Za-z0-9-]+(?:(?:[ \n](?i:{_POINT})[ \n]|\.)[A-Za-z0-9-]+)+(?![A-Za-z0-9])"
)
_SPOKEN_SIGN = regex.compile(rf"[ \n](?:(?P<at>(?i:{_SIGN}))|(?i:{_POINT}))[ \n]")
_BRACKET_AT, _BRACKET_DOT, _SPOKEN_AT = (re.compile(p) for p in (rf"[\[({{<][ \n]?(?:{_SIGN}|@)", rf"[\[({{<][ \n]?(?:{_POINT}|\.)", rf"[ \n](?:{_SIGN})[ \n][a-z0-9-]{{1,63}}(?:[ \n](?:{_POINT})|\.[a-z])"))
_SEVEN_HAN = re.compile("[零〇一二三四五六七八九]{7}")
_HAN = re.compile(r"[一-鿿]")
_DIGIT_RUN = regex.compile(rf"(?<!\p{{L}})(?i:{_SPELLED}|\d)(?:[ \n-](?i:{_SPELLED}|\d)){{6,}}(?!\p{{L}})|[零〇一二三四五六七八九]{{7,}}")
_DIGIT_WORD = regex.compile(rf"(?i:{_SPELLED})|[零〇一二三四五六七八九]")


_NO_MARKS = str.maketrans(dict.fromkeys("-.,;:!?()[]{}\"'“”„«»/|…", " "))
_DIGIT_TOKENS = {w.lower() for w in _DIGIT_OF} | set("0123456789")


class Traced:
    """A text with, for each of its pieces, where it came from.  Pieces that were rewritten map as a whole."""

    def __init__(self, text: str, at: list[int] | None = None, frm: list[int] | None = None, end: int = 0):
        self.text, self.at, self.frm, self.end = text, at or [0], frm or [0], end
        #: Spans of the text that were spelled numbers.
        self.spelled: list[tuple[int, int]] = []

    @classmethod
    def of(cls, source: str) -> Traced:
        return cls(source, end=len(source))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Traced:
        """Replaces spans of the text, which come in order and do not overlap."""
        if not edits:
            return self
        out, at, frm, done, size = [], [], [], 0, 0

        def keep(a: int, b: int) -> None:
            nonlocal size
            if a < b:
                i = bisect_right(self.at, a) - 1
                at.append(size)
                frm.append(self.source(a))
                for j in range(i + 1, len(self.at)):
                    if self.at[j] >= b:
                        break
                    if self.at[j] > a:
                        at.append(size + self.at[j] - a)
                        frm.append(self.frm[j])
                out.append(self.text[a:b])
                size += b - a

        for a, b, new in edits:
            keep(done, a)
            if new:
                at.append(size)
                frm.append(self.source(a))
                out.append(new)
                size += len(new)
            done = b
        keep(done, len(self.text))
        return Traced("".join(out), at or [0], frm or [0], self.end)

    def source(self, i: int) -> int:
        """Where the character at ``i`` begins in the source."""
        if i >= len(self.text):
            return self.end
        k = bisect_right(self.at, i) - 1
        return self.frm[k] + i - self.at[k]


_DASHES, _INVISIBLE = "‐‑‒–−﹣－", "͏ᅟᅠㅤ"
_LETTER = {a: b for others, latin in LOOK_ALIKE_LETTERS for a, b in zip(others, latin)}


@lru_cache(maxsize=4096)
def _plain(c: str) -> str | None:
    """The character as it is read, if it is another one."""
    kind = unicodedata.category(c)
    if kind == "Cf" or c in _INVISIBLE or "︀" <= c <= "️":
        return ""
    if c in _LETTER:
        return _LETTER[c]
    if kind == "Zs" or c in "\t\r":
        return " " if c != " " else None
    if kind == "Nd" and not c.isascii():
        return str(unicodedata.decimal(c))
    if c in _DASHES:
        return "-"
    folded = unicodedata.normalize("NFKC", c)
    return folded if len(folded) == 1 and folded != c and "！" <= c <= "～" else None


_ODD = regex.compile(r"[^\x20-\x7e\n\p{Han}，。；：、“”‘’«»¿¡·…—a-zA-ZÀ-ÖØ-öø-ÿœŒºª]|[\t\r]")


def _maybe_spelled(text: str) -> bool:
    """Whether seven or more words of the text are digits or spelled ones, or seven Chinese ones stand in a row."""
    return sum(map(_DIGIT_TOKENS.__contains__, text.lower().translate(_NO_MARKS).split())) >= 7 or bool(_SEVEN_HAN.search(text))


def normalise(source: str) -> Traced:
    traced = Traced.of(source)
    if _ODD.search(source):
        traced = traced.rewrite([(m.start(), m.end(), new) for m in _ODD.finditer(source) if (new := _plain(m.group())) is not None])
    runs, numbers = [], []
    for m in _DIGIT_RUN.finditer(traced.text) if _maybe_spelled(traced.text) else ():
        last, first = m.start(), len(runs)
        for w in regex.finditer(rf"{_DIGIT_WORD.pattern}|\d", m.group()):
            runs.append((last, m.start() + w.end(), _DIGIT_OF.get(w.group().lower(), w.group())))
            last = m.start() + w.end()
        if not any(c.isdigit() for c in m.group()):
            numbers.append((traced.source(m.start()), traced.source(m.end() - 1) + 1, len(runs) - first))
    traced = traced.rewrite(runs)
    low = traced.text.lower()
    dots = any(w in low for w in DOT_WORDS)
    needed = (_BRACKET_AT.search(low), _BRACKET_DOT.search(low), _SPOKEN_AT.search(low), dots, "@" in low)
    for need, (pattern, sign) in zip(needed, _EDITS):
        if not need:
            continue
        traced = traced.rewrite([(m.start(), m.end(), sign) for m in pattern.finditer(traced.text)])
    if dots and ("@" in traced.text or needed[2] or any(w in low for w in AT_WORDS)):
        traced = traced.rewrite([edit for m in _SPOKEN.finditer(traced.text) for edit in _signs(m)])
    for begin, _, digits in numbers:
        at = bisect_left(range(len(traced.text)), begin, key=traced.source)
        if traced.text[at : at + digits].isdigit():
            traced.spelled.append((at, at + digits))
    return traced


def _signs(m: regex.Match) -> Iterator[tuple[int, int, str]]:
    """The spoken signs of a spoken address, as edits."""
    for w in _SPOKEN_SIGN.finditer(m.group()):
        yield m.start() + w.start(), m.start() + w.end(), "@" if w.group("at") else "."


def _names(text: str) -> Iterator[tuple[int, int]]:
    low = text.lower()
    if len(low) != len(text):  # some capitals have longer small letters
        low = "".join(c if len(c.lower()) > 1 else c.lower() for c in text)
    found = [m.span() for hit in _BEFORE_NAME.finditer(low) if (m := _NAME.match(text, hit.end(1)))]
    if _CALLED_HINT.search(low):
        signed = [m for hit in _BEFORE_CAPITALS.finditer(low) if (m := _NAME.match(text, hit.end(1)))]
        found += [m.span() for m in signed if all(w[:1].isupper() for w in regex.split(r"[ \n,.-]+", m.group()) if w)]
    if _HAN.search(text):
        found += [m.span("name") for pattern in (_C_NAMED, _C_CLOSED) for m in pattern.finditer(text)]
    for a, b in found:
        name = text[a:b]
        words = regex.split(r"[ \n,]+", name)
        if "," in name and not all(w[:1].isupper() for w in words):
            continue  # "Dear reader, thank you"
        if not any(w.lower() in _NO_NAME for w in words[:2]):
            yield a, b


_ALL_NEEDS = list(dict.fromkeys(need for _, _, need in _FOUND))


def find(source: str, given: frozenset[str] = frozenset()) -> list[tuple[int, int, str]]:
    """(begin, end, kind) of every piece in the source text, in order, none within another.

    ``given``: characters seen in given names, which tell where a Chinese name ends that nothing ends.
    """
    traced = normalise(source)
    text, taken = traced.text, []

    def add(a: int, b: int, kind: str) -> None:
        while b > a and text[b - 1] in " \n":
            b -= 1
        if all(b <= x or a >= y for x, y, _ in taken):
            taken.append((a, b, kind))

    for m in _EMAIL.finditer(text):
        add(*m.span(), "email")
    has = {need: bool(need.search(text)) for need in _ALL_NEEDS}
    for kind, pattern, need in _FOUND:
        for m in pattern.finditer(text) if has[need] else ():
            if kind != "phone" or 7 <= sum(c.isdigit() for c in m.group()) <= 21 and (m.group()[0] == "+" or not _NO_PHONE.search(text, max(0, m.start() - _NEAR), m.start())):
                add(*m.span(), kind)
    for a, b in traced.spelled:  # a number that someone spells out is one to be dialled
        if not (text[a - 1 : a] + text[b : b + 1]).strip(" \n.,;:!?()“”\"").strip("，。；：！？、") or _HAN.search(text[a - 1 : a] + text[b : b + 1]):
            add(a, b, "phone")
    names = list(_names(text))
    for a, b in names:
        add(a, b, "name")
    for name in {text[a:b] for a, b in names if " " in text[a:b]}:  # whoever is named once is so wherever the name stands
        at = text.find(name, 0)
        while at >= 0:
            if not (text[at - 1 : at] + text[at + len(name) : at + len(name) + 1]).replace("-", "x").isalnum() and (at == 0 or not text[at - 1].isalnum()):
                add(at, at + len(name), "name")
            at = text.find(name, at + len(name))
    for m in _C_OPEN.finditer(text) if "名" in text else ():
        a, b = m.span("name")
        surname = 2 if text[a : a + 2] in _DOUBLE else 1
        b = min(b, a + surname + 2)
        if b - a == surname + 2 and text[b - 1] not in given:
            b -= 1
        add(a, b, "name")
    out = []
    for a, b, kind in sorted(taken):
        begin, end = traced.source(a), traced.source(b - 1) + 1
        if b < len(text):
            end = max(end, min(traced.source(b), end + _rest(source, end, traced.source(b))))
        out.append((begin, end, kind))
    return out


_DOUBLE = set(DOUBLE_SURNAMES)


def _rest(source: str, end: int, until: int) -> int:
    """How much of what follows belongs to a last character that was written longer than it reads."""
    piece = source[end:until]
    return len(piece) if piece.strip() and not any(_plain(c) == "" for c in piece) else 0


def given_characters(text: str) -> list[str]:
    """Characters of given names that something ends."""
    out = []
    for m in _C_CLOSED.finditer(normalise(text).text):
        name = m.group("name")
        out += name[2 if name[:2] in _DOUBLE else 1 :]
    return out


#: One of these stands beside every Chinese name that something ends.
_GIVEN_HINTS = ["联系人", "寄件人", "收件人", "借书人", "负责人", "借给", "签名", "署名", "姓名", "作者", *CHINESE_TITLES]


def learn_given(df: DataFrame, text_col: str = "text", least: float = 0.001) -> frozenset[str]:
    """Characters that make at least the share ``least`` of all characters of the corpus's given names; at most 1 / least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        for batch in batches:
            for t in batch.column(0).to_pylist():
                for c in given_characters(t or ""):
                    counts[c] = counts.get(c, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), type=pa.string()), pa.array(list(counts.values()), type=pa.int64())], names=["c", "n"])

    some = reduce(lambda a, b: a | b, [F.contains(F.col(f"`{text_col}`"), F.lit(x)) for x in _GIVEN_HINTS])
    found = df.select(f"`{text_col}`").where(some).mapInArrow(run, "c string, n long").groupBy("c").agg(F.sum("n").alias("n"))
    counts = {r.c: r.n for r in found.collect()}  # at most as many as there are ideographs
    return frozenset(c for c, n in counts.items() if n >= least * sum(counts.values()))


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", given: frozenset[str] | None = None) -> DataFrame:
    """(id_col, kind, found_text, begin int, length int): every occurrence of every piece, as it is written in the text.

    Null and empty texts have none.  Rows are independent of each other: repeated rows come out repeatedly.  Whole texts are read, whatever their
    length; other columns are not.  An empty table gives an empty table.
    """
    known = learn_given(df, text_col) if given is None else given
    kind = df.select(f"`{id_col}`").schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                if t:
                    for a, b, what in find(t, known):
                        rows.append(i)
                        found.append((what, t[a:b], a, b - a))
            cols = list(zip(*found)) if found else [[], [], [], []]
            ids = batch.column(0).take(pa.array(rows, type=pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(cols[0], type=pa.string()), pa.array(cols[1], type=pa.string()), pa.array(cols[2], type=pa.int32()), pa.array(cols[3], type=pa.int32())],
                names=[id_col, "kind", "found_text", "begin", "length"]
            )

    return df.select(f"`{id_col}`", f"`{text_col}`").mapInArrow(run, f"`{id_col}` {kind}, kind string, found_text string, begin int, length int")


def masked(text: str | None, given: frozenset[str] = frozenset()) -> str | None:
    """The text with each piece replaced by a placeholder of its kind, such as [EMAIL], and everything else unchanged."""
    if not text:
        return text
    out, done = [], 0
    for a, b, kind in find(text, given):
        out += text[done:a], f"[{kind.upper()}]"
        done = b
    return "".join(out) + text[done:]


def mask(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", given: frozenset[str] | None = None) -> DataFrame:
    """(id_col, text_col): each row's text ``masked``; null stays null."""
    known = learn_given(df, text_col) if given is None else given
    schema = df.select(f"`{id_col}`", f"`{text_col}`").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([masked(t, known) for t in batch.column(1).to_pylist()], type=pa.string())], names=[id_col, text_col])

    return df.select(f"`{id_col}`", f"`{text_col}`").mapInArrow(run, schema)
