"""Defective pairs of a question and the reply to it: empty, truncated, refusing, echoing, or in another language than the one due."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..ordering import with_neighbour
from .language import Model
from .messages import contents, heads
from .truncation import truncated

# What makes a sentence decline, by language: who speaks, a modal denied, a verb of answering, a verb of declining, and standing phrases in
# which a speaker is part.  A sentence declines if it has a standing phrase, or a speaker and either a verb of declining or a modal denied with a verb of answering.
DECLINING = {
    "en": {
        "speaker": r"\b(?:I|I['’](?:m|d|ll|ve)|me|my|we|us|our|assistant)\b",
        "denied": r"\b(?:can(?:['’]t|not| not)|won['’]t|will not|(?:must|may|do) not|unable|not (?:be )?(?:able|allowed|permitted|willing|in a position)|rather not|prefer not|(?:not|don['’]t) (?:feel )?comfortable|don['’]t (?:want|wish))\b",
        "answering": r"\b(?:answer|help|assist|respon[ds]|comment|provid|discuss|describ|view|go into|do (?:this|that|it)\b|speak|talk|request|translat|explain|tell you)",
        "declining": r"\b(?:declin|refus|abstain|pass on|pass over|skip|stay(?:ing)? out of|sit(?:ting)? (?:this )?(?:one )?out)",
        "standing": r"^no comment\b|\bno (?:answer|comment|response) from me\b|\b(?:outside|beyond)\b.*\b(?:I|my|me)\b|\blet(?: us|['’]s)\b.*\b(?:different|another|else)\b",
    },
    "de": {
        "speaker": r"\b(?:ich|mir|mich|mein\w*|wir|uns)\b",
        "denied": r"\b(?:nicht|keine?)\b",
        "answering": r"\b(?:weiter)?(?:helfen|beantworte|antwort|äußer|ein(?:zu)?gehe|gehe\b.*\bein\b|bearbeite|behandle|auskunft|stellungnahme|kommentier|beschreibe|übersetze|dienen)",
        "declining": r"\b(?:ab(?:zu)?lehnen|lehne\b.*\bab\b|verweiger|heraus(?:zu)?halten|halte\b.*\b(?:heraus|zurück)\b|überspring|auslassen)",
        "standing": r"^kein kommentar\b|\bau(?:ß|ss)erhalb (?:mein|dessen,? was ich)|\bnicht meine aufgabe\b|\b(?:übersteigt|geht über)\b.*\b(?:ich|meine?)\b|\blasst? uns lieber\b|\bsprechen wir lieber\b",
    },
    "fr": {
        "speaker": r"\b(?:je|me|moi|mon|ma|mes|nous)\b|\b[jm]['’]",
        "denied": r"\b(?:ne|n['’]\w+)\b.*\bpas\b|\bne pas\b|\bimpossible\b",
        "answering": r"\b(?:répon[ds]|aider|prononcer|comment(?:er|aire)|traiter|parler|décrire|fournir|assister|donner suite)",
        "declining": r"\b(?:décline|refuse|m['’]abst|passer mon tour|rester en dehors|à l['’]écart)",
        "standing": r"^(?:pas de|sans) commentaire\b|\bpas de réponse de ma part\b|\b(?:sort|dépasse|hors)\b.*\b(?:mon|ma|mes|je)\b|\bparlons plutôt\b",
    },
    "es": {
        "speaker": r"\b(?:puedo|podré|debo|quiero|voy|estoy|prefiero|tengo|me|mi|mis|yo)\b",
        "denied": r"\bno\b",
        "answering": r"\b(?:ayudar|responder|respuesta|comentar|pronunciar|tratar|describir|hablar|atender|opinar)",
        "declining": r"\b(?:rechazar|abstengo|declinar|omitir|saltarme|al margen)",
        "standing": r"^sin comentarios\b|\b(?:sin|ninguna) respuesta (?:por|de) mi parte\b|\b(?:fuera de|más allá de|excede|supera)\b.*\b(?:mi|mis|hago|puedo|me)\b|\bhablemos (?:mejor|de otr)",
    },
    "zh": {
        "speaker": r"我|本助手|^(?:[^，。！]{0,5}[，,])?(?:这[^，。]{0,6})?(?:无法|不便|不能)",
        "denied": r"无法|不能|不便|没办法|不方便|不想|不愿|不可以",
        "answering": r"回答|提供|协助|处理|评论|帮|完成|描述|谈|翻译|解释",
        "declining": r"拒绝|跳过|回避|不予",
        "standing": r"恕|无可奉告|超出了?我|聊聊别的|换个话题",
    },
}
# Patterns of what goes with declining: regret, reasons, offers of something else.
GOES_WITH = [
    r"\bsorry\b", r"\bapologi[sz]", r"\bunfortunately\b", r"\bappreciate the question\b", r"\bplease (?:ask|try)\b", r"\blet me know\b", r"\banother (?:topic|question)\b", r"\bsomething else\b", r"\bguidelines?\b", r"\bmy rules\b", r"\bprotected\b",
    r"\bleid\b", r"\bleider\b", r"\bentschuldig", r"\bbitte stell", r"\bandere frage\b", r"\brichtlinien\b", r"\banderes thema\b",
    r"\bdésolée?\b", r"\bmalheureusement\b", r"\bexcuse", r"\bautre (?:question|sujet|page)\b", r"\bposez\b", r"\bmes règles\b",
    r"\blo siento\b", r"\bdisculp", r"\bperdon", r"\blamentable", r"\botra (?:pregunta|página)\b", r"\bprueba con\b", r"\bmis normas\b", r"\botro tema\b",
    r"抱歉", r"对不起", r"不好意思", r"请换", r"换一个问题", r"使用规范", r"别的问题",
]
# What shows that a part of a prompt is the user's own words and not a quoted passage.
ASKING = {
    "en": r"\b(?:what|which|who|how|why|where|when|explain|translate|please|describe|read|summari[sz]e|sum up|can you|could you|tell me|i don['’]t|in simple words|does this|give me|thanks?|ok)\b",
    "de": r"\b(?:was|welche[rs]?|wer|wie|warum|wo|wann|erklär\w*|übersetz\w*|übertrag\w*|bitte|beschreib\w*|lies|fass\w*|zusammenfass\w*|kannst du|könntest du|sag\w*|verstehe|danke)\b",
    "fr": r"(?:\b(?:que|quoi|quel(?:le)?s?|qui|comment|pourquoi|où|quand|explique\w*|tradui\w*|s['’]il te plaît|décri\w*|lis|résum\w*|peux-tu|pourrais-tu|dis|donne-moi|comprends|merci|d['’]accord)\b|\bqu['’]|-tu\b|-t-on\b|-on\b)",
    "es": r"(?:¿|\b(?:qué|cuál\w*|quién\w*|cómo|por qué|dónde|cuándo|explica\w*|traduc\w*|por favor|describ\w*|lee|resum\w*|puedes|podrías|dime|dame|entiendo|gracias|vale)\b)",
    "zh": r"(?:什么|怎么|为什么|哪|谁|请|翻译|译为|解释|描述|概括|能帮|吗|呢|没看懂|谢谢|说明|好的)",
}
# Names of the languages in each of them, as they stand in a request to translate.
LANGUAGE_NAMES = {
    "en": r"\b(?:english|englische?[nr]?|anglaise?|ingl[eé]s\w*)\b|英语|英文",
    "de": r"\b(?:german|deutsche?|deutsch|allemande?|alem[aá]n\w*)\b|德语|德文",
    "fr": r"\b(?:french|franz[öo]sisch\w*|fran[cç]aise?|franc[eé]s\w*)\b|法语|法文",
    "es": r"\b(?:spanish|spanisch\w*|espagnole?|español\w*|castellano)\b|西班牙语|西语|西班牙文",
    "zh": r"\b(?:chinese|mandarin|chinesisch\w*|chinoise?|chin[oa])\b|中文|汉语|中文?普通话",
}

# Patterns are matched against text in lower case, which is much faster than matching whatever the case.
_DECLINING = [{k: re.compile(p.lower()) for k, p in d.items()} for d in DECLINING.values()]
_GOES_WITH = re.compile("|".join(GOES_WITH))
# In lower case, pieces of which every sentence has one that declines or goes with it.
HINTS = ["not", "n't", "n’t", "unable", "declin", "refus", "abst", "pass o", "skip", "out", "no comment", "no answer", "no response", "beyond", "let us", "let's", "let’s",
         "nicht", "kein", "lehne", "verweiger", "heraus", "überspring", "auslassen", "außerhalb", "ausserhalb", "übersteigt", "über", "lass", "lieber",
         "ne ", "n'", "n’", "impossible", "décline", "tour", "écart", "dehors", "commentaire", "réponse", "sort", "dépasse", "hors", "parlons",
         "no ", "rechazar", "omitir", "saltarme", "margen", "comentarios", "respuesta", "fuera", "más allá", "excede", "supera", "hablemos",
         "无", "不", "没办法", "拒绝", "跳过", "回避", "恕", "超出", "聊聊", "换个",
         "sorry", "apolog", "unfortunately", "appreciate", "please", "let me know", "another", "something else", "guideline", "my rules", "protected",
         "leid", "entschuldig", "bitte", "frage", "richtlinien", "thema", "désol", "malheureusement", "excuse", "autre", "posez", "mes règles",
         "siento", "disculp", "perdon", "otra", "prueba", "mis normas", "otro", "抱歉", "请换", "换一个", "使用规范", "别的"]
_HINTS = ahocorasick.Automaton()
for _hint in HINTS:
    _HINTS.add_word(_hint, True)
_HINTS.make_automaton()
_SENTENCE = re.compile(r"[^.!?。！？\n]+[.!?。！？]?")
_ASKING = {lang: re.compile(p) for lang, p in ASKING.items()}
_ANY_ASKING = re.compile("|".join(ASKING.values()))
_NAMES = {lang: re.compile(p) for lang, p in LANGUAGE_NAMES.items()}
#: What stands before the language into which a text is to be translated, where another one is named as well.
_INTO = {lang: re.compile(rf"(?:\b(?:into|to|ins?|auf|en|au|al)\s+(?:the\s+|el\s+)?|[成为])(?:{p})") for lang, p in LANGUAGE_NAMES.items()}
_QUOTED = re.compile(r"“[^”“]*[”“]|„[^“”]*[“”]|«[^»]*»|「[^」]*」|\"[^\"]*\"", re.S)
_QUOTES = re.compile("[“„«「\"]")
_OPEN_QUOTE = re.compile(r"[“„«「].*$", re.S)
_PARTS = re.compile(r"(?<=[.!?。！？])[”»“\")）]*\s*|\n+|(?<=[:：])\s*")
_TOKEN = re.compile(r"[一-鿿]|[^\W_]+")
#: Share of a reply's tokens that stand in the prompt in runs of RUN or more, for the reply to be an echo.
ECHO_SHARE, RUN = 0.85, 3
#: Languages of a prompt whose share is at least this much of the largest are all taken to be due.
PLAUSIBLE = 0.77
_LEAD_IN = re.compile(r"^[^:：\n]{2,30}[:：]\s*")


def declines(sentence: str) -> bool:
    """Whether the one who speaks, in lower case, denies an answer: not whether something can't be done."""
    return any(d["standing"].search(sentence) or d["speaker"].search(sentence) and (d["declining"].search(sentence) or d["denied"].search(sentence) and d["answering"].search(sentence)) for d in _DECLINING)


def refuses(reply: str) -> bool:
    """Some sentence declines, and no other gives anything but regret, reasons or another offer; what is quoted is not said."""
    declined = False
    for m in _SENTENCE.finditer(_QUOTED.sub(" ", reply) if _QUOTES.search(reply) else reply):
        s = m.group().strip().lower()
        if _TOKEN.search(s):
            if next(_HINTS.iter(s), None) is None:
                return False
            own = declines(s)
            if not own and not _GOES_WITH.search(s):
                return False
            declined = declined or own
    return declined


def _tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.casefold())


def echoes(prompt: str, reply: str) -> bool:
    """Nearly all tokens of the reply stand in the prompt, in runs; case, marks and blanks aside.  A lead-in with a colon may stand before them."""
    asked = _tokens(prompt)
    lead = _LEAD_IN.match(reply)
    return _gives_back(asked, _tokens(reply)) or bool(lead) and _gives_back(asked, _tokens(reply[lead.end() :]), least=4, loose=0)


def _gives_back(asked: list[str], said: list[str], least: int = 2, loose: int = 2) -> bool:
    if not asked or len(said) < least:
        return False
    common = set(asked)
    if sum(w not in common for w in said) > max(2, (1 - ECHO_SHARE) * len(said)):
        return False
    run = min(RUN, len(said))
    runs = {tuple(asked[i : i + run]) for i in range(len(asked) - run + 1)}
    if len(said) < RUN:
        return tuple(said) in runs
    covered = [False] * len(said)
    for i in range(len(said) - run + 1):
        if tuple(said[i : i + run]) in runs:
            covered[i : i + run] = [True] * run
    free = len(said) - sum(covered)
    return free <= (1 - ECHO_SHARE) * len(said) or free <= loose and len(said) >= 5


def languages_due(prompt: str, action: str | None, model: Model) -> frozenset[str]:
    """For a translation the language asked for, else that of the user's own words, whatever that of a quoted passage; several where few words leave them open."""
    own = (_OPEN_QUOTE.sub(" ", _QUOTED.sub(" ", prompt)) if _QUOTES.search(prompt) else prompt).lower()
    parts = [p for p in _PARTS.split(own) if _TOKEN.search(p)]
    if not parts:
        return frozenset()
    hits = [sum(1 for _ in _ANY_ASKING.finditer(part)) for part in parts]
    best = max(range(len(parts)), key=lambda i: (hits[i] > 0, i in (0, len(parts) - 1), hits[i], -i))
    part = parts[best]
    if action in ("translate", None):
        for part_ in [part, parts[0], parts[-1]]:
            named = [lang for lang, p in _NAMES.items() if p.search(part_)]
            if len(named) > 1:
                named = [lang for lang in named if _INTO[lang].search(part_)]
            if named and (action == "translate" or hits[parts.index(part_)]):
                return frozenset(named) if len(named) == 1 else frozenset()
        if action == "translate":
            return frozenset()
    shares = model.shares(part)
    for lang, p in _ASKING.items():
        shares[lang] += 2 * len(p.findall(part))
    top = max(shares.values())
    return frozenset(k for k, v in shares.items() if v >= PLAUSIBLE * top) if top >= 0.6 else frozenset()


def in_other_language(prompt: str, reply: str, action: str | None, model: Model) -> bool:
    shares = model.shares(reply)
    best = max(shares, key=shares.get)
    if shares[best] < 1.5:
        return False
    due = languages_due(prompt, action, model)
    return bool(due) and best not in due and shares[best] > 2 * max(shares[k] for k in due)


def pairs(messages: DataFrame) -> DataFrame:
    """(reply_id, prompt_id, and both's times, the reply's action_type and readable): assistant messages with the user message directly before.

    Before means in the same thread, by created_at (null last), then id, each id once and system messages skipped; any other role
    stands between.  A null thread_id is no thread.
    """
    rows = heads(messages).where("thread_id IS NOT NULL AND NOT (role <=> 'system')")
    laid = with_neighbour(
        rows.withColumn("late", F.col("created_at").isNull()), ["thread_id", "late", "created_at", "id"], ["thread_id", "role", "id", "created_at", "action_type", "tie"], before=True
    )
    both = laid.where("role = 'assistant' AND prev_role = 'user' AND thread_id = prev_thread_id")
    return both.select(
        F.col("id").alias("reply_id"), F.col("created_at").alias("reply_at"), "readable", F.coalesce("action_type", "prev_action_type").alias("action"), F.col("prev_id").alias("prompt_id"),
        F.col("prev_created_at").alias("prompt_at"), F.col("tie").alias("reply_tie"), F.col("prev_tie").alias("prompt_tie")
    )


def with_texts(messages: DataFrame, found: DataFrame) -> DataFrame:
    """``pairs`` with the texts ``prompt`` and ``reply``."""
    replies = found.select(F.col("reply_id").alias("id"), F.col("reply_at").alias("created_at"), F.col("reply_tie").alias("tie"), "readable", "action")
    prompts = found.select(F.col("prompt_id").alias("id"), F.col("prompt_at").alias("created_at"), F.col("prompt_tie").alias("tie"), "reply_id")
    said = contents(messages, replies, [F.col("content").alias("reply")]).withColumnRenamed("id", "reply_id")
    asked = contents(messages, prompts, [F.col("content").alias("prompt")])
    return said.join(asked.select("reply_id", "prompt"), "reply_id").select("reply_id", "readable", "action", "prompt", "reply")


def truncated_messages(messages: DataFrame) -> DataFrame:
    """(id): as ``truncation.truncated``, without replies that only give the prompt back: those end where the prompt's words do."""
    cut_off = truncated(messages)
    doubtful = pairs(messages).join(cut_off.withColumnRenamed("id", "reply_id"), "reply_id", "left_semi")
    kind = messages.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, asked, said = (batch.column(i).to_pylist() for i in range(3))
            yield pa.RecordBatch.from_arrays([pa.array([i for i, p, r in zip(ids, asked, said) if echoes(p or "", r or "")], type=batch.column(0).type)], names=["id"])

    echoed = with_texts(messages, doubtful).select("reply_id", "prompt", "reply").mapInArrow(run, f"id {kind}")
    return cut_off.join(echoed, "id", "left_anti")


def defects(messages: DataFrame, model: Model) -> DataFrame:
    """(reply_id, defect): the defective pairs of ``pairs``, each with one of empty, refusal, echo, truncated, wrong_lang.

    Of several the first in that order counts.  Rows may repeat (see ``messages.heads``); null roles, texts, times and actions have the
    results stated there; an empty table gives an empty table; other columns are not read.
    """
    cut_off = truncated(messages).select(F.col("id").alias("reply_id"), F.lit(True).alias("cut_off"))
    rows = with_texts(messages, pairs(messages)).join(cut_off, "reply_id", "left")
    kind = messages.schema["id"].dataType.simpleString()

    def one(readable: bool, action: str | None, prompt: str | None, reply: str | None, cut: bool | None) -> str | None:
        if not readable:
            return "empty"
        if refuses(reply):
            return "refusal"
        if echoes(prompt or "", reply):
            return "echo"
        if cut:
            return "truncated"
        return "wrong_lang" if in_other_language(prompt or "", reply, action, model) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(*row) for row in zip(*(batch.column(i).to_pylist() for i in range(1, 6)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, type=pa.string())], names=["reply_id", "defect"])

    return rows.select("reply_id", "readable", "action", "prompt", "reply", "cut_off").mapInArrow(run, f"reply_id {kind}, defect string").where("defect IS NOT NULL")
