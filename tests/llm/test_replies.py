import datetime as dt

import pytest

from lectern.llm import language, replies, truncation as T

T0 = dt.datetime(2024, 1, 1)
EN = "The lens grinder praised the clarity of the drawings and noted the height of the water. In most copies, the orchard opened a new room for visitors."
DE = "Die Lesegesellschaft ersetzte die hölzerne Brücke auf dem Weg nach Undostad. Der Vermesser bezweifelte das Datum der Handschrift und maß den Winkel."
FR = "Le relieur empruntait quatre volumes à la bibliothèque et expliquait la couleur du verre. La fille de l'éclusier notait la hauteur de l'eau."
ES = "El farero pagaba una pequeña tasa por el paso entre los saltos. La torre de señales perdía varios dibujos importantes y usaba una regla."
MODEL = language.Model([(EN, "en"), (DE, "de"), (FR, "fr"), (ES, "es")] * 3)


@pytest.mark.parametrize("text,lang", [(EN, "en"), (DE, "de"), (FR, "fr"), (ES, "es"), ("读书会保留了原来的装帧。", "zh"), ("", None), ("123 !", None)])
def test_language(text, lang):
    assert MODEL.of(text) == lang


@pytest.mark.parametrize(
    "text,want",
    [
        (None, T.COMPLETE), ("", T.COMPLETE), ("Whole sentence.", T.COMPLETE), ("他来了。", T.COMPLETE), ("Any time 🙂", T.COMPLETE), ("See it. https://docs.example.org/tides/3167", T.COMPLETE),
        ("Code:\n\n```python\nswap(a, i)\n```", T.COMPLETE), ("| # | n |\n|---|---|\n| the mill | 353 |", T.COMPLETE), ("Er sagte: „Die Brücke.“", T.COMPLETE), ("First. Nsvrivsanuit!!", T.COMPLETE),
        ("It comes down to two points:\n\n1. One thing.\n2. Another.", T.COMPLETE), ("It comes down to three points:\n\n1. One thing.\n2. Another.", T.CUT),
        ("The first thing. The second thi", T.CUT), ("The first thing. The seco\n\n> error: stream closed", T.CUT), ("One. Two of the thin...", T.CUT), ("One. L'édit�", T.CUT),
        ("Code:\n\n```python\nswap(a, i", T.CUT), ("Words.\n\n- Done with it.\n- **the half", T.CUT), ("oil. $$ h(t) = \\sum_{k=1}", T.CUT), ("| # | n |\n|---|---|\n| the mi", T.CUT),
        ("Explain this: “The mill owner", T.CUT), ("In the evening, the mill owner", T.OPEN), ("- One is done.\n- Two is not do", T.CUT), ("Here it is:", T.CUT),
        ("The Salt Road of Pelistad", T.OPEN), ("- the mill\n- the orchard", T.ITEM), ("- 果园\n- 附录", T.COMPLETE),
    ],
)
def test_ends(text, want):
    assert T.judge_end(text)[0] == want


def test_search_words_are_complete():
    assert T.judge_end("tide tables Zelawick 1896", asked=True)[0] == T.COMPLETE
    assert T.judge_end("ok thanks", asked=True)[0] == T.COMPLETE


def test_truncated_against_the_corpus(spark):
    rows = [(1, "The bookbinder counted every lantern", "assistant"), (2, "On Monday the bookbinder counted every lantern on the quay.", "assistant"), (3, "The Salt Road of Pelistad", "assistant"),
            (4, "- the orchard\n- the northern cat", "user"), (5, "- the northern catalogue\n- the orchard", "user"), (6, "the orchard was sold.", None), (7, None, "user"), (1, "The bookbinder counted every lantern", "assistant"),
            (None, "The orchard was so", "user"), (8, "x" * 100000 + " and then. It stopp", "tool")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id long, content string, role string, state int")
    assert sorted(r.id for r in T.truncated(df).collect()) == [1, 4, 8]
    assert T.truncated(df.limit(0)).collect() == []


@pytest.mark.parametrize(
    "text,want",
    [("I'm sorry, but I can't help with that request. Please ask something else.", True), ("Das liegt leider außerhalb meiner Aufgaben.", True), ("Je dois décliner cette demande.", True), ("Lo siento, pero prefiero no pronunciarme sobre eso.", True), ("很抱歉，这一点恕我不作评论。请换一个问题吧。", True),
     ("Sorry for the mix-up, here is the corrected reading. The mill was sold.", False), ("The letter says “I cannot help you with the boats”, which is the key line.", False), ("I can't see the next page, yet this page is clear. The mill was sold.", False), ("", False)],
)
def test_refusals(text, want):
    assert replies.refuses(text) is want


@pytest.mark.parametrize(
    "prompt,reply,want",
    [("What does this picture show?", "WHAT DOES THIS PICTURE SHOW?", True), ("What is it?", "You asked: What is it?", True), ("Explain this passage: “The mill owner was sold the road.”", "“The mill owner was sold the road.”", True), ("Explain: the mill was sold", "It means that the owner gave up his mill.", False), ("请解释", "好", False), ("Übersetze: „篁汀港盐道志“", "Du hast gefragt: 篁汀港盐道志", True), ("What is it?", "In short: It is the mill.", False), ("", "words", False)],
)
def test_echoes(prompt, reply, want):
    assert replies.echoes(prompt, reply) is want


@pytest.mark.parametrize(
    "prompt,action,due",
    [("Translate into Spanish: “The mill.”", "translate", "es"), ("Bitte übertrage das ins Französische:\nThe mill", "translate", "fr"), ("请翻译成德语：“The mill.”", "translate", "de"), (f"{FR}\n\nTranslate the lines above into Chinese, please.", None, "zh"), (f"Was meint der Autor mit „{EN}“?", "explain", "de"), (f"I don't follow this part about the mill: {FR}", "explain", "en"), ("¿Qué muestra esta imagen?", "vision", "es"), ("", "chat", None)],
)
def test_language_due(prompt, action, due):
    assert replies.languages_due(prompt, action, MODEL) == ({due} if due else set())


def test_defects(spark):
    turns = [("user", EN[:40] + "?"), ("assistant", "**"), ("user", "What happened to the mill in the end?"), ("assistant", "I must decline this."), ("tool", "x"), ("assistant", "No pair."), ("user", "What does it say here?"), ("system", "note"),
             ("assistant", "what does it say here"), ("user", "Explain it, please."), ("assistant", EN[:-12]), ("user", "Explain it, please."), ("assistant", DE), ("user", "Explain it, please."), ("assistant", EN), (None, None), ("user", None), ("assistant", None)]
    rows = [(i, 5, r, c, None, "explain" if i > 8 else None, T0 + dt.timedelta(seconds=i), "x") for i, (r, c) in enumerate(turns)]
    rows += [(*rows[1][:6], T0 + dt.timedelta(hours=1), "x"), (100, None, "assistant", "", None, None, None, "x"), (101, 6, "user", "Hello, what is this?", None, None, None, "x"), (102, 6, "assistant", "", None, None, None, "x")]
    df = spark.createDataFrame(rows, "id long, thread_id long, role string, content string, image_path string, action_type string, created_at timestamp_ntz, defect string")
    got = {r.reply_id: r.defect for r in replies.defects(df, MODEL).collect()}
    assert got == {1: "empty", 3: "refusal", 8: "echo", 10: "truncated", 12: "wrong_lang", 17: "empty", 102: "empty"}
    assert replies.defects(df.limit(0), MODEL).collect() == []


@pytest.mark.parametrize("text", ["No comment.", "That is something I must pass on.", "I'm going to skip this one.", "Auf diese Frage gehe ich nicht ein.", "Lehne ich ab. Das ist nicht meine Aufgabe.", "Il m'est impossible de vous aider sur ce point.", "Eso queda fuera de mi función.", "无法回答这个问题。", "对不起，我们还是聊聊别的页面吧。"])
def test_speakers_that_decline(text):
    assert replies.refuses(text)


@pytest.mark.parametrize(
    "text",
    ["The tower cannot be seen from the river.", "La torre queda fuera de la ciudad.", "人们不能进入塔。", "Das geht über das hinaus, was im Text steht.", "The owner refused to sell the mill.", "Le pont ne peut pas supporter ce poids.", "No hay respuesta en el texto.", "Der Turm darf nicht betreten werden.", "The ferry will not leave before noon.", "这座桥无法通行。"],
)
def test_what_cannot_be_done_is_no_refusal(text):
    assert not replies.refuses(text)


@pytest.mark.parametrize("prompt,due", [("Translate this German passage into English: “Die Mühle.”", "en"), ("Übersetze den englischen Text ins Französische: “The mill.”", "fr"), ("把这段英文翻译成德语：“The mill.”", "de"), ("Traduis ce passage espagnol en allemand : « El molino. »", "de")])
def test_language_due_where_two_are_named(prompt, due):
    assert replies.languages_due(prompt, "translate", MODEL) == {due}
