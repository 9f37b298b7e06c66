"""Problems 2, 4 and 9: small texts with their right answers, and the cases that data bring."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.llm import abuse, quoting, sentences

# 4 -----------------------------------------------------------------------------------------------

CASES = {
    "Dr. May met Prof. Lee at 9 p.m. near St. Anna Road. The U.N. team left, etc.\nWhat?!": ["Dr. May met Prof. Lee at 9 p.m. near St. Anna Road.", "The U.N. team left, etc.", "What?!"],
    "It cost 3.50 units (approx. 4) at www.shop-a.example for one. See Fig. 3 and pp. 4-5 of vol. 6.": ["It cost 3.50 units (approx. 4) at www.shop-a.example for one.", "See Fig. 3 and pp. 4-5 of vol. 6."],
    '"Stop it. We are late," said Tom. She asked, "Why?" and left.': ['"Stop it. We are late," said Tom.', 'She asked, "Why?" and left.'],
    "A heading\n\n1. One thing.\n2. Another thing\n(a) Third": ["A heading", "1. One thing.", "2. Another thing", "(a) Third"],
    "Both belong to Ada since\n1987. Then it broke.": ["Both belong to Ada since\n1987.", "Then it broke."],
    "It works again 👍 The next one does not :-) Really, it stopped ... then it went on.": ["It works again 👍", "The next one does not :-)", "Really, it stopped ... then it went on."],
    "They came.the others left.Nobody saw load.py or a.out move.": ["They came.", "the others left.", "Nobody saw load.py or a.out move."],
    "当社は売った。「古い。行こう。」と言った。高いです｡売上は3.5％増（含む。）である。": ["当社は売った。", "「古い。行こう。」と言った。", "高いです｡", "売上は3.5％増（含む。）である。"],
    "他说：“太旧。我们走。”新的真好！“谁呢？”他问。": ["他说：“太旧。我们走。”", "新的真好！", "“谁呢？”他问。"],
    "ถนนมีราคา 17 เหรียญ เรือเก่า\nใครขาย": ["ถนนมีราคา 17 เหรียญ", "เรือเก่า", "ใครขาย"],
    "डॉ. राम ने देखी। क्या नई हैं?": ["डॉ. राम ने देखी।", "क्या नई हैं?"],
    "قال د. سامر: «آلة رخيصة. هيا بنا». هذه آلة جديدة!": ["قال د. سامر: «آلة رخيصة. هيا بنا».", "هذه آلة جديدة!"],
    "На стр. 51 и т. д. есть мазь. «Она серая. Идём», — сказал г-н П.": ["На стр. 51 и т. д. есть мазь.", "«Она серая. Идём», — сказал г-н П."],
    "Am 16. März kam Dr. Au, z. B. in Ulm. „Alt. Wir gehen“, sagte er.": ["Am 16. März kam Dr. Au, z. B. in Ulm.", "„Alt. Wir gehen“, sagte er."],
    "Voir p. ex. l'art. 75. « Lente. On part », dit Zoé. Qui vend ?": ["Voir p. ex. l'art. 75.", "« Lente. On part », dit Zoé.", "Qui vend ?"],
    "—¿La presa? —preguntó Ana. ¡Queda nueva! El Sr. Gil la vio a las 4 p. m. Véase la pág. 6.": ["—¿La presa? —preguntó Ana.", "¡Queda nueva!", "El Sr. Gil la vio a las 4 p. m.", "Véase la pág. 6."],
}


@pytest.mark.parametrize("text", list(CASES))
def test_sentences(text):
    assert [text[a:b] for a, b in sentences.split(text)] == CASES[text]


@pytest.mark.parametrize("text", [None, "", " \n\t ", "." * 50, "((((", '"' * 31, "a" * 100_000, "x. " * 5000, "\r\n\r\n", "“" * 99 + "a"])
def test_odd_texts_are_covered(text):
    spans = sentences.split(text)
    assert all(0 <= a < b <= len(text) for a, b in spans) and all(b <= c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))
    inside = {i for a, b in spans for i in range(a, b)}
    assert all(c.isspace() or i in inside for i, c in enumerate(text or ""))


def test_sentences_of_redelivered_rows(spark):
    rows = [(1, 1, "One. Two."), (1, 2, "One. Two."), (2, 1, None), (3, None, "Three."), (None, 1, "Four.")]
    df = spark.createDataFrame(rows, "doc_id LONG, prepared_at INT, raw_text STRING").withColumn("start_pos", F.lit("clash"))
    assert sorted((r["doc_id"] or 0, r["start_pos"], r["end_pos"]) for r in sentences.found(df).collect()) == [(0, 0, 5), (1, 0, 4), (1, 5, 9), (3, 0, 6)]
    assert {r["doc_id"]: r["sentences_raw"] for r in sentences.sentence_units(df).collect()}[1] == ["One.", "Two."]
    assert sentences.found(df.limit(0)).count() == 0


# 2 -----------------------------------------------------------------------------------------------

MAILS = {
    "On 3 Dec 2018 at 9:14, Ann Lee\n<ann@mail.example> wrote:\n> Old words that were\nbroken\n> by a mailer.\n\nNew words.\n\n-- \nTom Fox\ntom@mail.example": {1, 2, 3, 4, 5, 9, 10, 11},
    "New words here.\n\n-----Original Message-----\nFrom: Ann\nSent: 1 May 2001\nSubject: Re: x\n\nOld words.": {3, 4, 5, 6, 8},
    "New words.\n\nIn article <12@mail.example>,\nann@mail.example writes:\n\nOld words without a mark.": {3, 4, 6},
    "New text.\n\nRegards,\nTom\n\nPS: one more\nline.": {3, 4},
    "Best regards are due to Ann for the archive.\nSent from Rome, the box needs 2 days.\nIn article 6 of the rules Ann writes: no boxes.\n: the cheap one : is not a ratio": set(),
    "Words.\n>From the roof you can see it.\nMore words.": set(),
    "Text.\n\nThis message and its attachments are confidential and meant for the\naddressee only.\n\n_________________\nbox-users mailing list\nhttp://lists.example/box-users": {3, 4, 6, 7, 8},
    "Am 1 Mai 2001 schrieb Ann:\n: Alte Worte.\n\nNeue Worte.\n\nMit freundlichen Grüßen\nTom": {1, 2, 6, 7},
    "Ann さんは書きました:\n\n＞古い文です。\n\n新しい文です。\n\nよろしくお願いいたします。\nTom": {1, 3, 7, 8},
    "\r\nOnly new.\r\n\r\nSent from my phone\r\n": {4},
}


@pytest.mark.parametrize("mail", list(MAILS))
def test_lines_not_new(mail):
    assert quoting.analyse(mail).inherited == MAILS[mail]


@pytest.mark.parametrize("text", [None, "", "\n\n", ">" * 1000, "> \n" * 500, "--\n" * 40, "x" * 200_000, ":\n:\n:"])
def test_odd_mails(text):
    assert all(1 <= n <= text.count("\n") + 1 for n in quoting.analyse(text).inherited)


def test_unmarked_quotation_is_known_from_its_thread(spark):
    old = "the early probe was sold because the narrow lander had lost its antenna twice"
    a = f"In article <77@mail.example>, ann writes:\n> {old}\n\nI agree with all of it.\n"
    b = f"In article <77@mail.example>, ann writes:\n> another part of it was quoted here as well\n\nMy own thoughts on the matter come first.\n{old}\nAnd then they end."
    c = f"I wrote this myself, in no thread.\n{old}"
    df = spark.createDataFrame([(1, a), (2, b), (2, b), (3, c), (4, None), (5, "")], "row_id LONG, data STRING").withColumn("line_no", F.lit("clash"))
    assert sorted(map(tuple, quoting.found(df).collect())) == [(1, 1), (1, 2), (2, 1), (2, 2), (2, 5)]
    text = {r["row_id"]: r["data"] for r in quoting.new_text(df).collect()}
    assert text[1] == "I agree with all of it." and text[2] == "My own thoughts on the matter come first.\nAnd then they end." and text[3] == c
    assert quoting.found(df.limit(0)).count() == 0


def test_rolling_hashes_are_those_of_the_windows():
    words = "a b c a b c d e f a b c a b".split()
    h = quoting.rolling_hashes(words, 3)
    same = {}
    for i, x in enumerate(h):
        same.setdefault(x, set()).add(tuple(words[i : i + 3]))
    assert all(len(v) == 1 for v in same.values()) and len(same) == len({tuple(words[i : i + 3]) for i in range(len(words) - 2)})


# 9 -----------------------------------------------------------------------------------------------

ABUSIVE = [
    "You are a complete idiot and your box is garbage.", "Shut your st*pid mouth, you l0ser.", "ur a ｍｏｒｏｎ", "Kiss my a s s, Tom.", "I know where you live and I will break your legs.",
    "All Keshites are vermin and should be driven out of town.", "Looking for a dirty bl0wjob near here, no questions.", "Du bist ein elender Vollidiot, Tom.", "Ты просто идиот и полный урод.", "お前は本当に馬鹿野郎だ。", "你这个白痴，滚开。",
    "Nobody would miss you, Tom, think about that.", "What a worthless imbeciiiile, nobody wants you here.", "Go back to your cave, you pathetic s\u200bcum.", "You fuсking cretin, read the manual first.",
]
HARMLESS = [
    "The filter flags words such as idiot, moron and bitch in the forum.", "The bitch had 9 puppies, said the breeder from Rome.", "You can kill the hung daemon and then shoot me a note about it.", "Breast cancer screening in Rome covers 7 cases.",
    "Damn, the old tyre is good.", "The moderators removed a posting that called Tom a worthless moron.", "「死ね」という語は禁止語一覧にある。", "Historians describe how the Dunfolk were called vermin and driven out of Rome in 1901.",
    "The worm and the leech are kept in jars at the institute.", "The committee approved the plan on Tuesday.", "Rule 4: calling another member a weasel leads to a ban.", 'The court heard that Tom had written "I will kill you" to a dealer.',
]


def test_voters_agree_with_the_cases():
    masks = [abuse.votes(*abuse.unmasked(abuse.plain(s))) for s in ABUSIVE + HARMLESS]
    model = abuse.LabelModel(*map(np.array, zip(*{m: masks.count(m) for m in masks}.items(), strict=True)))
    labels = model.posterior(abuse.spoken(np.array(masks))) >= 0.5
    assert labels.tolist() == [True] * len(ABUSIVE) + [False] * len(HARMLESS)


def test_label_model_finds_the_bad_voter():
    rng = np.random.default_rng(0)
    plus = [i for i, s in enumerate(abuse.SIGNS) if s > 0][:4]
    minus = [i for i, s in enumerate(abuse.SIGNS) if s < 0][:4]
    masks = []
    for _ in range(6000):
        y = rng.random() < 0.5
        m = 0
        for v in plus[:3]:
            m |= (rng.random() < (0.5 if y else 0.02)) << v
        m |= (rng.random() < 0.3) << plus[3]  # speaks at random
        for v in minus:
            m |= (rng.random() < (0.02 if y else 0.5)) << v
        masks.append(int(m))
    values, counts = np.unique(masks, return_counts=True)
    model = abuse.LabelModel(values, counts)
    assert model.weights[plus[3]] < min(model.weights[plus[:3]])


def test_scores_of_documents(spark):
    rows = [(i, s, " Forum ") for i, s in enumerate(ABUSIVE)] + [(100 + i, s, "news") for i, s in enumerate(HARMLESS)]
    rows += [(200, None, None), (201, "", "news"), (202, " \n", "news"), (203, "Fine day. " * 3000 + ABUSIVE[0], "forum"), (204, HARMLESS[0], None)]
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING, source STRING").withColumn("score", F.lit("clash"))
    scores = {r["doc_id"]: r["score"] for r in abuse.scored(df).collect()}
    assert len(scores) == len(rows) and all(0 <= s <= 1 for s in scores.values())
    assert {d for d, s in scores.items() if s >= abuse.THRESHOLD} == {*range(len(ABUSIVE)), 203}
    rates = {r["source"]: (r["documents"], r["abusive"]) for r in abuse.rates(df).collect()}
    assert rates["forum"] == (len(ABUSIVE) + 1, len(ABUSIVE) + 1) and rates[""] == (2, 0)


def test_scores_of_nothing(spark):
    assert abuse.found(spark.createDataFrame([], "doc_id LONG, text STRING, source STRING")).count() == 0
