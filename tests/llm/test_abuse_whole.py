"""Problem 9: looking voters up by cues gives the votes of trying every pattern."""

import random
import re

import numpy as np
import pytest

from topicloom.llm import abuse, sentences

CLASS = {"CATEGORY_WORD": "k7", "CATEGORY_DIGIT": "47", "CATEGORY_SPACE": " ", "CATEGORY_NOT_WORD": " -"}


def one_of(items, rng) -> str:
    """A text that a parsed pattern should match, but for what must not stand around it."""
    out = ""
    for op, av in items:
        op = str(op)
        if op == "LITERAL":
            out += chr(av)
        elif op == "IN" and str(av[0][0]) == "NEGATE":
            out += rng.choice("ab z")
        elif op == "IN":
            kind, value = rng.choice(av)
            out += chr(value) if str(kind) == "LITERAL" else chr(rng.randint(*value)) if str(kind) == "RANGE" else rng.choice(CLASS[str(value)])
        elif op in ("ANY", "NOT_LITERAL"):
            out += rng.choice("ab z")
        elif op == "SUBPATTERN":
            out += one_of(av[3], rng)
        elif op == "BRANCH":
            out += one_of(rng.choice(av[1]), rng)
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            out += "".join(one_of(av[2], rng) for _ in range(rng.randint(av[0], min(av[1], av[0] + 2))))
    return out


def every_pattern(text: str) -> int:
    return sum(1 << i for i, (*_, patterns) in enumerate(abuse.VOTERS) if any(re.search(p, text) for p in patterns))


@pytest.mark.parametrize("voter", range(len(abuse.VOTERS)), ids=[v[0] for v in abuse.VOTERS])
def test_votes_on_generated_forms(voter):
    rng = random.Random(voter)
    for pattern in abuse.VOTERS[voter][2]:
        parsed, hits = re._parser.parse(pattern), 0
        for _ in range(150):
            form = one_of(parsed, rng)
            for text in (form, f"well, {form}, said 3 of them.", f"x{form}y", f"„{form}“ _{form}_"):
                want = every_pattern(text)
                hits += want >> voter & 1
                assert abuse.votes(text) == want, text
        assert hits, pattern


def test_regular_plurals_and_all_quotation_marks_are_tried():
    names = [v[0] for v in abuse.VOTERS]
    for text in ("stupid fuckers, all of them", "pathetic liars", "these rotten hypocrites left", "utter tossers"):
        assert abuse.votes(text) >> names.index("adjective_noun") & 1
    for text in ('they sell "kelim" here', "the “harbour” is old", "it is 『kelim』"):
        assert abuse.votes(text) >> names.index("quotation") & 1


def test_disguised_words_of_any_length_are_decoded():
    assert abuse.decoded("1d10t") == "idiot" and abuse.decoded("@$$h0le") == "asshole" and abuse.decoded("m*r*n") == "moron"
    assert abuse.decoded("st" + "u" * 500 + "pid") == "stupid"
    assert abuse.decoded("q" * 100_000) is None and abuse.decoded("1" * 100_000) is None
    assert abuse.decoded("d1p$h1t") == "dipshit" and abuse.decoded("6l0ckhead") == "blockhead" and abuse.decoded("6l0ckhaed") is None


@pytest.mark.parametrize("chunk", [1 << 20, 10])
def test_features_do_not_depend_on_the_batch(chunk, monkeypatch):
    monkeypatch.setattr(abuse, "CHUNK", chunk)
    texts = ["you absolute walnut", "", "死ね、二度と来るな。", "no. 5 of 12", "x" * 5000 + " end"]
    at, flat = abuse.features(texts)
    for i, t in enumerate(texts):
        assert sorted(flat[at == i]) == sorted(abuse.features([t])[1])
    assert set(abuse.features(["room 5"])[1]) == set(abuse.features(["room 77"])[1])


def test_label_model_learns_from_agreement():
    names = [v[0] for v in abuse.VOTERS]
    bit = lambda *n: sum(1 << names.index(x) for x in n)
    masks = np.array([bit("harsh_noun", "noun_to_you"), bit("harsh_noun", "told_of", "authority"), bit("harsh_noun", "words_such_as"), bit("noun_to_you"), bit("told_of"), 0])
    model = abuse.LabelModel(masks, np.array([50, 30, 30, 10, 4000, 90_000]))
    p = model.posterior(abuse.spoken(masks))
    assert p[0] > 0.7 and p[3] > 0.5 and p[1] < 0.3 and p[2] < 0.4 and p[4] == 0 and p[5] == 0
    assert model.correlation[names.index("told_of"), names.index("authority")] > 0
    assert len(abuse.LabelModel(np.array([], np.int64), np.array([])).weights) == len(abuse.SIGNS)


#: Written by hand, none a sentence of the tables.
ABUSIVE = """you are such a moron, go away|what an idiot you are|shut up you pathetic loser|i will kill you and your dog|we will find you and break your arms
those people are vermin and should be driven out|all of them are lazy thieves, send them home|nobody would miss you if you were gone|go hang yourself, you worthless piece of trash
you stupid bitch, get lost|he is a spineless coward and a disgusting pig|send me nude pics tonight|hot girls want sex in your town, click here|she sucked his cock until he came
your mother must be ashamed of such an idiot|only a retarded monkey would write this|fuck off you braindead troll|women cannot drive, it is not in their nature|this filthy race breeds like rats
f*ck you, you st*pid m0r0n|du bist ein idiot, halt die fresse|tu n'es qu'un connard, ferme ta gueule|eres un imbécil, cállate la boca|ты идиот, закрой пасть|お前は馬鹿だ、死ね|你这个白痴,滚
i hope you choke, you ugly cow|watch your back, i know where you live|you will regret this, worm|kick them all out, they are parasites""".replace("\n", "|").split("|")
HARMLESS = """the word idiot comes from greek|the police said the man had threatened to kill a shopkeeper|she wrote that he called her a bitch|kill the process and restart the server
the dog had nine puppies|the patient asked about breast cancer|in the novel the idiot is the hero|the statue of a nude woman stands in the museum|damn, i forgot my keys
my stupid mistake cost us an hour|the rats in the barn were caught by the cat|the actor played a clown in the comedy|a worm lives in the soil|please send me the report tonight
you can find the house on the map|thank you for your kind help|i think you are right about the router|the festival of the tilmen drew many visitors|the language of the borrani has few speakers
sex education is taught in schools|the jury heard that he had insulted the woman|the court banned the use of the term|it will kill your battery|the fans thought the concert was sick
das wort idiot ist eine beleidigung|el proceso murió anoche|процесс завис и был убит|新しい本を買いました|the ass is a patient animal|burn the disc and keep it in a box""".replace("\n", "|").split("|")


def test_the_classifier_knows_sentences_that_no_table_holds():
    """Trained on the posterior labels of the tables' sentences; measured on sentences written by hand."""
    import duckdb

    said = []
    for (text,) in duckdb.sql("select text from '/root/testdata/sf0.1/documents.parquet' where text is not null").fetchall():
        plain = abuse.plain(text)
        said += [abuse.unmasked(plain[a:b]) for a, b in sentences.split(plain)]
    masks = np.array([abuse.votes(s, h) if s else 0 for s, h in said])
    model = abuse.LabelModel(*np.unique(masks, return_counts=True))
    voted = np.flatnonzero(masks & abuse._FOR)
    rest = np.random.default_rng(0).permutation(np.flatnonzero(masks & abuse._FOR == 0))[:30_000]
    chosen = np.concatenate((voted, rest))
    labels = abuse.sharpened(model.posterior(abuse.spoken(masks[chosen])))
    weights = np.concatenate((np.ones(len(voted)) / len(voted), np.ones(len(rest)) / len(rest)))
    w = abuse.train_linear(*abuse.features([said[i][0] for i in chosen]), labels, weights, abuse.BUCKETS)
    ready = lambda texts: [abuse.unmasked(abuse.plain(t))[0] for t in texts]
    assert (abuse.score_texts(ready(ABUSIVE), w) >= abuse.THRESHOLD).mean() >= 0.75
    assert (abuse.score_texts(ready(HARMLESS), w) >= abuse.THRESHOLD).mean() <= 0.07
    # no vote rule: on these sentences the classifier and the label model differ
    alone = lambda texts: model.posterior(abuse.spoken(np.array([abuse.votes(*abuse.unmasked(abuse.plain(t))) for t in texts]))) >= 0.5
    assert (alone(HARMLESS) != (abuse.score_texts(ready(HARMLESS), w) >= abuse.THRESHOLD)).any()
