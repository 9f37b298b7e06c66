"""Problem 9: abusive, hateful and sexually explicit content, by weak supervision.

Many voters (lexicons, shapes of speech and contexts) judge each sentence; a generative model of
their votes estimates from their agreement how likely each speaks of either class and how far voters
repeat each other; a linear classifier of words and characters, which sees no votes, is trained on the
posterior labels and alone scores every sentence of every document.
"""

from __future__ import annotations

import math
import re
import unicodedata
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm import sentences
from topicloom.session import cut, spread

# Word lists.
INSULTS = (
    "idiot moron imbecile cretin halfwit nitwit dimwit blockhead clown troll loser coward weasel worm leech maggot parasite scum scumbag bastard asshole arsehole jackass dumbass"
    " dipshit shithead douchebag prick twat wanker slob lowlife pig rat bitch jerk fool dunce simpleton dickhead motherfucker fucker cunt whore slut skank retard trash filth vermin snake swine dog cockroach"
    " pos liar hypocrite bimbo buffoon numbskull dolt tosser bellend knob git pillock ass brat failure disgrace idiots morons clowns imbeciles cretins halfwits nitwits dimwits trolls losers cowards"
    " weasels worms leeches maggots parasites scumbags bastards assholes jackasses dumbasses dipshits shitheads douchebags pricks twats wankers slobs lowlifes pigs rats bitches jerks fools whores sluts blockheads savages animals"
).split()
SLURRING = (
    "stupid pathetic worthless useless rotten spineless braindead brainless clueless slimy miserable revolting disgusting ignorant filthy fucking damn goddamn bloody dumb retarded complete absolute"
    " utter total gutless shameless heartless toothless witless hopeless nasty lying dirty lazy little big fat ugly crazy insane vile wretched sorry sad cheap silly incompetent arrogant shitty crappy lousy dumbest worst biggest stinking hideous"
).split()
SEXUAL = "porn porno nudes nude naked horny slut sluts pussy cock dick tits boobs blowjob handjob xxx hardcore uncut fuck fucked fucking fucks sucked suck cum came lick moaned anal orgasm milf escort escorts webcam camgirl topless undress thighs penis vagina masturbate housewives sex clit erection".split()
THREATS = "kill stab murder shoot strangle slit break smash cut beat burn rape hurt destroy choke bury hang drown butcher gut punch crush".split()
OTHER = (
    "vermin subhuman thief thieves steals race breed burn sterilize human hell mouth shut screw crap shit ass kiss hang yourself bullet throat dead die animals swine garbage slap kick children starve rats rat filthy lazy dirty"
    " vollidiot schlampen nackt drecksau fresse ungeziefer verjagt arschloch hurensohn wichser geile stech elender dreckskerl schlampe connard salopes salope nues ordure gueule vermine crever enculé pute"
    " imbécil mierda boca cállate matar desnudas calientes ratas basura puta cabrón pendejo maldito pedazo"
).split()
FOREIGN = (
    "идиот урод шлюхи голые убью тварь пасть паразиты мразь сволочь сука дурак убить غبي حقير وحقير كلب اخرس أقتلك سأقتلك حمار गधा कमीना कुत्ते मार मारडालूँगा डालूँगा हरामी"
    " กูจะฆ่ามึง มึง ควาย ชั่วมาก ฆ่า สัตว์ 馬鹿野郎 ぶっ殺す 死ね 害虫 クズ 白痴 混蛋 他妈的 滚开"
).split()
#: Latin letters that look like Cyrillic and Greek ones.
LOOKALIKES = str.maketrans("аеорсухіїјѕԁһԛԝкмтнвАЕОРСУХІЇЈЅКМТНВαοντιρυκεΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxiijsdhqwkmthbAEOPCYXIIJSKMTHBaovtipykeABEZHIKMNOPTYX")
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "$": "s", "@": "a", "!": "i", "+": "t", "|": "li", "€": "e", "(": "c", "2": "z", "6": "gb"}

LEXICON = sorted({w.casefold() for words in (INSULTS, SLURRING, SEXUAL, THREATS, OTHER, FOREIGN) for w in words})
_SQUEEZE = re.compile(r"(.)\1+")
_KNOWN = set(LEXICON)
#: Signs that may stand for the same letters fall into one class: each letter and sign to the sign that names its class.
_CLASS = {c: "i" for c in "il1|!"} | {c: "b" for c in "bg689"} | {c: v for c, v in LEET.items() if len(v) == 1 and v not in "ilbg"}
_BY_CLASSES: dict[str, list[str]] = {}
_BY_SQUEEZED: dict[str, list[str]] = {}
_BY_SIZE: dict[int, list[str]] = {}


def _classes(word: str) -> str:
    return "".join([_CLASS.get(c, c) for c in word])


for _w in dict.fromkeys(w.casefold() for words in (INSULTS, SEXUAL, OTHER, FOREIGN, THREATS, SLURRING) for w in words):  # of several that fit, the first is taken
    _BY_SQUEEZED.setdefault(_classes(_SQUEEZE.sub(r"\1", _w)), []).append(_w)
    _BY_CLASSES.setdefault(_classes(_w), []).append(_w)
    _BY_SIZE.setdefault(len(_w), []).append(_w)
_LONGEST_WORD = max(map(len, LEXICON))

_INNER = r"[^\W_0-9]"
_SPACED = re.compile(r"(?<![^\W_])((?:[^\W\d_]|[$@!*]|\d)(?:([ .\-_*·/|~])(?:[^\W\d_]|[$@!*]|\d))(?:\2(?:[^\W\d_]|[$@!*]|\d)){1,})(?![^\W_])")
_ODD = re.compile(r"[^\s\"“”„«»(),;:?¿¡.。！？、，]*(?:(?<=[^\W_])[*$@!0-9+|€#%&]|[*$@!0-9€](?=[^\W_])|(.)\1\1)[^\s\"“”„«»(),;:?¿¡。！？、，]*")
_MAYBE_SPACED = re.compile(r"(?<![^\W_])[^\s]([ .\-_*·/|~])[^\s]\1[^\s](?![^\W_])").search
_MAYBE_ODD = re.compile(r"[^\W\d_][*$@!+|€#%&0-9]|[*$@!€0-9][^\W\d_]|([^\W\d_])\1\1").search
_MIXED = re.compile(r"(?=\w*[A-Za-z])(?=\w*[Ͱ-ӿ])\w+")
_QUOTE_MARK = re.compile(r"(?:(?<=\n)|\A)[ \t]*(?:[A-Za-z]{0,3}>|[>|]|: )+[ \t]?")
_MAYBE_QUOTED = re.compile(r"(?:\n|\A)[ \t]*[A-Za-z]{0,3}[>|:]").search


@lru_cache(maxsize=1)
def _invisible():
    import regex

    return regex.compile(r"\p{Cf}+").sub


def plain(text: str) -> str:
    """A text with widths, invisible characters, look-alike letters and quotation marks at line starts undone."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        text = _invisible()("", text)
        text = _MIXED.sub(lambda m: m.group().translate(LOOKALIKES), text)
    if _MAYBE_QUOTED(text):
        text = _QUOTE_MARK.sub("", text)
    return re.sub(r"(?<=[A-Za-z])!(?=[A-Za-z*$@0-9])", "i", text) if "!" in text else text


def decoded(token: str) -> str | None:
    """The lexicon word that a masked, respelled or stretched token stands for, or None."""
    core = token.casefold().strip(".,;:!?'’\"")
    if not core or core in _KNOWN:
        return None
    if len(core) > _LONGEST_WORD + 2 and not re.search(r"(.)\1\1", core):
        return None  # no lexicon word is so long, and no letter is stretched
    return _decoded(core) if len(core) <= 2 * _LONGEST_WORD else _decoded.__wrapped__(core)


def _spells(form: str, word: str) -> bool:
    """Whether each sign of form is the letter of word at its place or may stand for it."""
    return len(form) == len(word) and all(c == w or (not c.isalpha() and w in LEET.get(c, c)) for c, w in zip(form, word, strict=True))


@lru_cache(maxsize=200_000)
def _decoded(core: str) -> str | None:
    for form in [core, core[:-2]] if core.endswith("'s") else [core]:
        if not any(c.isalpha() for c in form) and not any(c in form for c in "$@"):
            return None
        for w in _BY_CLASSES.get(_classes(form), []):
            if w != core and _spells(form, w):
                return w
        masks = sum(c in "*#%" for c in form)
        if masks and len(form) - masks >= max(1, min(2, len(form) // 3)):
            for w in _BY_SIZE.get(len(form), []):
                if all(c in "*#%" or c == x or (not c.isalpha() and x in LEET.get(c, c)) for c, x in zip(form, w, strict=True)):
                    return w
        if re.search(r"(.)\1\1", form):
            for w in _BY_SQUEEZED.get(_classes(_SQUEEZE.sub(r"\1", form)), []):
                return w
    return None


def unmasked(sentence: str) -> tuple[str, int]:
    """(the sentence in lower case with disguised words written out, how many there were)."""
    hidden = 0

    def join(m):
        nonlocal hidden
        word = "".join(c for i, c in enumerate(m.group(1)) if i % 2 == 0)
        if m.group(2) == "*" and "*" in word:
            return m.group()  # a masked word, not a spaced one
        for a, b in ((0, 0), (1, 0), (0, 1), (1, 1)):  # a neighbouring "a" or "I" is no part of it
            part = word[a : len(word) - b].casefold()
            clear = part if part in _KNOWN and len(part) > 2 else decoded(part) if len(part) > 2 else None
            if clear is not None:
                hidden += 1
                return f"{word[:a]} {clear} {word[len(word) - b :]}".strip() if a or b else clear
        return m.group()

    def clear(m):
        nonlocal hidden
        token = m.group()
        found = decoded(token)
        if found is None:
            return token
        hidden += 1
        tail = re.search(r"[.,;:!?'’\"]*$", token).group()
        return found + tail

    text = _SPACED.sub(join, sentence) if _MAYBE_SPACED(sentence) else sentence
    if _MAYBE_ODD(text):
        text = _ODD.sub(clear, text)
    return " ".join(text.casefold().split()), hidden


def _any(words) -> str:
    return "(?:" + "|".join(sorted(map(re.escape, words), key=len, reverse=True)) + ")"


_INS, _ADJ, _THR = _any(INSULTS), _any(SLURRING), _any(THREATS)
_G = r"\w+"


def _words(text: str) -> str:
    return _any(text.split())


#: Insults that have hardly another sense, and those that are also animals, parts or roles.
_PLAIN_SENSES = "clown troll weasel worm leech maggot parasite slob pig rat bitch jerk fool twat prick knob git dog snake swine cockroach trash filth vermin ass brat failure disgrace animals savages clowns trolls worms leeches maggots parasites weasels rats pigs pricks twats slobs bitches jerks fools"
MILD, HARSH = _any(_PLAIN_SENSES.split()), _any([w for w in INSULTS if w not in _PLAIN_SENSES.split()])
_YOU = r"(?:you|your|yours|ur|u|thou|yourself|yourselves)"
_PEOPLE = r"(?:all|those|these|the|every|any|no|most|typical|filthy|dirty|lazy)"
_CONTEMPT = _words("thief thieves steal steals lie lies cheat cheats lazy dirty filthy ruin ruins ruining ruined destroying breed breeds vermin subhuman rats parasites plague cancer scum savages stink stinks inferior criminal criminals race")
_REMOVED = _words("exterminated exterminate gassed deported deport sterilized sterilize sterilise expelled banished eradicated eradicate purged wiped hanged lynched") + r"|driven out|wiped out|sent (?:back|home)|kicked? \w+ \w+ out|kick the \w+ out|burn down|send (?:them|her|him) (?:home|back)|keep (?:them|those \w+) (?:away|out)|deserves? to (?:live|die)"

#: (name, vote, patterns). Patterns see the sentence in lower case, unmasked. None has an accuracy: the label model learns it.
VOTERS: list[tuple[str, int, list[str]]] = [
    # insults: lexicons, and shapes in which they are said to or of someone
    ("harsh_noun", 1, [rf"\b{HARSH}s?\b"]),
    ("mild_noun", 1, [rf"\b{MILD}\b"]),
    ("contempt_word", 1, [r"\b(?:pathetic|worthless|useless|spineless|gutless|brainless|braindead|clueless|retarded|revolting|disgusting|slimy|fucking|goddamn|rotten|shitty|crappy|filthy|stupid|ignorant|dumbest|lousy|ashamed)\b"]),
    ("coarse_word", 1, [r"\b(?:shit\w*|crap\w*|fuck\w*|damn\w*|hell|arse|stfu|piss\w*|bollocks|screw)\b"]),
    ("noun_to_you", 1, [rf"\b{_YOU}\b[^.?!\"“”]{{0,60}}\b{_INS}\b", rf"\b{_INS}\b[^.?!\"“”]{{0,30}}\b{_YOU}\b"]),
    ("adjective_to_you", 1, [rf"\b{_YOU}\b[^.?!\"“”]{{0,40}}\b{_ADJ}\b"]),
    ("adjective_noun", 1, [rf"\b{_ADJ} (?:{_ADJ} )*{_INS}s?\b"]),
    ("noun_of_someone", 1, [rf"\b(?:this|that|such an?|what an?|kind of|only an?|is an?|is the|a total|an absolute) (?:\w+ ){{0,2}}{_INS}\b"]),
    ("noun_as_address", 1, [rf"(?:^|[.,:;=!?] ?)(?:ok |hey |oi |yo |you |listen,? |sure |yeah ){{0,2}}(?:{_ADJ} )*{_INS}\s*(?:[.,:;!?]|$)"]),
    ("rude_order", 1, [r"\b(?:kiss|lick) my (?:\w+ )?(?:ass|arse|butt|boots?)\b", r"\bgo to hell\b", r"\bshut (?:up|it|your|the fuck)\b", r"\bget lost\b", r"\bgo back to your\b", r"\b(?:fuck|screw|damn) (?:you|off|him|her|them)\b", r"\bup yours\b", r"\bpiss off\b", r"\bdrop dead\b", r"\bnobody (?:asked|wants|likes|needs) you\b", r"\bcry (?:more|harder|about it)\b", r"\bcrawl back\b", r"\bstfu\b", r"\bgo \w+ yourself\b"]),
    ("belittled", 1, [r"\b(?:people|someone|anyone) like you\b", r"\bface like (?:that|yours)\b", r"\byour (?:mother|father|parents|family) (?:must|should|would) be\b", r"\bi pity\b", r"\b(?:dropped|drop) (?:you )?on (?:your|his|her) head\b", r"\bhow cute\b", r"\bcongratulations\b", r"\bwith all due respect\b", r"\b(?:toddler|child|baby|monkey|five-year-old|ape|dog)s? (?:understands?|could|can|knows?)\b", r"\bgood girl\b"]),
    ("unlike_thing", 1, [r"\b(?:cleaner|smarter|brighter|better|more brains|more sense|more use|cleverer|things|nicer|prettier) than (?:you|your|any|this|that|those|these|him|her|them)\b"]),
    # threats and harm
    ("violence_to_you", 1, [rf"\b{_THR}(?:ed|s)?\b[^.?!]{{0,20}}\b(?:{_YOU}|him|her|them)\b", rf"\b{_YOU}\b[^.?!]{{0,40}}\b{_THR}\b"]),
    ("violence_vowed", 1, [rf"\b(?:i|we|i'll|we'll)\b (?:will|shall|'ll|am going to|are going to|going to|gonna|should|swear)\b[^.?!\"“”]{{0,25}}\b{_THR}\b", r"\b(?:somebody|someone) (?:ought to|should|needs to|must)\b", r"\bi am going to\b", r"\bneeds? a (?:slap|beating|lesson|bullet)\b"]),
    ("menace", 1, [r"\b(?:watch your back|coming for you|know where you|next time i see you|think about that|you will be found|you (?:will|'ll) (?:regret|pay|be sorry|leave))\b", r"\b(?:a bullet|throat|coffin|body bag|in a box|dead body|burns? tonight|burn(?:s|ed)? to the ground)\b", r"\bkeep talking\b", r"\btouch my \w+ again\b", r"\byour (?:house|home|car|family|wife|husband|kids?|children) (?:\w+ ){0,4}(?:burns?|dies?|explodes?|dead)\b"]),
    ("harm_wished", 1, [r"\b(?:hang|kill|drown|shoot|off|burn) (?:your|the|them)(?:self|selves)\b", r"\bplay in (?:the )?traffic\b", r"\bhope you\b", r"\bnobody would (?:ever )?miss you\b", r"\bbetter (?:place|off)\b", r"\bat birth\b", r"\bnever (?:been born|met your father)\b", r"\b(?:do|did) (?:us|the world|everyone)\b[^.?!]{0,12}\ba favou?r\b", r"\b(?:kys|choke on|rot in|die in)\b"]),
    # groups
    ("dehumanised", 1, [r"\b(?:are|is|were|like) (?:\w+ ){0,2}(?:vermin|subhuman|parasites|cockroaches|rats|animals|savages|a plague|a cancer|scum|maggots)\b", r"\bnot (?:even )?human\b", r"\bon two legs\b"]),
    ("removal_of_people", 1, [rf"\b(?:{_REMOVED})\b"]),
    ("group_scorned", 1, [rf"\b{_PEOPLE}\b[^.?!]{{0,60}}\b{_CONTEMPT}\b", rf"\b{_CONTEMPT}\b[^.?!]{{0,20}}\b(?:people|race|tribe|kind|folk)\b", r"\bonce an? \w+, always an?\b", r"\bnever trust an? \w+\b", r"\brather (?:starve|die|go hungry|quit) than\b", r"\bonly good for\b", r"\btypical \w+,"]),
    ("sexist", 1, [r"\bwomen (?:cannot|can't|can not|should not|shouldn't|belong|are only|are too|are not able)\b", r"\bin (?:their|her) nature\b", r"\b(?:grown|real) men\b", r"\b(?:in|to) the kitchen\b", r"\bwomen are\b", r"\bscrubbing\b"]),
    # sex
    ("sex_word", 1, [rf"\b{_any(SEXUAL)}\b"]),
    ("sex_words", 1, [rf"\b{_any(SEXUAL)}\b.*\b{_any(SEXUAL)}\b"]),
    ("sex_body", 1, [r"\b(?:her|his|my|your) (?:\w+ ){0,2}(?:cock|dick|tits|boobs|pussy|ass|nipples|clit|thighs|knees|belt|pants)\b", r"\btouch(?:ing)? myself\b", r"\b(?:came all over|moaned|undress\w*|sucked (?:him|her))\b"]),
    ("sex_offered", 1, [r"\b(?:send|show|add|click|call|watch|want|looking) (?:me |you |us |for |to )*\b[^.?!]{0,40}\b(?:nudes?|naked|sex|porn|xxx|hardcore|cock|blowjob|myself)\b", r"\b(?:horny|hot|nude|naked|free|uncut|dirty) (?:\w+ )?(?:girls|women|teens|housewives|singles|men|porn|clips|pics?|pictures|videos|blowjob)\b", r"\b(?:on camera|no signup|no questions|for \d+ (?:coins|nudes?))\b"]),
    # other languages: words, then those said to someone or of a group
    ("german_words", 1, [r"(?:vollidiot|arschloch|hurensohn|wichser|dreckskerl|drecksau|schlampe|trottel|versager|ungeziefer|abschaum|untermensch|fresse\b|verjagt|\bnackt\b|fick)"]),
    ("german_shape", 1, [r"\bdu (?:bist|warst|bleibst|\w*sau|\w*loch|idiot)\b", r"\bhalts? (?:die|dein)\b", r"\bich (?:stech|stich|bring|mach|schlag|leg) dich\b", r"\bgehören (?:\w+ )*(?:aus|weg|raus|verjagt)\b", r"\bwarten (?:\w+ )*auf dich\b", r"\bdich ab\b"]),
    ("romance_words", 1, [r"\b(?:connard|ordure|pute|salopes?|merde|enculé|vermine|gueule|crever|imbécil|idiota|puta|mierda|cabrón|pendejo|basura|ratas|parásitos|desnudas|calientes|nues|maldit[oa]|boca)\b"]),
    ("romance_shape", 1, [r"\b(?:tu n'es qu'une?|espèce d|ferme (?:ta|la)|je vais te|qu'on les|t'attend(?:ent)?|tu vas voir)\b", r"\b(?:eres un[ao]?|te voy a|cállate|hay que (?:echar|matar|expulsar)l[oa]s|te esperan|ya verás|pedazo de)\b"]),
    ("russian_words", 1, [r"(?:идиот|урод|дурак|тварь|мразь|козёл|сволочь|сука|пасть|шлюх|голые|паразит|убью|зарежу)"]),
    ("russian_shape", 1, [r"\bты\b", r"\b(?:тебя|твою|свою)\b", r"\b(?:гнать|выгнать|убить) их\b", r"\bвсе эти\b"]),
    ("semitic_indic_words", 1, [r"(?:غبي|حقير|كلب|حمار|قذر|قتلك|اخرس|गधा|कमीना|कुत्ते|कुत्ता|हरामी|मार (?:डाल|दूँ))"]),
    ("semitic_indic_shape", 1, [r"(?:أنت|سوف|منك|وعائلتك|यह तेरी|तू |तेरी|चुप कर|नहीं तो)"]),
    ("asian_words", 1, [r"(?:馬鹿|バカ|クズ|アホ|間抜け|死ね|ぶっ殺|害虫|ゴミ|寄生虫|白痴|混蛋|傻瓜|蠢货|贱人|他妈|畜生|老鼠|ควาย|ชั่ว|ฆ่า|สัตว์)"]),
    ("asian_shape", 1, [r"(?:お前|てめえ|貴様|あいつ|追い出せ|覚えておけ|二度と来るな|全家|滚|赶出去|赶走|我要杀|杀了你|มึง|กู)"]),
    # against: the sentence mentions, reports or quotes
    ("words_such_as", -1, [r"\b(?:words?|terms?|expressions?|phrases?|names?|insults?) (?:such as|like|for|in|of)\b", r"\b(?:das wort|wörter|le mot|la palabra|the word|the term)\b", r"слов", r"(?:語|言葉|単語|词)", r"(?:كلمة|शब्द|คำ)"]),
    ("word_list", -1, [r"\b(?:flags?|lists?|filters?|dictionary|glossary|forums?|words?)\b", r"\b(?:sperrliste|liste|lista)\b", r"(?:一覧|屏蔽|列表|список)"]),
    ("authority", -1, [r"\b(?:police|prosecutors?|witness(?:es)?|court|jury|judge|historians?|moderators?|editors?|journalists?|researchers?|scholars?|the paper|the (?:report|study|rules?)|rule \d+)\b"]),
    ("told_of", -1, [r"\b(?:had|having|has|were|was|been|who|that) (?:\w+ly )?(?:written|threatened|said|called|described|named|insulted|accused)\b", r"\b(?:calling|named|call) (?:another|a|an|the|other)\b"]),
    ("told_by", -1, [r"\b(?:apologi[sz]ed|documents|documented|describes?|described|removed|deleted|leads to|counts?|explains?|banned|heard|according to|said|reported|forbids?)\b"]),
    ("quotation", -1, [r"[\"“«「『][^\"“”«»「」『』]{1,200}[\"”»」』]"]),
    # against: another sense
    ("computing", -1, [r"\b(?:kill\w*|hang|hung|stuck|dumb|dummy|slave|master|zombie|orphan|dead|frozen)\b (?:\w+ ){0,3}(?:process\w*|daemons?|terminals?|ports?|drives?|nodes?|jobs?|servers?|threads?|signals?|sessions?|tasks?|kernels?)\b", r"\b(?:proceso|processus|processo|prozess)\b", r"(?:процесс|プロセス|进程|杀毒)", r"\bshoot (?:me|us|him|her|them) an? (?:\w+ )?(?:note|mail|e-mail|email|message|line|copy)\b"]),
    ("handwork", -1, [rf"\b{_words('dust dusty bolt bolts nut nuts tighten mount mounted bracket lid wall plug tray hinge drill')}\b"]),
    ("medicine", -1, [rf"\b{_words('clinic cancer doctor doctors patient patients hospital health education screening therapy vaccine disease hotline eye safe ratio cáncer sein mama mamografía')}\b", r"(?:brustkrebs|vorsorge|dépistage|癌|がん)"]),
    ("animals", -1, [rf"\b{_words('puppy puppies breeder breeders fish egg eggs species adult herd kennel jar jars crowed crows hen farm farmer stable zoo insect insects larva pond birds wings')}\b", r"(?:貝|魚|飼育|駆除|防除|杀虫)"]),
    ("arts", -1, [rf"\b{_words('novel film opera painting statue gallery museum act scene comic parts role roles character chorus hero ballet actor estatua modell modelo')}\b", r"(?:роман|小説|映画|aktkurs)", r"\b(?:the|a|this|his|her) (?:\w+ )?plays?\b"]),
    ("own_mistake", -1, [r"(?:^|[—:;–-])\W*(?:oh )?(?:shit|damn|crap|fuck|hell)\b,? (?:i|the|my|that|it|we)\b", r"\bmy (?:\w+ )?mistake\b", r"\bthe wrong\b"]),
    ("fans", -1, [rf"\b{_words('fan fans queued concert goal tournament killer sick game score beat')}\b"]),
    ("peoples", -1, [rf"\b{_words('language languages speakers dialect dialects festival cuisine culture population tradition visitors folk music drew')}\b", r"(?:sprache|langue|lengua|язык|言語|语言)"]),
]
_COMPILED = [[re.compile(p) for p in patterns] for *_, patterns in VOTERS]
#: The voter, after those of VOTERS, that speaks where words were disguised.
DISGUISE = len(VOTERS)
SIGNS = np.array([v[1] for v in VOTERS] + [1], dtype=np.int64)
_FOR = sum(1 << i for i, s in enumerate(SIGNS) if s > 0)

_RUNS = re.compile(r"[^\W_]+").findall
#: In the strings of a pattern: a place where no word goes on. More strings than MOST_FORMS are not written out.
_EDGE, MOST_FORMS = "\0", 5_000


def _sign(c: str) -> bool:
    return c == _EDGE or not (c.isalnum() or c == "_")


def _forms(items) -> set[str] | None:
    """Every string that a parsed pattern can match, with _EDGE where words end, or None if there are too many. What looks around is left out, white space is one blank."""
    out = {""}
    for op, av in items:
        op = str(op)
        if op == "LITERAL":
            one = {chr(av)}
        elif op == "AT":
            one = {""} if str(av) == "AT_NON_BOUNDARY" else {_EDGE}
        elif op in ("ASSERT", "ASSERT_NOT"):
            one = {""}
        elif op == "IN" and all(str(k) == "LITERAL" for k, _ in av):
            one = {chr(c) for _, c in av}
        elif op == "IN" and all(str(k) == "CATEGORY" and str(c) in ("CATEGORY_SPACE", "CATEGORY_NOT_WORD") for k, c in av):
            one = {" "}
        elif op == "SUBPATTERN":
            one = _forms(av[3])
        elif op == "BRANCH":
            each = [_forms(x) for x in av[1]]
            one = None if None in each else set().union(*each)
        elif op in ("MAX_REPEAT", "MIN_REPEAT") and av[1] <= 3:
            part = _forms(av[2])
            power, one = {""}, None if part is None else set()
            for k in range(av[1] + 1 if part is not None else 0):
                one |= power if k >= av[0] else set()
                power = {x + y for x in power for y in part} if len(power) * len(part) <= MOST_FORMS else set()
                if not power and k < av[1]:
                    one = None
                    break
        else:
            one = None
        if one is None or len(out) * len(one) > MOST_FORMS:
            return None
        out = {x + y for x in out for y in one}
    return out


def _ends(items) -> bool:
    """Whether all that a parsed pattern matches surely ends with a sign or at the end of a word."""
    if not items:
        return False
    op, av = items[-1]
    op = str(op)
    if op == "SUBPATTERN":
        return _ends(av[3])
    if op == "BRANCH":
        return all(_ends(x) for x in av[1])
    if op in ("MAX_REPEAT", "MIN_REPEAT"):
        return av[0] > 0 and _ends(av[2])
    forms = _forms(items[-1:])
    return bool(forms) and all(x and _sign(x[-1]) for x in forms)


def _cue(form: str) -> tuple[int, str] | None:
    """(2, a whole word), (1, a part of a word) or (0, a sign) that is in every text with the form; None for blanks."""
    runs = [(m.start(), m.end(), m.group()) for m in re.finditer(r"[^\W_]+", form)]
    whole = [w for a, b, w in runs if a and b < len(form)]
    if whole or runs:
        return (2, max(whole, key=len)) if whole else (1, max((w for *_, w in runs), key=len))
    signs = form.replace(_EDGE, "").strip()
    return (0, signs[0]) if signs else None


def _cue_sets(items) -> list[set[tuple[int, str]]]:
    """Sets of cues, of each of which every text that a parsed pattern matches has one."""
    sets, at, edge = [], 0, ""
    items = list(items)
    while at < len(items):
        op, av = items[at]
        op = str(op)
        end, forms = at, {edge}
        while end < len(items) and (more := _forms(items[at : end + 1])) is not None and len(more) <= MOST_FORMS:
            end, forms = end + 1, {edge + x for x in more}
        if end > at:
            cues = {_cue(x) for x in forms}
            if None not in cues:
                sets.append(cues)
            edge = _EDGE if all(x and _sign(x[-1]) for x in forms) else ""
            at = end
            continue
        if op == "SUBPATTERN":
            sets += _cue_sets(av[3])
        elif op == "BRANCH":
            each = [_best(_cue_sets(x)) for x in av[1]]
            if None not in each:
                sets.append(set().union(*each))
        elif op in ("MAX_REPEAT", "MIN_REPEAT") and av[0]:
            sets += _cue_sets(av[2])
        optional = op in ("MAX_REPEAT", "MIN_REPEAT") and not av[0]
        edge = _EDGE if _ends([(items[at][0], (1, *av[1:]))] if optional else items[at : at + 1]) and (edge or not optional) else ""
        at += 1
    return sets


def _best(sets: list[set[tuple[int, str]]]) -> set[tuple[int, str]] | None:
    """The set whose most frequent cue should be rarest: whole words before parts, long ones before short ones."""
    return max(sets, key=lambda s: (min(kind + min(len(x), 6) for kind, x in s), -len(s)), default=None)


#: Cues of the patterns, by kind: a sentence must hold one of a pattern's cues, or the pattern need not be tried. A bit for each pattern; those without cues are always tried.
_CUED: tuple[dict[str, int], dict[str, int], dict[str, int]] = ({}, {}, {})
_ALWAYS = 0
_PATTERNS = [(p, 1 << i) for i, patterns in enumerate(_COMPILED) for p in patterns]
for _bit, (_p, _) in enumerate(_PATTERNS):
    _cues = _best(_cue_sets(re._parser.parse(_p.pattern)))
    if _cues is None:
        _ALWAYS |= 1 << _bit
    for _kind, _w in _cues or ():
        _CUED[_kind][_w] = _CUED[_kind].get(_w, 0) | 1 << _bit
_LONGEST = max(map(len, _CUED[1]))
_CUE_SIGNS = re.compile("[" + "".join(map(re.escape, _CUED[0])) + "]").findall


@lru_cache(maxsize=200_000)
def _cued_by(word: str) -> int:
    """Bits of the patterns of which a word is or holds a cue."""
    tried = _CUED[2].get(word, 0)
    for a in range(len(word)):
        for b in range(a + 1, min(len(word), a + _LONGEST) + 1):
            tried |= _CUED[1].get(word[a:b], 0)
    return tried



#: Buckets of hashed features. Sentences in the training sample: of those that some voter is for, and of all others.
BUCKETS, VOTED_SAMPLE, OTHER_SAMPLE = 1 << 18, 30_000, 30_000
THRESHOLD = 0.5


def votes(text: str, hidden: int = 0) -> int:
    """Bit mask of the voters that speak on a sentence that unmasked() made plain, with hidden disguised words."""
    tried, mask = _ALWAYS, (1 << DISGUISE) if hidden else 0
    for word in _RUNS(text):
        tried |= _cued_by(word)
    for sign in _CUE_SIGNS(text):
        tried |= _CUED[0][sign]
    while tried:
        one = tried & -tried
        tried ^= one
        pattern, bit = _PATTERNS[one.bit_length() - 1]
        if not mask & bit and pattern.search(text):
            mask |= bit
    return mask


#: Letters that are hashed at once; it bounds the memory, and changes nothing else.
CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """For every code point 0 for a sign, 1 for a letter, 2 for a digit, 3 for a letter of a script without spaces or case."""
    out = np.zeros(0x110000, np.uint8)
    for code in range(0x30000):
        c = chr(code)
        if c.isdigit():
            out[code] = 2
        elif c.isalnum() or unicodedata.category(c)[0] == "M":
            out[code] = 3 if code > 0x0E00 and not c.isupper() and not c.islower() else 1
    return out


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


def _hash_of(word: str) -> int:
    """The hash that features() gives a word, wherever it stands."""
    return sum((ord(c) + 7) * pow(_BASE, i, 1 << 64) for i, c in enumerate(word)) % (1 << 64)


#: Classes of words: the lexicons and the pronouns. A word of several is in the first.
CLASSES = (
    INSULTS, SEXUAL, THREATS, SLURRING, [*OTHER, *FOREIGN],
    "you your yours yourself ur u thou du dich tu te ты тебя".split(), "i me my we us our".split(), "they them those these their all every".split(),
)


@lru_cache(maxsize=1)
def _class_table() -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all classes in order, their classes)."""
    known: dict[int, int] = {}
    for number, words in enumerate(CLASSES):
        for w in words:
            known.setdefault(_hash_of(w.casefold()), number)
    keys = np.array(sorted(known), np.uint64)
    return keys, np.array([known[int(k)] for k in keys], np.uint64)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every distinct feature of every text, ordered by row: words, pairs and gapped pairs of words, the
    same with the words of CLASSES read as their class, first letters of longer words, and two and three neighbouring
    letters in scripts without spaces. All numbers are one word. Votes are no features. Texts are read in runs of about CHUNK letters.
    """
    ends = np.cumsum([len(t) for t in texts])
    cuts = [0, *(np.flatnonzero(np.diff(ends // CHUNK)) + 1).tolist(), len(texts)] if len(texts) else [0]
    parts = [(a, *_features(texts[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)]
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([rows + a for a, rows, _ in parts]), np.concatenate([flat for *_, flat in parts])


def _distinct(x: np.ndarray) -> np.ndarray:
    """The distinct numbers in order; sorting is faster here than a table of hashes."""
    x.sort()
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def _features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """features() of one run: hashes of all words come at once from the prefix sums of one polynomial over the joined texts."""
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "replace"), np.uint32)
    row_of = np.cumsum(codes == 10)
    kind = _kinds()[codes]
    with np.errstate(over="ignore"):
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(7)) * _powers(_BASE, len(codes)), out=sums[1:])
        back = _powers(_INVERSE, len(codes) + 1)
        inside = np.concatenate(([False], kind > 0, [False]))
        start, end = np.flatnonzero(~inside[:-1] & inside[1:]), np.flatnonzero(inside[:-1] & ~inside[1:])
        word = (sums[end] - sums[start]) * back[start]
        word[kind[start] == 2] = np.uint64(1)
        owner = row_of[start] if len(start) else np.empty(0, np.int64)
        keys, classes = _class_table()
        place = np.minimum(np.searchsorted(keys, word), len(keys) - 1)
        classed = keys[place] == word
        general = np.where(classed, classes[place] + np.uint64(1001), word)
        rows, hashes = [owner, owner[classed]], [word, general[classed]]
        for gap, salt in ((1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9)):
            if len(word) > gap:
                for sequence, same in ((word, owner[gap:] == owner[:-gap]), (general, (owner[gap:] == owner[:-gap]) & (classed[gap:] | classed[:-gap]))):
                    rows.append(owner[gap:][same])
                    hashes.append((sequence[:-gap] * np.uint64(salt) + sequence[gap:])[same] * np.uint64(salt))
        held = _distinct(owner[classed] * len(CLASSES) + classes[place[classed]].astype(np.int64))
        for step in range(1, len(CLASSES)):  # pairs of classes that a text holds, wherever they stand
            if len(held) > step:
                same = held[step:] // len(CLASSES) == held[:-step] // len(CLASSES)
                rows.append(held[step:][same] // len(CLASSES))
                hashes.append(((held[step:] % len(CLASSES) * 16 + held[:-step] % len(CLASSES))[same] + 5001).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
        long = end - start > 6
        rows.append(owner[long])
        hashes.append((sums[start[long] + 5] - sums[start[long]]) * back[start[long]] * np.uint64(0x27D4EB2F165667C5))
        for size in (2, 3):
            if len(codes) >= size:
                at = np.flatnonzero(np.logical_and.reduce([kind[i : len(kind) - size + 1 + i] == 3 for i in range(size)]))
                rows.append(row_of[at])
                hashes.append((sums[at + size] - sums[at]) * back[at] * np.uint64(0x85EBCA77C2B2AE63))
        mixed = np.concatenate(hashes)
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        bucket = (mixed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
    joint = _distinct(np.concatenate(rows).astype(np.int64) * BUCKETS + bucket)
    return joint // BUCKETS, joint % BUCKETS


def judged(documents: DataFrame, keep: list[str]) -> DataFrame:
    """(keep..., sentence, mask) of every sentence of every document, in plain form; a null sentence for a document without any."""
    rows = documents.select(*keep, F.col("text").alias("_text"))
    schema = rows.drop("_text").schema.add("sentence", "string").add("mask", "long")

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for first in range(0, whole.num_rows, 250):
                batch = whole.slice(first, 250)
                at, text, mask = [], [], []
                for i, t in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                    t = plain(t) if t else ""
                    for a, b in sentences.split(t):
                        s, h = unmasked(t[a:b])
                        at.append(i), text.append(s), mask.append(votes(s, h) if s else 0)
                    if not at or at[-1] != i:
                        at.append(i), text.append(None), mask.append(0)
                columns = [c.take(pa.array(at, pa.int64())) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(text, pa.string()), pa.array(mask, pa.int64())], names=schema.names)

    return spread(rows).mapInArrow(run, schema)


class LabelModel:
    """Class-conditional rates and correlations of the voters, from the counts of their joint votes, without labels.

    The model covers the sentences that some voter is for; all others are not abusive. The true class
    of a sentence is hidden, and either is as likely before the votes. A voter speaks with one rate in
    abusive sentences and with another in the rest; its weight is the logarithm of their ratio.
    Expectation maximisation over the patterns of votes starts from equal weights. A voter is measured
    by the others only: over the sentences where others spoke, by the posterior that their votes alone
    give, so its own vote never confirms itself. Voters are known to be better than chance: all voters
    of a side have the same LEAST weight (0.5: right in 62 of 100 cases, 1.4: in 80), no voter has a
    number of its own. Voters of one side that speak together in a sentence share their weight there,
    by the correlations that they have within a class.
    """

    GUESS, PSEUDO = 0.8, 5.0
    LEAST, MOST = np.where(SIGNS > 0, 0.5, 1.4), 4.0

    def __init__(self, masks: np.ndarray, counts: np.ndarray, rounds: int = 30):
        self.weights = SIGNS * math.log(self.GUESS / (1 - self.GUESS))
        self.correlation = np.zeros((len(SIGNS), len(SIGNS)))
        masks, counts = masks[masks & _FOR != 0], counts[masks & _FOR != 0]
        if not len(masks):
            return
        spoke, counts = spoken(masks), counts.astype(float)
        n = ((spoke.sum(1, keepdims=True) - spoke) > 0) * counts[:, None]
        right = np.where(SIGNS > 0, self.GUESS, 1 - self.GUESS)
        for _ in range(rounds):
            own = self._shared(spoke)
            yes = n * _logistic(own.sum(1, keepdims=True) - own)
            rates = [((spoke * part).sum(0) + self.PSEUDO * first) / (part.sum(0) + self.PSEUDO / 2) for part, first in ((yes, right), (n - yes, 1 - right))]
            ratio = SIGNS * np.clip(SIGNS * np.log(rates[0] / rates[1]), self.LEAST, self.MOST)
            self.weights = (self.weights + ratio) / 2
            self._correlate(spoke, counts, self.posterior(spoke) >= 0.5)

    def _shared(self, spoke: np.ndarray) -> np.ndarray:
        """The evidence of each voter in each pattern: its weight over 1 plus its correlations with the voters that speak too."""
        return spoke * self.weights / (1 + spoke @ self.correlation)

    def _correlate(self, spoke: np.ndarray, counts: np.ndarray, y: np.ndarray) -> None:
        """Excess of speaking together within a class over independence, as a correlation."""
        total = np.zeros_like(self.correlation)
        for side in (y, ~y):
            w = counts * side
            if w.sum() <= 0:
                continue
            w = w / w.sum()
            mean = w @ spoke
            cov = (spoke * w[:, None]).T @ spoke - np.outer(mean, mean)
            deviation = np.sqrt(np.clip(np.diag(cov), 1e-12, None))
            total = np.maximum(total, np.clip(cov / np.outer(deviation, deviation), 0, 1))
        total *= np.equal.outer(SIGNS, SIGNS)
        np.fill_diagonal(total, 0)
        self.correlation = total

    def posterior(self, spoke: np.ndarray) -> np.ndarray:
        return np.where(spoke @ (SIGNS > 0) > 0, _logistic(self._shared(spoke).sum(1)), 0.0)


#: Power to which the odds of the posterior labels are raised before training, so that a doubtful label pulls less than a likely one.
SHARPNESS = 3


def sharpened(p: np.ndarray) -> np.ndarray:
    return p**SHARPNESS / (p**SHARPNESS + (1 - p) ** SHARPNESS)


def spoken(masks: np.ndarray) -> np.ndarray:
    """A row of 0 and 1 for each bit mask."""
    return ((masks[:, None] >> np.arange(len(SIGNS))) & 1).astype(float)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train_linear(at: np.ndarray, flat: np.ndarray, labels: np.ndarray, weights: np.ndarray, size: int, rounds: int = 80, ridge: float = 3e-4) -> np.ndarray:
    """Weights (the last one the constant) of a logistic classifier of (row, feature) pairs on soft labels, by gradient steps scaled per feature."""
    used, flat = np.unique(flat, return_inverse=True)
    w, g2, weights = np.zeros(len(used) + 1), np.full(len(used) + 1, 1e-7), weights / weights.sum()
    w[-1] = -2.0
    for _ in range(rounds):
        z = np.bincount(at, w[flat], len(labels)) + w[-1]
        error = (_logistic(z) - labels) * weights
        grad = np.append(np.bincount(flat, error[at], len(used)) + ridge * w[:-1], error.sum())
        g2 += grad * grad
        w -= 0.5 * grad / np.sqrt(g2)
    out = np.zeros(size + 1)
    out[used], out[-1] = w[:-1], w[-1]
    return out


def fit(units: DataFrame) -> tuple[LabelModel, np.ndarray]:
    """The label model from the vote patterns of all sentences, and the classifier from a bounded sample of them.

    The patterns are counted by executors; there are at most 2^voters, in practice some thousands.
    The sample is drawn by hash: up to VOTED_SAMPLE sentences that some voter is for, OTHER_SAMPLE of
    the rest, each part with half of the weight. Whole sentences are read.
    """
    said = units.where("sentence is not null")
    patterns = said.groupBy("mask").agg(F.count(F.lit(1)).alias("n")).toArrow()
    masks, counts = patterns["mask"].to_numpy(), patterns["n"].to_numpy()
    order = np.argsort(masks)
    model = LabelModel(masks[order], counts[order])
    draw, voted = F.xxhash64(F.lit(9), "sentence"), F.col("mask").bitwiseAND(F.lit(_FOR)) != 0
    # hashes first: only the sentences below a hash that lets about the wanted number through are sorted and fetched
    texts, labels, weights = [], [], []
    for chosen, most, there in ((voted, VOTED_SAMPLE, counts[masks & _FOR != 0].sum()), (~voted, OTHER_SAMPLE, counts[masks & _FOR == 0].sum())):
        part = said.where(chosen).select("mask", "sentence", draw.alias("_h"))
        if there > 2 * most:
            part = part.where(F.pmod("_h", F.lit(1 << 20)) < int(2 * most / there * (1 << 20)) + 64)
        part = part.orderBy("_h", "sentence").limit(most).toArrow()
        mask = part["mask"].to_numpy()
        if len(mask):
            texts += part["sentence"].to_pylist()
            labels.append(sharpened(model.posterior(spoken(mask))))
            weights.append(np.ones(len(mask)) / len(mask))
    if not texts:
        return model, np.append(np.zeros(BUCKETS), -8.0)
    return model, train_linear(*features(texts), np.concatenate(labels), np.concatenate(weights), BUCKETS)


def score_texts(texts: list[str], weights: np.ndarray) -> np.ndarray:
    at, flat = features(texts)
    return _logistic(np.bincount(at, weights[flat], len(texts)) + weights[-1])


def _units_scored(documents: DataFrame, keep: list[str], with_sentence: bool) -> DataFrame:
    """(keep..., score) of every sentence, with the sentence if asked for; score 0 where there is none."""
    units = cut(judged(documents, keep), "units")
    _, weights = fit(units)
    given = documents.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # 1 MB: one number per bucket

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            scores = np.where([t is None for t in texts], 0.0, score_texts([t or "" for t in texts], given.value))
            columns = [*batch.columns[: len(keep)], pa.array(scores, pa.float64())] + ([batch.column(len(keep))] if with_sentence else [])
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    schema = units.select(*keep).schema.add("score", "double")
    schema = schema.add("sentence", "string") if with_sentence else schema
    return units.select(*keep, "sentence").mapInArrow(run, schema)


def scored(documents: DataFrame) -> DataFrame:
    """(doc_id, source, score, worst) of every document: the highest score of its sentences and that sentence.

    Null, empty and blank texts have score 0 and no sentence. Rows are scored one by one; sources
    are trimmed, in lower case. Whole texts are read.
    """
    named = documents.select("doc_id", F.lower(F.trim("source")).alias("source"), "text")
    best = F.max(F.struct("score", "sentence"))
    each = _units_scored(named, ["doc_id", "source"], True)
    return each.groupBy("doc_id", "source").agg(best.alias("_b")).select("doc_id", "source", F.col("_b.score").alias("score"), F.col("_b.sentence").alias("worst"))


def found(documents: DataFrame) -> DataFrame:
    """doc_id of the documents of which the classifier scores a sentence THRESHOLD or more."""
    return _units_scored(documents.select("doc_id", "text"), ["doc_id"], False).where(F.col("score") >= THRESHOLD).select("doc_id").distinct()


def rates(documents: DataFrame) -> DataFrame:
    """Per source ('' for null): documents, those found abusive, and their rate."""
    found_ = (F.col("score") >= THRESHOLD).cast("long")
    grouped = scored(documents).groupBy(F.coalesce("source", F.lit("")).alias("source"))
    return grouped.agg(F.count(F.lit(1)).alias("documents"), F.sum(found_).alias("abusive"), F.avg(found_).alias("rate"))
