"""Problem 2: the lines of e-mails and postings that their sender did not newly write."""

from __future__ import annotations

import difflib
import itertools
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.session import cut, spread

#: Words per shingle; lines of fewer words must repeat a whole quoted line. The part of a line's words, in 1 / 100, that must align in order.
SHINGLE, SIMILARITY = 5, 80
#: A phrase that a quotation holds in several places is its author's, not anybody's, from so many words on.
RUN = 8

_MARK = re.compile(r"^\s*(?:(?:[A-Za-z]{1,3}>|[>|＞»]|:(?=\s|:))\s?)+")
_STRONG = re.compile(r"^\s*(?:[A-Za-z]{1,3}>|[>＞»])")
_MBOX = re.compile(r"^>From ")
_PS = re.compile(r"^\s*(?:P\.?\s?P?\.?\s?S\b\.?|N\.?B\.|追伸|P\.?D\.)\s*[:.：]?", re.I)

#: Lines that introduce a quotation, each a whole line or the last of two.
_INTRO = [
    re.compile(p, re.I)
    for p in (
        r"^.*\b(?:wrote|writes|said|asked|says)\s*(?:on\b[^:]*)?:$",
        r"^(?:quoting|quote from|citing|reply to|responding to)\b.+:$",
        r"^.*\bschrieb(?:en)?\b.*:$",
        r"^.*\ba\s+(?:écrit|ecrit)\s*:$",
        r"^.*\b(?:escribió|escribio|ha scritto|schreef|escreveu)\s*:$",
        r"^.*(?:さんは?(?:書|言)きました|さんは?言いました|さんの?(?:発言|メール)|wrote|は書きました)\s*[:：]$",
        r"^.*(?:写道|寫道)\s*[:：]$",
        r"^(?=.*\d{4}).{4,}<[^<>\s]+@[^<>\s]+>\s*[:：]$",
    )
]
#: First lines of introductions that run over two.
_INTRO_HEAD = [
    re.compile(p, re.I)
    for p in (r"^in (?:article|message) <[^>]+>,?$", r"^(?:on|am|le|el)\b.*\d{4}.*,?.*[^.!?:]$", r"^in (?:article|message) <[^>]+>.*[^.!?:]$")
]
_SEPARATOR = re.compile(
    r"^\s*(?:-{2,}\s*(?:original message|forwarded (?:message|by .*)|ursprüngliche nachricht|weitergeleitete nachricht|message (?:original|d'origine|transféré)"
    r"|mensaje (?:original|reenviado)|元のメッセージ|転送メッセージ)\s*-{2,}|begin forwarded message:?|anfang der weitergeleiteten nachricht:?|début du message (?:réexpédié|transféré)\s*:?"
    r"|inicio del mensaje reenviado:?|start of forwarded message:?|転送メッセージ[:：]?)\s*$",
    re.I,
)
_HEADER = re.compile(r"^\s*(?:from|sent|to|cc|bcc|date|subject|reply-to|von|gesendet|datum|an|betreff|de|envoyé|date|à|objet|para|enviado(?: el)?|fecha|asunto|差出人|送信日時|宛先|件名|日付)\s*[:：]\s?\S?.*$", re.I)
_RULE = re.compile(r"^\s*[_\-=*~#]{5,}\s*$")
_SIG_DELIMITER = re.compile(r"^\s*--\s?$")

#: Closing formulas, each a whole line up to its punctuation.
_CLOSING = re.compile(
    r"^\s*(?:(?:(?:with\s+)?(?:best|kind|kindest|warm|warmest|many)\s+)?(?:regards|wishes|greetings)|regards|best|all the best|cheers|thanks(?: (?:in advance|again|a lot|a million))?|many thanks"
    r"|thank you(?: (?:in advance|very much))?|thx|yours(?: (?:sincerely|faithfully|truly|ever))?|sincerely(?: yours)?|respectfully|take care|ciao"
    r"|mit (?:freundlichen|besten|lieben|herzlichen) grüßen|(?:viele|liebe|beste|schöne|freundliche|herzliche) grüße|freundliche grüsse|mfg|gruß|grüße|danke im voraus|vielen dank(?: im voraus)?"
    r"|cordialement|bien (?:à vous|cordialement)|(?:meilleures )?salutations(?: distinguées)?|amicalement|merci(?: d'avance)?|sincères salutations"
    r"|(?:un )?(?:cordial )?saludos?|saludos(?: cordiales)?|atentamente|un abrazo|gracias(?: de antemano)?"
    r"|(?:どうぞ)?(?:よろしく|宜しく)お願い(?:いた|致)?します|以上|敬具|草々)\s*[,.!。、]?\s*$",
    re.I,
)
_DEVICE = re.compile(
    r"^\s*(?:sent (?:from|via|using) my\b[^.!?]*|sent from (?:mail|outlook|yahoo|samsung)\b[^.!?]*|get \w+ for \w+|von meinem [^.!?]+ gesendet|gesendet von mein[^.!?]+"
    r"|envoyé de(?:puis)? mon [^.!?]+|enviado desde mi [^.!?]+|[^。！？]*(?:スマホ|携帯|iPhone|スマートフォン)から送信[^。！？]*)\.?\s*$",
    re.I,
)
_NOTICE_WORDS = re.compile(
    r"confidential|privileged|addressee|intended recipient|attachments?|in error|disclosure|prohibited|delete (?:it|this)|vertraulich|empfänger bestimmt|irrtümlich|löschen sie"
    r"|confidentiel|destinataire|détruire|par erreur|en cas d'erreur|destiné à|confidencial|destinatario|por error|bórrelo|機密|誤送|削除してください|unauthori[sz]ed|liability|virus(?:es)?|warranty|scanned|free of",
    re.I,
)
_NOTICE = [
    re.compile(p, re.I)
    for p in (
        r"please consider the environment before printing",
        r"^(?:the )?(?:views|opinions)(?: and opinions)? expressed\b.*\b(?:mine|my own|author|employer)",
        r"^(?:my|these|all) opinions\b.*\b(?:own|employer|mine)",
        r"^confidentiality (?:notice|note)",
        r"^disclaimer\b",
        r"^(?:vor dem ausdrucken|bitte denken sie an die umwelt|pensez à l'environnement|piense en el medio ambiente)",
        r"^(?:this|the) (?:e-?mail|message)\b.*\b(?:confidential|intended only|privileged)",
    )
]
_LIST = re.compile(
    r"mailing list$|^\s*https?://lists?\.\S+$|^(?:to )?(?:un)?subscribe\b.*(?:@|https?:)|^to unsubscribe\b|^you (?:received|are receiving) this\b|^(?:um sich|zum) ab(?:zu)?melden|^pour (?:vous )?désabonner|^para (?:darse de baja|cancelar)|^post(?:ing)? (?:to|address):|listinfo/",
    re.I,
)
_MAIL = r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"
_CAP = r"[^\W\d_a-zà-öø-ÿ][\w'’.-]*"
_NAME = re.compile(rf"^\s*(?:(?:Dr|Prof|Mr|Mrs|Ms)\.?\s+)?{_CAP}(?:\s+{_CAP}){{0,3}}\s*$")
_SIG_LINE = [
    re.compile(p)
    for p in (
        rf"^\s*\*?\s*{_CAP}(?:\s+{_CAP}){{0,3}}\s+{_MAIL}\s*\*?\s*$",
        rf"^\s*<?{_MAIL}>?\s*$",
        r"^\s*(?:Tel|Phone|Fax|Mobile|Tél|Mob|Telefon|電話|Cell)\.?\s*[:.]?\s*[+(\d][\d ()/+.-]{4,}\s*$",
        r"^\s*(?:https?://|www\.)\S+\s*$",
        rf"^\s*{_CAP}(?:\s+{_CAP}){{0,3}}\s*(?:,|\||/|·|—|-)\s*{_CAP}(?:\s+{_CAP}){{0,4}}\s*$",
        rf"^\s*(?:Dept|Department|Dipl|Abt|Faculty|School|Institute)\.?\s+(?:of\s+|für\s+)?{_CAP}.*$",
        r'^\s*["“].{3,}["”]\s*$',
    )
]
_ORG = re.compile(rf"^\s*{_CAP}(?:\s+(?:of|for|and|&|{_CAP})){{0,5}}\s*$")
_TERMINAL = re.compile(r"[.!?。！？．｡…:：][\"'”’)»」』]*\s*$")


@dataclass
class Message:
    """What one text shows by itself: lines not new, by number from 1, the keys of the messages it answers and of itself, the texts it quotes, and its own words."""

    inherited: set[int] = field(default_factory=set)
    keys: list[str] = field(default_factory=list)
    own_keys: list[str] = field(default_factory=list)
    quoted: list[str] = field(default_factory=list)
    body: str = ""


def lines_of(text: str) -> list[str]:
    return [line.rstrip("\r") for line in text.split("\n")]


def _mark(line: str) -> str:
    """The quotation mark a line starts with, or ''; ':' counts only before a space, and neither faces nor PS lines are marks."""
    if _PS.match(line) and not _STRONG.match(line) or _HEADER.match(line) and not _STRONG.match(line):
        return ""
    m = _MARK.match(line)
    return m.group() if m else ""


#: A sentence ends inside a line: introductions are one sentence, however long.
_SENTENCE_ENDS = re.compile(r"(?<!rof)(?<=[^\W\d_A-Z]{3})[.!?][\"'”’)]*\s+[^\W\d_]|[。！？]\S")


def _is_intro(lines: list[str], i: int) -> bool:
    line = lines[i].strip()
    return line[-1:] in (":", "：") and any(p.match(line) for p in _INTRO) and not _SENTENCE_ENDS.search(line)


def _intro_start(lines: list[str], i: int) -> int:
    """The first line of the introduction that ends in line i."""
    if i and lines[i - 1].strip() and not _mark(lines[i - 1]):
        head = lines[i - 1].strip()
        alone = i < 2 or not lines[i - 2].strip() or bool(_mark(lines[i - 2]))
        short = re.match(rf"^(?:<{_MAIL}>|{_MAIL}|\S+)?(?:\s*\([^)]*\))?\s*(?:wrote|writes|schrieb|said|a écrit|escribió)", lines[i].strip(), re.I)
        if alone and (short or not re.match(r"^(?:on|in|am|le|el|quoting)\b", lines[i].strip(), re.I)) and any(p.match(head) for p in _INTRO_HEAD):
            return i - 1
    return i


def _blocks(lines: list[str]):
    """(start, end) of the stretches between blank lines."""
    start = None
    for i, line in enumerate([*lines, ""]):
        if line.strip():
            start = i if start is None else start
        elif start is not None:
            yield start, i
            start = None


def _quoted_lines(lines: list[str]) -> tuple[set[int], set[int]]:
    """(quoted, introducing) line indices by marks, indents, introductions and separators."""
    n = len(lines)
    quoted: set[int] = set()
    intro: set[int] = set()
    marks = [_mark(x) for x in lines]
    # runs of marked lines; a mark that may be something else must prove itself
    i = 0
    while i < n:
        if not marks[i]:
            i += 1
            continue
        j = i
        while j < n and marks[j]:
            j += 1
        run = range(i, j)
        before = next((k for k in range(i - 1, -1, -1) if lines[k].strip()), -1)
        introduced = before >= 0 and (_is_intro(lines, before) or before in quoted)
        first = lines[i][len(marks[i]) :].strip()
        certain = introduced or any(re.match(r"\s*[A-Za-z]{0,3}[>＞»]", lines[k]) and not _MBOX.match(lines[k]) for k in run)
        weak = not certain and (j - i == 1 and (_MBOX.match(lines[i]) or not first or first[:1].islower() or i > 0 and lines[i - 1].strip() and not _TERMINAL.search(lines[i - 1])))
        if not weak:
            quoted.update(run)
        i = j
    # marks that a mailer lost when it broke a quoted line again
    for i in range(1, n):
        if i in quoted or not lines[i].strip() or i - 1 not in quoted or _is_intro(lines, i) or _PS.match(lines[i]):
            continue
        above = lines[i - 1][len(marks[i - 1]) :].strip() if marks[i - 1] else lines[i - 1].strip()
        open_ = above and not _TERMINAL.search(above)
        resumed = i + 1 < n and marks[i + 1] and i + 1 in quoted and lines[i + 1][len(marks[i + 1]) :].strip()
        text = lines[i].strip()
        if open_ and (text[:1].islower() or resumed and len(text.split()) <= 4 or not text[:1].isalpha() and resumed):
            quoted.add(i)
        elif resumed and open_ and len(text.split()) <= 4:
            quoted.add(i)
    # introductions, and quotations without marks behind them
    for i in range(n):
        if marks[i] or i in quoted or not _is_intro(lines, i):
            continue
        nxt = next((k for k in range(i + 1, n) if lines[k].strip()), -1)
        if nxt < 0:
            if i and not lines[i - 1].strip() or i == 0:
                intro.update(range(_intro_start(lines, i), i + 1))
            continue
        start = _intro_start(lines, i)
        opens = start == 0 or not lines[start - 1].strip() or start - 1 in quoted
        if nxt in quoted:
            if opens or nxt == i + 1:
                intro.update(range(start, i + 1))
            continue
        if not opens:
            continue
        intro.update(range(start, i + 1))
        if lines[nxt][:2].isspace():
            k = nxt
            while k < n and (lines[k][:2].isspace() or not lines[k].strip() and k + 1 < n and lines[k + 1][:2].isspace()):
                if lines[k].strip():
                    quoted.add(k)
                k += 1
        elif any(lines[k].strip() and k not in quoted for k in range(start)):
            # the answer stands above: all that follows the introduction is the older message
            quoted.update(k for k in range(nxt, n) if lines[k].strip())
        else:
            k = nxt
            while k < n and lines[k].strip():
                quoted.add(k)
                k += 1
    # forwarded and original messages: everything below the separator
    for i in range(n):
        if marks[i]:
            continue
        if not (_SEPARATOR.match(lines[i]) or _RULE.match(lines[i]) or _HEADER.match(lines[i])):
            continue
        head = list(itertools.islice((k for k in range(i + 1, n) if lines[k].strip()), 3))  # a header block is known by its first three lines
        headers = sum(bool(_HEADER.match(lines[k])) for k in head)
        if (_SEPARATOR.match(lines[i]) and headers >= 1) or (_RULE.match(lines[i]) and headers >= 2):
            quoted.update(k for k in range(i, n) if lines[k].strip())
            break
        if _HEADER.match(lines[i]) and headers >= 2 and (i == 0 or not lines[i - 1].strip()) and re.match(r"^\s*(?:from|von|de|差出人)\s*[:：]", lines[i], re.I):
            quoted.update(k for k in range(i, n) if lines[k].strip())
            break
    return quoted, intro


def _looks_signed(line: str) -> bool:
    return bool(_NAME.match(line) or any(p.match(line) for p in _SIG_LINE) or _ORG.match(line)) and not _TERMINAL.search(line.rstrip('"”')) or any(p.match(line) for p in _SIG_LINE)


#: Parts that the alternatives of _NOTICE_WORDS begin with: a text without any has no notice word.
_NOTICE_STEMS = [w for x in _NOTICE_WORDS.pattern.split("|") if (w := re.match(r"[^\[(?]*", x.replace("s?", "")).group())]


def _is_notice(lines: list[str]) -> bool:
    text = " ".join(x.strip() for x in lines)
    if any(p.search(text) for p in _NOTICE):
        return True
    low = text.casefold()
    if not any(w in low for w in _NOTICE_STEMS):
        return False
    return len({m.lower() for m in _NOTICE_WORDS.findall(text)}) >= 2


def _furniture(lines: list[str], gone: set[int]) -> set[int]:
    """Lines of signatures, closings, devices, list footers and notices, block by block, among the lines not yet gone."""
    found: set[int] = set()
    blocks = []
    for a, b in _blocks(lines):
        stretch = []
        for i in range(a, b):
            if i in gone:
                if stretch:
                    blocks.append(stretch)
                stretch = []
            else:
                stretch.append(i)
        if stretch:
            blocks.append(stretch)
    bodies = 0
    signed = False
    for block in blocks:
        texts = [lines[i] for i in block]
        start = 0
        if _PS.match(texts[0]):
            continue
        # a delimiter or rule opens a signature or footer that takes the rest of the block
        mark = next((k for k, x in enumerate(texts) if _SIG_DELIMITER.match(x)), -1)
        if mark >= 0 and (mark == 0 or mark < len(texts) - 1):
            found.update(block[mark:])
            signed, texts, block = True, texts[:mark], block[:mark]
            if not block:
                continue
        rule = next((k for k, x in enumerate(texts) if _RULE.match(x)), -1)
        if rule >= 0 and rule < len(texts) - 1 or rule == 0:
            rest = [x for x in texts[rule + 1 :] if not _RULE.match(x)]
            if not rest or all(_looks_signed(x) or _LIST.search(x.strip()) for x in rest):
                found.update(block[rule:])
                signed, texts, block = True, texts[:rule], block[:rule]
                if not block:
                    continue
        close = next((k for k, x in enumerate(texts) if _CLOSING.match(x)), -1)
        if close >= 0 and all(_looks_signed(x) or _DEVICE.match(x) for x in texts[close + 1 :]) and (close or bodies or gone or len(texts) > 1):
            found.update(block[close:])
            signed, texts, block = True, texts[:close], block[:close]
            if not block:
                continue
        if all(_DEVICE.match(x) for x in texts) or all(_LIST.search(x.strip()) or _RULE.match(x) for x in texts) or _is_notice(texts):
            found.update(block)
            continue
        if any(_LIST.search(x.strip()) for x in texts) and all(_LIST.search(x.strip()) or _RULE.match(x) or not _TERMINAL.search(x) for x in texts):
            found.update(block)
            continue
        # a block of a name and its particulars, without a delimiter
        if (bodies or gone) and all(_looks_signed(x) for x in texts) and (len(texts) > 1 or signed or _NAME.match(texts[0]) and len(texts[0].split()) <= 3):
            found.update(block)
            signed = True
            continue
        # device, list or notice lines at the end of a block of text
        while texts and _DEVICE.match(texts[-1]) and len(texts) > 1:
            found.add(block[-1])
            texts, block = texts[:-1], block[:-1]
        bodies += 1
    return found


_CITED = re.compile(r"(?:in article|in message|references?:|in-reply-to:)\s*((?:<[^<>\s]+>[\s,]*)+)", re.I)
_OWN_ID = re.compile(r"^message-id:\s*(<[^<>\s]+>)", re.I | re.M)
_ATTRIBUTED = re.compile(r"^(?P<who>.*)\b(?:wrote|writes|said|schrieb|a écrit|escribió|さんは書きました)", re.I)
_DAY = re.compile(r"\b(\d{1,2})\.? (jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.? (\d{4})\b|\b(\d{4})-(\d{2})-(\d{2})\b", re.I)
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def _days(text: str) -> set[str]:
    """The days that a text names, as yyyy-mm-dd."""
    out = set()
    for m in _DAY.finditer(text):
        d, mon, y, *iso = m.groups()
        out.add(f"{y}-{_MONTHS.index(mon.lower()) + 1:02d}-{int(d):02d}" if d else "-".join(iso))
    return out


def _thread_keys(lines: list[str], intro: set[int], quoted: set[int]) -> list[str]:
    """Keys of the messages that a text answers: cited ids, attributions that name a person and a date, and "address|day" of these."""
    keys = {x.lower() for m in _CITED.finditer("\n".join(lines)) for x in re.findall(r"<[^<>\s]+>", m.group(1))}
    text = " ".join(lines[i].strip() for i in sorted(intro))
    if re.search(r"\d{4}", text) and (m := _ATTRIBUTED.match(text)):
        keys.add(re.sub(r"\W+", " ", m.group("who")).strip().lower())
    head = [re.sub(r"\s+", " ", lines[i].strip().lower()) for i in sorted(quoted) if _HEADER.match(lines[i])]
    if len(head) >= 2:
        keys.add("|".join(sorted(head)))
    named = " ".join([text, *head])
    keys |= {f"{a.lower()}|{day}" for a in re.findall(_MAIL, named) for day in _days(named)}
    return sorted(k for k in keys if k)


def _own_keys(lines: list[str], signed: set[int], day: str | None) -> list[str]:
    """Keys under which answers may cite a message itself: its own id, and the addresses of its signature with the day it was posted and those beside it, since clocks differ."""
    keys = {m.group(1).lower() for m in _OWN_ID.finditer("\n".join(lines))}
    if day:
        import datetime

        near = [(datetime.date.fromisoformat(day) + datetime.timedelta(days=k)).isoformat() for k in (-1, 0, 1)]
        keys |= {f"{a.lower()}|{d}" for i in signed for a in re.findall(_MAIL, lines[i]) for d in near}
    return sorted(keys)


def analyse(text: str | None, day: str | None = None, marks: bool = True) -> Message:
    """The structure of one text, posted on a day if that is known; nothing for a null or blank one.

    Without marks, quotation marks and what they imply are not read: the text's own lines are then
    known by comparison alone, which is how that is tested.
    """
    out = Message()
    if not text or not text.strip():
        return out
    lines = lines_of(text)
    quoted, intro = _quoted_lines(lines)
    signed = _furniture(lines, quoted | intro)
    gone = (quoted | intro if marks else intro) | signed
    out.inherited = {i + 1 for i in gone if lines[i].strip()}
    out.keys, out.own_keys = _thread_keys(lines, intro, quoted), _own_keys(lines, signed, day)
    if not marks:
        return out
    for a, b in _runs(sorted(quoted)):
        span = "\n".join(x for i in range(a, b) if (x := " ".join(words_of(lines[i][len(_mark(lines[i])) :]))))
        if span:
            out.quoted.append(span)
    for span in out.quoted:
        out.inherited |= aligned_lines(_left(lines, out), span)
    if out.own_keys:
        out.body = "\n".join(x for _, line in _left(lines, out) if (x := " ".join(words_of(line))))
    return out


def _left(lines: list[str], message: Message) -> list[tuple[int, str]]:
    """The lines that may still be new, by number from 1."""
    return [(i, x) for i, x in enumerate(lines, 1) if i not in message.inherited and x.strip()]


def _runs(numbers: list[int]):
    start = prior = None
    for x in numbers:
        if prior is not None and x == prior + 1:
            prior = x
            continue
        if start is not None:
            yield start, prior + 1
        start = prior = x
    if start is not None:
        yield start, prior + 1


def words_of(line: str) -> list[str]:
    return re.findall(r"[^\W_]+", line.lower())


def rolling_hashes(words: list[str], size: int = SHINGLE) -> list[int]:
    """Polynomial hashes of all runs of size words, each from the one before by taking one word off and one on."""
    import xxhash

    base, mod = 1_000_003, (1 << 61) - 1
    codes = [xxhash.xxh64_intdigest(w) % mod for w in words]
    if len(codes) < size:
        return []
    top, value, out = pow(base, size - 1, mod), 0, []
    for i, c in enumerate(codes):
        if i >= size:
            value = (value - codes[i - size] * top) % mod
        value = (value * base + c) % mod
        if i >= size - 1:
            out.append(value)
    return out


def _pairs(words: list[str]) -> list[tuple[str, str]]:
    return list(zip(words, words[1:], strict=False))


def _places(words: list[str], other: list[str], at: dict[tuple[str, str], list[int]]) -> list[int]:
    """Where other has SIMILARITY of the words in order, numbers all, in a stretch that is no longer than as much more; one start for each place.

    at has the places of other's word pairs. Common subsequences are counted with a bit for each word.
    """
    n = len(words)
    need, width = -(-n * SIMILARITY // 100), n * 100 // SIMILARITY
    starts = {s for i, pair in enumerate(_pairs(words)) for j in at.get(pair, ()) for s in range(max(0, j - i - width + n), min(len(other), j - i + n - need + 1))}
    bits: dict[str, int] = {}
    for i, w in enumerate(words):
        bits[w] = bits.get(w, 0) | 1 << i
    numbers = {w for w in words if any(c.isdigit() for c in w)}
    full, found = (1 << n) - 1, []
    for s in sorted(starts):
        if found and s < found[-1] + need:
            continue
        window = other[s : s + width]
        if window[0] not in bits or not numbers.issubset(window):
            continue
        free = full
        for w in window:
            hit = free & bits.get(w, 0)
            free = ((free + hit) | (free - hit)) & full
        if n - free.bit_count() >= need:
            found.append(s)
    return found


def aligned_lines(lines: list[tuple[int, str]], ancestor: str) -> set[int]:
    """Numbers of the lines that repeat the ancestor's text, whose lines are parted by line feeds.

    A line does if SIMILARITY of its words, with all its numbers, align in order with one place of the
    text; a line of fewer than SHINGLE words must be one whole line of it. What the text has in several
    places may be a stock phrase: it counts only if SIMILARITY of its words lie in common runs of RUN or
    more. A line inside a sentence that begins or ends in a new line is new, however well it aligns.
    """
    other = ancestor.split()
    whole: dict[str, int] = {}
    for x in ancestor.split("\n"):
        whole[x] = whole.get(x, 0) + 1
    at: dict[tuple[str, str], list[int]] = {}
    for j, pair in enumerate(_pairs(other)):
        at.setdefault(pair, []).append(j)
    texts = dict(lines)
    likely: set[int] = set()
    long: list[tuple[int, list[str]]] = []
    for number, line in lines:
        words = words_of(line)
        if len(words) < SHINGLE:
            if whole.get(" ".join(words)) == 1:
                likely.add(number)
        elif any(pair in at for pair in _pairs(words)):
            long.append((number, words))
            if len(_places(words, other, at)) == 1:
                likely.add(number)
    if any(len(words) >= RUN for _, words in long):
        likely |= _in_long_runs(long, other)
    flat = f" {' '.join(other)} "
    edited = {number for number, words in long if f" {' '.join(words)} " not in flat}
    while True:
        kept = {i for i in likely if not ((i - 1 not in likely and _open(texts.get(i - 1), texts[i])) or (i + 1 not in likely and _open(texts[i], texts.get(i + 1), i not in edited)))}
        if kept == likely:
            return kept
        likely = kept


def _open(line: str | None, following: str | None, capital_starts: bool = False) -> bool:
    """Whether a sentence of a line seems to run on into the one that follows, if both are there."""
    if line is None or following is None or _TERMINAL.search(line):
        return False
    return not (capital_starts and next((c for c in following if c.isalnum()), "").isupper())


def _in_long_runs(lines: list[tuple[int, list[str]]], other: list[str]) -> set[int]:
    """Numbers of the lines of which SIMILARITY of the words lie in runs of RUN or more that also run, in order, through other."""
    words = [w for _, found in lines for w in found]
    owner = [number for number, found in lines for _ in found]
    hit: dict[int, int] = {}
    for a, _, size in difflib.SequenceMatcher(None, words, other, autojunk=False).get_matching_blocks():
        if size >= RUN:
            for number in owner[a : a + size]:
                hit[number] = hit.get(number, 0) + 1
    return {number for number, found in lines if hit.get(number, 0) * 100 >= SIMILARITY * len(found)}


def structure(train: DataFrame, marks: bool = True) -> DataFrame:
    """(row_id, inherited, keys, own_keys, quoted, body, lines) of every row: line numbers not new by structure, keys of the messages answered and
    of the message itself, quoted texts, its own words if it has a key, and all lines that have words of rows that answer something, without marks.
    """
    schema = "row_id LONG, inherited ARRAY<INT>, keys ARRAY<STRING>, own_keys ARRAY<STRING>, quoted ARRAY<STRING>, body STRING, lines ARRAY<STRUCT<line_no: INT, line: STRING>>"
    day = F.date_format("posted_at", "yyyy-MM-dd") if "posted_at" in train.columns else F.lit(None).cast("string")

    def run(batches):
        import pyarrow as pa

        line_type = pa.list_(pa.struct([("line_no", pa.int32()), ("line", pa.string())]))
        names, of = pa.list_(pa.string()), [f.split(" ")[0] for f in schema.split(", ")[:6]]
        for whole in batches:
            for first in range(0, whole.num_rows, 500):
                batch = whole.slice(first, 500)
                texts = batch.column(1).to_pylist()
                found = [analyse(t, d, marks) for t, d in zip(texts, batch.column(2).to_pylist(), strict=True)]
                lines = [
                    [{"line_no": i, "line": x[len(_mark(x)) :]} for i, x in enumerate(lines_of(t), 1) if x.strip()] if m.keys and t else []
                    for t, m in zip(texts, found, strict=True)
                ]
                columns = [
                    batch.column(0),
                    pa.array([sorted(m.inherited) for m in found], pa.list_(pa.int32())),
                    pa.array([m.keys for m in found], names),
                    pa.array([m.own_keys for m in found], names),
                    pa.array([m.quoted for m in found], names),
                    pa.array([m.body for m in found], pa.string()),
                    pa.array(lines, line_type),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[*of, "lines"])

    return spread(train.select("row_id", "data", day.alias("_day")).where(F.col("data").isNotNull())).mapInArrow(run, schema)


def _hashed(rows: DataFrame, keep: list[str], text: str) -> DataFrame:
    """One row per distinct rolling-hash of two words of a text column, and of each word that is a line by itself, with the columns keep."""
    from pyspark.sql import types as T

    schema = T.StructType([rows.schema[c] for c in keep] + [T.StructField("shingle", T.LongType())])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            hashes = []
            for t in batch.column(len(keep)).to_pylist():
                words = words_of(t or "")
                alone = [x for line in lines_of(t or "") if len(x := words_of(line)) == 1]
                hashes.append(sorted({*rolling_hashes(words, 2), *(h for x in alone for h in rolling_hashes(x, 1))}))
            at = pa.array(np.repeat(np.arange(len(hashes)), [len(h) for h in hashes]))
            flat = pa.array([h for x in hashes for h in x], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(at) for i in range(len(keep))], flat], names=[*keep, "shingle"])

    return rows.select(*keep, text).mapInArrow(run, schema)


def inherited_in_threads(messages: DataFrame, quoting: DataFrame | None = None) -> DataFrame:
    """(row_id, line_no) of all lines that repeat what the message answers, marked or not, by comparison alone.

    The messages that a text answers are those whose own keys it cites; the texts of messages that are
    not in the table are known by what others with the same reference quote of them. So each message
    is indexed under its own keys with its own words and all that it quotes, and its quotations under
    the keys that it cites. The distinct spans are indexed per key by rolling hashes of two words, of
    which lines with edited words and short ones have some left; a much-quoted text is one entry, and
    no thread is gathered in one task. Rows that hit a span of another row are then aligned with it
    line by line. The own words of rows that merely cite the same reference are not compared: two
    answers to one message don't inherit from each other, and near copies of one answer are new in both.
    quoting gives the index if it is to be made of other readings of the rows than messages.
    """
    source = messages if quoting is None else quoting
    keyed = messages.where((F.size("keys") > 0) & (F.size("lines") > 0))
    # only keys that some row cites and another row cites or is known by can show anything; the others, most of all, carry no text
    named = keyed.select("row_id", F.explode("keys").alias("key"), F.lit(1).alias("c"))
    for keys in ("keys", "own_keys"):
        named = named.unionByName(source.select("row_id", F.explode(keys).alias("key"), F.lit(0).alias("c")))
    wanted = named.groupBy("key").agg(F.min("row_id").alias("_a"), F.max("row_id").alias("_b"), F.max("c").alias("_c"))
    wanted = cut(wanted.where("_a <> _b and _c = 1").select("key"), "keys")

    def under(rows: DataFrame, keys: str, *columns) -> DataFrame:
        return rows.select("row_id", F.explode(keys).alias("key"), *columns).join(wanted, "key", "left_semi")

    quotes = under(source, "keys", "quoted").select("row_id", "key", F.explode("quoted").alias("span"))
    owned = under(source, "own_keys", F.concat(F.array("body"), "quoted").alias("_s")).select("row_id", "key", F.explode("_s").alias("span")).where("span <> ''")
    # of equal spans one entry is left, with its owner only if no other row has it: a row is not compared with what it alone holds
    spans = quotes.unionByName(owned).groupBy("key", "span").agg(F.min("row_id").alias("_a"), F.max("row_id").alias("_b"))
    spans = spans.select("key", "span", F.when(F.col("_a") == F.col("_b"), F.col("_a")).alias("only"), F.xxhash64("key", "span").alias("span_id"))
    spans = cut(spans, "spans")
    index = _hashed(spans, ["key", "span_id", "only"], "span")
    lines = under(keyed, "keys", F.col("lines").alias("_l"))
    lines = lines.select("row_id", "key", F.explode("_l").alias("_l")).select("row_id", "key", "_l.line")
    probe = _hashed(lines, ["row_id", "key"], "line").distinct()
    hits = probe.join(index, ["key", "shingle"]).where("only is null or only <> row_id").select("row_id", "span_id").distinct()
    texts = spans.select("span_id", "span").dropDuplicates(["span_id"])
    pairs = hits.join(texts, "span_id").join(keyed.select("row_id", "lines").dropDuplicates(["row_id"]), "row_id")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows, numbers = [], []
            for row_id, span, lines in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                for number in sorted(aligned_lines([(x["line_no"], x["line"]) for x in lines], span)):
                    rows.append(row_id)
                    numbers.append(number)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(numbers, pa.int32())], names=["row_id", "line_no"])

    return pairs.select("row_id", "span", "lines").mapInArrow(run, "row_id LONG, line_no INT").distinct()


def evidence(train: DataFrame) -> DataFrame:
    """(row_id, line_no, by_structure, by_comparison) of the lines that are not new: whether the text's own structure shows it, and whether comparison with what the message answers does."""
    messages = cut(structure(train), "messages")
    marked = messages.select("row_id", F.explode("inherited").alias("line_no"), F.lit(True).alias("s"), F.lit(False).alias("c"))
    compared = inherited_in_threads(messages).select("row_id", "line_no", F.lit(False).alias("s"), F.lit(True).alias("c"))
    rows = marked.unionByName(compared).where(F.col("row_id").isNotNull())
    return rows.groupBy("row_id", "line_no").agg(F.max("s").alias("by_structure"), F.max("c").alias("by_comparison"))


def found(train: DataFrame) -> DataFrame:
    """(row_id, line_no) of the lines that are not new, once however often a row was delivered. Rows with null data have none."""
    return evidence(train).select("row_id", "line_no")


def new_text(train: DataFrame) -> DataFrame:
    """(row_id, data) reduced to the lines that are new, once per row_id and text; '' if none is. Runs of blank lines fold into one."""
    gone = found(train).groupBy("row_id").agg(F.collect_set("line_no").alias("gone"))
    rows = train.select("row_id", "data").dropDuplicates(["row_id", "data"]).join(gone, "row_id", "left")
    numbered = F.transform(F.split(F.regexp_replace("data", "\r(?=\n|$)", ""), "\n"), lambda line, i: F.struct(line.alias("line"), (i + 1).alias("no")))
    kept = F.filter(numbered, lambda x: ~F.coalesce(F.array_contains("gone", x["no"]), F.lit(False)))
    joined = F.array_join(F.transform(kept, lambda x: x["line"]), "\n")
    return rows.select("row_id", F.trim(F.regexp_replace(joined, r"\n\s*\n\s*", "\n\n"), F.lit(" \n\t")).alias("data"))
