"""Problem 4: sentence units of texts in any language and script.

The rules follow the character properties of the Unicode sentence-break standard (terminators of
all scripts, closing marks, lower-case continuation), with suppressed abbreviations, matched
quotations and brackets, list items, emoji and the break rules of Thai on top.
"""

from __future__ import annotations

import bisect
import re
import sys
import unicodedata

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.session import spread

# Abbreviations after which a sentence goes on, by language. All are tried for every
# text, since the stated language is often missing or wrong; none is a usual last word elsewhere.
ALWAYS_GO_ON = {
    "en": "dr prof mr mrs ms messrs st sen rep gov gen col lt capt sgt maj rev hon pres cf eg ie viz vs approx dept esp incl resp mt ft ca",
    "de": "hr fr frl nr abb bzw ca evtl ggf inkl lt mio mrd sog str tel usf vgl zzgl fa dipl ing geb gest kap hrsg allg bes dgl einschl entspr gem prof",
    "fr": "mme mlle mm mgr env ex fig art chap éd réf tél boul pl mlles",
    "es": "sr sra srta dr dra d dña ud uds pág págs núm vol fig cap art prof lic ing ej aprox avda tel izq dcha",
    "ru": "стр тыс млн млрд г ул им рис см напр проф акад гл ст обл просп пл д кв тел руб коп",
    "hi": "डॉ श्री प्रो पं सं कृ",
    "ar": "د أ م ص",
}
#: Go on only before a number: "no. 5", but "No. We left."
BEFORE_NUMBER = set("no nos nr p pp s vol fig figs sec art ch para abs núm n nº št eq jan feb mar apr jun jul aug sep sept oct nov dec rev ver box bd kap pág с гл т".split())
#: May end a sentence: they do so before a word that starts one.
MAY_END = set("etc inc ltd co corp plc llc jr sr bros al ff f usw seq ave blvd rd am pm тд тп др гг руб".split())
#: Pairs of single letters that may end a sentence; others ("z. B.", "d. h.", "u. a.", "p. ex.") go on.
LETTERS_MAY_END = {"a.m", "p.m", "т.д", "т.п", "u.s", "u.n", "u.k", "e.u", "d.c", "b.c", "a.d", "o.ä", "ph.d", "т.е"}
MONTHS = set("januar jänner februar märz april mai juni juli august september oktober november dezember".split())
ORDINAL_BEFORE = set("am vom zum bis der den dem des im seit ab beim die das".split())
#: A capitalised word that a preposition governs and a mark follows: a name that holds the mark, if another name comes next.
MARKED_NAME = re.compile(r"\b(?:at|of|from|by|with|for|via|von|bei|mit|für|chez|par|avec|de|del|con|para)\s+[^\W\d_a-z]\w*$")
#: Second parts of names of companies, whose first part may hold a mark.
COMPANY = re.compile(r"商会|商店|商事|会社|株式|工業|製作所|銀行|出版|放送|新聞社|公司|集团|銀行")
#: Last parts of file names and addresses, which are no first words of sentences.
ENDINGS = set("py txt out exe com org net edu gov io example html htm pdf doc csv json xml js java cpp zip gz tar png jpg sh cfg ini log sql md de fr es jp ru cn uk eu info biz tv co".split())
STARTERS = set("the a an in on at it he she we they you i this that these those there but and so if when while after before for no not our my his her its their what who how why where which some only both".split())

#: Every sign that Unicode lets end a sentence (Sentence_Break STerm and ATerm).
TERMINATORS = "".join(regex.findall(r"[\p{SB=STerm}\p{SB=ATerm}]", "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))))
_PAUSE = "…‥"
_OPEN = {"(": ")", "[": "]", "{": "}", "“": "”", "«": "»", "‹": "›", "「": "」", "『": "』", "（": "）", "【": "】", "〈": "〉", "《": "》", "［": "］", "｢": "｣", "〔": "〕"}
_CLOSE = {v: k for k, v in _OPEN.items()}
_BRACKETS = set("([{（【［〔")
_PAIRED = re.compile("[" + re.escape("".join({*_OPEN, *_CLOSE, *"„\"＂'‘’"})) + "]")
_EMOJI = "[\U0001f000-\U0001faff☀-➿⭐⭕⌚⌛❤]"
#: It begins with one class of signs, which the search runs to; what stands before and after is asked then.
_FACE = re.compile(
    rf"[:;=^<xX{_EMOJI[1:-1]}](?:(?<={_EMOJI})[️‍\U0001f3fb-\U0001f3ff]*(?:{_EMOJI}[️‍\U0001f3fb-\U0001f3ff]*)*"
    r"|(?<!\S[:;=^<xX])(?:(?<=[:;=])[-'^o]?[)(DPp\]\[|/\\*]|(?<=\^)_\^|(?<=<)3|(?<=[xX])D)(?!\w))"
)
_FACE_ASCII = re.compile(r"[:;=^<xX](?<!\S[:;=^<xX])(?:(?<=[:;=])[-'^o]?[)(DPp\]\[|/\\*]|(?<=\^)_\^|(?<=<)3|(?<=[xX])D)(?!\w)")
_ENDS = re.compile(rf"[{re.escape(TERMINATORS)}{_PAUSE}]+")
#: The same for texts without signs beyond 16 bits, and for plain ASCII: shorter classes are faster, and hold all that can occur.
_ASTRAL = re.compile("[\U00010000-\U0010ffff]")
_ENDS_BMP = re.compile(rf"[{re.escape(''.join(c for c in TERMINATORS if c <= chr(0xFFFF)))}{_PAUSE}]+")
_ENDS_ASCII = re.compile(f"[{re.escape(''.join(c for c in TERMINATORS if c.isascii()))}]+")
_BLANK = re.compile(r"(?:\r\n|\r|\n| | |\x0b|\x0c)[^\S\r\n]*(?:\r\n|\r|\n| )| ")
_LINE = re.compile(r"\r\n|\r|\n| |\x0b|\x0c|\x85")
_ITEM = re.compile(r"\s*(?:[-*•·–—‣◦▪●○■]|\(?\d{1,3}[.)]|\([a-zA-Zа-я]\)|[a-z]\)|\(?[ivx]{1,4}\)|（\d{1,3}）)\s+\S")
_THAI = re.compile(r"[฀-๿]")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_CJK = re.compile(r"[぀-ヿ㐀-鿿豈-﫿ｦ-ﾝ]")
_SAYS = re.compile(r"(?:と|って|の|は|が|を|に|、|，|,)|[^\s。！？，、：“”「」]{0,6}(?:问|說|说|喊|答|叫|言った|述べ|話し|尋ね|道[。，：])")
_SPACE_CLOSE = re.compile(r"[   ]+»")


def _pairs(text: str, start: int, end: int) -> dict[int, int]:
    """Opening place -> closing place of the matched quotation marks and brackets of one paragraph."""
    pairs: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    low_open = False
    for m in _PAIRED.finditer(text, start, end):
        i, c = m.start(), m.group()
        before = text[i - 1] if i > start else " "
        after = text[i + 1] if i + 1 < end else " "
        if c == "„":
            stack.append(("„", i))
            low_open = True
        elif c in '"＂':
            if any(k == '"' for k, _ in stack):
                while stack:
                    k, at = stack.pop()
                    if k == '"':
                        pairs[at] = i
                        break
            else:
                stack.append(('"', i))
        elif c in "'‘’":
            opened = next((j for j in range(len(stack) - 1, -1, -1) if stack[j][0] == "'"), -1)
            if opened >= 0 and not after.isalnum() and not before.isspace() and c != "‘":
                pairs[stack[opened][1]] = i
                del stack[opened:]
            elif c != "’" and (before.isspace() or before in "([{—“\"") and not after.isspace() and opened < 0:
                stack.append(("'", i))
        elif low_open and c in "“”":
            while stack:
                k, at = stack.pop()
                if k == "„":
                    pairs[at] = i
                    break
            low_open = False
        elif c in _OPEN:
            stack.append((c, i))
        elif c in _CLOSE:
            at = next((j for j in range(len(stack) - 1, -1, -1) if stack[j][0] == _CLOSE[c]), -1)
            if at >= 0:
                pairs[stack[at][1]] = i
                del stack[at:]
    return pairs


def _first_word(text: str, at: int, end: int) -> tuple[str, str]:
    """(the first letter, digit or other sign that counts, the word it starts) from at on, past opening marks."""
    while at < end and (text[at].isspace() or text[at] in "\"'“„«‹‘¿¡([{「『（【《〈—–-*_" or text[at] in "‐‑"):
        at += 1
    if at >= end:
        return "", ""
    m = _WORD.match(text, at)
    return text[at], m.group() if m else ""


class _Block:
    """A stretch of text without blank lines and list items inside, in which sentences are sought."""

    def __init__(self, text: str, start: int, end: int, pairs: dict[int, int], item: bool = False, ends: re.Pattern = _ENDS):
        self.text, self.start, self.end, self.item = text, start, end, item
        self.closed = {b: a for a, b in pairs.items()}
        spans = sorted((a, b) for a, b in pairs.items())
        self.spans: list[tuple[int, int]] = []  # outermost only
        for a, b in spans:
            if not self.spans or a > self.spans[-1][1]:
                self.spans.append((a, b))
        self.opens = [a for a, _ in self.spans]
        self._spaces = self._is_german = None
        self.ends, self.faces = ends, _FACE_ASCII if text.isascii() else _FACE

    def inside(self, at: int) -> bool:
        k = bisect.bisect_right(self.opens, at) - 1
        return k >= 0 and self.spans[k][0] < at <= self.spans[k][1]

    def sentences(self) -> list[tuple[int, int]]:
        text, out, begin, at = self.text, [], self.start, self.start
        marks = [(m.start(), m.end(), False) for m in self.ends.finditer(text, self.start, self.end)]
        marks += [(m.start(), m.end(), True) for m in self.faces.finditer(text, self.start, self.end)]
        marks += [(m.start(), m.start(), None) for m in self._thai_spaces()]
        for s, e, kind in sorted(marks, key=lambda x: x[:2]):
            if s < at:
                continue
            stop = self._stop(begin, s, e, kind)
            if stop:
                out.append((begin, stop))
                begin = at = stop
        out.append((begin, self.end))
        return [t for t in (_trim(text, a, b) for a, b in out) if t[1] > t[0]]

    def _thai_spaces(self):
        if not _THAI.search(self.text, self.start, self.end):
            return []
        found = []
        for m in re.compile(r"\s+").finditer(self.text, self.start, self.end):
            before = self.text[m.start() - 1] if m.start() > self.start else ""
            after = self.text[m.end()] if m.end() < self.end else ""
            if not before or not after:
                continue
            line = bool(_LINE.search(m.group()))
            thai = _THAI.match(before) or (_THAI.match(after) and not before.isspace())
            if _THAI.match(before) and (line or not (after.isdigit() or before.isdigit())):
                found.append(m)
            elif thai and line and before.isdigit():
                found.append(m)
        return found

    def _stop(self, begin: int, s: int, e: int, kind) -> int:
        """Where the sentence ends if the mark at s..e ends it, else 0."""
        text, end = self.text, self.end
        if kind is None:
            return 0 if self.inside(s) else s
        if kind:  # emoji and emoticons
            if self.inside(s):
                return 0
            c, word = _first_word(text, e, end)
            if not c:
                return 0
            return e if text[e : e + 1].isspace() and _starts(c, word) else 0
        # closing marks that belong to the sentence
        stop, last_closed = e, -1
        while stop < end:
            if stop in self.closed:
                last_closed = self.closed[stop]
                stop += 1
            elif (m := _SPACE_CLOSE.match(text, stop, end)) and m.end() - 1 in self.closed:
                last_closed = self.closed[m.end() - 1]
                stop = m.end()
            elif text[stop] in TERMINATORS and last_closed >= 0:
                stop += 1
            elif text[stop] in "*_" and text[stop - 1] in TERMINATORS:
                stop += 1
            else:
                break
        if self.inside(s) and (last_closed < 0 or self.inside(stop)):
            return 0
        run = text[s:e]
        if m := re.compile(r"[ \t]*").match(text, stop, end):
            face = _FACE.match(text, m.end(), end)
            if face and face.end() <= end:
                c, word = _first_word(text, face.end(), end)
                if not c or _starts(c, word):
                    return face.end()
        if stop >= end:
            return 0  # the block ends here anyway
        nxt = text[stop]
        c, word = _first_word(text, stop, end)
        if not c:
            return 0
        spaced = nxt.isspace()
        here = stop
        while here < end and text[here].isspace():
            here += 1
        if text[here] in ",;:،؛、，；：)]}）】»”":
            return 0
        lower = c.islower() and not re.match(r"\w?[a-z]+[A-Z]", word[:12] or "") and not _CJK.match(c)
        wide = any(x in "。！？｡．" for x in run)
        if wide or (_CJK.match(text[s - 1] if s > begin else " ") and not all(x in "." for x in run)):
            return self._wide(begin, s, e, stop, last_closed, run)
        if lower and spaced:
            return 0
        if any(x in _PAUSE for x in run) or (run.strip(".") == "" and len(run) > 1):
            return stop if spaced and not lower else 0
        if run not in (".", "․", "﹒"):
            return self._strong(begin, s, stop, nxt, word, spaced, lower, last_closed)
        return self._dot(begin, s, stop, c, word, spaced, lower)

    def _wide(self, begin, s, e, stop, last_closed, run) -> int:
        """Marks of scripts without spaces."""
        text = self.text
        if all(x in _PAUSE for x in run):
            return 0
        if "．" in run and s > begin and text[s - 1].isdigit() and text[e : e + 1].isdigit():
            return 0
        if run in "!！" and COMPANY.match(text, e):
            return 0
        if run in ".!?" and last_closed < 0 and re.match(r"[A-Za-z0-9]", text[e : e + 1] or " ") and not _CJK.match(text[s - 1]):
            return 0
        if last_closed >= 0:
            opener, first = text[last_closed], not text[begin:last_closed].strip()
            if opener in _BRACKETS:
                return stop if first else 0
            if first:
                return 0 if _SAYS.match(text[stop:].lstrip()[:12]) else stop
            return stop if text[:last_closed].rstrip()[-1:] in "：:，,、" and text[stop] not in "とっ、，," else 0
        return stop

    def _strong(self, begin, s, stop, nxt, word, spaced, lower, last_closed) -> int:
        """! and ? and the marks of other scripts; they need no space."""
        text = self.text
        if text[s] == "!" and spaced and word[:1].isupper() and word.casefold() not in STARTERS and self._named_by_preposition(begin, s):
            return 0
        if not spaced and lower and last_closed < 0:
            # "what?the next one" ends, an address such as "x.cgi?a=b" does not
            return 0 if self._token_has(begin, s, "/@=&") or not _WORD_THEN_SPACE.match(text, stop) else stop
        if not spaced and (nxt.isdigit() or nxt in "=&/\\_%#@-"):
            return 0
        return stop

    def _dot(self, begin, s, stop, c, word, spaced, lower) -> int:
        text = self.text
        at = s
        while at > begin and (text[at - 1].isalnum() or unicodedata.category(text[at - 1])[0] == "M"):
            at -= 1
        left = text[at:s]
        prior = text[at - 1] if at > begin else " "
        if not spaced and stop == s + 1:
            return self._joined(begin, s, stop, left, at, prior, lower)
        if lower:
            return 0
        low = left.casefold()
        if not left:
            return stop
        letters = re.search(r"((?:[^\W\d_]{1,2}\.\s?)+)[^\W\d_]$", text[max(begin, s - 16) : s])  # only the last pair is asked for
        if letters and (len(left) == 1 or low == "d"):
            joined = re.sub(r"\s", "", letters.group()).casefold()
            pair = ".".join(joined.split(".")[-2:])
            if pair in LETTERS_MAY_END:
                if left.isupper() and pair[:1] in "ueb":
                    return stop if word.casefold() in STARTERS else 0
                return stop
            return 0
        if left.isdigit():
            if not text[begin:at].strip():
                return 0  # the number of a list item or heading
            if len(left) <= 2 and word.casefold() in MONTHS:
                return 0
            if len(left) <= 2 and word[:1].isupper() and self._word_before(begin, at) in ORDINAL_BEFORE and self._german():
                return 0
            return stop
        if len(left) == 1 and left.isalpha() and not _CJK.match(left):
            return 0 if not (prior.isalnum() or prior in "'’") else stop
        if low in _GO_ON and not (low in BEFORE_NUMBER and not c.isdigit()):
            return 0
        if low in BEFORE_NUMBER and (c.isdigit() or c == "."):
            return 0
        if low in MAY_END and c in "(（":
            return 0
        if low == "al" and text[stop:].lstrip()[:1] in "([":
            return 0
        return stop

    def _joined(self, begin, s, stop, left, at, prior, lower) -> int:
        """A dot with no space after it: a sentence may follow, but so may the rest of a number, name or address."""
        text = self.text
        follows = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?").match(text, stop, self.end)
        if not follows:
            return stop if text[stop] in "\"“„«¿¡(—" and len(left) > 1 else 0
        if len(left) < 2 or self._token_has(begin, s, "@/\\") or (prior in "._-@" and not left.isdigit()):
            return 0
        tail, then = follows.group(), text[follows.end() : follows.end() + 1]
        if not (text[stop].isascii() or text[stop].isupper() or text[stop].islower()):
            return stop  # a script without case follows
        if tail.casefold() in ENDINGS and not tail.istitle() or then in "@/\\_=" and then:
            return 0
        if then == "." and text[follows.end() + 1 : follows.end() + 2].isalnum():
            return 0
        if left.isdigit():
            return stop if tail[0].isupper() or (len(left) == 4 and len(tail) > 1) else 0
        if left.casefold() in _GO_ON:
            return 0
        return stop if tail[0].isupper() or (not then or then.isspace() or then in ",;:") else 0

    def _german(self) -> bool:
        """Whether the whole block has a word that hardly any other language has."""
        if self._is_german is None:
            self._is_german = bool(_GERMAN.search(self.text, self.start, self.end))
        return self._is_german

    def _word_before(self, begin: int, at: int) -> str:
        """The word of letters before the white space that ends at a place, or ''."""
        end = at
        while end > begin and self.text[end - 1].isspace():
            end -= 1
        start = end
        while start > begin and self.text[start - 1].isalpha():
            start -= 1
        return self.text[start:end] if end < at else ""

    def _named_by_preposition(self, begin: int, s: int) -> bool:
        """Whether a preposition and a capitalised word stand before a mark."""
        start = s
        while start > begin and self.text[start - 1].isalnum():
            start -= 1
        before = self._word_before(begin, start)
        return bool(before) and bool(MARKED_NAME.search(f" {before} {self.text[start:s]}"))

    def _token_has(self, begin: int, s: int, signs: str) -> bool:
        """Whether the signs without white space before a mark, of whatever length, hold one of signs, or www."""
        if self._spaces is None:
            self._spaces = [m.start() for m in _SPACE.finditer(self.text, self.start, self.end)]
            self._address = [m.start() for m in _ADDRESS.finditer(self.text, self.start, self.end)]
        k = bisect.bisect_left(self._spaces, s) - 1
        start = max(begin, self._spaces[k] + 1 if k >= 0 else begin)
        for at in self._address[bisect.bisect_left(self._address, start) : bisect.bisect_left(self._address, s)]:
            if self.text[at] in signs or self.text[at] == "w":
                return True
        return False


_GERMAN = re.compile(r"\b(?:der|die|das|und|ist|war|kam|mit|wurde|im|am|vom|zum|nicht|ein|eine)\b")
_SPACE = re.compile(r"\s")
_ADDRESS = re.compile(r"[/@=&\\]|www\.")
_WORD_THEN_SPACE = re.compile(r"[^\W\d_]+\s")
_GO_ON = {w for words in ALWAYS_GO_ON.values() for w in words.split()}


def _starts(c: str, word: str) -> bool:
    """Whether a first sign may start a sentence: anything but a lower-case word; brand names such as eBoard may."""
    return not c.islower() or bool(re.match(r"[a-z]{1,2}[A-Z]", word))


def _trim(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and (text[a].isspace() or text[a] in "﻿​"):
        a += 1
    while b > a and (text[b - 1].isspace() or text[b - 1] in "﻿​"):
        b -= 1
    return a, b


def _paragraphs(text: str):
    at = 0
    for m in _BLANK.finditer(text):
        if m.start() > at:
            yield at, m.start()
        at = m.end()
    if at < len(text):
        yield at, len(text)


def _lines(text: str, start: int, end: int):
    at = start
    for m in _LINE.finditer(text, start, end):
        yield at, m.start()
        at = m.end()
    yield at, end


_ENDED = re.compile(rf"(?:[{re.escape(TERMINATORS)}…:：)\]”»\"'」』）]|{_EMOJI}️?|[:;]-?[)(D])\s*$")


def _blocks(text: str, start: int, end: int):
    """(start, end, is an item) of the list items and the stretches between them in one paragraph."""
    begin, item, before = start, False, None
    for a, b in _lines(text, start, end):
        if not text[a:b].strip():
            continue
        starts = _ITEM.match(text, a, b) and (before is None or item or _ENDED.search(text[before[0] : before[1]]))
        if starts and text[a:b].lstrip()[:1] in "—–":
            starts = False  # a dash may open speech
        if starts:
            if a > begin and text[begin:a].strip():
                yield begin, a, item
            begin, item = a, True
        elif item and before is not None:
            goes_on = not _ENDED.search(text[before[0] : before[1]]) and text[a:b].lstrip()[:1].islower()
            if not goes_on:
                yield begin, a, True
                begin, item = a, False
        before = (a, b)
    if text[begin:end].strip():
        yield begin, end, item


def split(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of every sentence of a text, in code points; [] for a null or blank text."""
    if not text or not text.strip():
        return []
    out: list[tuple[int, int]] = []
    ends = _ENDS_ASCII if text.isascii() else _ENDS if _ASTRAL.search(text) else _ENDS_BMP
    for a, b in _paragraphs(text):
        for s, e, item in _blocks(text, a, b):
            if item:
                t = _trim(text, s, e)
                if t[1] > t[0]:
                    out.append(t)
            else:
                out += _Block(text, s, e, _pairs(text, s, e), ends=ends).sentences()
    return out


def sentence_spans(documents: DataFrame, keep: list[str], text: str = "raw_text") -> DataFrame:
    """(keep..., start_pos, end_pos) of every sentence of every row; rows with null or blank text have none. Whole texts are read."""
    rows = documents.select(*keep, F.col(text).alias("_text")).where(F.col("_text").isNotNull())
    schema = rows.drop("_text").schema.add("start_pos", "integer").add("end_pos", "integer")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for whole in batches:
            for first in range(0, whole.num_rows, 1000):
                batch = whole.slice(first, 1000)
                spans = [split(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
                rows_of = pa.array(np.repeat(np.arange(len(spans)), [len(x) for x in spans]))
                flat = np.array([p for x in spans for p in x], dtype=np.int32).reshape(-1, 2)
                columns = [c.take(rows_of) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=schema.names)

    return spread(rows).mapInArrow(run, schema)


def one_text_per_document(prepared: DataFrame) -> DataFrame:
    """(doc_id, raw_text), once per doc_id: the text of the latest prepared_at that has one; folded on the map side."""
    newest = F.max(F.struct(F.col("raw_text").isNotNull().alias("ok"), "prepared_at", "raw_text"))
    return prepared.groupBy("doc_id").agg(newest.alias("_newest")).select("doc_id", "_newest.raw_text")


def found(prepared: DataFrame) -> DataFrame:
    return sentence_spans(one_text_per_document(prepared), ["doc_id"])


def sentence_units(prepared: DataFrame) -> DataFrame:
    """(doc_id, sentences_raw): the list that sentences_raw should hold, for every document; empty for null and blank texts."""
    texts = one_text_per_document(prepared)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lists = [[t[a:b] for a, b in split(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.string()))], names=["doc_id", "sentences_raw"])

    return spread(texts).mapInArrow(run, "doc_id LONG, sentences_raw ARRAY<STRING>")
