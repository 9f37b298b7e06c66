"""Text column functions: cleaning and quality of English sentences, splitting, tokens, slugs."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters translated, and patterns with their replacements in the order they are applied.
DASHES_AND_QUOTES = (" ‐‑‒–—―‘’‚‛“”„‟", " ------''''\"\"\"\"")
CLEANING = [
    (r"(?i)\b(?:https?://|www\.)\S+", " "),
    (r"\b[\w.+-]+@[\w.-]+\.\w+\b", " "),
    (r"(?:[-_=*~.]){3,}", " "),
    (r"[^0-9A-Za-z.,!?;:'\"()\s-]+", " "),
    (r"\s+", " "),
]
LEADING_MARKS = r"^(?:[:>|#*=_\"']\s*)+"
LEADING_NUMBER = r"(?i)^(?:\(?\d+[.)]|[ivxlcdm]{1,6}\))\s+"
TRAILING_FACE = r"\s*[:;]-?[)D]\s*$"
SPACE_BEFORE_MARK = r"\s+([.,!?;:])"
SHORT_FRAGMENTS = ["hi terry", "no nagging", "non toxic", "not necessarily"]
DOMAIN_AT_END = r"(?i)\b[A-Za-z0-9][A-Za-z0-9.-]*\.(?:com|edu|net|org)\.?$"
BAD_BOUNDARY = r"(?i)\b[a-z]{2,}[.!?][\"']?[a-z]{2,}\b"
AGE_AND_PLACE = (
    r"(?i)^[a-z][a-z' -]+,\s*\d{1,3},\s+[^.]+\bof\b[^.]+,\s*(?:a[krlz]|c[aot]|d[ce]|fl|ga|hi|i[adln]|k[sy]|la|m[adeinost]|"
    r"n[cdehjmvy]|o[hkr]|pa|ri|s[cd]|t[nx]|ut|v[at]|w[aivy])\.$"
)
#: Limits of the quality rules.
#: Words whose dot ends no sentence.
ABBREVIATIONS = "Dr Mr Mrs Ms Prof St Jr Sr Gen Col Rep Sen Rev Lt Capt Sgt No Nos Fig Figs vs etc al cf approx dept e.g i.e".split()
LIMITS = {"min_words": 4, "min_letters": 4, "max_words": 120, "boundary_words": 50, "parenthetical_words": 8, "punctuation": 0.45, "upper_noise": 0.65}


@F.pandas_udf(T.StringType())
def unicode_stage(text: pd.Series) -> pd.Series:
    """Entities decoded, then NFKC: the only steps that the JVM's functions lack."""
    return text.map(lambda t: unicodedata.normalize("NFKC", html.unescape(t)), na_action="ignore")


@F.pandas_udf(T.StringType())
def folded(text: pd.Series) -> pd.Series:
    """NFKC, then letters without their accents."""
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", t)) if not unicodedata.combining(c))
    return text.map(lambda t: t if t.isascii() else plain(t), na_action="ignore")


def clean_english_sentence(text: Column, unicode: bool = True, marks: bool = True, numbers: bool = True) -> Column:
    """The cleaned sentence; unicode=False leaves out unicode_stage and stays in the JVM."""
    x = unicode_stage(text) if unicode else text
    x = F.translate(x, *DASHES_AND_QUOTES)
    for pattern, put in CLEANING:
        x = F.regexp_replace(x, pattern, put)
    x = F.trim(x)
    if marks:
        x = F.trim(F.regexp_replace(x, LEADING_MARKS, ""))
    if numbers:
        x = F.trim(F.regexp_replace(x, LEADING_NUMBER, ""))
    x = F.trim(F.regexp_replace(x, TRAILING_FACE, ""))
    return F.trim(F.regexp_replace(x, SPACE_BEFORE_MARK, "$1"))


def repair_boundaries(text: Column) -> Column:
    """A space between a word's closing mark and the word that follows without one."""
    return F.regexp_replace(text, r"\b([A-Za-z]{2,}[.!?][\"']?)(?=[A-Za-z]{2,}\b)", "$1 ")


#: Private characters: a dot that ends nothing, and a place where a sentence ends.
HELD, ENDED = "\ue000", "\ue001"
SPACES = r"[\s\p{Z}]+"
SENTENCE_RULES = [
    (r"(^|[^A-Za-z])(" + "|".join(re.escape(w) for w in ABBREVIATIONS) + r")\.", rf"\1\2{HELD}"),
    (r"(^|[^A-Za-z])([A-Z])\.", rf"\1\2{HELD}"),
    (r"(^|[^A-Za-z])([A-Z])\.", rf"\1\2{HELD}"),
    (r"([.!?][\"')\]]*)\s+([\"'(\[]*[A-Z0-9])", rf"\1{ENDED}\2"),
]


def split_sentences(text: Column, delimiter: str | None = " / ", rules: bool = True) -> Column:
    """Trimmed, non-empty sentences of a text, white space collapsed first: the parts around a delimiter, or, without
    one, those that rules find: after closing marks before a capital or a number, but not after abbreviations and
    initials. Without either, the whole text is one sentence."""
    flat = F.trim(F.regexp_replace(text, SPACES, " "))
    if delimiter:
        parts = F.split(flat, r"\Q" + delimiter + r"\E")
    elif rules:
        for pattern, put in SENTENCE_RULES:
            flat = F.regexp_replace(flat, pattern, re.sub(r"\\(\d)", r"$\1", put))
        parts = F.transform(F.split(flat, ENDED), lambda s: F.translate(s, HELD, "."))
    else:
        parts = F.array(flat)
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def quality(cleaned: Column) -> dict[str, Column]:
    """Measures of a cleaned sentence by name, and the reason why it is dropped, or 'kept'."""
    size = F.length(cleaned)
    words = F.regexp_count(cleaned, F.lit(r"[A-Za-z]+|[0-9]+"))
    letters = F.regexp_count(cleaned, F.lit(r"[A-Za-z]"))
    marks = F.regexp_count(cleaned, F.lit(r"[^A-Za-z0-9\s]"))
    ratio = F.when(size > 0, marks / size).otherwise(F.lit(0.0))
    chunks = F.regexp_extract_all(cleaned, F.lit(r"([A-Za-z0-9]+)"), F.lit(1))
    noisy = F.filter(chunks, lambda c: c.rlike("[0-9]") | (c.rlike("^[A-Z]+$") & (F.length(c) <= 5)))
    upper = (F.size(chunks) >= 3) & (F.size(noisy) / F.greatest(F.size(chunks), F.lit(1)) >= LIMITS["upper_noise"])
    key = F.array_join(F.regexp_extract_all(F.lower(cleaned), F.lit(r"([a-z]+)"), F.lit(1)), " ")
    rules = [
        ("empty_after_cleaning", cleaned == ""),
        ("punctuation_only", cleaned.rlike(r"^[^A-Za-z0-9]+$")),
        ("parenthetical_only", cleaned.rlike(r"^\([^()]+\)\.?$") & (words <= LIMITS["parenthetical_words"])),
        ("domain_ending_fragment", cleaned.rlike(DOMAIN_AT_END)),
        ("unbalanced_parentheses", F.regexp_count(cleaned, F.lit(r"\(")) > F.regexp_count(cleaned, F.lit(r"\)"))),
        ("too_many_word_tokens", words > LIMITS["max_words"]),
        ("bad_sentence_boundary", (words >= LIMITS["boundary_words"]) & cleaned.rlike(BAD_BOUNDARY)),
        ("age_location_appositive_fragment", cleaned.rlike(AGE_AND_PLACE)),
        ("upper_noise", upper),
        ("short_fragment_no_terminal_punctuation", (words <= 3) & ~cleaned.rlike(r"[.?!]$")),
        ("short_discourse_fragment", (words <= 2) & key.isin(SHORT_FRAGMENTS)),
        ("too_few_word_tokens", words < LIMITS["min_words"]),
        ("too_few_alpha_chars", letters < LIMITS["min_letters"]),
        ("punctuation_heavy", ratio > LIMITS["punctuation"]),
    ]
    reason = F.lit("kept")
    for name, rule in reversed(rules):
        reason = F.when(rule, F.lit(name)).otherwise(reason)
    return {"reason": reason, "char_count": size, "word_count": words, "alpha_count": letters, "punctuation_ratio": ratio}


def english_tokens(text: Column, min_length: int = 2, number: str | None = "<NUM>", fold: bool = False, lemmas: dict[str, str] | None = None) -> Column:
    """Lower-case words of letters and a sign for each number (None keeps numbers), in order; words shorter than min_length are dropped. fold reads letters without accents.

    lemmas replace words from a small table, which becomes part of the plan; a table of more than 1,000 words is joined by corpus.lemmatised().
    """
    found = F.regexp_extract_all(folded(text) if fold else text, F.lit(r"([A-Za-z]+|[0-9]+(?:[.,][0-9]+)?)"), F.lit(1))
    words = F.transform(found, lambda w: F.when(w.rlike("^[0-9]"), w if number is None else F.lit(number)).otherwise(F.lower(w)))
    if lemmas:
        if len(lemmas) > 1000:
            raise ValueError("join more than 1,000 lemmas by corpus.lemmatised()")
        table = F.create_map(*[F.lit(x) for pair in lemmas.items() for x in pair])
        words = F.transform(words, lambda w: F.coalesce(table[w], w))
    return F.filter(words, lambda w: w.rlike("^[0-9<]") | (F.length(w) >= min_length))


#: Runs of one Japanese script, of Latin letters, or a number.
JAPANESE_TOKEN = "[一-龯々〆]+|[ァ-ヶー]+|[ぁ-ゖ]+|[A-Za-z]+|[0-9]+"


def script_runs(text: Column) -> Column:
    """Japanese text as runs of one script, Latin words in lower case, <NUM> for numbers. It is no morphological analysis: a word of two scripts is two tokens."""
    found = F.regexp_extract_all(text, F.lit(f"({JAPANESE_TOKEN})"), F.lit(1))
    return F.transform(found, lambda w: F.when(w.rlike("^[0-9]"), F.lit("<NUM>")).otherwise(F.lower(w)))


def whitespace_terms(text: Column, stopwords: list[str] = (), fold: bool = False) -> Column:
    """Lower-case terms with punctuation and digits read as spaces, without stopwords; fold reads letters without accents."""
    spaced = F.regexp_replace(F.lower(folded(text) if fold else text), r"[^a-z]+", " ")
    return F.filter(F.split(F.trim(spaced), " "), lambda w: (w != "") & ~w.isin(list(stopwords)))


def with_prefix(text: Column, prefix: str) -> Column:
    return F.when(F.startswith(text, F.lit(prefix)), text).otherwise(F.concat(F.lit(prefix), text))


def slug(text: Column, longest: int = 40) -> Column:
    """Letters without accents and digits in lower case, all else as single hyphens; 'na' if nothing is left."""
    plain = F.regexp_replace(F.lower(folded(text)), r"[^a-z0-9]+", "-")
    short = F.regexp_replace(F.substring(F.regexp_replace(plain, r"^-+|-+$", ""), 1, longest), r"-+$", "")
    return F.when(short == "", "na").otherwise(short)


def selector_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def fingerprint(columns: dict[str, Column], digits: int = 10) -> Column:
    """First digits of the SHA-1 of a canonical JSON: names in order, no blanks, null for null, other letters than ASCII escaped."""
    mark = lambda h: F.concat(F.lit("\\u"), h)
    unit = lambda h: F.when(F.length(h) > 4, F.concat(mark(F.substring(h, 1, 4)), mark(F.substring(h, 5, 4)))).otherwise(mark(h))
    values = F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)]), {"ignoreNullFields": "false"})
    escaped = F.aggregate(
        F.split(values, ""), F.lit(""), lambda a, c: F.concat(a, F.when(c.rlike(r"^[\x00-\x7f]?$"), c).otherwise(unit(F.lower(F.hex(F.encode(c, "UTF-16BE"))))))
    )
    return F.substring(F.sha1(F.when(values.rlike(r"^[\x00-\x7f]*$"), values).otherwise(escaped)), 1, digits)


def latex(text: Column) -> Column:
    for a, b in (("\\", "\\textbackslash "), ("&", "\\&"), ("%", "\\%"), ("$", "\\$"), ("#", "\\#"), ("_", "\\_"), ("{", "\\{"), ("}", "\\}")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def hash_order(seed: str, *key: Column) -> Column:
    """A uniform order by key that every engine with MD5 can repeat."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[k.cast("string") for k in key]))


def hash_uniform(seed: str, *key: Column) -> Column:
    return F.conv(F.substring(hash_order(seed, *key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
