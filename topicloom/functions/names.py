"""Names of languages, ways to split and ways to make tokens, and the columns they stand for."""

from __future__ import annotations

from pyspark.sql import Column

from topicloom.functions import text as X

# Names that settings may use.
LANGUAGES = {"english": "en", "japanese": "ja"}
SEGMENTERS = {"pysbd": "rules", "rules": "rules", "default": "delimiter", "delimiter": "delimiter", "split_on_delimiter": "delimiter"}
TOKENIZERS = {"simple": "words", "gensim": "words", "words": "words", "mecab": "scripts", "scripts": "scripts"}


def language(name: str) -> str:
    """Two letters for a language's name or code."""
    plain = name.strip().lower()
    return LANGUAGES.get(plain, plain[:2])


def _known(kind: str, table: dict[str, str], name: str) -> str:
    plain = name.strip().lower()
    if plain not in table:
        raise ValueError(f"{kind} {name!r} is none of {sorted(table)}")
    return table[plain]


def tokenizer(language_name: str, name: str = "default") -> str:
    """'words' or 'scripts'; by default scripts for Japanese and words for the rest, and neither for the other."""
    japanese = language(language_name) == "ja"
    if name.strip().lower() == "default":
        return "scripts" if japanese else "words"
    found = _known("tokenizer", TOKENIZERS, name)
    if (found == "scripts") != japanese:
        raise ValueError(f"tokenizer {name!r} is {'not ' if japanese else 'only '}for Japanese text")
    return found


def sentences(text: Column, segmenter: str = "default", delimiter: str | None = " / ") -> Column:
    """The sentences of a text by the segmenter of a name; the delimiter None keeps the text whole."""
    by_rules = _known("segmenter", SEGMENTERS, segmenter) == "rules"
    return X.split_sentences(text, None if by_rules else delimiter, rules=by_rules)


def tokens(text: Column, language_name: str, name: str = "default") -> Column:
    """The tokens of a text in a language by the tokenizer of a name."""
    return X.script_runs(text) if tokenizer(language_name, name) == "scripts" else X.english_tokens(text, fold=True)
