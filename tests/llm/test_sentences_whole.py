"""Problem 4: the signs that end sentences in every script."""

import pytest
import regex

from topicloom.llm import sentences


@pytest.mark.parametrize("text", ["ខ្ញុំទៅ។ គាត់មក។", "ទៅ៕ មក៕", "ܐܒܐ܀ ܐܡܐ܀", "ߒߏ߹ ߒߞߏ߹", "ᐃᓄᒃ᙮ ᐃᓄᒃ᙮", "ꓡꓲ꓿ ꓢꓴ꓿", "One﹖ Two﹖", "One﹗ Two﹗", "One⸮ Two⸮"])
def test_terminators_of_other_scripts(text):
    assert [text[a:b] for a, b in sentences.split(text)] == text.replace(" ", "\n").split("\n")


def test_every_terminator_of_the_standard_is_known():
    assert all(chr(c) in sentences.TERMINATORS for c in range(0x20000) if not 0xD800 <= c < 0xE000 and regex.match(r"[\p{SB=STerm}\p{SB=ATerm}]", chr(c)))
    assert len(sentences.split("Dr﹒ May went to Rome")) == 1


def test_names_that_hold_a_mark_follow_rules_not_lists():
    one = lambda t: [t[a:b] for a, b in sentences.split(t)]
    assert one("Nobody at Wham! Records sold it. She left.") == ["Nobody at Wham! Records sold it.", "She left."]
    assert one("I work at Wham! The boss is nice.") == ["I work at Wham!", "The boss is nice."]
    assert one("Stop! Cars are coming.") == ["Stop!", "Cars are coming."]
    assert one("昨日きらり!商店が移転した。次の文。") == ["昨日きらり!商店が移転した。", "次の文。"]


def test_context_of_any_length_counts():
    url = "http://host.example/" + "a." * 300 + "b"
    assert len(sentences.split(f"See {url} for more. Then go.")) == 2
    long = "Der Bericht kam an. " + "Wörter " * 200 + "kamen am 3. Tag an. Ende."
    assert long[slice(*sentences.split(long)[1])].endswith("kamen am 3. Tag an.")
    assert len(sentences.split("a." * 100_000)) >= 1
