import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.functions import numeric as N
from topicloom.functions import text as X


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, v {kind}")
    return [r["o"] for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_cleaning(spark):
    given = [": >>> ----------", "2. Japanese manufacturers peddling encryption chips.", "ii) When I open an Xterm.", "licensing costs... of course :)", "See &lt;me&gt; at http://x.org/a now", None]
    want = ["", "Japanese manufacturers peddling encryption chips.", "When I open an Xterm.", "licensing costs of course", "See me at now", None]
    assert column(spark, given, X.clean_english_sentence) == want


@pytest.mark.parametrize("unicode", [True, False])
def test_quality_reasons(spark, unicode):
    cases = {
        "(Istanbul, 1916).": "parenthetical_only",
        "Seattle, WA 98195": "upper_noise",
        "Hi, Terry.": "short_discourse_fragment",
        "word " * 121: "too_many_word_tokens",
        "This sentence is long enough to keep.": "kept",
        "": "empty_after_cleaning",
        "?!.,": "punctuation_only",
        "Mail it to the host at foo.edu": "domain_ending_fragment",
        "He opened (the door and left again": "unbalanced_parentheses",
        "two words": "short_fragment_no_terminal_punctuation",
        "Yes it is.": "too_few_word_tokens",
    }
    got = column(spark, list(cases), lambda v: X.quality(X.clean_english_sentence(v, unicode))["reason"])
    assert dict(zip(cases, got, strict=True)) == cases


def test_boundaries_and_splits(spark):
    assert column(spark, ["ten years.the major came"], X.repair_boundaries) == ["ten years. the major came"]
    assert column(spark, ["alpha / beta /  gamma", "  ", None], lambda v: X.split_sentences(v)) == [["alpha", "beta", "gamma"], [], None]


def test_tokens(spark):
    lemmas = {"running": "run", "ran": "run", "runners": "runner", "tests": "test"}
    assert column(spark, ["Running runners ran 123 tests. a"], lambda v: X.english_tokens(v, lemmas=lemmas)) == [["run", "runner", "run", "<NUM>", "test"]]
    assert column(spark, ["1,234.5"], X.english_tokens) == [["<NUM>", "<NUM>"]]


def test_slug_prefix_selector(spark):
    assert column(spark, ["Ab c--D!", "x" * 50], lambda v: X.slug(v)) == ["ab-c-d", "x" * 40]
    assert column(spark, ["x: a", "a"], lambda v: X.with_prefix(v, "x: ")) == ["x: a", "x: a"]
    assert column(spark, ["Blei LDA (v2)"], X.selector_key) == ["bleildav2"]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0, 0.0], [3.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 1.0])], "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>")
    assert [r[0] for r in df.select(N.cosine("a", "b")).collect()] == [0.0, 1.0, -1.0, 0.0]
    got = df.select(N.logsumexp("b"), N.softmax("b", 0.5), N.argmax("b"), N.unit_interval("b")).first()
    assert got[0] == pytest.approx(math.log(1 + math.e**2)) and sum(got[1]) == pytest.approx(1) and got[2] == 1 and got[3] == pytest.approx([0, 1])


def test_rounding(spark):
    assert column(spark, [0.0226815, -0.0000001, 1.5], N.r6, "DOUBLE") == [0.022682, 0.0, 1.5]


def test_bessel_against_series():
    for order, x in ((31, 5.0), (31, 80.0), (0.5, 3.0), (10, 200.0)):
        terms = [(2 * m + order) * math.log(x / 2) - math.lgamma(m + 1) - math.lgamma(m + order + 1) for m in range(600)]
        top = max(terms)
        assert N.log_bessel_i(order, x) == pytest.approx(top + math.log(sum(math.exp(t - top) for t in terms)), abs=1e-5)


def test_digamma():
    assert N.digamma(1) == pytest.approx(-0.5772156649015329, abs=1e-9)
    assert N.digamma(10.5) == pytest.approx((math.lgamma(10.5 + 1e-5) - math.lgamma(10.5 - 1e-5)) / 2e-5, abs=1e-5)


def test_vmf_density_integrates_on_the_circle():
    k = 2.5
    angles = np.linspace(0, 2 * math.pi, 2001)[:-1]
    assert np.mean(np.exp(N.vmf_log_normaliser(k, 2) + k * np.cos(angles))) * 2 * math.pi == pytest.approx(1, abs=1e-6)


def test_hash_order_is_stable(spark):
    rng = random.Random(0)
    values = [str(rng.random()) for _ in range(5)]
    import hashlib

    want = [int(hashlib.md5(f"7|{v}".encode()).hexdigest()[:8], 16) / 2**32 for v in values]
    assert column(spark, values, lambda v: X.hash_uniform("7", v)) == pytest.approx(want)
