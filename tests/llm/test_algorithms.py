"""Problems 1, 3, 5, 6, 7 and 8 against plain versions, with the cases that data bring."""

import html
import itertools
import json
import math
import os
import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.llm import mixing, overlap, sampling, termcounts, tokens, topn

T0 = datetime(2024, 1, 1)


# 1 -----------------------------------------------------------------------------------------------


def scored_rows(seed, n=3000):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        run, topic = rng.choice(["a", "b"]), rng.choice([0, 0, 0, 0, 1, 2, None])
        p = rng.choice([None, float("nan"), 0.5, 0.5, round(rng.random(), 2)])
        rows.append((run, topic, rng.randrange(150), rng.randrange(4), p, T0 + timedelta(seconds=rng.randrange(10_000_000))))
    return rows + rows[:200]


def plain_top(rows, n):
    last = {}
    for r in rows:
        if r[1] is not None and (r[:4] not in last or r[5] > last[r[:4]][5]):
            last[r[:4]] = r
    groups = {}
    for r in last.values():
        if r[4] is not None and not math.isnan(r[4]):
            groups.setdefault(r[:2], []).append((-r[4], r[2], r[3]))
    return {(*g, d, s) for g, items in groups.items() for _, d, s in sorted(items)[:n]}


@pytest.mark.parametrize("hot_rows", [0, 100, 10**9])
def test_top_n(spark, hot_rows):
    rows = scored_rows(1)
    df = spark.createDataFrame(rows, "data_run STRING, topic_id INT, doc_id LONG, sent_id INT, p DOUBLE, loaded_at TIMESTAMP").withColumn("rank", F.lit("clash"))
    got = topn.best_sentences(df, 10, hot_rows)
    assert {tuple(r) for r in got.select("data_run", "topic_id", "doc_id", "sent_id").collect()} == plain_top(rows, 10)
    assert got.groupBy("data_run", "topic_id").agg(F.max("rank").alias("m"), F.count(F.lit(1)).alias("n")).where("m <> n").count() == 0


def test_top_n_empty_and_nulls(spark):
    s = spark.createDataFrame([], "data_run STRING, topic_id INT, doc_id LONG, sent_id INT, p DOUBLE, loaded_at TIMESTAMP")
    d = spark.createDataFrame([(None, None, 1, 0.5, None), (None, None, 2, 0.7, None)], "data_run STRING, doc_id LONG, topic_id INT, theta DOUBLE, loaded_at TIMESTAMP")
    assert sorted(r["topic_id"] for r in topn.found(s, d).collect()) == [1, 2]


# 3 -----------------------------------------------------------------------------------------------


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_word_distance():
    rng = random.Random(2)
    for _ in range(300):
        a = [rng.randrange(6) for _ in range(rng.randrange(30))]
        b = [x for x in a if rng.random() > 0.2] + [rng.randrange(6) for _ in range(rng.randrange(4))]
        want, most = edit(a, b), rng.randrange(12)
        assert overlap.word_distance(a, b, most) == min(want, most + 1)
        assert overlap.fewest_edits(a, b) <= want


def test_reader_words():
    assert overlap.reader_words("Tom &amp;amp; Ｊｅｒｒｙ’s co\u00adop\u200b №5 &eacute;t\u0065\u0301!") == ["tom", "jerry", "s", "coop", "no5", "été"]
    assert overlap.reader_words(None) == overlap.reader_words("") == []


def corpus_for_overlap(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    train, test = [], []
    for i in range(120):
        base = [rng.choice(words) for _ in range(rng.choice([18, 20, 21, 25, 40, 80]))]
        train.append((i, " ".join(base)))
        new = list(base)
        for _ in range(rng.randrange(0, int(len(base) * 0.3) + 1)):
            kind, at = rng.randrange(3), rng.randrange(max(1, len(new)))
            if kind == 0:
                new.insert(at, rng.choice(words))
            elif kind == 1 and new:
                del new[at]
            elif new:
                new[at] = rng.choice(words)
        test.append((1000 + i, rng.choice([", ", "  ", "\n"]).join(w.upper() if rng.random() < 0.3 else w for w in new)))
    return train + [(500, None), (501, "")] + train[:9] + [(900 + i, t) for i, t in train[:5]], test + [(2000, None)] + test[:4]


@pytest.mark.parametrize("seed,chunk", [(1, 1 << 20), (2, 300)])
def test_overlap_loses_nothing(spark, seed, chunk, monkeypatch):
    monkeypatch.setattr(overlap, "CHUNK", chunk)
    train, test = corpus_for_overlap(seed)
    a = spark.createDataFrame([(i, t, "src") for i, t in train], "row_id LONG, data STRING, source STRING").withColumn("side", F.lit(1))
    b = spark.createDataFrame([(i, t, "dev" if i % 2 else "test", None) for i, t in test], "row_id LONG, data STRING, split STRING, source STRING")
    want = set()
    for (i, x), (j, y) in itertools.product(set(train), set(test)):
        u, v = overlap.reader_words(x), overlap.reader_words(y)
        if min(len(u), len(v)) >= 20 and edit(u, v) * 100 <= 20 * max(len(u), len(v)):
            want.add((i, j))
    got = overlap.found(a, b)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    by = {(r["split"], r["source"]): (r["rows"], r["pairs"]) for r in overlap.report(a, b).collect()}
    assert sum(p for _, p in by.values()) == len(want) and sum(n for n, _ in by.values()) == len({j for _, j in want})


def phrased(rng, phrases):
    return " ".join(rng.choice(phrases) for _ in range(20))


def test_pairs_that_share_phrases_only_do_not_travel(spark, monkeypatch):
    rng = random.Random(4)
    phrases = [" ".join(f"w{rng.randrange(400)}" for _ in range(5)) for _ in range(60)]
    train = [(i, phrased(rng, phrases)) for i in range(300)]
    test = [(1000 + i, phrased(rng, phrases)) for i in range(100)] + [(2000 + i, "new " * 5 + " ".join(t.split()[5:])) for i, t in train[:5]]
    sent, verified = [], overlap._verified
    monkeypatch.setattr(overlap, "_verified", lambda pairs: sent.append(pairs.count()) or verified(pairs))
    a = spark.createDataFrame(train, "row_id LONG, data STRING")
    b = spark.createDataFrame([(i, t, "test", "s") for i, t in test], "row_id LONG, data STRING, split STRING, source STRING")
    got = {tuple(r) for r in overlap.found(a, b).collect()}
    want = {(i, j) for (i, x), (j, y) in itertools.product(train, test) if overlap.word_distance(x.split(), y.split(), 20) <= 20}
    assert got == want >= {(i, 2000 + i) for i in range(5)} and len(want) <= sent[0] <= len(want) + 20


@pytest.mark.parametrize("rows,compared", [(150, 1 << 20), (1 << 20, 9), (150, 9)])
def test_overlap_in_small_blocks(spark, monkeypatch, rows, compared):
    for name, value in (("INDEX_ROWS", rows), ("PROBE_ROWS", rows), ("COMPARED", compared), ("CHUNK", 500)):
        monkeypatch.setattr(overlap, name, value)
    train, test = corpus_for_overlap(3)
    a = spark.createDataFrame(train, "row_id LONG, data STRING")
    b = spark.createDataFrame([(i, t, "test", "s") for i, t in test], "row_id LONG, data STRING, split STRING, source STRING")
    want = set()
    for (i, x), (j, y) in itertools.product(set(train), set(test)):
        u, v = overlap.reader_words(x), overlap.reader_words(y)
        if min(len(u), len(v)) >= 20 and overlap.word_distance(u, v, 100) * 100 <= 20 * max(len(u), len(v)):
            want.add((i, j))
    assert {tuple(r) for r in overlap.found(a, b).collect()} == want
    assert sum(r["pairs"] for r in overlap.report(a, b).collect()) == len(want)


@pytest.mark.parametrize("compared", [1, 8, 50])
def test_compared_pairs_do_not_depend_on_their_number_at_once(monkeypatch, compared):
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(20, 60))) for _ in range(40)]
    texts += [t + " w1" for t in texts[:20]]
    rarity = overlap.Rarity(np.full(8, 255, np.uint8), np.zeros(64, np.uint32))
    both = []
    for side in (texts[:30], texts[30:]):
        side = [t.split() for t in side]
        both.append(overlap._rare_places([" ".join(t) for t in side], [len(t) for t in side], rarity) + (np.array([len(t) for t in side]),))
    (*rows, sketches, lengths), (text, shingle, place, served, theirs, long) = both
    keys = overlap._keys(shingle, long[text])
    order = np.argsort(keys)
    block = [np.arange(30), long, theirs, keys[order], text[order], (place[order] << 1) | served[order]]
    near = lambda: {p for a, b in overlap._near(block, lengths, sketches, rows[1], rows[0], *rows[2:]) for p in zip(a.tolist(), b.tolist(), strict=True)}
    whole = near()
    monkeypatch.setattr(overlap, "COMPARED", compared)
    assert near() == whole >= {(i, i + 10) for i in range(20)}


def test_rows_of_several_texts_are_counted_once(spark):
    x, y, z = ("one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty " + t for t in ("a", "b", "c"))
    train = spark.createDataFrame([(1, x), (1, y), (2, x), (3, z), (3, None)], "row_id LONG, data STRING")
    test = spark.createDataFrame([(7, x, "test", " S "), (8, y, "dev", None), (8, z, "dev", None), (9, x, "test", "s")], "row_id LONG, data STRING, split STRING, source STRING")
    assert {tuple(r) for r in overlap.found(train, test).collect()} == {(a, b) for a in (1, 2, 3) for b in (7, 8, 9)}
    assert {tuple(r) for r in overlap.report(train, test).collect()} == {("test", "s", 2, 6), ("dev", "", 1, 3)}


def test_hashes_do_not_depend_on_the_batch():
    texts = ["a b c d", "x", "ü b c d e ü", "a b c d"]
    words, at = overlap.text_hashes(texts)
    assert [b - a for a, b in zip(at, at[1:], strict=False)] == [4, 1, 6, 4]
    assert (words[at[0] : at[1]] == words[at[3] : at[4]]).all() and words[at[2]] == words[at[2] + 5]
    shingles, to = overlap._shingles_of(texts)
    assert [b - a for a, b in zip(to, to[1:], strict=False)] == [2, 0, 4, 2]
    for i, t in enumerate(texts):
        assert (shingles[to[i] : to[i + 1]] == overlap._shingles_of([t])[0]).all()
    assert overlap.reader_words("a &" + "amp;" * 50 + "lt; b") == ["a", "b"]


def test_overlap_of_empty_tables(spark):
    a = spark.createDataFrame([], "row_id LONG, data STRING, source STRING")
    b = spark.createDataFrame([], "row_id LONG, data STRING, split STRING, source STRING")
    assert overlap.found(a, b).count() == 0


# 5 -----------------------------------------------------------------------------------------------


def page(i, n=6, broken=False):
    text = json.dumps({"id": str(i), "title": f"t{i}", "tokens": ["x"] * n})
    return text[: len(text) // 2] if broken else text


def stream_rows():
    rows = []
    for piece in range(4):
        for line in range(1, 41):
            i = (piece * 13 + line * 7) % 90
            rows.append((piece, line, T0, str(i), f"t{i}", 1, page(i, 6 if i % 5 else 3, broken=line % 11 == 0)))
    return rows + [(9, 1, None, None, None, None, page(777)), (9, 2, None, None, None, None, None), (9, 3, None, "8", None, None, ""), (9, 4, None, "8", None, None, page(8) + " tail")]


SCHEMA = "piece_id INT, line_no INT, arrived_at TIMESTAMP, page_id STRING, title STRING, token_count INT, row_json STRING"


def plain_pages(rows):
    first = {}
    for piece, line, _, given, _, _, text in rows:
        try:
            obj = json.loads(text)
        except (TypeError, ValueError):
            continue
        if len(obj["tokens"]) >= 5:
            key = given or obj["id"]
            first[key] = min(first.get(key, (99, 99, "")), (piece, line, text))
    return first


def test_sample_is_drawn_from_distinct_eligible_pages(spark):
    rows = stream_rows()
    first = plain_pages(rows)
    order = {v[2]: i for i, v in enumerate(sorted(first.values()), 1)}
    got = sampling.reservoir_sample(spark.createDataFrame(rows, SCHEMA), 20, seed=3).collect()
    assert len(got) == 20 and len({r["row_json"] for r in got}) == 20 and sorted(r["slot"] for r in got) == list(range(20))
    assert all(order[r["row_json"]] == r["eligible_index"] for r in got)


def test_sample_of_few_and_of_none(spark):
    rows = stream_rows()
    assert sampling.reservoir_sample(spark.createDataFrame(rows, SCHEMA), 500).count() == len(plain_pages(rows))
    assert sampling.reservoir_sample(spark.createDataFrame([], SCHEMA), 5).count() == 0


@pytest.mark.parametrize("sizes", [[1, 9998, 1], [1] * 400, [5, 0, 5], [64], [65], [30, 34]])
def test_odd_blocks(sizes):
    slots = sampling.draw_slots(len(sizes), max(sizes), 64, 1, lambda blocks: {b: sizes[b] for b in blocks})
    assert len(set(slots)) == len(slots) == min(64, sum(sizes)) and all(0 <= o < sizes[b] for b, o in slots)


def test_sample_over_many_unequal_row_groups(spark, monkeypatch):
    monkeypatch.setattr(sampling, "BLOCK_ROWS", 150)
    rows = [(i % 7, i, None, str(i), "t", 1, page(i)) for i in range(3000)] * 2 + [(1, 5000 + i, None, "7", "t", 1, page(7)) for i in range(2000)]
    df = spark.createDataFrame(rows, SCHEMA)
    asked = []
    known = sampling.draw_slots
    monkeypatch.setattr(sampling, "draw_slots", lambda blocks, largest, *a: asked.append((blocks, largest)) or known(blocks, largest, *a))
    got = sampling.reservoir_sample(df, 64, seed=4).collect()
    assert asked[0][0] >= 20 and asked[0][1] <= 150
    first = plain_pages(rows)
    order = {v[2]: i for i, v in enumerate(sorted(first.values()), 1)}
    assert len({r["row_json"] for r in got}) == len(got) == 64 and all(order[r["row_json"]] == r["eligible_index"] for r in got)


def test_every_row_is_equally_likely():
    sizes, hits = [3, 50, 17, 1], Counter()
    for seed in range(4000):
        hits.update(sampling.draw_slots(4, 50, 5, seed, lambda blocks: {b: sizes[b] for b in blocks}))
    counts = np.array([hits[b, o] for b, n in enumerate(sizes) for o in range(n)])
    expected = 4000 * 5 / 71
    chi = ((counts - expected) ** 2 / expected).sum() / (1 - 5 / 71)
    assert chi < 70 + 4 * math.sqrt(140)


# 6 -----------------------------------------------------------------------------------------------


def documents_of_tokens(seed):
    rng = random.Random(seed)
    words = ["a", "b", " B ", "Ａ", "c d", "", None, "ß", "x"]
    return [(i, [rng.choice(words) for _ in range(rng.randrange(12))]) for i in range(60)] + [(90, None), (91, [])]


@pytest.mark.parametrize("block", [7, 10**6])
def test_counts_of_ngrams(spark, block):
    docs = documents_of_tokens(5)
    df = spark.createDataFrame(docs, "doc_id LONG, document_tokens ARRAY<STRING>").repartition(3)
    cf, recs = Counter(), Counter()
    for _, toks in docs:
        t = [x for x in map(termcounts.normal_term, toks or []) if x]
        grams = [termcounts.GLUE.join(t[i : i + n]) for n in (1, 2, 3) for i in range(len(t) - n + 1)]
        cf.update(grams)
        recs.update(set(grams))
    got = {r["term"]: (r["occurrences"], r["records"]) for r in termcounts.ngram_counts(df, max_n=3, block_tokens=block).collect()}
    assert got == {g: (cf[g], recs[g]) for g in cf}


def test_suffix_array_sorts_suffixes():
    rng = np.random.default_rng(0)
    text = rng.integers(0, 3, 200)
    order, levels = termcounts.suffix_array(text)
    suffixes = [tuple(text[i:]) for i in order]
    assert suffixes == sorted(suffixes)
    lcp = termcounts.common_prefixes(order, levels)
    for i in range(1, len(text)):
        a, b = suffixes[i - 1], suffixes[i]
        assert lcp[i] == next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_ngrams_of_every_length(spark):
    long = [f"w{i % 7}" for i in range(40)]
    docs = [(1, long), (2, long), (3, long[5:25]), (4, ["w1", "w2"]), (5, [])]
    df = spark.createDataFrame(docs, "doc_id LONG, document_tokens ARRAY<STRING>").coalesce(1)
    cf, recs = Counter(), Counter()
    for _, t in docs:
        grams = [termcounts.GLUE.join(t[i : i + n]) for n in range(1, len(t) + 1) for i in range(len(t) - n + 1)]
        cf.update(grams)
        recs.update(set(grams))
    got = {r["term"]: (r["occurrences"], r["records"]) for r in termcounts.ngram_counts(df, max_n=None).collect()}
    assert got == {g: (cf[g], recs[g]) for g in cf}


def test_marks_count_the_latest_delivery_only(spark):
    rows = [(1, 1, ["old"]), (1, 2, ["new", "all"]), (2, 1, ["all", "two"]), (3, 1, ["all", "two"]), (4, 1, ["all", "two"]), (5, 1, None), (6, 1, ["", " "])]
    df = spark.createDataFrame(rows, "doc_id LONG, prepared_at INT, document_tokens ARRAY<STRING>")
    assert {tuple(r) for r in termcounts.found(df).collect()} == {("new", "rare"), ("all", "common"), ("two", "common")}
    vocab = spark.createDataFrame([(0, "ALL"), (1, "none"), (2, None), (3, "")], "word_id INT, word STRING")
    both = {(r["word_id"], r["term"]): r["records"] for r in termcounts.against_vocabulary(df, vocab).collect()}
    assert both[0, "all"] == 4 and both[1, "none"] == 0 and both[2, None] == both[3, None] == 0 and both[None, "two"] == 3


# 7 -----------------------------------------------------------------------------------------------

needs_file = pytest.mark.skipif(not os.path.exists(tokens.DEFAULT_TOKENIZER), reason="no tokenizer file here")


@needs_file
def test_ids_equal_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.DEFAULT_TOKENIZER)
    library.encode_special_tokens = True
    rng = random.Random(7)
    alphabet = ["a", "e", "th", "ing", " ", "  ", "\n", "\t", "1", "23", "'s", "é", "日本", "ไทย", "🙂", "!", "\u00a0", "\u200b", "_", "<|endoftext|>", "Ω"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400)] + ["a" * 3000, " " * 500, "ab" * 700, "<|endoftext|>", "x\ud7ffy"]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None), (-2, "")], "doc_id LONG, text STRING").withColumn("ids", F.lit("clash"))
    got = {r["doc_id"]: r["ids"] for r in tokens.ids(df).collect()}
    assert [got[i] for i in range(len(texts))] == want and got[-1] == got[-2] == []


@needs_file
def test_words_without_the_automaton():
    with open(tokens.DEFAULT_TOKENIZER, encoding="utf-8") as f:
        encoder = tokens.PrefixEncoder(f.read())
    word = "unbelievablyxyzzyantidisestablishment".encode()
    with_automaton = encoder.encode_word(word)
    encoder.walk = None
    assert encoder.encode_word(word) == with_automaton and len(with_automaton) > 3


# 8 -----------------------------------------------------------------------------------------------


def sources():
    S = mixing.Source
    return [S("big", 0.5, 1, 1000, 90_000), S("mid", 0.3, 2, 100, 9_000), S("small", 0.15, 4, 10, 1_000), S("absent", 0.05, 2, 0, 0)]


def test_targets_are_met_where_no_budget_binds():
    exponent, weights, quotas = mixing.plan(sources())
    assert exponent == 1.0 and weights == pytest.approx([0.5 / 0.95, 0.3 / 0.95, 0.15 / 0.95, 0.0])
    assert all(q <= s.most + 1e-6 for q, s in zip(quotas, sources(), strict=True)) and quotas[2] == pytest.approx(4000, abs=1)


def test_a_budget_tempers_the_weights():
    exponent, weights, quotas = mixing.plan(sources(), budget=60_000)
    assert 0 < exponent < 1 and sum(quotas) == pytest.approx(60_000) and all(q <= s.most * (1 + 1e-6) for q, s in zip(quotas, sources(), strict=True))
    assert sum(mixing.plan(sources(), budget=10**9)[2]) == sum(s.most for s in sources())
    target = 0.5
    x = mixing.bisect_exponent(sources(), target_entropy=target)
    assert mixing.entropy(mixing.tempered(sources(), x)) == pytest.approx(target, abs=1e-6)


@needs_file
def test_mix_keeps_limits_and_shares(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 20)
    rng = random.Random(8)
    docs = [(i, " ".join(["word"] * rng.randrange(1, 30)), rng.choice(["Big", " big ", "big", "small"] if i % 9 else ["other", None])) for i in range(900)] + [(10_000, None, "big"), (10_001, "", "small")]
    targets = [("BIG", 0.4, 1), ("small", 0.5, 3), ("missing", 0.1, 2)]
    d = spark.createDataFrame(docs, "doc_id LONG, text STRING, source STRING")
    t = spark.createDataFrame(targets, "source STRING, target_share DOUBLE, max_repeats INT")
    mixed, report = mixing.mix(d, t)
    used = mixed.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("repeat").alias("r")).collect()
    assert all(r["n"] == r["r"] <= {"big": 1, "small": 3}[r["source"]] for r in used)
    got = {r["source"]: r for r in report.collect()}
    assert got["big"]["actual_share"] == pytest.approx(0.4 / 0.9, abs=0.01) and got["small"]["actual_share"] == pytest.approx(0.5 / 0.9, abs=0.01) and got["missing"]["mix_tokens"] == 0
    assert sorted(map(tuple, mixing.mix(d.repartition(5), t)[0].collect())) == sorted(map(tuple, mixed.collect()))


@needs_file
def test_mix_of_nothing(spark):
    d = spark.createDataFrame([], "doc_id LONG, text STRING, source STRING")
    t = spark.createDataFrame([("a", 1.0, 1)], "source STRING, target_share DOUBLE, max_repeats INT")
    mixed, report = mixing.mix(d, t)
    assert mixed.count() == 0 and report.first()["actual_share"] == 0.0


_ = html


def test_a_budget_in_parts_of_the_supply_bisects_the_exponent():
    S = mixing.Source
    sources = [S("a", 0.5, 1, 10, 1000), S("b", 0.3, 2, 10, 4000), S("c", 0.2, 1, 10, 5000)]
    exponent, weights, quotas = mixing.plan(sources, budget=0.5)
    assert 0 < exponent < 1 and sum(quotas) == pytest.approx(5000)
    assert all(q <= s.most + 1e-6 for q, s in zip(quotas, sources, strict=True))
    assert quotas[0] == pytest.approx(1000, rel=1e-6)  # the scarce source is used up, no more
    assert weights[0] > 1000 / 10000  # and still stands above its part of the supply


def test_blocks_joined_by_shuffle_give_the_same_mix(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "some words here " * (i % 5 + 1), "ab"[i % 2]) for i in range(60)], "doc_id LONG, text STRING, source STRING")
    targets = spark.createDataFrame([("a", 0.7, 2), ("b", 0.3, 1)], "source STRING, target_share DOUBLE, max_repeats INT")
    one = sorted(map(tuple, mixing.mix(docs, targets, budget=0.9)[0].collect()))
    monkeypatch.setattr(mixing, "BROADCAST_BLOCKS", 0)
    assert sorted(map(tuple, mixing.mix(docs, targets, budget=0.9)[0].collect())) == one
