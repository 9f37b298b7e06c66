"""Sources, settings, run tables and encoders: results of small cases, and errors where they are due."""

import gzip
import hashlib
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.functions import text as X
from topicloom.models import encoders, gibbs
from topicloom.operators import corpus, runs, sampling
from topicloom.session import release, scratch
from topicloom.sources import config, readers, writers


def values(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_text_lines_and_unstripped_csv(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\n  two \n \n")
    assert values(readers.text_lines(spark, str(tmp_path / "a.txt")), "text") == [("one",), ("two",)]
    (tmp_path / "a.csv").write_text('data,target_str\n" x ",a\n"  ",b\n"y\nz",\n')
    assert values(readers.csv_corpus(spark, str(tmp_path / "a.csv"), strip=False), "text") == [(" x ",), ("y\nz",)]
    with pytest.raises(ValueError, match="no column"):
        readers.csv_corpus(spark, str(tmp_path / "a.csv"), "nothing")


def test_numbers_run_on_over_frames_and_partitions(spark):
    a = spark.range(0, 10, 1, 3).select(F.col("id").alias("x"))
    b = spark.range(100, 105, 1, 2).select(F.col("id").alias("x"))
    got = dict((r["doc_id"], r["x"]) for r in readers.numbered([a, b]).collect())
    assert got == dict(enumerate([*range(10), *range(100, 105)]))


def test_splits_by_name_and_years(spark, tmp_path):
    spark.createDataFrame([(1, "x")], "row_id INT, data STRING").write.parquet(str(tmp_path / "train.parquet"))
    spark.createDataFrame([(2, "y", "dev")], "row_id INT, data STRING, split STRING").write.parquet(str(tmp_path / "test.parquet"))
    catalog = {"mail": ["train", "test"]}
    assert values(readers.dataset_split(spark, str(tmp_path), catalog, "mail"), "row_id", "split") == [(1, "train"), (2, "dev")]
    with pytest.raises(ValueError, match="unknown data set"):
        readers.dataset_split(spark, str(tmp_path), catalog, "news")
    df = spark.createDataFrame([("2020-03-31",), ("2020-04-01",), ("2021-03-31",), (None,)], "d STRING")
    assert values(readers.fiscal_years(df, "d", [2020, 2020, 2019]), "d", "run") == [("2020-03-31", "2019"), ("2020-04-01", "2020"), ("2021-03-31", "2020")]
    assert {r["run"] for r in readers.fiscal_years(df, "d", [2019, 2020, 2019], per_year=False).collect()} == {"2019-2020"}
    assert values(readers.labelled_frame(spark.createDataFrame([("a", "b"), (None, "b"), ("a", None)], "text STRING, label STRING")), "text") == [("a",)]


def test_word_vectors_of_three_kinds(spark, tmp_path):
    vecs = {"ein": [1.0, -2.0], "zwei": [0.5, 4.0]}
    data = b"2 2\n" + b"".join(w.encode() + b" " + struct.pack("<2f", *v) + b"\n" for w, v in vecs.items())
    (tmp_path / "a.bin").write_bytes(data)
    (tmp_path / "b.bin.gz").write_bytes(gzip.compress(data))
    for name in ("a.bin", "b.bin.gz"):
        assert {r["word"]: list(r["vec"]) for r in readers.word_vectors_binary(spark, str(tmp_path / name)).collect()} == vecs
    with gzip.open(tmp_path / "c.txt.gz", "wt") as f:
        f.write("2 3\nwort 1 2 3\nENTITY/Alte_Brücke 4 5 6\n")
    got = {(r["name"], r["is_entity"]): list(r["vec"]) for r in readers.entity_vectors(spark, str(tmp_path / "c.txt.gz")).collect()}
    assert got == {("wort", False): [1.0, 2.0, 3.0], ("Alte Brücke", True): [4.0, 5.0, 6.0]}


def test_stopwords_and_strict_lines(spark, tmp_path):
    (tmp_path / "s.txt").write_text("# comment\n\nｏｆ\nthe\nthe\n")
    assert values(readers.stopwords(spark, str(tmp_path / "s.txt")), "word") == [("of",), ("the",)]
    lines = spark.createDataFrame([(1, '{"tokens": ["a"]}'), (2, "broken")], "line_no INT, value STRING")
    assert readers.tokenized_jsonl(lines).count() == 1
    with pytest.raises(Exception, match="in line 2: broken"):
        readers.tokenized_jsonl(lines, strict=True).collect()


def test_settings_extend_each_other(tmp_path):
    (tmp_path / "base.json").write_text(json.dumps({"model": {"k": 20, "seed": 0}, "runs": 5}))
    (tmp_path / "more.json").write_text(json.dumps({"extends": "base.json", "model": {"k": 50}}))
    (tmp_path / "both.json").write_text(json.dumps({"extends": ["base.json", "more.json"], "name": "x"}))
    assert config.load(tmp_path / "both.json") == {"model": {"k": 50, "seed": 0}, "runs": 5, "name": "x"}
    (tmp_path / "circle.json").write_text(json.dumps({"extends": "circle.json"}))
    with pytest.raises(ValueError, match="extends itself"):
        config.load(tmp_path / "circle.json")


def test_fingerprints_are_those_of_canonical_json(spark):
    rows = [("plain", 3, None), ("ü \"q\"", 4, "日本"), ("😀\\", 5, "a\nb")]
    df = spark.createDataFrame(rows, "b STRING, a INT, c STRING")
    got = [r["fp"] for r in df.select(X.fingerprint({k: F.col(k) for k in "bac"}).alias("fp")).collect()]
    assert got == [hashlib.sha1(json.dumps({"a": a, "b": b, "c": c}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:10] for b, a, c in rows]


def test_slugs_and_tokens_without_accents(spark):
    df = spark.createDataFrame([("Émile Zola — Œuvre",), ("日本",), (None,), ("x" * 50,)], "v STRING")
    assert [r["s"] for r in df.select(X.slug(F.col("v"), 12).alias("s")).collect()] == ["emile-zola-u", "na", None, "x" * 12]
    got = spark.createDataFrame([("Café ＡＢＣ №5 naïve",)], "v STRING").select(X.english_tokens(F.col("v"), fold=True).alias("t")).first()["t"]
    assert got == ["cafe", "abc", "no", "<NUM>", "naive"]
    assert df.limit(1).select(X.english_tokens(F.lit("a 12 bc"), number=None).alias("t")).first()["t"] == ["12", "bc"]


def test_sentences_by_rules(spark):
    df = spark.createDataFrame([("Dr. Lee met J. K. Roe at 5 p.m. on Monday.  She left! \"Why?\" No one knew.\nIt cost 3.5 crowns. e.g. this.",)], "v STRING")
    got = df.select(X.split_sentences(F.col("v"), None).alias("s")).first()["s"]
    assert got == ["Dr. Lee met J. K. Roe at 5 p.m. on Monday.", "She left!", '"Why?"', "No one knew.", "It cost 3.5 crowns. e.g. this."]
    assert df.select(X.split_sentences(F.col("v"), None, rules=False).alias("s")).first()["s"] == [" ".join(df.first()["v"].split())]


def test_lemmas_are_joined(spark):
    rows = spark.createDataFrame([(1, 0, "tests"), (1, 1, "run"), (2, 0, None)], "doc_id INT, pos INT, term STRING")
    lemmas = spark.createDataFrame([("tests", "test"), ("tests", "zest"), ("runs", "run")], "term STRING, lemma STRING")
    assert values(corpus.lemmatised(rows, lemmas), "doc_id", "pos", "term") == [(1, 0, "test"), (1, 1, "run"), (2, 0, None)]


def test_targets_of_categories(spark):
    rows = spark.createDataFrame([("b",), ("a",), (" ",), ("x",)], "label STRING")
    assert corpus.targets_of("sci", {"sci": ["q"]}, {"sci": ["r"]}) == ["q"] and corpus.targets_of("sci", None, {"sci": ["r"]}) == ["r"]
    assert corpus.targets_of("unfiltered") is None and corpus.targets_of("all", rows=rows, excluded=["x"]) == ["a", "b"]
    with pytest.raises(KeyError):
        corpus.targets_of("sci", rows=rows)
    with pytest.raises(ValueError, match="unknown category"):
        corpus.category_texts(rows, "label", "label", "none", {"a": []})


def test_runs_strict_matching_and_counts(spark):
    df = spark.createDataFrame([("m", 1, "2020-01-01", None), ("m", 2, "2020-01-02", 0.5), ("n", 3, None, None)], "model STRING, execution_id INT, started_at STRING, value DOUBLE")
    assert values(runs.resolved(df, ["model"]), "model", "execution_id", "candidates") == [("m", 2, 2), ("n", 3, 1)]
    with pytest.raises(Exception, match="ambiguous: m"):
        runs.resolved(df, ["model"], strict=True).collect()
    assert values(runs.matching(df, {"model": "m"}), "execution_id") == [(1,)] and values(runs.matching(df, {"value": 0.5}), "execution_id") == [(2,)]
    with pytest.raises(ValueError, match="3 rows became 1"):
        runs.check_rows(df, df.limit(1), "join")


def test_samples_until_two_classes_and_shortcuts(spark):
    df = spark.createDataFrame([(i, "a" if i else "b") for i in range(30)], "k INT, y STRING")
    one = df.where("y = 'a'")
    rows, tries = sampling.until_two_classes(lambda seed: df if seed == "2" else one, "y", ["1", "2", "3"])
    assert tries == 2 and rows.count() == 30
    with pytest.raises(ValueError, match="one label only"):
        sampling.until_two_classes(lambda seed: one, "y", ["1"])
    assert sampling.limited_train(df, "y", "k", 1.0).count() == 30 and sampling.limited_train(df, "y", "k", 0.0).count() == 0
    assert sampling.limited_train(df, "y", "k", count=40).count() == 30 and sampling.limited_train(df, "y", "k", count=10).count() == 10
    assert sampling.limited_train(df, "y", "k", count=7, stratified=False).count() == 7


def test_cells_and_json_results(spark, tmp_path):
    df = spark.createDataFrame([(1.005, "best"), (2.0, "second"), (3.14159, ""), (None, "")], "v DOUBLE, m STRING")
    assert [r["c"] for r in df.select(writers.marked_cell(F.col("v"), F.col("m"), 1).alias("c")).collect()] == ["\\textbf{1.0}", "\\underline{2.0}", "3.1", "--"]
    writers.evaluation_json(df.limit(2), str(tmp_path / "r.json"), {"run": 1})
    assert json.loads((tmp_path / "r.json").read_text())["results"][1] == {"m": "second", "v": 2.0}
    path = scratch(spark, "x")
    df.write.parquet(path)
    assert release(spark) >= 1
    with pytest.raises(Exception):
        spark.read.parquet(path)


def test_encoders_in_batches(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (4, "b a"), (5, "c")], "doc_id INT, text STRING").withColumn("vec", F.lit("clash"))
    got = {r["doc_id"]: np.array(r["vec"]) for r in encoders.encoded(rows, "text", encoders.HashEncoder(6), normalise=True, truncate_dim=4, batch=2).collect()}
    plain = encoders.HashEncoder(6).encode(["a b", "c"])[:, :4]
    assert got[1] == pytest.approx(plain[0] / np.linalg.norm(plain[0])) and got[4] == pytest.approx(got[1]) and (got[2] == 0).all() and (got[3] == 0).all()
    table = encoders.TableEncoder({"a": np.array([3.0, 4.0])}, 2, {"a": 2.0})
    assert {r["doc_id"]: tuple(r["vec"]) for r in encoders.encoded(rows, "text", table).collect()} == {1: (1.2, 1.6), 2: (0.0, 0.0), 3: (0.0, 0.0), 4: (1.2, 1.6), 5: (0.0, 0.0)}
    sents = spark.createDataFrame([(1, 1, [0.0, 2.0]), (1, 0, [3.0, 4.0]), (2, 0, [0.0, 0.0])], "doc_id INT, sent_id INT, vec ARRAY<DOUBLE>")
    docs = {r["doc_id"]: (r["units"], [list(map(float, v)) for v in r["vecs"]]) for r in encoders.document_vectors(sents).collect()}
    assert docs[1][0] == [0, 1] and docs[1][1][0] == pytest.approx([0.6, 0.8]) and docs[1][1][1] == [0.0, 1.0] and docs[2][1] == [[0.0, 0.0]]
    assert encoders.resolved("MiniLM", normalise=True)["variant"] == "all_minilm_l6_v2_norm" and encoders.resolved("x/Base_raw", truncate_dim=8)["variant"] == "base_d8_raw"
    with pytest.raises(ValueError, match="unknown settings"):
        encoders.resolved("x", colour=1)


def test_components_of_directions(spark):
    rng = np.random.default_rng(0)
    centres = np.eye(4)
    rows = []
    for d in range(30):
        for u in range(6):
            v = centres[(2 * (d % 2)) + (u % 2)] + rng.normal(scale=0.05, size=4)
            rows.append((d, u, (v / np.linalg.norm(v)).tolist()))
    units = spark.createDataFrame(rows, "doc_id LONG, unit LONG, vec ARRAY<DOUBLE>")
    model, state = gibbs.train(units, "doc_id", "unit", "vec", 2, "vmf", 6, components=2)
    assert model.mean.shape == (2, 2, 4) and model.weights.sum(1) == pytest.approx([1.0, 1.0])
    assert gibbs.parameters(model, spark).count() == 4
    x = np.array([r[2] for r in rows[:6]])
    p = model.responsibilities(x, 0)
    assert p.shape == (6, 2) and p.sum(1) == pytest.approx(np.ones(6))
    plain = gibbs.Topics("vmf", np.ones(2), model.mean[:, 0], model.kappa[:, 0])
    single = gibbs.Topics("vmf", np.ones(2), model.mean[:, :1], model.kappa[:, :1], weights=np.ones((2, 1)))
    assert single.log_density(x) == pytest.approx(plain.log_density(x))
    assert {len(set(r["z"])) for r in state.collect()} <= {1, 2}


def test_names_and_tokenized_documents(spark):
    from topicloom.functions import names

    assert names.language(" English ") == "en" and names.language("German") == "ge" and names.tokenizer("Japanese") == "scripts" and names.tokenizer("en", "gensim") == "words"
    for call in (lambda: names.tokenizer("en", "mecab"), lambda: names.tokenizer("ja", "simple"), lambda: names.tokenizer("en", "x"), lambda: names.sentences(F.lit("a"), "x")):
        with pytest.raises(ValueError):
            call()
    docs = spark.createDataFrame([(1, "The old box. It fell on 3 mats!"), (2, None), (3, " ")], "doc_id INT, t STRING")
    got = {r["doc_id"]: (r["sentences_raw"], r["sentences_tokenized"], r["document_tokens"]) for r in corpus.tokenized(docs, "t", "en").collect()}
    assert got[1] == (["The old box.", "It fell on 3 mats!"], [["the", "old", "box"], ["it", "fell", "on", "<NUM>", "mats"]], ["the", "old", "box", "it", "fell", "on", "<NUM>", "mats"])
    assert got[2] == got[3] == ([], [], [])


def test_cholesky_updates():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(5, 5))
    a, x = a @ a.T + np.eye(5), rng.normal(size=5)
    up = gibbs.cholesky_update(np.linalg.cholesky(a), x)
    assert up @ up.T == pytest.approx(a + np.outer(x, x))
    down = gibbs.cholesky_update(up, x, -1.0)
    assert down @ down.T == pytest.approx(a)
    with pytest.raises(ValueError):
        gibbs.cholesky_update(np.eye(2), np.array([2.0, 0.0]), -1.0)
