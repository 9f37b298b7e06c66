"""Corpus operators: latest documents, sentences, tokens, selection, vocabularies and bags of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.functions import text as X
from topicloom.session import bounded_broadcast

#: A vocabulary of up to this many words (some 10 MB) is broadcast; a larger one is joined by shuffles.
VOCABULARY_BROADCAST = 200_000


def latest(df: DataFrame, key: list[str], at: str) -> DataFrame:
    """The row with the latest value of at for every key. It folds on the map side, so a key that was delivered very often is no hot key."""
    rest = [c for c in df.columns if c not in {*key, at}]
    return df.groupBy(*key).agg(F.max(F.struct(at, *rest)).alias("_l")).select(*key, "_l.*")


def documents(prepared: DataFrame) -> DataFrame:
    """One row per doc_id, the one prepared last."""
    return latest(prepared, ["doc_id"], "prepared_at")


def sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, sent_id, raw, tokens): the two sentence lists side by side, as far as the shorter goes."""
    pairs = F.arrays_zip(F.col("sentences_raw").alias("raw"), F.col("sentences_tokenized").alias("tokens"))
    shorter = F.least(F.size("sentences_raw"), F.size("sentences_tokenized"))
    rows = docs.where(F.col("sentences_raw").isNotNull() & F.col("sentences_tokenized").isNotNull())
    rows = rows.select("doc_id", F.posexplode(F.slice(pairs, F.lit(1), shorter)).alias("sent_id", "_s"))
    return rows.select("doc_id", "sent_id", F.col("_s").getField("raw").alias("raw"), F.col("_s").getField("tokens").alias("tokens"))


def normal(token: Column) -> Column:
    return F.lower(F.trim(token))


def usable(tokens: Column | str) -> Column:
    """The tokens of a list in normal form, without null and empty ones, in order."""
    kept = F.filter(tokens, lambda t: t.isNotNull() & (F.trim(t) != ""))
    return F.transform(kept, normal)


def tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, term) of the document tokens."""
    return docs.select("doc_id", F.posexplode(usable("document_tokens")).alias("pos", "term"))


def selection(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept sentences (doc_id, sent_id), dropped documents (doc_id, reason)).

    A sentence is kept if its trimmed text is not empty and it has a token. A document is dropped,
    with the first reason that holds: it has no sentence list or none that is not blank, none with
    tokens, or no document tokens.
    """
    raw = F.coalesce("sentences_raw", F.array().cast("array<string>"))
    tokenized = F.coalesce("sentences_tokenized", F.array().cast("array<array<string>>"))
    both = F.arrays_zip(raw.alias("raw"), tokenized.alias("tok"))
    shorter = F.least(F.size(raw), F.size(tokenized))
    text = lambda s: F.coalesce(F.trim(s["raw"]), F.lit("")) != ""
    good = lambda s: text(s) & (F.size(F.coalesce(s["tok"], F.array().cast("array<string>"))) > 0)
    pairs = docs.select("doc_id", F.when(shorter > 0, F.slice(both, F.lit(1), F.greatest(shorter, F.lit(1)))).otherwise(F.slice(both, 1, 0)).alias("s"), raw.alias("raw"), F.size(usable(F.coalesce("document_tokens", F.array().cast("array<string>")))).alias("n_tokens"))
    reason = (
        F.when(F.size(F.filter("raw", lambda r: F.coalesce(F.trim(r), F.lit("")) != "")) == 0, "no_sentences")
        .when(F.size(F.filter("s", good)) == 0, "no_tokenized_sentences")
        .when(F.col("n_tokens") == 0, "no_document_tokens")
    )
    judged = pairs.withColumn("reason", reason)
    kept = judged.where("reason is null").select("doc_id", F.posexplode("s").alias("sent_id", "_s")).where(good(F.col("_s"))).select("doc_id", "sent_id")
    return kept, judged.where("reason is not null").select("doc_id", "reason")


def document_frequency(toks: DataFrame) -> DataFrame:
    """(term, df, cf), counted per document first so that no term is a hot key."""
    per_doc = toks.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("cf"))


def vocabulary(toks: DataFrame, no_below: int = 3, no_above: float = 0.7, plain_words: bool = False) -> DataFrame:
    """(term, df, cf) of the terms in at least no_below documents and at most the share no_above of them.

    plain_words also drops single letters, numbers and terms of hiragana only.
    """
    n_docs = toks.agg(F.count_distinct("doc_id").alias("n_docs"))
    vocab = document_frequency(toks).crossJoin(F.broadcast(n_docs))  # one row
    vocab = vocab.where((F.col("df") >= no_below) & (F.col("df") <= F.lit(no_above) * F.col("n_docs")))
    if plain_words:
        vocab = vocab.where(~F.col("term").rlike(r"^(?:[a-z]|[0-9]+|[぀-ゟ]+)$"))
    return vocab.select("term", "df", "cf")


def restrict(rows: DataFrame, vocab: DataFrame, max_broadcast: int = VOCABULARY_BROADCAST) -> DataFrame:
    """The token rows whose term is in the vocabulary; broadcast only behind a check of its size."""
    return rows.join(bounded_broadcast(vocab.select("term"), max_broadcast), "term", "left_semi")


def bag_of_words(toks: DataFrame, by: list[str]) -> DataFrame:
    return toks.groupBy(*by, "term").agg(F.count(F.lit(1)).alias("cnt"))


def sentence_tokens(sents: DataFrame) -> DataFrame:
    return sents.select("doc_id", "sent_id", F.posexplode(usable("tokens")).alias("pos", "term"))


def judged_sentences(sents: DataFrame, unicode: bool = True) -> DataFrame:
    """(doc_id, sent_id, cleaned, reason and measures) of every sentence."""
    rows = sents.withColumn("cleaned", X.clean_english_sentence(F.coalesce("raw", F.lit("")), unicode))
    measures = X.quality(F.col("cleaned"))
    return rows.select("doc_id", "sent_id", "cleaned", *[c.alias(n) for n, c in measures.items()])


def raw_sentences(docs: DataFrame, text: str = "raw_text", delimiter: str | None = None, repair: bool = False) -> DataFrame:
    """(doc_id, sent_id, raw) of the sentences of whole texts, by a delimiter or by rules; repair first parts words run together over a closing mark."""
    whole = F.coalesce(text, F.lit(""))
    parts = X.split_sentences(X.repair_boundaries(whole) if repair else whole, delimiter)
    return docs.select("doc_id", F.posexplode(parts).alias("sent_id", "raw"))


def segmented(docs: DataFrame, text: str = "raw_text", delimiter: str = " / ") -> DataFrame:
    """(doc_id, text): every text as its sentences, joined by a delimiter; '' for null and blank texts."""
    return docs.select("doc_id", F.array_join(X.split_sentences(F.coalesce(text, F.lit("")), None), delimiter).alias("text"))


def tokenized(docs: DataFrame, text: str, language: str, tokenizer: str = "default", segmenter: str = "pysbd") -> DataFrame:
    """(doc_id, sentences_raw, sentences_tokenized, document_tokens) of whole texts: sentences by a segmenter, each with its tokens, and all tokens in order."""
    from topicloom.functions import names

    rows = docs.select("doc_id", names.sentences(F.coalesce(text, F.lit("")), segmenter).alias("sentences_raw"))
    each = rows.select("doc_id", "sentences_raw", F.posexplode_outer("sentences_raw").alias("_i", "_s"))
    each = each.select("doc_id", "sentences_raw", "_i", names.tokens(F.coalesce("_s", F.lit("")), language, tokenizer).alias("_t"))
    lists = each.groupBy("doc_id").agg(F.first("sentences_raw").alias("sentences_raw"), F.array_sort(F.collect_list(F.struct("_i", "_t"))).alias("_l"))
    lists = lists.withColumn("sentences_tokenized", F.transform(F.filter("_l", lambda x: x["_i"].isNotNull()), lambda x: x["_t"]))
    return lists.select("doc_id", "sentences_raw", "sentences_tokenized", F.flatten("sentences_tokenized").alias("document_tokens"))


def reference_corpus(articles: DataFrame, key: str, text: str, n: int, min_tokens: int = 5, seed: str = "42", fold: bool = True) -> DataFrame:
    """(key, tokens) of n articles of at least min_tokens English tokens, each as likely as any other; all of them if there are fewer."""
    from topicloom.operators.sampling import fixed_size

    rows = articles.select(key, X.english_tokens(F.coalesce(text, F.lit("")), fold=fold).alias("tokens")).where(F.size("tokens") >= min_tokens)
    return fixed_size(rows, [key], n, seed)


def lemmatised(rows: DataFrame, lemmas: DataFrame, term: str = "term") -> DataFrame:
    """The rows with each term replaced by its lemma in (term, lemma), if it has one; of several the least. A table of checked size is broadcast."""
    table = lemmas.groupBy(F.col("term").alias(term)).agg(F.min("lemma").alias("_lemma"))
    joined = rows.join(bounded_broadcast(table, VOCABULARY_BROADCAST), term, "left")
    return joined.select(*[F.coalesce("_lemma", term).alias(term) if c == term else F.col(c) for c in rows.columns])


def shares(bow: DataFrame, by: list[str]) -> DataFrame:
    """The counts of each document (or sentence) over their sum."""
    return bow.join(bow.groupBy(*by).agg(F.sum("cnt").alias("_n")), by).withColumn("share", F.col("cnt") / F.col("_n")).drop("_n")


def category_texts(rows: DataFrame, text: str, label: str, category: str, targets: dict[str, list[str]]) -> DataFrame:
    """Rows whose label is a target of the category, a null text as ''; blank texts are kept, an unknown category is an error."""
    if category not in targets:
        raise ValueError(f"unknown category {category!r}; there are {sorted(targets)}")
    return rows.where(F.col(label).isin(targets[category])).withColumn(text, F.coalesce(text, F.lit("")))


def prepared_texts(judged: DataFrame) -> DataFrame:
    """(doc_id, text): the kept cleaned sentences of each document, joined in order by ' / '."""
    kept = judged.where("reason = 'kept'").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sent_id", "cleaned"))).alias("s"))
    return kept.select("doc_id", F.array_join(F.transform("s", lambda x: x["cleaned"]), " / ").alias("text"))


def quality_stats(judged: DataFrame) -> DataFrame:
    per_doc = judged.groupBy("doc_id").agg(F.count(F.lit(1)).alias("seen"), F.sum((F.col("reason") == "kept").cast("long")).alias("kept"))
    return per_doc.agg(
        F.count(F.lit(1)).alias("documents_seen"),
        F.sum((F.col("kept") > 0).cast("long")).alias("documents_kept"),
        F.sum("seen").alias("sentences_seen"),
        F.sum("kept").alias("sentences_kept"),
        F.sum(F.col("seen") - F.col("kept")).alias("sentences_dropped"),
    )


def labels(rows: DataFrame, column: str, allowed: list[str] | None = None, excluded: list[str] = ()) -> DataFrame:
    """Rows with a label that is not blank, trimmed; only allowed ones, and none of the excluded."""
    out = rows.withColumn("label", F.trim(column)).where(F.col("label") != "")
    if allowed is not None:
        out = out.where(F.col("label").isin(allowed))
    return out.where(~F.col("label").isin(list(excluded))) if excluded else out


def extracted_labels(docs: DataFrame, label: str, sentences_: str, allowed: list[str] | None = None) -> DataFrame:
    """Documents with a sentence that is not blank and a label that is not, trimmed; only allowed ones if a category is known (None: all)."""
    said = F.coalesce(F.exists(sentences_, lambda s: F.coalesce(F.trim(s), F.lit("")) != ""), F.lit(False))
    return labels(docs.where(said), label, allowed)


def targets_of(category: str, explicit: dict[str, list[str]] | None = None, built_in: dict[str, list[str]] | None = None, rows: DataFrame | None = None, column: str = "label", excluded: list[str] = ()) -> list[str] | None:
    """The targets of a category: those given for it, else no filter for 'unfiltered', else the built-in ones, else, for 'all', all labels of rows without the excluded; a KeyError otherwise."""
    if explicit and category in explicit:
        return explicit[category]
    if category == "unfiltered":
        return None
    if built_in and category in built_in:
        return built_in[category]
    if category == "all" and rows is not None:
        found = labels(rows, column, None, excluded).select("label").distinct().limit(10_001).collect()  # the classes of a data set
        if len(found) > 10_000:
            raise ValueError(f"{column} has more than 10,000 values; it is no label")
        return sorted(r["label"] for r in found)
    raise KeyError(category)


def all_targets(rows: DataFrame, column: str, category: Column, excluded: list[str] = ()) -> DataFrame:
    """(category, targets): the sorted labels of each category, and of 'all' without the excluded."""
    named = rows.select(category.alias("category"), F.col(column).alias("label")).distinct()
    every = named.where(~F.col("label").isin(list(excluded))).select(F.lit("all").alias("category"), "label").distinct()
    return named.unionByName(every).groupBy("category").agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("targets"))
