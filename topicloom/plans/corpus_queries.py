"""Queries over texts, tokens, selections and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicloom.functions import text as X
from topicloom.functions.numeric import r6 as R
from topicloom.operators import corpus, sampling
from topicloom.plans.base import BOW, DOCS, SENTS, TRAIN, VOCAB, Base, r6
from topicloom.session import scratch
from topicloom.sources import readers, writers


def _judged(b: Base, unicode: bool = False):
    return corpus.judged_sentences(b.sentences(), unicode)


def _clean_sql(x: str) -> str:
    sql = f"coalesce({x}, '')"
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    sql = f"translate({sql}, {quote(X.DASHES_AND_QUOTES[0])}, {quote(X.DASHES_AND_QUOTES[1])})"
    for pattern, put in X.CLEANING:
        sql = f"regexp_replace({sql}, {quote(pattern)}, {quote(put)}, 'g')"
    sql = f"trim({sql})"
    for pattern in (X.LEADING_MARKS, X.LEADING_NUMBER, X.TRAILING_FACE):
        sql = f"trim(regexp_replace({sql}, {quote(pattern)}, ''))"
    return f"trim(regexp_replace({sql}, {quote(X.SPACE_BEFORE_MARK)}, '\\1', 'g'))"


def _judged_sql(source: str = SENTS) -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    lim = X.LIMITS
    return f"""{source},
cl AS MATERIALIZED (SELECT doc_id, sent_id, {_clean_sql('raw')} AS cleaned FROM sents),
me AS (SELECT *, length(cleaned) AS char_count, len(regexp_extract_all(cleaned, '[A-Za-z]+|[0-9]+')) AS word_count,
  len(regexp_extract_all(cleaned, '[A-Za-z]')) AS alpha_count, len(regexp_extract_all(cleaned, '[^A-Za-z0-9\\s]')) AS marks,
  regexp_extract_all(cleaned, '[A-Za-z0-9]+') AS chunks FROM cl),
ju AS (SELECT doc_id, sent_id, cleaned, char_count, word_count, alpha_count, CASE WHEN char_count > 0 THEN marks / char_count ELSE 0.0 END AS punctuation_ratio,
 CASE WHEN cleaned = '' THEN 'empty_after_cleaning'
  WHEN regexp_full_match(cleaned, '[^A-Za-z0-9]+') THEN 'punctuation_only'
  WHEN regexp_full_match(cleaned, '\\([^()]+\\)\\.?') AND word_count <= {lim['parenthetical_words']} THEN 'parenthetical_only'
  WHEN regexp_matches(cleaned, {q(X.DOMAIN_AT_END)}) THEN 'domain_ending_fragment'
  WHEN length(cleaned) - length(replace(cleaned, '(', '')) > length(cleaned) - length(replace(cleaned, ')', '')) THEN 'unbalanced_parentheses'
  WHEN word_count > {lim['max_words']} THEN 'too_many_word_tokens'
  WHEN word_count >= {lim['boundary_words']} AND regexp_matches(cleaned, {q(X.BAD_BOUNDARY)}) THEN 'bad_sentence_boundary'
  WHEN regexp_matches(cleaned, {q(X.AGE_AND_PLACE)}) THEN 'age_location_appositive_fragment'
  WHEN len(chunks) >= 3 AND len(list_filter(chunks, lambda c: regexp_matches(c, '[0-9]') OR (regexp_full_match(c, '[A-Z]+') AND length(c) <= 5))) / len(chunks) >= {lim['upper_noise']} THEN 'upper_noise'
  WHEN word_count <= 3 AND NOT regexp_matches(cleaned, '[.?!]$') THEN 'short_fragment_no_terminal_punctuation'
  WHEN word_count <= 2 AND array_to_string(regexp_extract_all(lower(cleaned), '[a-z]+'), ' ') IN ({', '.join(map(q, X.SHORT_FRAGMENTS))}) THEN 'short_discourse_fragment'
  WHEN word_count < {lim['min_words']} THEN 'too_few_word_tokens'
  WHEN alpha_count < {lim['min_letters']} THEN 'too_few_alpha_chars'
  WHEN (CASE WHEN char_count > 0 THEN marks / char_count ELSE 0.0 END) > {lim['punctuation']} THEN 'punctuation_heavy'
  ELSE 'kept' END AS reason FROM me)"""


MD5 = "md5(concat_ws('|', '{seed}', {key}))"
GROUP = "CASE WHEN reason <> 'kept' THEN 'drop' WHEN word_count <= 5 THEN 'short' WHEN punctuation_ratio >= 0.25 THEN 'punct' ELSE 'random' END"


def _csv_corpus(b: Base):
    """Writes the training rows as CSV and scans them again, targets pushed into the scan."""
    rows = b.table("train").select("row_id", F.regexp_replace("data", "\r", "").alias("data"), F.lower(F.trim("target_str")).alias("target_str"))
    path = scratch(b.spark, "csv")
    writers.csv_dataset(rows, path)
    out = readers.csv_corpus(b.spark, path, "data", "target_str", ["comp.shading", "sci.orbit", "rec.velo"])
    return out.select("text", "label")


def _modelable(b: Base):
    return corpus.selection(b.docs("sentences_raw", "sentences_tokenized", "document_tokens"))


def _restricted_sentences(b: Base):
    """Sentences with a word of the vocabulary, under their old number, and the words left."""
    kept = corpus.restrict(corpus.sentence_tokens(b.sentences()), b.vocab())
    return kept.groupBy("doc_id", "sent_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"]), " ").alias("words"))


def _limited(b: Base):
    return sampling.limited_train(corpus.labels(b.train(), "label"), "label", "row_id", 0.25).select("row_id", "label")


SELECT_SQL = DOCS + """,
pairs AS (SELECT doc_id, coalesce(sentences_raw, []) AS r, coalesce(sentences_tokenized, []) AS t, len(list_filter(coalesce(document_tokens, []), lambda x: x IS NOT NULL AND trim(x) <> '')) AS n_tokens FROM docs),
cells AS (SELECT doc_id, i AS sent_id, trim(coalesce(r[i + 1], '')) <> '' AND coalesce(len(t[i + 1]), 0) > 0 AS good FROM (SELECT *, unnest(range(0, least(len(r), len(t)))) AS i FROM pairs)),
why AS (SELECT p.doc_id, CASE WHEN len(list_filter(r, lambda x: trim(coalesce(x, '')) <> '')) = 0 THEN 'no_sentences'
   WHEN NOT EXISTS (SELECT 1 FROM cells c WHERE c.doc_id = p.doc_id AND good) THEN 'no_tokenized_sentences'
   WHEN n_tokens = 0 THEN 'no_document_tokens' END AS reason FROM pairs p)"""

QUERIES = {
    "sentence_quality_full": (lambda b: _judged(b, True).select("doc_id", "sent_id", "cleaned", "reason"), None),
    "sentence_quality": (
        lambda b: _judged(b).select("doc_id", "sent_id", "cleaned", "reason", "char_count", "word_count", "alpha_count", R("punctuation_ratio").alias("punctuation_ratio")),
        lambda: f"WITH {_judged_sql()} SELECT doc_id, sent_id, cleaned, reason, char_count, word_count, alpha_count, {r6('punctuation_ratio')} AS punctuation_ratio FROM ju",
    ),
    "quality_reason_counts": (lambda b: _judged(b).groupBy("reason").agg(F.count(F.lit(1)).alias("n")), lambda: f"WITH {_judged_sql()} SELECT reason, count(*) AS n FROM ju GROUP BY reason"),
    "quality_stats": (
        lambda b: corpus.quality_stats(_judged(b)),
        lambda: f"""WITH {_judged_sql()}, d AS (SELECT doc_id, count(*) AS seen, count(*) FILTER (reason = 'kept') AS kept FROM ju GROUP BY doc_id)
SELECT count(*) AS documents_seen, count(*) FILTER (kept > 0) AS documents_kept, sum(seen) AS sentences_seen, sum(kept) AS sentences_kept, sum(seen - kept) AS sentences_dropped FROM d""",
    ),
    "prepared_document_text": (
        lambda b: corpus.prepared_texts(_judged(b)),
        lambda: f"WITH {_judged_sql()} SELECT doc_id, string_agg(cleaned, ' / ' ORDER BY sent_id) AS text FROM ju WHERE reason = 'kept' GROUP BY doc_id",
    ),
    "audit_review_sample": (
        lambda b: sampling.review_sample(_judged(b), 200).select("doc_id", "sent_id", "reason", "sample_group"),
        lambda: f"""WITH {_judged_sql()}, g AS (SELECT *, {GROUP} AS sample_group, {MD5.format(seed=42, key="doc_id::VARCHAR, sent_id::VARCHAR")} AS h FROM ju),
f AS (SELECT *, sample_group IN ('drop', 'short') AS pri FROM g),
k AS (SELECT least(count(*) FILTER (pri), greatest(100, 200 - count(*) FILTER (NOT pri))) AS first FROM f),
c AS (SELECT *, row_number() OVER (PARTITION BY pri ORDER BY h, doc_id, sent_id) AS r FROM f),
one AS (SELECT * FROM c, k WHERE pri AND r <= first),
two AS (SELECT * FROM (SELECT f.*, row_number() OVER (ORDER BY h, f.doc_id, f.sent_id) AS r FROM f WHERE NOT EXISTS (SELECT 1 FROM one o WHERE o.doc_id = f.doc_id AND o.sent_id = f.sent_id)), k WHERE r <= 200 - first)
SELECT doc_id, sent_id, reason, sample_group FROM one UNION ALL SELECT doc_id, sent_id, reason, sample_group FROM two""",
    ),
    "audit_group_counts": (
        lambda b: sampling.review_groups(_judged(b)).groupBy("sample_group", "reason").agg(F.count(F.lit(1)).alias("n")),
        lambda: f"WITH {_judged_sql()} SELECT {GROUP} AS sample_group, reason, count(*) AS n FROM ju GROUP BY ALL",
    ),
    "boundary_repair": (
        lambda b: b.sentences().where("raw is not null").select("doc_id", "sent_id", X.repair_boundaries(F.col("raw")).alias("repaired")),
        lambda: f"""WITH {SENTS} SELECT doc_id, sent_id, regexp_replace(regexp_replace(raw, '\\b([A-Za-z]{{2,}}[.!?]["'']?)([A-Za-z]{{2,}})\\b', '\\1 \\2', 'g'), '\\b([A-Za-z]{{2,}}[.!?]["'']?)([A-Za-z]{{2,}})\\b', '\\1 \\2', 'g') AS repaired FROM sents WHERE raw IS NOT NULL""",
    ),
    "delimiter_split": (
        lambda b: corpus.prepared_texts(_judged(b)).select("doc_id", F.posexplode(X.split_sentences(F.col("text"), " / ")).alias("sent_id", "sentence")),
        lambda: f"WITH {_judged_sql()} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sent_id) - 1 AS INTEGER) AS sent_id, cleaned AS sentence FROM ju WHERE reason = 'kept'",
    ),
    "english_tokens": (
        lambda b: b.table("documents").select("doc_id", F.posexplode(X.english_tokens(F.col("text"))).alias("pos", "token")),
        lambda: """WITH t AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[A-Za-z]+|[0-9]+(?:[.,][0-9]+)?'), lambda w: CASE WHEN regexp_matches(w, '^[0-9]') THEN '<NUM>' ELSE lower(w) END), lambda w: w = '<NUM>' OR length(w) >= 2) AS a FROM documents)
SELECT doc_id, CAST(i AS INTEGER) AS pos, a[i + 1] AS token FROM (SELECT doc_id, a, unnest(range(0, len(a))) AS i FROM t)""",
    ),
    "modelable_selection": (lambda b: _modelable(b)[0], lambda: f"WITH {SELECT_SQL} SELECT c.doc_id, CAST(c.sent_id AS INTEGER) AS sent_id FROM cells c JOIN why w USING (doc_id) WHERE w.reason IS NULL AND good"),
    "drop_reasons": (lambda b: _modelable(b)[1], lambda: f"WITH {SELECT_SQL} SELECT doc_id, reason FROM why WHERE reason IS NOT NULL"),
    "vocabulary_df_filter": (lambda b: b.vocab(), lambda: f"WITH {VOCAB} SELECT term, df, cf FROM vocab"),
    "document_frequency": (lambda b: corpus.document_frequency(b.tokens()), lambda: f"WITH {VOCAB} SELECT term, df, cf FROM freq"),
    "bag_of_words": (lambda b: b.bow(), lambda: f"WITH {BOW} SELECT doc_id, term, cnt FROM bow"),
    "sentence_bow": (
        lambda b: corpus.bag_of_words(corpus.restrict(corpus.sentence_tokens(b.sentences()), b.vocab()), ["doc_id", "sent_id"]),
        lambda: f"""WITH {VOCAB}, {SENTS.removeprefix(DOCS)[1:].strip()}
SELECT doc_id, CAST(sent_id AS INTEGER) AS sent_id, lower(trim(t)) AS term, count(*) AS cnt FROM (SELECT doc_id, sent_id, unnest(tokens) AS t FROM sents) WHERE t IS NOT NULL AND trim(t) <> '' AND lower(trim(t)) IN (SELECT term FROM vocab) GROUP BY ALL""",
    ),
    "vocabulary_restricted_sentences": (
        _restricted_sentences,
        lambda: f"""WITH {VOCAB}, {SENTS.removeprefix(DOCS)[1:].strip()},
x AS (SELECT doc_id, sent_id, unnest(tokens) AS t, unnest(range(0, len(tokens))) AS pos FROM sents)
SELECT doc_id, CAST(sent_id AS INTEGER) AS sent_id, string_agg(lower(trim(t)), ' ' ORDER BY pos) AS words FROM x WHERE t IS NOT NULL AND trim(t) <> '' AND lower(trim(t)) IN (SELECT term FROM vocab) GROUP BY ALL""",
    ),
    "reference_jsonl_scan": (
        lambda b: readers.tokenized_jsonl(b.table("reference_stream"), "row_json", 5).select("piece_id", "line_no", F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("words")),
        lambda: """WITH j AS (SELECT piece_id, line_no, CASE WHEN json_valid(row_json) THEN list_filter(list_transform(json_extract_string(row_json, '$.tokens[*]'), lambda t: trim(t)), lambda t: t <> '') END AS a FROM reference_stream)
SELECT piece_id, line_no, CAST(len(a) AS INTEGER) AS n_tokens, array_to_string(a, ' ') AS words FROM j WHERE len(a) >= 5""",
    ),
    "csv_corpus_scan": (
        _csv_corpus,
        lambda: """SELECT regexp_replace(replace(data, chr(13), ''), '^\\s+|\\s+$', '', 'g') AS text, lower(trim(target_str)) AS label FROM train
WHERE trim(regexp_replace(replace(data, chr(13), ''), '\\s+', ' ', 'g')) <> '' AND lower(trim(target_str)) IN ('comp.shading', 'sci.orbit', 'rec.velo')""",
    ),
    "distinct_labels": (lambda b: corpus.labels(b.train(), "label").select("label").distinct(), lambda: f"WITH {TRAIN} SELECT DISTINCT label FROM tr WHERE label <> ''"),
    "category_targets": (
        lambda b: corpus.all_targets(corpus.labels(b.train(), "label"), "label", F.substring_index("label", ".", 1), ["talk.zoning"]),
        lambda: f"""WITH {TRAIN}, n AS (SELECT DISTINCT split_part(label, '.', 1) AS category, label FROM tr WHERE label <> ''), e AS (SELECT category, label FROM n UNION SELECT 'all', label FROM n WHERE label <> 'talk.zoning')
SELECT category, string_agg(label, ',' ORDER BY label) AS targets FROM e GROUP BY category""",
    ),
    "label_filter": (
        lambda b: corpus.labels(b.train(), "label", ["comp.shading", "comp.netboot", "sci.orbit"], ["comp.netboot"]).select("row_id", "label"),
        lambda: f"WITH {TRAIN} SELECT row_id, label FROM tr WHERE label IN ('comp.shading', 'sci.orbit')",
    ),
    "stratified_split": (
        lambda b: sampling.stratified_split(corpus.labels(b.train(), "label"), "label", "row_id").select("row_id", "label", "split"),
        lambda: f"""WITH {TRAIN}, r AS (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY {MD5.format(seed=42, key='row_id::VARCHAR')}, row_id) AS i, count(*) OVER (PARTITION BY label) AS n FROM tr WHERE label <> '')
SELECT row_id, label, CASE WHEN i <= ceil(0.6::DOUBLE * n - 1e-9) THEN 'train' ELSE 'test' END AS split FROM r""",
    ),
    "per_label_subset": (
        lambda b: sampling.per_label(corpus.labels(b.train(), "label"), "label", "row_id", 5).select("row_id", "label"),
        lambda: f"""WITH {TRAIN}, r AS (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY {MD5.format(seed=42, key='row_id::VARCHAR')}, row_id) AS i FROM tr WHERE label <> '') SELECT row_id, label FROM r WHERE i <= 5""",
    ),
    "limited_train_sample": (
        _limited,
        lambda: f"""WITH {TRAIN}, r AS (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY {MD5.format(seed=42, key='row_id::VARCHAR')}, row_id) AS i, count(*) OVER (PARTITION BY label) AS n FROM tr WHERE label <> '')
SELECT row_id, label FROM r WHERE i <= greatest(1, floor(0.25::DOUBLE * n + 1e-9))""",
    ),
    "line_sample": (
        lambda b: sampling.fixed_size(b.table("reference_stream").select("piece_id", "line_no", "page_id"), ["piece_id", "line_no"], 100, "7"),
        lambda: f"SELECT piece_id, line_no, page_id FROM reference_stream ORDER BY {MD5.format(seed=7, key='piece_id::VARCHAR, line_no::VARCHAR')}, piece_id, line_no LIMIT 100",
    ),
    "seed_schedule": (
        lambda b: b.runs().select("iteration").distinct().withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("seed", sampling.seed_of(F.col("iteration"), F.col("repeat"), F.lit(0))),
        lambda: "SELECT DISTINCT CAST(event_id % 4 AS INTEGER) AS iteration, CAST(r AS INTEGER) AS repeat, CAST(42 + event_id % 4 + r * 1000 AS INTEGER) AS seed FROM events, range(0, 3) x(r)",
    ),
    "label_slugs": (
        lambda b: b.train().where("label is not null").select("label").distinct().select("label", X.slug(F.col("label"), 9).alias("slug"), X.selector_key(F.col("label")).alias("selector"), X.with_prefix(F.col("label"), "comp").alias("prefixed")),
        lambda: f"""WITH {TRAIN} SELECT DISTINCT label, regexp_replace(substr(regexp_replace(regexp_replace(lower(strip_accents(label)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 9), '-+$', '') AS slug,
regexp_replace(lower(label), '[^a-z0-9]', '', 'g') AS selector, CASE WHEN starts_with(label, 'comp') THEN label ELSE 'comp' || label END AS prefixed FROM tr WHERE label IS NOT NULL""",
    ),
    "document_availability": (
        lambda b: b.docs("document_tokens", "raw_text", "sentences_raw").select("doc_id", F.coalesce(F.size(corpus.usable("document_tokens")) > 0, F.lit(False)).alias("has_tokens"), (F.coalesce(F.trim("raw_text"), F.lit("")) != "").alias("has_text"), (F.size(F.coalesce("sentences_raw", F.array().cast("array<string>"))) > 0).alias("has_sentences")),
        lambda: f"WITH {DOCS} SELECT doc_id, coalesce(len(list_filter(document_tokens, lambda t: t IS NOT NULL AND trim(t) <> '')) > 0, false) AS has_tokens, trim(coalesce(raw_text, '')) <> '' AS has_text, coalesce(len(sentences_raw), 0) > 0 AS has_sentences FROM docs",
    ),
    "whitespace_vocabulary": (
        lambda b: b.table("documents").select("doc_id", F.explode(X.whitespace_terms(F.col("text"), ["the", "a", "of", "and", "in"])).alias("term")).groupBy("term").agg(F.count_distinct("doc_id").alias("df"), F.count(F.lit(1)).alias("cf")).orderBy(F.col("cf").desc(), "term").limit(500),
        lambda: """WITH w AS (SELECT doc_id, unnest(string_split(trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')), ' ')) AS term FROM documents)
SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM w WHERE term <> '' AND term NOT IN ('the', 'a', 'of', 'and', 'in') GROUP BY term ORDER BY cf DESC, term LIMIT 500""",
    ),
}
