"""Problem 6: how often, and in how many records, every term and n-gram occurs, by suffix arrays."""

from __future__ import annotations

import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.session import cut, spread

#: Batches are cut into blocks of about this many tokens, each with its own suffix array.
BLOCK_TOKENS = 1_000_000
#: Joins the terms of an n-gram; it can't occur in a trimmed term.
GLUE = "\x1f"


def normal_term(token: str | None) -> str | None:
    """NFKC, then trimmed and in lower case; None for null and empty tokens."""
    return (unicodedata.normalize("NFKC", token).strip().lower() or None) if token is not None else None


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(starts of all suffixes of text in full order, the ranks after each doubling), by prefix doubling.

    Rank r of level l is the place in the array where the suffixes begin that share the first 2^l
    symbols. Only suffixes that still share all their symbols so far with another are sorted again, so
    a round costs what repeats are that long. The suffix that ends first sorts first.
    """
    n = len(text)
    order = np.argsort(text, kind="stable")
    fresh = np.ones(n, bool)
    fresh[1:] = np.diff(text[order]) != 0
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    levels, k = [rank.astype(np.int32)], 1
    while True:
        alone = fresh.copy()  # begins a group, and so does the next place
        alone[:-1] &= fresh[1:]
        slots = np.flatnonzero(~alone)
        if not len(slots):
            return order, levels
        at = order[slots]
        ahead = np.zeros(len(at), np.int64)
        inside = at + k < n
        ahead[inside] = rank[at[inside] + k] + 1
        key = rank[at] * (n + 1) + ahead
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[slots] = at
        starts = np.ones(len(at), bool)
        starts[1:] = np.diff(key) != 0
        fresh[slots] = starts
        rank[at] = np.maximum.accumulate(np.where(starts, slots, 0))
        levels.append(rank.astype(np.int32))
        k *= 2


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Length of the prefix that each suffix of the array shares with the one before it, from the ranks of the doublings."""
    n = len(order)
    lcp = np.zeros(n, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    for level in range(len(levels) - 1, -1, -1):
        rank = levels[level]
        same = (a < n) & (b < n)
        same[same] = rank[a[same]] == rank[b[same]]
        step = same.astype(np.int64) << level
        lcp[1:] += step
        a += step
        b += step
    return lcp


def interval_counts(text: np.ndarray, record: np.ndarray, max_n: int | None = None):
    """Yields (n, start, occurrences, records) arrays for all n-grams of n = 1 .. max_n, or of every length.

    text holds codes, with a different code after each record (where record is -1), so no two suffixes
    agree beyond their records. The n-grams are the intervals of the one full suffix array whose common
    prefix is n or longer. The records of an interval are its occurrences less the neighbours, once its
    starts are in order, that lie in the same record.
    """
    order, levels = suffix_array(text)
    lcp = common_prefixes(order, levels)
    ends = np.flatnonzero(np.append(record < 0, True))
    left = ends[np.searchsorted(ends, np.arange(len(text)))] - np.arange(len(text))  # terms up to the end of the record
    n = 0
    while max_n is None or n < max_n:
        n += 1
        keep = left[order] >= n
        at = order[keep]
        if not len(at):
            return
        # suffixes left out lie between intervals, never inside one
        fresh = (lcp < n)[keep]
        fresh[0] = True
        group = np.cumsum(fresh) - 1
        at = at[np.lexsort((at, group))]
        again = np.zeros(len(at), bool)
        again[1:] = (record[at[1:]] == record[at[:-1]]) & (group[1:] == group[:-1])
        occurrences = np.bincount(group)
        yield n, at[np.flatnonzero(fresh)], occurrences, occurrences - np.bincount(group[again], minlength=len(occurrences))


def _blocks(tokens, max_tokens: int):
    """Splits a list array into runs of whole records of about max_tokens tokens; a longer record is a run of its own."""
    lengths = np.asarray(tokens.value_lengths().fill_null(0), dtype=np.int64)
    group = (np.cumsum(lengths) - lengths) // max_tokens
    edges = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *edges], [*edges, len(lengths)], strict=True):
        if b > a:
            yield tokens.slice(a, b - a)


def ngram_counts(records: DataFrame, tokens: str = "document_tokens", max_n: int | None = 1, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(term, n, occurrences, records) of every n-gram of up to max_n terms, or of every length if it is None; the terms of one are joined by GLUE.

    The suffix array of a block is complete whatever max_n, which only says up to which length its
    intervals are put out: all n-grams of a record of L terms are L * (L + 1) / 2. Every record lies wholly in one block, and one suffix array per block gives the block's exact
    counts; so counts of occurrences and of records just add up over blocks, and only one row per
    distinct n-gram and block is shuffled. A term that is in every record is one row per block, so
    no key is hot. Null and empty tokens are left out before n-grams are formed. Records with null
    or empty token lists, or of such tokens only, count nothing.
    """

    def count(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            for block in _blocks(batch.column(0), block_tokens):
                flat = block.flatten()
                if not len(flat):
                    continue
                owner = np.asarray(pc.list_parent_indices(block), dtype=np.int64)
                coded = flat.dictionary_encode()
                normal = [normal_term(t) for t in coded.dictionary.to_pylist()]
                terms = {t: i for i, t in enumerate(sorted({t for t in normal if t is not None}))}
                recode = np.array([terms.get(t, -1) for t in normal] + [-1], dtype=np.int64)
                codes = recode[np.asarray(coded.indices.fill_null(len(normal)), dtype=np.int64)]
                owner, codes = owner[codes >= 0], codes[codes >= 0]
                if not len(codes):
                    continue
                # a separator of its own after each record, of a code above all terms
                ends = np.flatnonzero(np.diff(owner)) + 1
                text = np.insert(codes, ends, len(terms) + np.arange(len(ends)))
                record = np.insert(owner, ends, -1)
                words = np.array([*terms], dtype=object)
                for n, at, cf, df in interval_counts(text, record, max_n):
                    term = words[text[at]]
                    for d in range(1, n):
                        term = term + GLUE + words[text[at + d]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(term, pa.string()), pa.array(np.full(len(at), n, np.int32)), pa.array(cf.astype(np.int64)), pa.array(df.astype(np.int64))],
                        names=["term", "n", "occurrences", "records"],
                    )

    local = records.select(tokens).where(F.col(tokens).isNotNull()).mapInArrow(count, "term STRING, n INT, occurrences LONG, records LONG")
    return local.groupBy("term", "n").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def latest_documents(prepared: DataFrame) -> DataFrame:
    """(doc_id, document_tokens) of the row with the latest prepared_at of every doc_id.

    A null prepared_at is older than all; of rows prepared at the same time the greater token list
    is taken, which is the same in every run. A null doc_id is a document like any other.
    """
    newest = F.max(F.struct("prepared_at", "document_tokens"))
    return prepared.groupBy("doc_id").agg(newest.alias("_newest")).select("doc_id", "_newest.document_tokens")


def records_with_terms(records: DataFrame, tokens: str = "document_tokens") -> int:
    """The number of records with at least one term."""
    blank = r"^[\s\p{Z}\x1c-\x1f\x85]*$"
    return records.where(F.exists(tokens, lambda t: ~t.rlike(blank))).count()


def marked_terms(prepared: DataFrame, max_n: int | None = 1, no_below: int = 3, no_above: float = 0.7) -> DataFrame:
    """(term, n, occurrences, records, mark) of every n-gram: rare below no_below records, else common above no_above of them."""
    documents = cut(spread(latest_documents(prepared)), "documents")
    total = records_with_terms(documents)
    mark = F.when(F.col("records") < no_below, "rare").when(F.col("records") > no_above * total, "common")
    return ngram_counts(documents, max_n=max_n).withColumn("mark", mark)


def found(prepared: DataFrame) -> DataFrame:
    return marked_terms(prepared).where(F.col("mark").isNotNull()).select("term", "mark")


def against_vocabulary(prepared: DataFrame, vocab: DataFrame) -> DataFrame:
    """Every term and every word of the model's vocabulary side by side: word_id and word (null for terms the model lacks), counts (0 for words that don't occur).

    Vocabulary words are brought to the same normal form for the comparison; null and empty ones are kept with a null term.
    """
    normal = F.udf(normal_term, "string", useArrow=True)
    words = vocab.select("word_id", "word", normal("word").alias("term"))
    counts = marked_terms(prepared).select("term", "occurrences", "records", "mark")
    both = counts.join(words, "term", "full_outer")
    zero = F.lit(0).cast("long")
    return both.select("term", "word_id", "word", F.coalesce("occurrences", zero).alias("occurrences"), F.coalesce("records", zero).alias("records"), "mark")
