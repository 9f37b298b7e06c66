"""Problem 3: records of evaluation splits that also stand, exactly or nearly, in the training split."""

from __future__ import annotations

import html
import unicodedata
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.session import cut, spread

#: Words per shingle. 3 is the largest size for which every text of 20 or more words keeps a shingle
#: that 20 edits per 100 words of a longer partner can't touch, so none is lost.
SHINGLE = 3
MIN_WORDS = 20
#: Edits allowed per words of the longer text, as a fraction.
EDITS, PER_WORDS = 20, 100
#: Most bits of the table that marks the shingles of evaluation texts (8 MB), and most counters of their frequencies (16 MB); both are sized to the evaluation texts.
MARK_BITS, COUNTER_BITS = 26, 22
#: Rows of a block of the index of evaluation texts (16 bytes each), rows of training texts that probe it at once, and pairs of rows that are compared at once; they bound the memory of a task.
INDEX_ROWS, PROBE_ROWS, COMPARED = 1 << 21, 1 << 20, 1 << 20
#: Bits of the sketch of a text's words.
SKETCH = 512


def reader_words(text: str | None) -> list[str]:
    """The words of a text as a reader sees them: runs of letters and digits after entities are decoded, widths and compositions unified, invisible characters removed and case folded."""
    if not text:
        return []
    while "&" in text and (plain := html.unescape(text)) != text:  # however often entities were encoded
        text = plain
    text = unicodedata.normalize("NFKC", text)
    if not text.isascii():
        text = "".join(c for c in text if unicodedata.category(c) != "Cf" and not 0xFE00 <= ord(c) <= 0xFE0F)
    text = unicodedata.normalize("NFKC", text.casefold())
    return _runs(text)


def _runs(text: str) -> list[str]:
    import regex

    global _FIND
    try:
        return _FIND(text)
    except NameError:
        _FIND = regex.compile(r"[\p{L}\p{M}\p{N}]+").findall
        return _FIND(text)


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


def text_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words of all texts in order, where each text starts among them and where the last ends).

    The words of a text are parted by single blanks. Equal words have equal hashes; they come at once
    from the prefix sums of one polynomial over the joined texts.
    """
    if not texts:
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    codes = np.frombuffer("\n".join(texts).encode("utf-8", "replace"), np.uint8)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(codes)), out=sums[1:])
        gaps = np.flatnonzero((codes == 32) | (codes == 10))
        start, end = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(codes)]))
        words = (sums[end] - sums[start]) * _powers(_INVERSE, len(codes) + 1)[start]
        words ^= words >> np.uint64(32)
        words *= np.uint64(0xD6E8FEB86659FD93)
        words ^= words >> np.uint64(32)
    first = np.concatenate(([0], np.cumsum(codes[gaps] == 10)))
    return words, np.searchsorted(first, np.arange(len(texts) + 1))


#: Letters of texts that are hashed at once; it bounds the memory of a task.
CHUNK = 1 << 20


def _runs_of_texts(texts: list[str]):
    """(first, end) of runs of texts of about CHUNK letters."""
    ends = np.cumsum([len(t) for t in texts])
    cuts = [0, *(np.flatnonzero(np.diff(ends // CHUNK)) + 1).tolist(), len(texts)] if texts else [0]
    return zip(cuts, cuts[1:], strict=False)


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """One 64-bit hash per shingle of neighbouring words; equal shingles always have equal hashes."""
    n = len(words) - SHINGLE + 1
    if n < 1:
        return np.empty(0, np.uint64)
    mixed = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(SHINGLE):
            mixed = (mixed ^ words[i : n + i]) * np.uint64(_BASE)
            mixed ^= mixed >> np.uint64(29)
    return mixed


class Rarity:
    """One order of all shingles, rarest first, by bounded tables: which shingles evaluation texts hold, and how often these occur anywhere.

    A shingle without a mark is in no evaluation text and comes first; then counters order the others,
    and hashes break ties. Two shingles that share a mark or counter cost time, never a pair.
    """

    def __init__(self, marks: np.ndarray, counters: np.ndarray):
        self.marks, self.counters = marks, counters
        self.mark_shift = np.uint64(64 - (len(marks) * 8).bit_length() + 1)
        self.counter_shift = np.uint64(64 - len(counters).bit_length() + 1)

    def marked(self, shingles: np.ndarray) -> np.ndarray:
        at = shingles >> self.mark_shift
        return (self.marks[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)

    def order(self, shingles: np.ndarray) -> np.ndarray:
        return np.lexsort((shingles, np.where(self.marked(shingles), self.counters[shingles >> self.counter_shift], 0)))


def rare_prefix(shingles: np.ndarray, order: np.ndarray, length: int) -> tuple[np.ndarray, int]:
    """(positions of the rarest shingles that more edits would be needed to destroy than a partner allows, how many of them serve shorter partners).

    order has their positions, rarest first, by one order for all texts. An edit destroys the
    shingles that cover one word, so the fewest edits that destroy a set of positions is the number of
    disjoint windows that cover it. The prefix is the shortest whose number exceeds the edits allowed;
    it ends with all places of its last shingle. The edits are a share of the longer text, so a text
    needs its full prefix only against longer partners, and a shorter one against the others. Two
    texts within the limit always share a shingle of these prefixes, at places no further apart than
    the edits.
    """
    if not len(shingles):
        return np.empty(0, np.int64), 0
    full = _shortest(order, shingles, length * EDITS // (PER_WORDS - EDITS))  # the longest partner has length * 100/80 words
    return order[:full], _shortest(order, shingles, length * EDITS // PER_WORDS)


def _shortest(order: np.ndarray, shingles: np.ndarray, allowed: int) -> int:

    def needed(count: int) -> int:
        edits, reach = 0, -1
        for p in np.sort(order[:count]).tolist():
            if p > reach:
                edits, reach = edits + 1, p + SHINGLE - 1
        return edits

    low, high = min(allowed + 1, len(order)), len(order)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if needed(middle) > allowed else (middle + 1, high)
    while low < len(order) and shingles[order[low]] == shingles[order[low - 1]]:
        low += 1
    return low


def fewest_edits(a: list, b: list) -> int:
    """A bound below the word distance: each word of the longer text that the other does not hold as often takes an edit."""
    held = Counter(b)
    common = sum(min(n, held[w]) for w, n in Counter(a).items() if w in held)
    return max(len(a), len(b)) - common


def word_distance(a: list, b: list, most: int) -> int:
    """The fewest inserted, deleted or replaced items that turn a into b, or most + 1 if it is more; bit-parallel over a."""
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    a, b = a[start:], b[start:]
    if abs(len(a) - len(b)) > most:
        return most + 1
    if not a or not b:
        return len(a) + len(b)
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | (1 << i)
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for done, x in enumerate(b, 1):
        match = places.get(x, 0)
        zero = (((match & up) + up) ^ up) | match | down
        plus, minus = down | (full & ~(zero | up)), up & zero
        score += bool(plus & top) - bool(minus & top)
        if score - (len(b) - done) > most:
            return most + 1
        plus, minus = ((plus << 1) | 1) & full, (minus << 1) & full
        up, down = minus | (full & ~(zero | plus)), plus & zero
    return min(score, most + 1)


def word_sketches(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of SKETCH bits per text, as 64-bit numbers: the first, second... occurrence of each word sets one bit.

    A bit that only one of two texts has stands for a word that the other doesn't hold as often, which takes an edit.
    """
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((words, text))
    sorted_words, sorted_text = words[order], text[order]
    first = np.append(True, (sorted_words[1:] != sorted_words[:-1]) | (sorted_text[1:] != sorted_text[:-1]))[: len(order)]
    starts = np.flatnonzero(first)
    nth = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    with np.errstate(over="ignore"):
        items = (sorted_words ^ (nth.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(_BASE)
    bits = np.zeros((len(at) - 1, SKETCH), bool)
    bits[sorted_text, items >> np.uint64(64 - (SKETCH - 1).bit_length())] = True
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def _distinct_texts(rows: DataFrame, side: str, keep: list[str]) -> DataFrame:
    """(side, fingerprint, words, length, keep...) of every row with enough words; words as one string. Rows with null data have none."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                joined, prints, sizes = [], [], []
                for text in batch.column(batch.num_columns - 1).to_pylist():
                    words = reader_words(text)
                    ok = len(words) >= MIN_WORDS
                    joined.append(" ".join(words) if ok else None)
                    prints.append(xxhash.xxh3_128_digest(joined[-1]) if ok else None)
                    sizes.append(len(words))
                columns = [*batch.columns[:-1], pa.array([side] * len(batch), pa.string()), pa.array(prints, pa.binary()), pa.array(joined, pa.string()), pa.array(sizes, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "side", "fingerprint", "words", "length"]).filter(pa.array([j is not None for j in joined]))

    schema = rows.select(*keep).schema.add("side", "string").add("fingerprint", T.BinaryType()).add("words", "string").add("length", "integer")
    return spread(rows.select(*keep, "data")).mapInArrow(run, schema)


def _shingles_of(texts: list[str], hashed: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all shingles of all texts in order, where each text starts among them and where the last ends). hashed: the texts' text_hashes, if they are known."""
    words, at = hashed or text_hashes(texts)
    shingles = shingle_hashes(words)
    inside = np.ones(len(shingles), bool)  # all but those that run over the end of a text
    for back in range(1, SHINGLE):
        over = at[1:] - back
        inside[over[(over >= 0) & (over < len(shingles))]] = False
    kept = np.concatenate(([0], np.cumsum(inside)))
    return shingles[inside], kept[np.minimum(at, len(shingles))]


def _table_size(texts: DataFrame, most_bits: int) -> int:
    """A power of two above the words of the texts, within 2^12 and 2^most_bits."""
    words = texts.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"]
    return 1 << max(12, min(most_bits, int(words).bit_length()))


def _rarity(texts: DataFrame, theirs: DataFrame) -> Rarity:
    """The order of shingles over all texts; executors make the tables, a bounded number of numbers comes to the driver."""
    spark = texts.sparkSession
    n_marks, n_counters = _table_size(theirs, MARK_BITS - 3) * 8, _table_size(theirs, COUNTER_BITS)
    shift = np.uint64(64 - n_marks.bit_length() + 1)

    def mark(batches):
        import pyarrow as pa

        marks = np.zeros(n_marks, bool)
        for batch in batches:
            texts_ = batch.column(0).to_pylist()
            for a, b in _runs_of_texts(texts_):
                marks[_shingles_of(texts_[a:b])[0] >> shift] = True
        packed = np.packbits(marks, bitorder="little").view(np.int64)
        used = np.flatnonzero(packed)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(packed[used])], names=["place", "bits"])

    found = theirs.select("words").mapInArrow(mark, "place LONG, bits LONG").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    packed = np.zeros(n_marks // 64, np.int64)
    packed[found["place"].to_numpy()] = found["bits"].to_numpy()
    given = spark.sparkContext.broadcast(Rarity(packed.view(np.uint8), np.zeros(n_counters, np.uint32)))

    def count(batches):
        import pyarrow as pa

        rarity, total = given.value, np.zeros(n_counters, np.int64)
        for batch in batches:
            texts_ = batch.column(0).to_pylist()
            for a, b in _runs_of_texts(texts_):
                shingles = _shingles_of(texts_[a:b])[0]
                np.add.at(total, (shingles[rarity.marked(shingles)] >> rarity.counter_shift).astype(np.int64), 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], names=["counter", "n"])

    counts = texts.select("words").mapInArrow(count, "counter LONG, n LONG").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(n_counters, np.uint32)
    total[counts["counter"].to_numpy()] = np.minimum(counts["n"].to_numpy(), 2**32 - 1)
    return Rarity(packed.view(np.uint8), total)


def _rare_places(texts: list[str], lengths: list[int], rarity: Rarity) -> tuple[np.ndarray, ...]:
    """(text, shingle, place, served) of the rare prefix of every text, and the sketches of the texts. Texts are numbered from 0;
    served tells whether a row is in the part that serves partners no longer than the text.

    Shingles of the prefix that no evaluation text holds can't meet a partner and are left out once the prefix is known.
    """
    words, ends = text_hashes(texts)
    shingles, at = _shingles_of(texts, (words, ends))
    marked = rarity.marked(shingles)
    out: list[tuple] = []
    for i, length in enumerate(lengths):
        own = shingles[at[i] : at[i + 1]]
        places, few = rare_prefix(own, rarity.order(own), length)
        held = marked[at[i] : at[i + 1]][places]
        out.append((np.full(len(held), i)[held], own[places[held]], places[held], (np.arange(len(places)) < few)[held]))
    return *(np.concatenate([o[k] for o in out]) for k in range(4)), word_sketches(words, ends)


class _Gathered:
    """Texts and the rows of their rare prefixes, gathered over several batches."""

    def __init__(self):
        self.parts: list[tuple] = []
        self.n_texts = self.n_rows = 0

    def add(self, ids: np.ndarray, words: list[str], lengths: list[int], rarity: Rarity) -> None:
        text, shingle, place, served, sketches = _rare_places(words, lengths, rarity)
        self.parts.append((ids, np.asarray(lengths, np.int64), sketches, shingle, text + self.n_texts, place, served))
        self.n_texts, self.n_rows = self.n_texts + len(ids), self.n_rows + len(text)

    def arrays(self) -> list[np.ndarray]:
        """ids, lengths and sketches of the texts; shingles, texts, places and parts of the rows."""
        return [np.concatenate([p[k] for p in self.parts]) for k in range(7)]


def _keys(shingles: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sort keys: 48 bits of the shingle, then the length, so rows of like length are together."""
    return (shingles & np.uint64(0xFFFFFFFFFFFF0000)) | np.minimum(lengths, 0xFFFF).astype(np.uint64)


def _index(texts: DataFrame, given) -> DataFrame:
    """The rare prefixes of evaluation texts in blocks of at most about INDEX_ROWS rows, each a row of packed arrays: ids, lengths and
    sketches of its texts, and of its rows, sorted, the key, the text and the place with the part it is in."""
    names = ["ids", "lengths", "sketches", "keys", "texts", "spots"]

    def packed(gathered: _Gathered):
        import pyarrow as pa

        ids, lengths, sketches, shingle, text, place, served = gathered.arrays()
        keys = _keys(shingle, lengths[text])
        order = np.argsort(keys)
        cells = [ids, lengths, sketches, keys[order], text[order].astype(np.uint32), ((place[order] << 1) | served[order]).astype(np.uint32)]
        return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cells], names=names)

    def run(batches):
        gathered = _Gathered()
        for whole in batches:
            words = whole.column(1).to_pylist()
            for a, b in _runs_of_texts(words):
                gathered.add(np.asarray(whole.column(0))[a:b], words[a:b], whole.column(2).slice(a, b - a).to_pylist(), given.value)
                if gathered.n_rows >= INDEX_ROWS:
                    yield packed(gathered)
                    gathered = _Gathered()
        if gathered.n_rows:
            yield packed(gathered)

    return texts.select("text_id", "words", "length").mapInArrow(run, ", ".join(f"{n} BINARY" for n in names))


def _near(block: list[np.ndarray], lengths: np.ndarray, sketches: np.ndarray, shingle: np.ndarray, text: np.ndarray, place: np.ndarray, served: np.ndarray):
    """Pairs (number of the training text, number of the text in the block) that share a shingle of their rare prefixes and pass the bounds; a pair may come again.

    The edits before a shared shingle are at least the difference of its places, those after it at
    least the difference of what follows, and all are at least the bits that one sketch has alone.
    """
    _, their_lengths, their_sketches, keys, their_texts, spots = block
    own = lengths[text]
    least = np.where(served, own - own * EDITS // PER_WORDS, own + 1)  # a longer text serves with its short prefix only
    start = np.searchsorted(keys, _keys(shingle, least))
    counts = np.searchsorted(keys, _keys(shingle, own * PER_WORDS // (PER_WORDS - EDITS) + 1), "right") - start
    used = np.flatnonzero(counts > 0)
    upto = np.cumsum(counts[used])
    i = 0
    while i < len(used):
        done = upto[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(upto, done + COMPARED, "right")))
        rows, n = used[i:j], counts[used[i:j]]
        at = np.arange(upto[j - 1] - done) + np.repeat(start[rows] - (upto[i:j] - n - done), n)
        mine = np.repeat(rows, n)
        theirs, spot = their_texts[at], spots[at].astype(np.int64)
        longer, shorter = own[mine], their_lengths[theirs]
        apart, shift = longer - shorter, place[mine] - (spot >> 1)
        most = np.maximum(longer, shorter) * EDITS // PER_WORDS
        ok = np.flatnonzero((np.abs(shift) + np.abs(apart - shift) <= most) & np.where(apart >= 0, served[mine], (spot & 1).astype(bool)))
        mine, theirs, most = text[mine[ok]], theirs[ok].astype(np.int64), most[ok]
        step = COMPARED // 8 + 1  # a sketch is eight numbers
        for k in range(0, len(ok), step):
            a, b = sketches[mine[k : k + step]], their_sketches[theirs[k : k + step]]
            alone = np.maximum(np.bitwise_count(a & ~b).sum(1, np.int64), np.bitwise_count(b & ~a).sum(1, np.int64))
            like = np.flatnonzero(alone <= most[k : k + step]) + k
            yield mine[like], theirs[like]
        i = j


def _candidates(texts: DataFrame, index: DataFrame, given) -> DataFrame:
    """(train_print, test_id, a): the pairs of texts that may be near, with the words of the training text; a pair may come again if there are very many.

    Every task reads the index block by block beside the rows of its training texts, so nothing is
    shuffled, and what leaves a task are the pairs that no bound rules out.
    """
    files = index.inputFiles()

    def blocks():
        import pyarrow.fs as fs
        import pyarrow.parquet as pq

        kinds = (np.int64, np.int64, np.uint64, np.uint64, np.uint32, np.uint32)
        for name in files:
            system, inner = fs.FileSystem.from_uri(name)
            with system.open_input_file(inner) as handle:
                for batch in pq.ParquetFile(handle).iter_batches(1):
                    block = [np.frombuffer(batch.column(k)[0].as_buffer(), kind) for k, kind in enumerate(kinds)]
                    block[2] = block[2].reshape(len(block[0]), -1)
                    yield block

    def probed(gathered: _Gathered, prints: list, words: list):
        import pyarrow as pa

        _, lengths, sketches, *rows = gathered.arrays()
        order = np.argsort(rows[0])  # neighbours are sought in neighbouring places
        rows = [r[order] for r in rows]

        def put(block, pairs):
            for k in range(0, len(pairs), 5000):
                mine, theirs = pairs[k : k + 5000] // len(block[0]), pairs[k : k + 5000] % len(block[0])
                out = [pa.array([x[i] for i in mine.tolist()], kind) for x, kind in ((prints, pa.binary()), (words, pa.string()))]
                yield pa.RecordBatch.from_arrays([out[0], pa.array(block[0][theirs]), out[1]], names=["train_print", "test_id", "a"])

        for block in blocks():
            pairs = np.empty(0, np.int64)
            for mine, theirs in _near(block, lengths, sketches, *rows):
                if len(mine):
                    pairs = np.unique(np.append(pairs, mine * len(block[0]) + theirs))
                    if len(pairs) >= COMPARED:  # what comes again after that is dropped once it is verified
                        yield from put(block, pairs)
                        pairs = np.empty(0, np.int64)
            yield from put(block, pairs)

    def run(batches):
        gathered, prints, words = _Gathered(), [], []
        for whole in batches:
            texts_ = whole.column(1).to_pylist()
            for a, b in _runs_of_texts(texts_):
                gathered.add(np.empty(b - a, np.int64), texts_[a:b], whole.column(2).slice(a, b - a).to_pylist(), given.value)
                prints += whole.column(0).slice(a, b - a).to_pylist()
                words += texts_[a:b]
                if gathered.n_rows >= PROBE_ROWS:
                    yield from probed(gathered, prints, words)
                    gathered, prints, words = _Gathered(), [], []
        if gathered.n_rows:
            yield from probed(gathered, prints, words)

    return spread(texts.select("fingerprint", "words", "length")).mapInArrow(run, "train_print BINARY, test_id LONG, a STRING")


def _verified(candidates: DataFrame) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = []
            for x, y in zip(a, b, strict=True):
                x, y = x.split(" "), y.split(" ")
                most = max(len(x), len(y)) * EDITS // PER_WORDS
                keep.append(fewest_edits(x, y) <= most and word_distance(x, y, most) <= most)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return candidates.mapInArrow(run, "train_print BINARY, test_print BINARY")


def overlapping_texts(train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs of fingerprints, members): the pairs of different-table texts within the limit, each distinct text once, and the rows of every text.

    Copies of a text are one text here, however many rows they are, so a text that a third of all
    rows hold is joined once. Evaluation texts are indexed by their rare prefixes, training texts
    probe them in place; lengths, places and sketches filter, and the word distance of what is left is computed exactly.
    Only these few pairs travel: where texts share phrases, pairs that share a rare shingle grow with the square of the rows.
    """
    spark = train.sparkSession
    rows = _distinct_texts(train, "train", ["row_id"]).unionByName(_distinct_texts(test, "test", ["row_id", "split", "source"]), allowMissingColumns=True)
    rows = cut(rows, "rows", compression="zstd")
    members = rows.drop("words", "length").dropDuplicates(["side", "row_id", "fingerprint"])
    texts = rows.groupBy("side", "fingerprint").agg(F.first("words").alias("words"), F.first("length").alias("length"))
    texts = cut(texts.withColumn("text_id", F.monotonically_increasing_id()), "texts", compression="zstd")  # written, so a text keeps its number
    ours, theirs = (texts.where(F.col("side") == s).drop("side") for s in ("train", "test"))
    rarity = spark.sparkContext.broadcast(_rarity(texts, theirs))  # at most 24 MB
    index = cut(_index(theirs, rarity), "index", compression="zstd")
    pairs = cut(_candidates(ours, index, rarity), "candidates", compression="zstd")
    b = theirs.select(F.col("text_id").alias("test_id"), F.col("fingerprint").alias("test_print"), F.col("words").alias("b"))
    pairs = pairs.join(b, "test_id")
    return _verified(pairs.select("train_print", "test_print", "a", "b")).distinct(), members


def found(train: DataFrame, test: DataFrame) -> DataFrame:
    """(row_id_a, row_id_b) of every pair; a row_id that came with several texts makes one pair if any of them is near."""
    pairs, members = overlapping_texts(train, test)
    return _expanded(pairs, members).select("row_id_a", "row_id_b").distinct()


def _expanded(pairs: DataFrame, members: DataFrame) -> DataFrame:
    ours = members.where("side = 'train'").select(F.col("fingerprint").alias("train_print"), F.col("row_id").alias("row_id_a"))
    theirs = members.where("side = 'test'").select(F.col("fingerprint").alias("test_print"), F.col("row_id").alias("row_id_b"), "split", "source")
    rows = pairs.join(ours, "train_print").join(theirs, "test_print").where("row_id_a is not null and row_id_b is not null")
    return rows.select(F.least("row_id_a", "row_id_b").alias("row_id_a"), F.greatest("row_id_a", "row_id_b").alias("row_id_b"), "split", "source")


def report(train: DataFrame, test: DataFrame) -> DataFrame:
    """Per split and source (trimmed, in lower case; '' for null) of the test rows: rows with a partner, and pairs.

    Pairs are counted, not made: a link of two texts stands for the rows of the one times the rows of
    the other. Only rows that came with several texts, which may be linked twice, are paired one by one.
    """
    links, members = overlapping_texts(train, test)
    links = cut(links, "links")
    side = [F.coalesce(F.lower(F.trim(c)), F.lit("")).alias(c) for c in ("split", "source")]
    ours = members.where("side = 'train' and row_id is not null").select(F.col("fingerprint").alias("train_print"), F.col("row_id").alias("row_id_a")).distinct()
    theirs = members.where("side = 'test' and row_id is not null").select(F.col("fingerprint").alias("test_print"), F.col("row_id").alias("row_id_b"), *side).distinct()
    several = ours.groupBy("row_id_a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("row_id_a")
    several = cut(ours.join(several, "row_id_a", "left_semi"), "several")
    twice = theirs.select("row_id_b", "test_print").distinct().groupBy("row_id_b").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("row_id_b")
    twice = cut(theirs.join(twice, "row_id_b", "left_semi"), "twice")
    sizes = ours.groupBy("train_print").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.join(several.groupBy("train_print").agg(F.count(F.lit(1)).alias("s")), "train_print", "left").withColumn("s", F.coalesce("s", F.lit(0)))
    per_text = links.join(sizes, "train_print").groupBy("test_print").agg(F.sum(F.col("n") - F.col("s")).alias("n"))
    plain = theirs.join(twice.select("row_id_b").distinct(), "row_id_b", "left_anti").join(per_text, "test_print").select("row_id_b", "split", "source", "n")
    # rows of several texts on either side: one row for each pair, then distinct
    mixed = links.join(several, "train_print").join(theirs, "test_print").select("row_id_a", "row_id_b", "split", "source")
    mixed = mixed.unionByName(links.join(ours, "train_print").join(twice, "test_print").select("row_id_a", "row_id_b", "split", "source")).distinct()
    rows = plain.unionByName(mixed.groupBy("row_id_b", "split", "source").agg(F.count(F.lit(1)).alias("n"))).where("n > 0")
    per_row = rows.groupBy("split", "source", "row_id_b").agg(F.sum("n").alias("n"))
    return per_row.groupBy("split", "source").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("pairs"))
