"""Problem 7: exact ids of a byte-level BPE tokenizer, by dynamic programming over the prefixes of each word."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.session import spread

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: the published pattern by which this family of tokenizers cuts text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words up to this many bytes are remembered by each Python worker, up to MEMORY of them.
REMEMBERED_BYTES, MEMORY = 64, 400_000


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for the 256 bytes: printable ones stand for themselves, others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class PrefixEncoder:
    """Encodes words by storing, for each prefix, the one token that can end its encoding.

    A token may end a prefix only if the encoding of what precedes it ends in a token that the merges
    would leave apart from it; that makes the last token of each prefix unique, and the ids follow
    from the pointers back. Candidates are all tokens that are suffixes of the prefix, which an
    automaton over the vocabulary lists in one walk along the word.
    """

    def __init__(self, model: str):
        data = json.loads(model)["model"]
        letters = byte_letters()
        spell = lambda s: bytes(letters[c] for c in s)
        vocab = data["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in data["merges"]]
        self.order: dict[int, int] = {}  # id -> place in the order of merges, bytes first
        self.joined: dict[tuple[int, int], int] = {}  # pair of ids -> id of their merge
        self.parts: dict[int, tuple[int, int]] = {}
        self.whole: dict[bytes, int] = {}
        for place, letter in enumerate(letters):
            self.order[vocab[letter]] = place
            self.whole[spell(letter)] = vocab[letter]
        for place, (left, right) in enumerate(merges):
            token = vocab[left + right]
            self.joined[vocab[left], vocab[right]] = token
            self.parts.setdefault(token, (vocab[left], vocab[right]))
            self.order.setdefault(token, 256 + place)
            self.whole.setdefault(spell(left + right), token)
        self.longest = max(map(len, self.whole))
        self.memory: dict[str, list[int]] = {}
        self.apart: dict[tuple[int, int], bool] = {}
        self.walk = self._automaton()
        import regex

        self.words = regex.compile(WORDS).findall

    def _automaton(self):
        try:
            import ahocorasick
        except ImportError:
            return None
        machine = ahocorasick.Automaton()
        for spelled, token in self.whole.items():
            machine.add_word(spelled.decode("latin-1"), (len(spelled), token))
        machine.make_automaton()
        return machine.iter

    def _matches(self, word: bytes):
        """(end, length, token) of every token inside word, by end, the longest first."""
        if self.walk:
            for end, (length, token) in self.walk(word.decode("latin-1")):
                yield end + 1, length, token
        else:
            for end in range(1, len(word) + 1):
                for length in range(min(end, self.longest), 0, -1):
                    if (token := self.whole.get(word[end - length : end])) is not None:
                        yield end, length, token

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether the merges leave the neighbours left and right as they are.

        Undoes the later merge of the two sides again and again; if at any time the tokens that face
        each other would themselves have been merged before the merge just undone, they don't stay.
        """
        key = (left, right)
        if (known := self.apart.get(key)) is not None:
            return known
        order, joined, parts = self.order, self.joined, self.parts
        # a merge across the gap comes first if its place is below limit; ties go to the one further left
        limit, result = 1 << 60, None
        while result is None:
            across = joined.get((left, right))
            if across is not None and order[across] < limit:
                result = False
                break
            a, b = order[left], order[right]
            left_parts, right_parts = parts.get(left), parts.get(right)
            if left_parts is None and right_parts is None:
                result = True
            elif right_parts is None or (left_parts is not None and a > b):
                limit, left = a, left_parts[1]
            else:
                limit, right = b + 1, right_parts[0]
        if len(self.apart) > 2_000_000:
            self.apart.clear()
        self.apart[key] = result
        return result

    def encode_word(self, word: bytes) -> list[int]:
        if (token := self.whole.get(word)) is not None:
            return [token]
        size = len(word)
        last, back = [-1] * (size + 1), [0] * (size + 1)
        for end, length, token in self._matches(word):
            if last[end] >= 0:
                continue
            start = end - length
            if start == 0 or (last[start] >= 0 and self.stay_apart(last[start], token)):
                last[end], back[end] = token, start
        ids, at = [], size
        while at:
            ids.append(last[at])
            at = back[at]
        return ids[::-1]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        ids, memory = [], self.memory
        for word in self.words(text):
            known = memory.get(word)
            if known is None:
                spelled = word.encode("utf-8", "replace")
                known = self.encode_word(spelled)
                if len(spelled) <= REMEMBERED_BYTES:
                    if len(memory) >= MEMORY:
                        memory.clear()
                    memory[word] = known
            ids += known
        return ids


_ENCODERS: dict[int, PrefixEncoder] = {}


def _encoder(model: str) -> PrefixEncoder:
    """One encoder per Python worker and vocabulary; workers are used again for later tasks."""
    key = hash(model)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = PrefixEncoder(model)
    return _ENCODERS[key]


def encoded(documents: DataFrame, keep: list[str], tokenizer: str = DEFAULT_TOKENIZER, text: str = "text", count_only: bool = False) -> DataFrame:
    """The columns keep and ids (ARRAY<INT>), or n_tokens (LONG) if count_only, of every row.

    A null and an empty text have no ids: an empty list, and 0. Text that spells a special token is
    ordinary text. The tokenizer's file (1.6 MB) is read by the driver and broadcast, whole texts
    are encoded, rows stay in their partitions.
    """
    spark = documents.sparkSession
    with open(tokenizer, encoding="utf-8") as file:
        model = spark.sparkContext.broadcast(file.read())
    rows = documents.select(*keep, F.col(text).alias("_text"))
    schema = rows.drop("_text").schema
    result = schema.add("n_tokens", T.LongType(), False) if count_only else schema.add("ids", T.ArrayType(T.IntegerType(), False), False)

    def run(batches):
        import pyarrow as pa

        encoder = _encoder(model.value)
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                lists = [encoder.encode(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
                last = pa.array(map(len, lists), pa.int64()) if count_only else pa.array(lists, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], last], names=[*keep, result.names[-1]])

    return spread(rows).mapInArrow(run, result)


def ids(documents: DataFrame, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    return encoded(documents, ["doc_id"], tokenizer)
