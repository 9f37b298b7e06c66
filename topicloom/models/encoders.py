"""From texts to vectors: a protocol for sentence encoders, run in Arrow batches where the rows lie."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.operators.topics import matrix


class SentenceEncoder(Protocol):
    """Anything that turns a list of texts into a matrix, a row for each; it is pickled to the executors."""

    def encode(self, texts: list[str]) -> np.ndarray: ...


@dataclass(frozen=True)
class HashEncoder:
    """The mean of vectors that digests of a text's words give, each number between -1 and 1; zeros for a text without words. It needs no model and is the same everywhere."""

    dim: int = 16
    seed: str = "0"

    def encode(self, texts: list[str]) -> np.ndarray:
        known: dict[str, np.ndarray] = {}
        out = np.zeros((len(texts), self.dim))
        for i, text in enumerate(texts):
            words = [w for w in text.split(" ") if w]
            for w in words:
                if w not in known:
                    known[w] = np.array([int(hashlib.md5(f"{self.seed}|{j}|{w}".encode()).hexdigest()[:8], 16) / 2147483648.0 - 1.0 for j in range(self.dim)])
                out[i] += known[w] / len(words)
        return out


@dataclass(frozen=True)
class TableEncoder:
    """Weighted means of given word vectors, less common components; zeros where no word is known."""

    vectors: dict[str, np.ndarray]
    dim: int
    weights: dict[str, float] | None = None
    directions: np.ndarray | None = None
    shares: np.ndarray | None = None

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, text in enumerate(texts):
            known = [w for w in text.split() if w in self.vectors]
            for w in known:
                v = np.asarray(self.vectors[w], dtype=float)
                length = np.linalg.norm(v)
                out[i] += (self.weights.get(w, 1.0) if self.weights else 1.0) * (v / length if length > 0 else v) / len(known)
        if self.directions is not None:
            for u, share in zip(self.directions, self.shares, strict=True):
                out -= share * np.outer(out @ u, u)
        return out


#: Short names of public encoders, and the settings each is used with.
ALIASES = {"minilm": "all-MiniLM-L6-v2", "mpnet": "all-mpnet-base-v2"}
SETTINGS = {"prefix": "", "normalise": False, "truncate_dim": None}


def resolved(name: str, **given) -> dict:
    """The settings of an encoder by name or alias, given ones first, with variant, a label for its results: the last part of the name as a slug, with the settings that change vectors."""
    import re

    unknown = set(given) - set(SETTINGS)
    if unknown:
        raise ValueError(f"unknown settings {sorted(unknown)}")
    full = ALIASES.get(name.lower(), name)
    out = SETTINGS | {k: v for k, v in given.items() if v is not None}
    tail = re.sub(r"_(?:raw|norm)$", "", re.sub(r"[^a-z0-9]+", "_", full.rsplit("/", 1)[-1].lower()).strip("_"))
    variant = tail + (f"_d{out['truncate_dim']}" if out["truncate_dim"] else "") + ("_norm" if out["normalise"] else "_raw")
    return {"name": full, **out, "variant": variant}


def encoded(rows: DataFrame, text: str, encoder: SentenceEncoder, prefix: str = "", normalise: bool = False, truncate_dim: int | None = None, batch: int = 512) -> DataFrame:
    """The rows with vec ARRAY<DOUBLE> of a text column; null texts are read as ''.

    The encoder is broadcast once and called with batch texts at a time, wherever the rows are; nothing
    is shuffled or collected. A prefix goes before every text, truncate_dim keeps the first numbers,
    normalise then gives unit length, and leaves vectors of no length as they are.
    """
    sent = rows.sparkSession.sparkContext.broadcast(encoder)
    columns = [c for c in rows.columns if c != "vec"]
    kept = rows.select(*columns, F.coalesce(text, F.lit("")).alias("_text"))
    from pyspark.sql import types as T

    schema = rows.select(*columns).schema.add("vec", T.ArrayType(T.DoubleType()))

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for first in range(0, whole.num_rows, batch):
                part = whole.slice(first, batch)
                x = np.asarray(sent.value.encode([prefix + t for t in part.column(part.num_columns - 1).to_pylist()]), dtype=np.float64)
                x = x if truncate_dim is None else x[:, :truncate_dim]
                if normalise:
                    length = np.linalg.norm(x, axis=1, keepdims=True)
                    x = np.where(length > 0, x / np.where(length > 0, length, 1.0), x)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(x.tolist(), pa.list_(pa.float64()))], names=schema.names)

    return kept.mapInArrow(run, schema)


def document_vectors(sentences: DataFrame, transform=None) -> DataFrame:
    """(doc_id, units, vecs) of encoded sentences (doc_id, sent_id, vec): transformed if asked (a function of a matrix), then of unit length, in single precision; in order within the document."""
    from pyspark.sql import types as T

    schema = sentences.select("doc_id", "sent_id").schema.add("vec", T.ArrayType(T.FloatType()))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = matrix(batch.column(2)) if len(batch) else np.zeros((0, 1))
            x = x if transform is None else transform(x)
            length = np.linalg.norm(x, axis=1, keepdims=True)
            x = (x / np.where(length > 0, length, 1.0)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x.tolist(), pa.list_(pa.float32()))], names=schema.names)

    unit = sentences.select("doc_id", "sent_id", F.col("vec").cast("array<double>")).mapInArrow(run, schema)
    packed = unit.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sent_id", "vec"))).alias("s"))
    return packed.select("doc_id", F.transform("s", lambda x: x["sent_id"]).alias("units"), F.transform("s", lambda x: x["vec"]).alias("vecs"))
