"""Vectors of passages: an encoder of hashed words, or another that is given, over those passages that have none yet."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import fold

DIMENSIONS = 384
#: Texts that an encoder gets at once.
AT_ONCE = 256
_WORD = re.compile(r"[^\W_]+")

Encode = Callable[[list[str]], list[list[float]]]


class EncoderMissing(RuntimeError):
    """The package that an encoder needs is not there."""


def encode(texts: list[str]) -> list[list[float]]:
    """Unit vectors of hashed words and letter triples: a stand-in for a trained encoder, the same everywhere."""
    out = []
    for text in texts:
        words = _WORD.findall(fold(text))
        parts = Counter([*words, *(f"{w[i : i + 3]}~" for w in words for i in range(len(w) - 2))])
        v = [0.0] * DIMENSIONS
        for part, n in parts.items():
            h = xxhash.xxh64_intdigest(part)
            v[h % DIMENSIONS] += (1 + math.log(n)) * (1 if h >> 63 else -1)
        norm = math.sqrt(sum(x * x for x in v)) or 1.0
        out.append([x / norm for x in v])
    return out


def encode_query(text: str, of: Encode = encode, prefix: str = "") -> list[float]:
    """Vector of a question; some encoders want a prefix on questions only."""
    return of([prefix + text])[0]


def is_available(vectors: DataFrame | None) -> bool:
    return vectors is not None and not vectors.isEmpty()


def pending(chunks: DataFrame, vectors: DataFrame | None) -> DataFrame:
    """Passages without a vector."""
    return chunks if vectors is None else chunks.join(vectors.select("chunk_id"), "chunk_id", "left_anti")


def embed_pending(chunks: DataFrame, vectors: DataFrame | None = None, of: Encode = encode) -> DataFrame:
    """chunk_id, embedding of the passages without a vector, AT_ONCE texts a call."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, AT_ONCE):
                part = b.slice(at, AT_ONCE)
                found = of(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.float32()))], ["chunk_id", "embedding"])

    return pending(chunks, vectors).select("chunk_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "chunk_id long, embedding array<float>")
