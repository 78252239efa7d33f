"""Language identification: multinomial naive Bayes over hashed character n-grams.

The counts come from every training row in one distributed pass; the log-probability matrix (buckets x languages) has a
fixed number of rows, is broadcast, and batches are scored with sparse gathers in numpy. Priors are shares of training texts.

Defined cases: a null text, and a text without any letter, get ``und`` with score 0. Texts are read whole. With no
training rows every text is ``und``. Rows are scored one by one: ties go to the language that sorts first; repeated
rows stay. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_mod, group_sums, prepare

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: The score is the posterior as if the text had this many n-grams, so that long texts do not saturate it.
EVIDENCE = 40.0
CHUNK_CHARS = 1 << 20
#: Languages that the broadcast matrix may have.
LANGUAGES = 500
_OTHER = re.compile(r"[\W\d_]+")
_PRIME = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def has_letter(text: str | None) -> bool:
    if not text:
        return False
    return re.search("[A-Za-z]", text) is not None or any(c.isalpha() for c in text)


def _grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the buckets of all texts, one after another, and how many each has. Other than letters: one space."""
    cleaned = [_OTHER.sub(" ", f" {t.lower()} ") for t in texts]
    lengths = np.array([len(t) for t in cleaned], np.int64)
    codes = np.frombuffer("".join(cleaned).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    of = np.repeat(np.arange(len(texts)), lengths)
    for order in ORDERS:
        n = len(codes) - order + 1
        if n <= 0:
            yield np.empty(0, np.int64), np.zeros(len(texts), np.int64)
            continue
        h = np.full(n, order, np.uint64)
        for i in range(order):
            h = (h ^ codes[i : n + i]) * _PRIME[i]
            h ^= h >> np.uint64(29)
        inside = of[:n] == of[order - 1 :]
        yield ((h >> np.uint64(17)) % np.uint64(BUCKETS)).astype(np.int64)[inside], np.bincount(of[:n][inside], minlength=len(texts))


def _pieces(texts: list[str]) -> Iterator[list[int]]:
    """Indices of texts in runs of about CHUNK_CHARS characters; a longer text is a run by itself."""
    run, size = [], 0
    for i, t in enumerate(texts):
        if run and size + len(t) > CHUNK_CHARS:
            yield run
            run, size = [], 0
        run.append(i)
        size += len(t)
    if run:
        yield run


Model = tuple[list[str], np.ndarray, np.ndarray]


def train(docs: DataFrame, keep: Column, text: str = "text", lang: str = "lang") -> Model:
    """Languages in order, the log-probability matrix (BUCKETS, languages) and the log priors, from every row where ``keep`` holds."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for b in batches:
            texts, langs = b.column(0).to_pylist(), b.column(1).to_pylist()
            for own in set(langs):
                mine = [t for t, x in zip(texts, langs, strict=True) if x == own and has_letter(t)]
                sums = totals.setdefault(own, np.zeros(BUCKETS + 1, np.int64))
                sums[BUCKETS] += len(mine)
                for run in _pieces(mine):
                    for buckets, _ in _grams([mine[i] for i in run]):
                        sums += np.bincount(buckets, minlength=BUCKETS + 1)
        for own, sums in totals.items():
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([own] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(sums[at])], ["lang", "bucket", "n"])

    prepare(docs.sparkSession)
    rows = docs.where(keep & F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("t"), F.col(lang).alias("l"))
    counted = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # One row for each language and bucket at most; more languages than LANGUAGES are an error, not a cut.
    langs = sorted(r["l"] for r in rows.select("l").distinct().limit(LANGUAGES + 1).collect())
    if len(langs) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    found = counted.toPandas()
    langs = [x for x in langs if (found["lang"] == x).any()]
    logs, texts = np.zeros((BUCKETS, len(langs)), np.float32), np.ones(len(langs))
    for k, own in enumerate(langs):
        mine = found[found["lang"] == own]
        n = np.full(BUCKETS + 1, 0.5)
        n[mine["bucket"].to_numpy()] += mine["n"].to_numpy()
        texts[k] = n[BUCKETS]
        logs[:, k] = np.log(n[:BUCKETS] / n[:BUCKETS].sum())
    return langs, logs, np.log(texts / texts.sum())


def predict(docs: DataFrame, model: Model, columns: list[str], text: str = "text") -> DataFrame:
    """``columns`` of ``docs`` with lang_pred and score."""
    spark = docs.sparkSession
    prepare(spark)
    langs, logs, prior = model
    shared = spark.sparkContext.broadcast(logs)
    out = docs.select(*columns, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields[:-1]) + ", lang_pred string, score double"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = shared.value
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            best, sure = np.full(len(texts), -1), np.zeros(len(texts))
            real = [i for i, t in enumerate(texts) if langs and has_letter(t)]
            for run in _pieces([texts[i] for i in real]):
                at = np.array([real[i] for i in run])
                total, grams = np.zeros((len(at), len(langs))), np.zeros(len(at))
                for buckets, n in _grams([texts[i] for i in at]):
                    grams += n
                    for k in range(len(langs)):
                        total[:, k] += group_sums(matrix[:, k][buckets], n)
                best[at] = (total + prior).argmax(1)
                scaled = prior + total * np.minimum(1.0, EVIDENCE / np.maximum(grams, 1))[:, None]
                odds = np.exp(scaled - scaled.max(1, keepdims=True))
                sure[at] = odds[np.arange(len(at)), best[at]] / odds.sum(1)
            names = pa.array([langs[k] if k >= 0 else "und" for k in best], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], names, pa.array(sure)], [*b.schema.names[:-1], "lang_pred", "score"])

    return out.mapInArrow(score, schema)


def identify(docs: DataFrame, held_out: Column | None = None, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Train on the rows that are not held out and predict for all rows."""
    held = held_out if held_out is not None else doc_mod(F.col("doc_id"), 3) == 1
    model = train(docs, ~held)
    return predict(docs.withColumn("held_out", held), model, [*columns, "held_out"])
