"""Helpers shared by the operators: input access, lineage cuts, whitespace words, ranks without hot groups."""

from __future__ import annotations

import re
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch, so that a batch of long texts stays in a worker's memory.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches; take the checkpoint folder from the session.

    Where none is set, a session on one machine (tests) gets a temporary one; on a cluster executors don't share such a
    folder, so that is an error.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if not 0 < int(spark.conf.get(key).rstrip("bB")) <= most:
            spark.conf.set(key, str(most))
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="cairn-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from the files: it is computed once and survives lost executors."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def doc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, mod n; a null id counts as empty text (remainder 0)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % n


#: Byte tables: white space, and A-Z in lower case.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts (null: none), one after another, and the len + 1 offsets of the texts in them."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def split_words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """Whitespace words of each text (null: none), all in one array, and the number in each text."""
    data, offsets = text_bytes(texts)
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = offsets[:-1][np.diff(offsets) > 0]
    first[begins] = inside[begins]
    starts = np.flatnonzero(first)
    kept = data[inside]
    place = np.cumsum(inside)
    ends = np.append(place[starts] - 1, len(kept)).astype(np.int64)
    flat = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(_LOWER[kept] if lower else kept))
    at = np.searchsorted(starts, offsets)
    return flat, np.diff(at)


def starts_of(counts: np.ndarray) -> np.ndarray:
    """Where each run of ``counts`` begins."""
    return np.cumsum(counts) - counts


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every run, one after another."""
    total = int(lengths.sum())
    return np.repeat(starts - starts_of(lengths), lengths) + np.arange(total)


def group_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each run of ``counts`` rows of ``values`` (0 for an empty run)."""
    out = np.zeros((len(counts), *values.shape[1:]), np.float64)
    full = np.flatnonzero(counts > 0)
    if len(full):
        out[full] = np.add.reduceat(values.astype(np.float64), starts_of(counts)[full], axis=0)
    return out


#: A key is hot beyond so many rows, and beyond so many parts of all rows: at most HOT_KEYS keys are.
HOT_ROWS, HOT_KEYS = 1000, 10_000


def join_counted(many: DataFrame, one: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``many`` joined with ``one``, a row for each key with how many rows of ``many`` have it (of ``total``).

    Rows of a hot key stay where they are: the rows of ``one`` for hot keys are broadcast, HOT_KEYS at most.
    """
    least = max(HOT_ROWS, total // HOT_KEYS)
    hot = one.where(F.col(count) > least).drop(count).withColumn("_hot", F.lit(True))
    marked = many.join(F.broadcast(hot), key, "left")
    rest = marked.where("_hot IS NULL").select(*many.columns).join(one.where(F.col(count) <= least).drop(count), key)
    return marked.where("_hot").drop("_hot").unionByName(rest.select(*marked.drop("_hot").columns))


def salted_rank(df: DataFrame, keys: list[str], order: list[Column], salt: Column, salts: int, name: str) -> DataFrame:
    """Rank from 0 within ``keys`` without bringing a key's rows together.

    Rows are ranked inside (keys, salt) and each salt starts after the rows of the smaller ones, so a key with a third
    of all rows is dealt over ``salts`` groups. The rank is a function of the rows alone: reruns agree.
    """
    salted = df.withColumn("_salt", F.pmod(salt, F.lit(salts)).cast("int"))
    before = W.partitionBy(*keys).orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    base = salted.groupBy(*keys, "_salt").agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    same = [salted[k].eqNullSafe(base[k]) for k in (*keys, "_salt")]
    joined = salted.join(base, same, "left").select(salted["*"], base["_base"])
    inside = F.row_number().over(W.partitionBy(*keys, "_salt").orderBy(*order))
    return joined.withColumn(name, F.col("_base") + inside - 1).drop("_salt", "_base")
