"""Pages over HTTP as the same columns that a folder of pages gives."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: How often a page is asked for, and the seconds before it is asked for again, times the tries so far.
TRIES, PAUSE, TIMEOUT = 3, 0.5, 20.0
_SCHEMA = "site_number int, path string, status int, content binary"


def _get(url: str) -> tuple[int, bytes | None]:
    """Status and content; an answer below 500 is final, and -1 stands for none at all."""
    status = -1
    for n in range(1, TRIES + 1):
        try:
            with urllib.request.urlopen(url, timeout=TIMEOUT) as answer:
                return answer.status, answer.read()
        except urllib.error.HTTPError as e:
            status = e.code
            if status < 500:
                break
        except OSError:
            status = -1
        if n < TRIES:
            time.sleep(PAUSE * n)
    return status, None


def fetch_pages(spark: SparkSession, url: str, first: int, last: int, have: DataFrame | None = None, at_once: int = 8) -> DataFrame:
    """site_number, path, status, content, byte_size, content_sha256 of ``url`` (with a place for the number, as in
    ``https://host/{:04d}.htm``) for a range of numbers, ``at_once`` at a time. Numbers that ``have`` lists are left out; a
    page that is not there or does not answer is a row with its status and no content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n in b.column(0).to_pylist():
                status, content = _get(url.format(n))
                yield pa.RecordBatch.from_pylist([{"site_number": n, "path": url.format(n), "status": status, "content": content}], pa.schema([("site_number", pa.int32()), ("path", pa.string()), ("status", pa.int32()), ("content", pa.binary())]))

    wanted = spark.range(first, last + 1, 1, at_once).select(F.col("id").cast("int").alias("site_number"))
    if have is not None:
        wanted = wanted.join(F.broadcast(have.select("site_number").distinct()), "site_number", "left_anti")  # numbers of pages
    got = wanted.mapInArrow(run, _SCHEMA)
    return got.select("site_number", "path", "status", "content", F.octet_length("content").cast("long").alias("byte_size"), F.sha2("content", 256).alias("content_sha256"))
