"""Extension: an index of page digests kept up to date from a stream of pages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def changed_digests(pages: DataFrame, key: str, text: str) -> DataFrame:
    """key, digest of each row whose digest differs from the one before of its key.

    The last digest of a key is its state, so no batch reads what earlier ones wrote. Of several in a batch the largest counts.
    """
    kind = pages.schema[key].dataType.simpleString()

    def update(of: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = max((d for f in frames for d in f["digest"].dropna()), default=None)
        if last is not None and not (state.exists and state.get[0] == last):
            state.update((last,))
            yield pd.DataFrame({key: [of[0]], "digest": [last]})

    digests = pages.select(key, F.sha2(text, 256).alias("digest"))
    return digests.groupBy(key).applyInPandasWithState(update, f"`{key}` {kind}, digest string", "digest string", "append", GroupStateTimeout.NoTimeout)


def keep_digests(pages: DataFrame, key: str, text: str, target: str, checkpoint: str) -> StreamingQuery:
    """Append key and digest of new or changed rows of each micro-batch to the Parquet table ``target``."""
    out = changed_digests(pages, key, text).writeStream.format("parquet").outputMode("append")
    return out.option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
