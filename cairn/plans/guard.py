"""Ad-hoc SQL over registered views: one reading statement, no paths, at most 200 rows."""

from __future__ import annotations

import re

from pyspark.sql import Row, SparkSession

ROW_LIMIT = 200
_READS = re.compile(r"\s*(?:WITH|SELECT)\b", re.I)
# Words of statements that write.
_WRITES = re.compile(r"\b(?:INSERT|UPDATE|DELETE|DROP|ALTER|CREATE|REPLACE|ATTACH|DETACH|PRAGMA|VACUUM)\b", re.I)
_REACHES_OUT = re.compile(r"\b(?:reflect|java_method|try_reflect|read_files)\s*\(|`[^`]*[/:][^`]*`", re.I)


def allowed(query: str) -> bool:
    return bool(_READS.match(query)) and not _WRITES.search(query) and not _REACHES_OUT.search(query) and ";" not in query.strip().rstrip(";")


def run_sql(spark: SparkSession, query: str) -> tuple[list[Row], bool]:
    """Rows and whether more were cut off."""
    if not allowed(query):
        raise ValueError("only a single SELECT or WITH statement over registered views is allowed")
    rows = spark.sql(query.strip().rstrip(";")).limit(ROW_LIMIT + 1).collect()
    return rows[:ROW_LIMIT], len(rows) > ROW_LIMIT
