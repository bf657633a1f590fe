"""Current state of versioned rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def current_files(files: DataFrame, keep: Column | None = None) -> DataFrame:
    """The row with the greatest crawled_at of each (repo_name, repo_path).

    One aggregation with map-side combine: no window, no sort of whole texts per key. Rows that tie are copies, any of
    them serves. A null crawled_at is older than every time. Null keys form a key of their own. The result has
    repo_name, repo_path, raw_content (null when the newest version has none), size_bytes, language, crawled_at.
    """
    rows = files if keep is None else files.where(keep)
    newest = F.max_by(
        F.struct("raw_content", "size_bytes", "language", "crawled_at"),
        F.coalesce(F.col("crawled_at").cast("timestamp_ntz"), F.lit("0001-01-01").cast("timestamp_ntz")),
    )
    return rows.groupBy("repo_name", "repo_path").agg(newest.alias("_n")).select("repo_name", "repo_path", "_n.*")
