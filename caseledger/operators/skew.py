"""Joins of a table with a one-row-per-key summary of some table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_back(rows: DataFrame, summary: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Join rows with grouped or distinct keys so that a hot key can be split.

    Adaptive execution splits a hot key only where both sides of the join come straight
    from a shuffle of their own. A grouped side would keep the partitioning of its
    grouping and rule that out. Joining on a hash of the key besides the key itself
    makes both sides shuffle for the join; the summary has one row per key, so that
    costs little. Nothing should join on the same key right after it: combine
    summaries first, they have unique keys.
    """
    keys = [on] if isinstance(on, str) else on
    digest = F.xxhash64(*keys)
    joined = rows.withColumn("_digest", digest).join(
        summary.withColumn("_digest", digest), ["_digest", *keys], how
    )
    return joined.drop("_digest")
