"""Row numbers, keep-first de-duplication and top-k without any one-task step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseledger.storage import reliable

_ROW_BITS = 33


def number_rows(table: DataFrame, order: list[Column | str], name: str = "position") -> DataFrame:
    """Consecutive numbers from 1 over the whole table in ``order``.

    A window without partitions would pull every row into one task. Here rows are
    range-partitioned and sorted in place, then each partition adds the sizes of those
    before it. ``order`` should end in a unique column, so that a frequent first key
    still spreads over partitions. The sorted rows are written once, which fixes which
    partition a row is in even if executors are lost between the two reads.
    """
    ranged = table.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = reliable(ranged.withColumn("_row", F.monotonically_increasing_id()))
    part = F.shiftright("_row", _ROW_BITS)
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    # one row per partition: bounded by the number of tasks, not by the data
    before = F.sum("_size").over(
        Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.col("_row").bitwiseAND((1 << _ROW_BITS) - 1)
    return (
        ranged.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + within + 1)
        .drop("_part", "_row", "_before")
    )


def query_label(position: Column) -> Column:
    return F.format_string("Q%03d", position)


def keep_first(table: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row per key, the first in ``order``; null keys equal each other.

    Comparing the rank with one lets Spark drop all but the first row of a key before
    the shuffle, so copies of a frequent row never meet in one task.
    """
    digest = F.xxhash64(*[F.col(f"`{k}`") for k in keys])
    ranked = table.withColumn("_digest", digest).withColumn(
        "_rank",
        F.row_number().over(
            Window.partitionBy("_digest", *[F.col(f"`{k}`") for k in keys]).orderBy(*order)
        ),
    )
    return ranked.filter(F.col("_rank") == 1).drop("_rank", "_digest")


def top_per_group(
    table: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """The first ``k`` rows of each group; also cut before the shuffle."""
    window = Window.partitionBy(*group).orderBy(*order)
    return table.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def distinct_values(table: DataFrame, column: str) -> DataFrame:
    """Each value of a column once; null is none."""
    return table.select(column).dropna(subset=[column]).distinct()


def assign_chunks(numbered: DataFrame, size: Column | int, position: str = "position") -> DataFrame:
    """Adds ``chunk``, counted from 0, for fixed-size runs of an ordered list."""
    width = F.lit(size) if isinstance(size, int) else size
    return numbered.withColumn(
        "chunk", F.floor((F.col(position) - 1) / width).cast("bigint")
    )


def shuffled(table: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Random order that is the same in every run with the same seed."""
    return table.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)


def sample_head(table: DataFrame, order: list[str], rows: int = 3, columns: int = 10) -> DataFrame:
    return table.orderBy(*order).limit(rows).select(*table.columns[:columns])


def take_until(
    candidates: DataFrame,
    key: str,
    valid_format: Column,
    accepted_rows: Column,
    target: int,
    max_attempts: int,
    order: list[Column | str],
) -> DataFrame:
    """Walk the ordered keys until enough rows are accepted or enough keys checked.

    ``accepted_rows`` is 0 for a key that failed its check. Keys of an invalid format
    are passed over without being counted. A walk never sees more than
    ``max_attempts`` keys, so the running sums cover at most that many rows.
    """
    walk = (
        candidates.filter(valid_format)
        .withColumn("_accepted", accepted_rows)
        .orderBy(*order)
        .limit(max_attempts)
    )
    so_far = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    walk = walk.withColumn("_before", F.coalesce(F.sum("_accepted").over(so_far), F.lit(0)))
    walk = walk.filter(F.col("_before") < target)
    return walk.select(
        key,
        (F.col("_accepted") > 0).alias("accepted"),
        F.col("_accepted").cast("bigint").alias("accepted_rows"),
    )
