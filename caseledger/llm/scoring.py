"""A score per row from its text, appended in place; folds and bounded samples for fitting."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id: Column, of: int) -> Column:
    """Remainder of the CRC-32 of the id's decimal text; null for a null id."""
    return F.crc32(id.cast("string").cast("binary")) % of


def free_name(table: DataFrame, wish: str) -> str:
    """A column name that the table does not have, whatever its case."""
    taken = {c.lower() for c in table.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def append_score(
    docs: DataFrame, text: str, name: str, score: Callable[[pa.Array], np.ndarray]
) -> DataFrame:
    """All columns of ``docs`` and a double that ``score`` gives for each text.

    Only the texts go to Python and only the scores come back.
    """

    @F.arrow_udf("double")
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            yield pa.array(score(column), pa.float64())
            pa.default_memory_pool().release_unused()

    return docs.withColumn(name, scored(F.col(text)))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, id: str, text: str, label: str, rows: int, train: Column
) -> DataFrame:
    """``_id, _label, _text`` of at most ``rows`` labelled rows in the fold ``train``.

    ``train`` is a condition on ``_id``. The sample is that of the smallest hashes of the
    id, so it does not depend on how the tables are stored. Labels are 1 or not; of
    several labels for an id the largest counts, of several texts the smallest; a null id
    or label is none. The sample is bounded by ``rows``, so it is broadcast to find the texts.
    """
    given = labels.select(F.col(id).alias("_id"), F.col(label).alias("_label"))
    given = given.filter("_id is not null and _label is not null").filter(train)
    given = given.groupBy("_id").agg(F.max((F.col("_label") == 1).cast("int")).alias("_label"))
    sample = given.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    texts = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text"))
    found = texts.join(F.broadcast(sample), "_id")
    return found.groupBy("_id").agg(F.max("_label").alias("_label"), F.min("_text").alias("_text"))
