"""Element-wise sums of the rows of small matrices that tasks hand in."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS = "i int, v array<double>"


def rows_of(matrix: np.ndarray) -> pa.RecordBatch:
    """A task's matrix as rows ``i, v``."""
    values = pa.array(np.ascontiguousarray(matrix, np.float64).ravel())
    ends = pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1])
    return pa.RecordBatch.from_arrays(
        [pa.array(np.arange(len(matrix), dtype=np.int32)), pa.ListArray.from_arrays(ends, values)], names=["i", "v"]
    )


def summed(parts: DataFrame, rows: int, columns: int) -> np.ndarray:
    """The sum of all tasks' matrices of that shape; summed row by row in the cluster."""
    total = np.zeros((rows, columns))
    sums = parts.groupBy("i").agg(Summarizer.sum(array_to_vector("v")).alias("s"))
    for r in sums.select("i", vector_to_array("s").alias("s")).collect():
        total[r.i] = r.s
    return total
