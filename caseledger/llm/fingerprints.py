"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch is the ``k`` smallest of a text's distinct shingle hashes (top 48 bits of 64),
kept as a sorted array. That of a union is the ``k`` smallest of both, so sketches of
parts merge in any order. From two sketches follow estimates of resemblance, of
containment and of the number of distinct shingles.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseledger.llm.words import shingle_sets

SHINGLE, K, BITS = 5, 128, 48
_FLUSH = 20_000  # keys that a task holds while merging


def bottom(shingles: np.ndarray, k: int = K) -> np.ndarray:
    """Sketch of a sorted set of shingle hashes."""
    return np.unique(shingles[:k] >> np.uint64(64 - BITS))


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def distinct_shingles(a: np.ndarray, k: int = K) -> float:
    """Exact below ``k`` shingles, then (k - 1) over the share of hashes up to the k-th."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**BITS / float(int(a[k - 1]) + 1)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity; 1 for two empty sketches."""
    union = merge(a, b, k)
    if not len(union):
        return 1.0
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(union, both, assume_unique=True).sum() / len(union))


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the first's shingles that the second has; 1 for an empty first."""
    if not len(a):
        return 1.0
    shared = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return min(1.0, shared / distinct_shingles(a, k))


def to_text(a: np.ndarray) -> str:
    """Base64 of the hashes, 6 bytes each, smallest first; no shingles give ``""``."""
    raw = a.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]
    return base64.b64encode(raw.tobytes()).decode("ascii")


def from_text(s: str | None) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(s or ""), np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 2:] = raw
    return wide.reshape(-1).view(">u8").astype(np.uint64)


def sketches(texts: pa.Array, n: int = SHINGLE, k: int = K) -> list[np.ndarray]:
    return [bottom(s, k) for s in shingle_sets(texts, n)]


def fingerprint(docs: DataFrame, id: str = "doc_id", text: str = "text", n: int = SHINGLE, k: int = K) -> DataFrame:
    """``doc_id, fingerprint, shingles`` for every row, without a shuffle.

    ``shingles`` estimates the distinct word ``n``-shingles. A text of fewer words is one
    shingle; null, empty and blank texts have none and the fingerprint ``""``. Ids are
    handed through, null and repeated ones too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sketches(batch.column(1), n, k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([to_text(s) for s in found], pa.string()),
                    pa.array([distinct_shingles(s, k) for s in found], pa.float64()),
                ],
                names=["doc_id", "fingerprint", "shingles"],
            )

    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, fingerprint string, shingles double")


def merged(parts: DataFrame, key: str, fingerprint: str = "fingerprint", k: int = K) -> DataFrame:
    """``key, fingerprint, shingles``: one fingerprint for all parts of a key.

    Each task first merges what it holds of a key, so a key with very many parts reaches
    its reducer as one row per task. Null is a key like any other; null and empty
    fingerprints add nothing.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, np.ndarray] = {}
        for batch in batches:
            for name, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = from_text(s)
                held[name] = merge(held[name], own, k) if name in held else own[:k]
            if len(held) > _FLUSH:
                yield told(held)
                held = {}
        if held:
            yield told(held)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key, so all but the last key of a batch are complete."""
        held: dict[object, np.ndarray] = {}
        for batch in batches:
            for name, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = from_text(s)
                held[name] = merge(held[name], own, k) if name in held else own
            last = batch.column(0)[-1].as_py() if len(batch) else None
            if len(held) > 1:
                tail = {last: held.pop(last)}
                yield told(held)
                held = tail
        if held:
            yield told(held)

    kind = parts.schema[key].dataType

    def told(held: dict[object, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array(list(held), arrow_kind),
                pa.array([to_text(s) for s in held.values()], pa.string()),
                pa.array([distinct_shingles(s, k) for s in held.values()], pa.float64()),
            ],
            names=["key", "fingerprint", "shingles"],
        )

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_kind = to_arrow_type(kind)
    shape = f"key {kind.simpleString()}, fingerprint string, shingles double"
    partial = parts.select(F.col(key).alias("key"), F.col(fingerprint).alias("fingerprint")).mapInArrow(fold, shape)
    together = partial.select("key", "fingerprint").repartition("key").sortWithinPartitions("key")
    return together.mapInArrow(stream, shape).withColumnRenamed("key", key)


_EDITED = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, shingles double, in_next double"
)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of bucket and falling id; each is compared with the row after it."""
    held = None  # the row that waits for its next: bucket, tail, id, text, sketch
    for batch in batches:
        if not batch.num_rows:
            continue
        buckets, tails, ids = (batch.column(i).to_pylist() for i in range(3))
        texts = [t or "" for t in batch.column(3).to_pylist()]
        own = sketches(batch.column(3))
        rows = list(zip(buckets, tails, ids, texts, own, strict=True))
        rows = rows if held is None else [held, *rows]
        held = rows[-1]
        pairs = [(a, b) for a, b in zip(rows[:-1], rows[1:], strict=True) if not a[1] and a[0] == b[0]]
        for k in range(0, len(pairs), 500):
            yield _compared(pairs[k : k + 500])


def _compared(pairs: list[tuple]) -> pa.RecordBatch:
    edited = []
    for a, b in pairs:
        cut = len(a[3]) // 3
        edited.append(a[3][: len(a[3]) - cut] + b[3][:cut])
    changed = sketches(pa.array(edited, pa.large_string()))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([a[2] for a, _ in pairs], pa.int64()),
            pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8")).hexdigest() for t in edited]),
            pa.array([to_text(a[4]) for a, _ in pairs], pa.string()),
            pa.array([to_text(s) for s in changed], pa.string()),
            pa.array([resemblance(a[4], s) for (a, _), s in zip(pairs, changed, strict=True)], pa.float64()),
            pa.array([resemblance(a[4], b[4]) for a, b in pairs], pa.float64()),
            pa.array([distinct_shingles(a[4]) for a, _ in pairs], pa.float64()),
            pa.array([containment(a[4], b[4]) for a, b in pairs], pa.float64()),
        ],
        names=[c.split()[0] for c in _EDITED.split(", ")],
    )


def against_edits(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every text's fingerprint beside those of its edited text and of the next document.

    The next document is that of the next smaller id, after the smallest the largest.
    The edited text has its last third (rounded down, in code points) replaced by as
    many first code points of the next, or all it has. Also returns the estimated
    distinct shingles and the containment in the next document.

    The texts are shuffled once: ids are cut into buckets at their quantiles, and the
    first document of a bucket also goes, as a tail that is not returned, to the bucket
    before it, so every bucket has what its last row needs.

    Null texts are empty. Rows without an id come last; rows of one id are ordered by
    their text. With a single row, the next document is the row itself. Ids are meant to
    be unique: rows of one id share a bucket.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    falling = rows.withColumn("fall", F.coalesce(-F.col("doc_id").cast("double"), F.lit(float("inf"))))
    shares = [k / (4 * n) for k in range(1, 4 * n)]
    numbers = falling.filter("doc_id is not null").select("fall")
    bounds = sorted(set(numbers.stat.approxQuantile("fall", shares, 1 / (16 * n))))
    cuts = [-float("inf"), *(bounds or [0.0]), float("inf")]
    bucketed = Bucketizer(splits=cuts, inputCol="fall", outputCol="bucket", handleInvalid="keep").transform(falling)
    bucketed = bucketed.select(F.col("bucket").cast("int").alias("bucket"), "doc_id", "text")

    # one row per bucket, 4 for each partition: their number is set, not the data's
    heads = bucketed.groupBy("bucket").agg(F.max("doc_id").alias("head"))
    in_order = Window.orderBy("bucket")
    everything = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select(
        F.col("bucket").alias("of"),
        "head",
        F.coalesce(F.lag("bucket").over(in_order), F.max("bucket").over(everything)).alias("before"),
    )
    is_head = (F.col("bucket") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("head"))
    places = F.when(
        F.col("before").isNotNull(),
        F.array(
            F.struct("bucket", F.lit(0).alias("tail")),
            F.struct(F.col("before").alias("bucket"), F.lit(1).alias("tail")),
        ),
    ).otherwise(F.array(F.struct("bucket", F.lit(0).alias("tail"))))
    dealt = (
        bucketed.join(F.broadcast(heads), is_head, "left")
        .withColumn("place", F.explode(places))
        .select("place.bucket", "place.tail", "doc_id", "text")
        .repartition(n, "bucket")
        .sortWithinPartitions("bucket", "tail", F.desc_nulls_last("doc_id"), "text")
    )
    return dealt.mapInArrow(_compare, _EDITED)
