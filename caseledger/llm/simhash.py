"""SimHash near-duplicates by the generalised pigeonhole principle.

Distinct fingerprints are joined where at most ``TAU`` of their 64 bits differ:

1. Bits are put into four groups of 16 so that correlated bits share a group (greedily,
   from the bits' correlation matrix). Two groups together make a half of 32 bits, so
   there are two partitionings: four groups, or two halves.
2. If fingerprints differ in at most ``TAU`` bits, then for any thresholds of a
   partitioning whose (threshold + 1) add up to ``TAU + 1`` some part differs in no more
   bits than its threshold; -1 leaves a part out. Every fingerprint gets thresholds of its
   own: dynamic programming over the parts of each partitioning finds the least sum of
   probes and expected candidates, and the cheaper partitioning is taken. Candidates
   are estimated from exact counts of the 16-bit values of each group within 0 to
   ``TAU`` bits; those of a half from both of its groups as if independent. So a fingerprint
   in a dense neighbourhood leaves out the parts that all its neighbours share and
   probes others further, and in larger tables more and more take the halves.
3. Each fingerprint probes all values of a part within its threshold; all fingerprints are
   filed under the value of every part of the partitionings in use. Probe and file
   meet by value, and the pair is verified on all 64 bits inside the join, once, from
   the larger fingerprint.

The statistics that go through the driver are 4 x 65,536 counts, whatever the number of
documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseledger.llm.components import components
from caseledger.llm.sums import PARTS, rows_of, summed
from caseledger.llm.words import in_parts
from caseledger.operators.skew import join_back
from caseledger.storage import discard, stored

TAU = 3  # bits
WORDS = 3  # in a shingle
SEED = 42
GROUPS, WIDTH = 4, 16
PROBE_COST = 8.0  # of a probe that is shuffled, in candidates compared
_BLOCK = 1 << 20  # bytes of a text that are split at once
_ONCE = 1 << 16  # shingles whose bits are counted at once

# --- fingerprints


def _words(text: bytes) -> Iterator[list[bytes]]:
    """Lower-cased words of a text, block by block. bytes.split() splits at 20, 09-0D only."""
    at = 0
    while at < len(text):
        end = at + _BLOCK
        while end < len(text) and not text[end : end + 1].isspace():
            end += 1
        yield text[at:end].lower().split()
        at = end


def _hash_bits(shingles: list[bytes]) -> np.ndarray:
    """How often each bit is set in the hashes, from the highest bit on."""
    total = np.zeros(64, np.int64)
    for k in range(0, len(shingles), _ONCE):
        raw = b"".join([xxhash.xxh64_digest(s, SEED) for s in shingles[k : k + _ONCE]])
        total += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return total


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The 64-bit SimHash of a text's word shingles, 0 for a text without words."""
    set_bits, n, tail = np.zeros(64, np.int64), 0, []
    for block in _words((text or "").encode("utf-8")):
        tail += block
        shingles = [b" ".join(tail[i : i + words]) for i in range(len(tail) - words + 1)]
        set_bits += _hash_bits(shingles)
        n += len(shingles)
        tail = tail[max(0, len(tail) - words + 1) :]
    if not n and tail:
        set_bits, n = _hash_bits([b" ".join(tail)]), 1
    return int(np.packbits(2 * set_bits > n).view(">u8")[0])


def _signed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fingerprint(t) for part in in_parts(batch.column(1)) for t in part.to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], names=["doc_id", "fp"]
        )


# --- the partitioning


def _bits(values: np.ndarray) -> np.ndarray:
    """A row of 64 zeros and ones for each value, lowest bit first."""
    return np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _bit_products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((65, 64))
    for batch in batches:
        bits = _bits(np.asarray(batch.column(0)).view(np.uint64)).astype(np.float64)
        total[:-1] += bits.T @ bits
        total[-1] += len(bits)
    yield rows_of(total)


def bit_groups(products: np.ndarray) -> list[list[int]]:
    """Four groups of 16 bits with much correlation inside, from the sums of products of bits."""
    n = max(products[-1, 0], 1.0)
    mean = np.diag(products[:-1]) / n
    covariance = products[:-1] / n - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(covariance), 1e-12))
    strength = np.round(np.abs(covariance) / np.outer(spread, spread), 9)  # ties go to the lower bit
    np.fill_diagonal(strength, 0)
    left = list(range(64))
    groups = []
    for _ in range(GROUPS):
        rest = strength[np.ix_(left, left)]
        group = [left[int(rest.max(1).argmax())]]
        left.remove(group[0])
        while len(group) < WIDTH:
            group.append(left[int(strength[np.ix_(left, group)].sum(1).argmax())])
            left.remove(group[-1])
        groups.append(sorted(group))
    return groups


def _arranged(values: np.ndarray, groups: list[list[int]]) -> np.ndarray:
    """The fingerprints with each group's bits next to each other; distances stay the same."""
    bits = np.ascontiguousarray(_bits(values)[:, np.concatenate(groups)])
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


# --- thresholds


def _within(counts: np.ndarray) -> np.ndarray:
    """``[t, value]``: how many counted values differ from a value in exactly ``t`` bits."""
    value = np.arange(len(counts))

    def neighbours(x: np.ndarray) -> np.ndarray:
        return sum(x[value ^ (1 << b)] for b in range(WIDTH))

    exact = [counts.astype(np.float64)]
    exact.append(neighbours(exact[0]))
    for t in range(2, TAU + 1):  # a step from distance t - 1 leads to t, or back
        exact.append((neighbours(exact[t - 1]) - (WIDTH - t + 2) * exact[t - 2]) / t)
    return np.array(exact)


@lru_cache(maxsize=16)
def masks(width: int, threshold: int) -> np.ndarray:
    """All values of ``width`` bits with at most ``threshold`` bits set."""
    chosen = (sum(1 << b for b in c) for t in range(threshold + 1) for c in combinations(range(width), t))
    return np.array(list(chosen), np.uint64)


def _least_cost(costs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Least total cost per fingerprint, and the threshold of each part.

    ``costs[part][s]`` is the cost of threshold ``s - 1``; the ``s`` add up to ``TAU + 1``.
    """
    n = costs[0].shape[1]
    best = np.full((TAU + 2, n), np.inf)
    best[0] = 0
    choices = []
    for cost in costs:
        options = np.full((TAU + 2, TAU + 2, n), np.inf)  # [sum so far, s of this part]
        for total in range(TAU + 2):
            for s in range(total + 1):
                options[total, s] = best[total - s] + cost[s]
        choices.append(options.argmin(1))
        best = options.min(1)
    at = np.full(n, TAU + 1)
    found = np.zeros((len(costs), n), np.int64)
    for part in range(len(costs) - 1, -1, -1):
        found[part] = choices[part][at, np.arange(n)]
        at = at - found[part]
    return best[TAU + 1], found - 1


def allocate(values: np.ndarray, within: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per arranged fingerprint whether it takes the halves, and thresholds of its parts.

    ``within[group]`` is what ``_within`` gives; a row of thresholds has four entries, of
    which the halves use the first two.
    """
    part = [((values >> np.uint64(WIDTH * g)) & np.uint64((1 << WIDTH) - 1)).astype(np.int64) for g in range(GROUPS)]
    exact = [within[g][:, part[g]] for g in range(GROUPS)]

    def cost(width: int, at_distance: np.ndarray) -> np.ndarray:
        probes = np.array([[len(masks(width, t))] for t in range(TAU + 1)])
        return np.vstack([np.zeros((1, len(values))), PROBE_COST * probes + np.cumsum(at_distance, 0)])

    by_group, quarters = _least_cost([cost(WIDTH, e) for e in exact])
    halves = [
        np.array([sum(a[s] * b[t - s] for s in range(t + 1)) for t in range(TAU + 1)]) / max(n, 1)
        for a, b in (exact[:2], exact[2:])
    ]
    by_half, pair = _least_cost([cost(2 * WIDTH, h) for h in halves])
    wide = by_half < by_group
    thresholds = np.where(wide, np.vstack([pair, np.full_like(pair, -1)]), quarters)
    return wide, thresholds.T


def _allocated(groups: list[list[int]], within: np.ndarray, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.asarray(batch.column(0)).view(np.uint64)
            wide, thresholds = allocate(values, within, n)
            code = ((thresholds + 1) * 8 ** np.arange(GROUPS)).sum(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(wide), pa.array(code.astype(np.int32))], names=["p", "wide", "code"]
            )

    return run


def _probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, p`` of every value that a fingerprint probes."""
    for batch in batches:
        values = np.asarray(batch.column(0)).view(np.uint64)
        wide = np.asarray(batch.column(1))
        thresholds = (np.asarray(batch.column(2))[:, None] // 8 ** np.arange(GROUPS)) % 8 - 1
        for is_wide, width, parts in ((False, WIDTH, GROUPS), (True, 2 * WIDTH, 2)):
            for part in range(parts):
                for t in range(TAU + 1):
                    here = values[(wide == is_wide) & (thresholds[:, part] == t)]
                    flips = masks(width, t)
                    step = max(1, (1 << 18) // len(flips))
                    for k in range(0, len(here), step):
                        some = here[k : k + step]
                        yield _filed(some, flips, width, part)


def _filed(values: np.ndarray, flips: np.ndarray, width: int, part: int) -> pa.RecordBatch:
    own = (values >> np.uint64(width * part)) & np.uint64((1 << width) - 1)
    place = np.uint64((part + (GROUPS if width > WIDTH else 0)) << 2 * WIDTH)
    keys = (own[:, None] ^ flips[None, :]).ravel() | place
    return pa.RecordBatch.from_arrays(
        [pa.array(keys.view(np.int64)), pa.array(np.repeat(values, len(flips)).view(np.int64))], names=["key", "p"]
    )


# --- the join


def links(prints: DataFrame) -> DataFrame:
    """``a, b``: every pair of distinct fingerprints (column ``fp``, 64 bits) within ``TAU`` bits."""
    spark = prints.sparkSession
    distinct = stored(prints.select("fp").distinct(), "fingerprints")
    groups = bit_groups(summed(distinct.mapInArrow(_bit_products, PARTS), 65, 64))

    def arrange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _arranged(np.asarray(batch.column(0)).view(np.uint64), groups)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p.view(np.int64))], names=["fp", "p"])

    arranged = stored(distinct.mapInArrow(arrange, "fp bigint, p bigint"), "arranged")
    discard(distinct)
    cut = [F.expr(f"cast(shiftrightunsigned(p, {WIDTH * g}) & {(1 << WIDTH) - 1} as int)") for g in range(GROUPS)]
    counted = arranged.select(F.posexplode(F.array(*cut)).alias("g", "value")).groupBy("g", "value").count()
    counts = np.zeros((GROUPS, 1 << WIDTH))
    for r in counted.toLocalIterator():  # at most 65,536 a group
        counts[r.g, r.value] = r["count"]
    n = int(counts[0].sum())
    within = np.array([_within(c) for c in counts]).astype(np.float32)
    plan = stored(arranged.select("p").mapInArrow(_allocated(groups, within, n), "p bigint, wide boolean, code int"), "thresholds")
    used = {r.wide for r in plan.select("wide").distinct().collect()}
    parts = [(WIDTH, g, g) for g in range(GROUPS) if False in used] + [(2 * WIDTH, h, GROUPS + h) for h in range(2) if True in used]
    files = [
        F.expr(f"(shiftrightunsigned(p, {w * k}) & {(1 << w) - 1}L) | {place << 2 * WIDTH}L") for w, k, place in parts
    ]
    if not files:
        return spark.createDataFrame([], "a bigint, b bigint")
    filed = arranged.select(F.explode(F.array(*files)).alias("key"), F.col("p").alias("q"))
    probes = plan.mapInArrow(_probes, "key bigint, p bigint")
    near = probes.join(filed, "key").filter((F.col("q") < F.col("p")) & (F.bit_count(F.col("p").bitwiseXOR(F.col("q"))) <= TAU))
    pairs = near.select("p", "q").distinct()
    named = join_back(pairs, arranged.select("p", F.col("fp").alias("a")), "p")
    return join_back(named, arranged.select(F.col("p").alias("q"), F.col("fp").alias("b")), "q").select("a", "b")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id, near_fingerprints`` for every row of ``docs``.

    The fingerprint is the SimHash of the text's shingles of three lower-cased (A-Z)
    words, repeats included, under XXH64: a bit is set where more than half of the hashes
    have it. Fewer words are one shingle; null, empty and blank texts have none and the
    fingerprint zero, which links like any other. Rows link where fingerprints differ in at
    most three bits; ``component_id`` is the smallest id reachable. ``near_fingerprints``
    counts the other fingerprints that the row's own links with.

    A row without an id has a fingerprint, takes no part in links and has a null
    component. Rows that repeat an id are each placed by their own text. An empty
    table gives no rows. Other columns are ignored.
    """
    rows = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    signed = stored(rows.mapInArrow(_signed_ids, "doc_id bigint, fp bigint"), "signed")
    classes = signed.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = stored(links(classes), "links")
    roots = components(found).select(F.col("node").alias("fp"), "root")
    ends = found.select(F.col("a").alias("fp")).union(found.select(F.col("b").alias("fp")))
    degree = ends.groupBy("fp").agg(F.count(F.lit(1)).alias("near"))
    placed = classes.join(roots, "fp", "left").join(degree, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = join_back(placed, least, "root").select("fp", "component_id", "near")
    named = F.col("doc_id").isNotNull()
    return join_back(signed, placed, "fp", "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(named, F.col("component_id")).alias("component_id"),
        F.when(named, F.coalesce("near", F.lit(0))).cast("bigint").alias("near_fingerprints"),
    )
