"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

One scan of the training texts finds the places of the test items' seeds, which are four
words in a row or with one left out, and keeps the passages around them. No seed is set aside for being frequent: of the seeds
that a passage shares with an item even the rarest may be frequent, as when a text has
many edited copies. Every passage that shares a seed with an item is aligned with it word
by word, which scores copies with words replaced, left out or put in; only pairs with too
few words in common to reach the threshold are left out before. Equal texts are aligned
once. Words are runs of letters and digits, A-Z lower-cased.

Test items are the query set: their seeds are sent to the tasks in blocks of bounded
size, one scan of the texts for each block. Passages that the scans find near each other
in one text are joined, so the result does not depend on the number of blocks.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseledger.llm.scoring import free_name
from caseledger.llm.words import PUNCTUATION, in_parts, pattern_hash, text_bytes, word_hashes, word_spans
from caseledger.storage import stored

# Places of a seed's words: runs of four, and four of five, so that a word replaced in
# every third or fourth place still leaves whole seeds.
SHAPES = ((0, 1, 2, 3), (0, 2, 3, 4), (0, 1, 3, 4), (0, 1, 2, 4))
THRESHOLD = 0.5  # of the score of an item aligned with itself
MATCH, MISMATCH, GAP = 1.0, -0.5, 0.5
SEEDS_AT_ONCE = 2_000_000  # that are sent to the tasks, 8 bytes each
_WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").translate(_LOWER))


def align(item: list[int], passage: np.ndarray) -> tuple[float, int]:
    """Best local alignment score, and the place in the passage after its last word.

    A row of the table is filled at once: gaps along it are a running maximum.
    """
    n = len(passage)
    slope = GAP * np.arange(n + 1)
    above = np.zeros(n + 1)
    best, end = 0.0, 0
    for word in item:
        row = np.zeros(n + 1)
        row[1:] = np.maximum(above[:-1] + np.where(passage == word, MATCH, MISMATCH), above[1:] - GAP)
        np.maximum(row, 0, out=row)
        above = np.maximum.accumulate(row + slope) - slope
        top = int(above.argmax())
        if above[top] > best:
            best, end = float(above[top]), top
    return best, end


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every seed of every item; words of the item."""
    for batch in batches:
        at = 0
        for part in in_parts(batch.column(1)):
            data, starts = text_bytes(part)
            words, begin = word_hashes(data, starts, PUNCTUATION)
            grams = [pattern_hash(words, shape) for shape in SHAPES]
            for k, (a, b) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)):
                own = [g[a : max(a, b - shape[-1])] for g, shape in zip(grams, SHAPES, strict=True)]
                own = np.unique(np.concatenate(own)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(np.full(len(own), at + k))),
                        pa.array(own),
                        pa.array(np.full(len(own), b - a, np.int32)),
                    ],
                    names=["item_key", "seed", "words"],
                )
            at += len(part)


_PASSAGE = "doc_id bigint, doc_key bigint, hit bigint, last_hit bigint, begin bigint, passage string, seeds array<bigint>"


def _hits(words: np.ndarray, seeds: np.ndarray, first_bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, seed and number of words of every seed found, by place."""
    found = []
    for shape in SHAPES:
        grams = pattern_hash(words, shape)
        maybe = np.flatnonzero(first_bits[(grams >> np.uint64(42)).astype(np.int64)])
        row = np.minimum(np.searchsorted(seeds, grams[maybe]), len(seeds) - 1)
        at = maybe[seeds[row] == grams[maybe]]
        found.append((at, grams[at], np.full(len(at), shape[-1] + 1)))
    hits, own, span = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.argsort(hits, kind="stable")
    return hits[order], own[order], span[order]


def _passages(seeds: np.ndarray, margin: int):
    """Passages of the texts around seeds; passages nearer than a margin are one."""
    names = [c.split()[0] for c in _PASSAGE.split(", ")]
    first_bits = np.zeros(1 << 22, bool)
    first_bits[(seeds >> np.uint64(42)).astype(np.int64)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in in_parts(batch.column(2)):
                data, starts = text_bytes(part)
                words, begin = word_hashes(data, starts, PUNCTUATION)
                hits, own, span = _hits(words, seeds, first_bits)
                text = np.searchsorted(begin, hits, "right") - 1
                inside = hits + span <= begin[text + 1]  # not across two texts
                hits, own, span, text = hits[inside], own[inside], span[inside], text[inside]
                if len(hits):
                    first, last = word_spans(data, starts, PUNCTUATION)
                    cut = (np.diff(hits) > margin) | (np.diff(text) > 0)
                    groups = np.split(np.arange(len(hits)), np.flatnonzero(cut) + 1)
                    told = []
                    for g in groups:
                        t = int(text[g[0]])
                        a = max(int(begin[t]), int(hits[g[0]]) - margin)
                        b = min(int(begin[t + 1]), int((hits[g] + span[g]).max()) + margin)
                        passage = data[first[a] : last[b - 1]].tobytes().decode("utf-8")
                        places = [int(x) - int(begin[t]) for x in (hits[g[0]], hits[g[-1]], a)]
                        told.append((at + t, *places, passage, np.unique(own[g]).view(np.int64)))
                    rows = pa.array([x[0] for x in told])
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(rows),
                            batch.column(1).take(rows),
                            *(pa.array([x[k] for x in told], pa.int64()) for k in (1, 2, 3)),
                            pa.array([x[4] for x in told], pa.string()),
                            pa.array([x[5] for x in told], pa.list_(pa.int64())),
                        ],
                        names=names,
                    )
                at += len(part)

    return run


_JOINED = "doc_key bigint, begin bigint, passage string, seeds array<bigint>"


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One passage for those of several blocks that overlap; words are told apart by their places."""
    names = [c.split()[0] for c in _JOINED.split(", ")]
    for batch in batches:
        begins, passages, seeds = [], [], []
        for pieces, lists in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            pieces.sort(key=lambda piece: piece["begin"])
            words: list[str] = []
            for piece in pieces:
                own = words_of(piece["passage"])
                words += own[pieces[0]["begin"] + len(words) - piece["begin"] :] if words else own
            begins.append(pieces[0]["begin"])
            passages.append(" ".join(words))
            seeds.append(sorted({seed for own in lists for seed in own}))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(begins, pa.int64()),
                pa.array(passages, pa.string()),
                pa.array(seeds, pa.list_(pa.int64())),
            ],
            names=names,
        )


def _of_all_blocks(found: DataFrame, margin: int) -> DataFrame:
    """As one scan for all seeds would tell them: passages nearer than the margin are one."""
    before = Window.partitionBy("doc_key").orderBy("hit", "last_hit", "block")
    reached = F.max("last_hit").over(before.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.coalesce(F.col("hit") - reached > margin, F.lit(False)).cast("int")
    run = F.sum("apart").over(before.rowsBetween(Window.unboundedPreceding, 0))
    together = found.withColumn("apart", apart).withColumn("run", run).groupBy("doc_key", "run")
    pieces = together.agg(
        F.collect_list(F.struct("begin", "passage")).alias("pieces"), F.collect_list("seeds").alias("seeds")
    )
    return pieces.select("doc_key", "pieces", "seeds").mapInArrow(_joined, _JOINED)


_SCORED = "doc_key bigint, item_key bigint, score double, last_word bigint"
_CONTAMINATED = "doc_id bigint, doc_key bigint, item_id bigint, score double, last_word bigint"


def in_common(item: list[str], passage: list[str]) -> int:
    """Words of the item that the passage has too, repeated ones as often as in both.

    No alignment has more matches, so none scores more than ``MATCH`` for each.
    """
    return (Counter(item) & Counter(passage)).total()


def _aligned(threshold: float):
    names = [c.split()[0] for c in _SCORED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], tuple[float, int]] = {}
        for batch in batches:
            scores, ends = [], []
            for passage, item in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if (item, passage) not in seen:
                    if len(seen) > 2_000:
                        seen.clear()
                    own, other = words_of(item), words_of(passage)
                    best, end = 0.0, 0
                    if MATCH * in_common(own, other) / (MATCH * len(own)) >= threshold:
                        index = {w: i for i, w in enumerate(dict.fromkeys(own))}
                        coded = np.array([index.get(w, -1) for w in other])
                        best, end = align([index[w] for w in own], coded)
                    seen[item, passage] = (best / (MATCH * len(own)), end)
                score, end = seen[item, passage]
                scores.append(score)
                ends.append(end)
            last = pa.compute.add(batch.column(2), pa.array(ends, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), last], names=names
            )

    return run


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``doc_id, doc_key, item_id, score, last_word``: texts that hold (a copy of) an item.

    ``score`` is the best alignment's share of what the item scores with itself, at least
    ``threshold``; ``last_word`` counts the text's words up to the alignment's end.
    ``doc_key`` is a hash of the text, so that rows without an id can be told apart; rows
    that repeat an id and a text are one. Null and empty texts hold nothing. An item of
    fewer than four words, or without an id, is no evidence and never matched. Of several
    texts with one item id, the one that scores best counts.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item).cast("bigint").alias("item_id"), F.col(item_text).alias("item"))
    items = items.filter("item_id is not null and item is not null").withColumn("item_key", F.xxhash64("item"))
    wanted = items.select("item_key", "item").dropDuplicates(["item_key"])
    seeds = wanted.mapInArrow(_seeds, "item_key bigint, seed bigint, words int")
    seeds = stored(seeds.distinct(), "seeds")
    rows = docs.select(
        F.col(id).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("doc_key"), F.col(text).alias("text")
    )
    n, margin = seeds.agg(F.count(F.lit(1)), F.coalesce(F.max("words"), F.lit(0))).first()
    blocks = max(1, -(-n // SEEDS_AT_ONCE))
    found = None
    for block in range(blocks):
        own = seeds.filter(F.pmod("seed", F.lit(blocks)) == block).select("seed").distinct().toArrow()
        table = np.sort(np.asarray(own.column("seed")).view(np.uint64))
        if len(table):
            passages = rows.mapInArrow(_passages(table, margin), _PASSAGE).withColumn("block", F.lit(block))
            found = passages if found is None else found.unionByName(passages)
    if found is None:
        return spark.createDataFrame([], _CONTAMINATED)
    found = stored(found.dropDuplicates(["doc_id", "doc_key", "block", "begin"]), "passages")

    texts = found.drop("doc_id").dropDuplicates(["doc_key", "block", "begin"])
    texts = _of_all_blocks(texts, margin) if blocks > 1 else texts.select("doc_key", "begin", "passage", "seeds")
    texts = stored(texts, "distinct")
    pairs = (
        texts.select("doc_key", "begin", F.explode("seeds").alias("seed"))
        .join(seeds.select("item_key", "seed"), "seed")
        .select("doc_key", "begin", "item_key")
        .distinct()
    )
    joined = (
        pairs.join(texts.drop("seeds"), ["doc_key", "begin"])
        .join(wanted, "item_key")
        .select("doc_key", "item_key", "begin", "passage", "item")
    )
    scored = joined.mapInArrow(_aligned(threshold), _SCORED).filter(F.col("score") >= threshold)
    best = (
        scored.join(items.select("item_id", "item_key").distinct(), "item_key")
        .groupBy("doc_key", "item_id")
        .agg(F.max(F.struct("score", "last_word")).alias("best"))
    )
    return (
        found.select("doc_id", "doc_key")
        .distinct()
        .join(best, "doc_key")
        .select("doc_id", "doc_key", "item_id", "best.score", "best.last_word")
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no test item, with their columns.

    Rows are told apart by their text, so those without an id are judged as well.
    """
    held = contaminated(docs, benchmark, id, text)
    name = free_name(docs, "_held_key")
    keys = held.select(F.col("doc_key").alias(name)).distinct()
    return docs.join(keys, F.xxhash64(docs[text]) == F.col(name), "left_anti")
