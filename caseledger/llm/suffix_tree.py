"""LM scoring: a probabilistic suffix tree over the bytes of texts.

A text is read as its words, lower-cased (A-Z), each followed by a blank, and an end
sign. A node of the tree is a context of up to ``DEPTH`` symbols. A context is counted
over all training texts and kept when it occurs ``LEAST`` times and its next symbols
differ from what the context one symbol shorter tells, by a likelihood-ratio test of a
fixed level; what is kept is closed under suffixes. Both bounds are absolute, so the tree
grows with the corpus. Distributions are smoothed towards the shorter context's
(Witten-Bell), down to a uniform one. A symbol is scored in the state of the longest kept
suffix of what precedes it.

The nodes are a table, one row per (context, next symbol) that any text holds, and a
depth is joined with the one before. Of its last depth, the windows that make up a least
share of all symbols are broadcast with their probability, which bounds their number by
the share's inverse; texts' other windows are joined with the table. Words of the base
score are treated alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseledger.llm.scoring import fold
from caseledger.llm.words import in_parts, text_bytes, word_hashes, word_spans
from caseledger.storage import discard, stored

DEPTH = 5
LEAST = 4  # occurrences of a context
NORMAL = 3.09  # the standard normal's quantile at the test's level, 0.001
COMMON_WINDOWS = 2e-7  # of all symbols, for a window whose probability is broadcast
COMMON_SHARE = 2e-6  # of all training tokens, for a word whose count is broadcast
_END, _BLANK, _PAD = 1, 32, 0
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[_PAD, _END]] = 2  # control characters that stand for something else here
END_WORD = 0x656E64  # the hash that counts ends; word hashes are never so small in practice


def symbols(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each after ``DEPTH`` pads, and where each text's begin."""
    first, last = word_spans(data, starts)
    at = np.searchsorted(first, starts)
    n = len(starts) - 1
    # each text: pads, its words with a blank after each, the end
    length = last - first + 1
    total = np.concatenate([[0], np.cumsum(length)])
    own = total[at[1:]] - total[at[:-1]]
    begin = np.concatenate([[0], np.cumsum(own + DEPTH + 1)])
    out = np.full(int(begin[-1]), _BLANK, np.uint8)
    pads = (begin[:-1, None] + np.arange(DEPTH)).ravel()
    out[pads] = _PAD
    out[begin[1:] - 1] = _END
    if len(first):
        text = np.repeat(np.arange(n), np.diff(at))
        to = begin[text] + DEPTH + total[:-1] - total[at[text]]
        shift = np.repeat(to - first, last - first)
        inside = np.zeros(len(data) + 1, np.int8)
        inside[first] += 1
        inside[last] -= 1
        where = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8))
        out[where + shift] = _FOLD[data[where]]
    return out, begin


def windows(stream: np.ndarray) -> np.ndarray:
    """For every symbol from the first after the pads: it and the five before, as one number."""
    m = len(stream) - DEPTH
    key = np.zeros(max(0, m), np.uint64)
    for i in range(DEPTH + 1):
        key = (key << np.uint64(8)) | stream[i : i + m].astype(np.uint64)
    return key


def _scored_places(begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``windows`` that belong to a text's own symbols, and each one's text."""
    size = np.diff(begin) - DEPTH
    text = np.repeat(np.arange(len(size)), size)
    offset = np.arange(len(text)) - np.repeat(np.concatenate([[0], np.cumsum(size)[:-1]]), size)
    return begin[:-1][text] + offset, text


def text_blocks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and starts of slices of about a megabyte; a longer text is a slice by itself."""
    for part in in_parts(column, 1 << 20):
        yield text_bytes(part)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words (kind 0) and of windows (kind 1), summed over blocks of the task.

    ``n`` counts in training texts, ``every`` in all; words are counted in the first only.
    """
    held: list[list[tuple]] = [[], []]
    room = 0
    for batch in batches:
        learned = np.asarray(batch.column(1).fill_null(False).to_numpy(zero_copy_only=False), bool)
        done = 0
        for data, starts in text_blocks(batch.column(0)):
            size = len(starts) - 1
            own = learned[done : done + size]
            done += size
            words, at = word_hashes(data, starts)
            stream, begin = symbols(data, starts)
            places, owner = _scored_places(begin)
            found = windows(stream)[places]
            if own.any():
                words = words[np.repeat(own, np.diff(at))]
                names, seen = np.unique(
                    np.concatenate([words, np.full(int(own.sum()), END_WORD, np.uint64)]), return_counts=True
                )
                held[0].append((names, seen, seen))
                room += len(names)
            for told, chosen in ((1, own[owner]), (0, ~own[owner])):
                names, seen = np.unique(found[chosen], return_counts=True)
                held[1].append((names, seen * told, seen))
                room += len(names)
            if room > 4_000_000:
                held = [[_added(h)] if h else [] for h in held]
                room = sum(len(h[0][0]) for h in held if h)
                if room > 2_000_000:
                    yield from _told(held)
                    held, room = [[], []], 0
    yield from _told(held)


def _told(held: list[list[tuple]]) -> Iterator[pa.RecordBatch]:
    for kind in (0, 1):
        if not held[kind]:
            continue
        names, n, every = _added(held[kind])
        for k in range(0, len(names), 1 << 18):
            part = slice(k, k + (1 << 18))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(names[part]), kind, np.int32)),
                    pa.array(names[part].view(np.int64)),
                    pa.array(n[part].astype(np.int64)),
                    pa.array(every[part].astype(np.int64)),
                ],
                names=["kind", "name", "n", "every"],
            )


def _added(parts: list[tuple]) -> tuple[np.ndarray, ...]:
    """Sorted distinct names with the sums of their counts."""
    names, *counts = (np.concatenate(c) for c in zip(*parts, strict=True))
    if not len(names):
        return names, *counts
    order = np.argsort(names, kind="stable")
    names = names[order]
    first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
    return names[first], *(np.add.reduceat(c[order], first) for c in counts)


def _find(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(values), int), np.zeros(len(values), bool)
    row = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return row, table[row] == values


def _tail(symbols: int) -> Column:
    """The last symbols of a pair."""
    return F.col("pair").bitwiseAND((1 << (8 * symbols)) - 1)


def significant(kinds: Column) -> Column:
    """The chi-square quantile for so many next symbols, as bits of log likelihood."""
    part = F.lit(2.0) / (9.0 * F.greatest(kinds, F.lit(1)))
    return kinds * F.pow(1.0 - part + NORMAL * F.sqrt(part), F.lit(3.0)) / (2 * math.log(2))


def states(whole: DataFrame, least: int = LEAST) -> DataFrame:
    """``pair, every, p``: for every window, the probability of its last symbol.

    ``whole`` has ``name, n, every``: windows with their occurrences in training and in
    all texts. A context has at most 256 next symbols, so its rows fit in a task.
    """
    pairs = None
    for d in range(DEPTH + 1):
        own = whole.select(F.lit(d).alias("depth"), F.col("name").alias("pair"), "n", "every")
        own = own.withColumn("pair", _tail(d + 1))
        pairs = own if pairs is None else pairs.unionByName(own)
    pairs = stored(
        pairs.groupBy("depth", "pair").agg(F.sum("n").alias("n"), F.sum("every").alias("every")), "pairs"
    )
    context = Window.partitionBy("context").orderBy("pair")
    context = context.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = None
    for d in range(DEPTH + 1):
        own = pairs.filter(F.col("depth") == d).select(
            "pair", "n", "every", F.shiftright("pair", 8).alias("context"), _tail(d).alias("suffix")
        )
        if level is None:
            own = own.withColumns({"shorter": F.lit(1 / 256), "before": F.lit(True)})
        else:
            before = level.select(F.col("pair").alias("suffix"), F.col("p").alias("shorter"), F.col("kept").alias("before"))
            own = own.join(before, "suffix")
        own = own.withColumns(
            {"held": F.sum("n").over(context), "kinds": F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).over(context)}
        )
        held, kinds = F.col("held"), F.col("kinds")
        own = own.withColumn(
            "own", (F.col("n") + kinds * F.col("shorter")) / F.greatest(held + kinds, F.lit(1))
        )
        if level is None:
            kept = held > 0
        else:
            bits = F.when(F.col("n") > 0, F.col("n") * F.log2(F.col("own") / F.col("shorter"))).otherwise(0.0)
            own = own.withColumn("gain", F.sum(bits).over(context))
            kept = F.col("before") & (held >= least) & (F.col("gain") >= significant(kinds))
        own = own.withColumn("kept", kept)
        level = own.select(
            "pair", "every", "kept", F.when(F.col("kept"), F.col("own")).otherwise(F.col("shorter")).alias("p")
        )
    found = stored(level.select("pair", "every", "p"), "states")
    discard(pairs)
    return found


def _scored(common: np.ndarray, common_counts: np.ndarray, likely: np.ndarray, chance: np.ndarray):
    """Per text: tokens, what is known without a join, and what is not: the kind (word 0,
    window 1), name and number of the others."""
    logs = np.log10(common_counts + 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for data, starts in text_blocks(batch.column(1)):
                n = len(starts) - 1
                words, at = word_hashes(data, starts)
                text = np.repeat(np.arange(n), np.diff(at))
                row, known = _find(common, words)
                n_known = np.bincount(text[known], minlength=n)
                base = np.bincount(text[known], logs[row[known]], minlength=n) if len(logs) else np.zeros(n)
                stream, begin = symbols(data, starts)
                places, owner = _scored_places(begin)
                distinct, which = np.unique(windows(stream)[places], return_inverse=True)
                row, sure = _find(likely, distinct)
                value = np.where(sure, chance[row], 0.0) if len(chance) else np.zeros(len(distinct))
                score = np.bincount(owner, value[which], minlength=n)
                open_ = ~sure[which]
                owners = np.concatenate([text[~known], owner[open_]])
                rare = np.concatenate([words[~known], distinct[which[open_]]])
                kind = np.ones(len(rare), np.int8)
                kind[: len(rare) - int(open_.sum())] = 0
                order = np.lexsort((rare, kind, owners))
                owners, rare, kind = owners[order], rare[order], kind[order]
                new = np.ones(len(rare), bool)
                new[1:] = (rare[1:] != rare[:-1]) | (kind[1:] != kind[:-1]) | (owners[1:] != owners[:-1])
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(rare)))
                ends = pa.array(np.searchsorted(owners[first], np.arange(n + 1)).astype(np.int32))
                lists = [
                    pa.ListArray.from_arrays(ends, pa.array(v))
                    for v in (kind[first], rare[first].view(np.int64), times.astype(np.int32))
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(done, n),
                        pa.array(np.diff(at) + 1, pa.int64()),
                        pa.array(n_known, pa.int64()),
                        pa.array(base, pa.float64()),
                        pa.array(score, pa.float64()),
                        *lists,
                    ],
                    names=["doc_id", "n_tokens", "n_known", "base", "score", "kind", "rare", "times"],
                )
                done += n

    return run


def _sorted(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """A small table of (name, value), by unsigned name."""
    found = table.toArrow()
    names = np.asarray(found.column(0)).astype(np.int64).view(np.uint64)
    order = np.argsort(names)
    return names[order], np.asarray(found.column(1))[order]


def language_scores(
    docs: DataFrame, train: Column, id: str = "doc_id", text: str = "text", least: int = LEAST
) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    ``train`` is a condition on the column ``id``. The base score is that of words with
    add-one smoothing; ``score`` is the tree's log10 probability of the whole text. Null
    and empty texts have one token, the end. Rows without an id are scored and never
    trained on; rows of one id are each scored by their own text. Without training texts
    every symbol has probability 1/256 and nothing is known.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    learned = docs.select(
        F.col(text).alias("text"), (F.col(id).isNotNull() & F.coalesce(train, F.lit(False))).alias("learned")
    )
    parts = learned.mapInArrow(_count, "kind int, name bigint, n bigint, every bigint")
    sums = F.sum("n").alias("n"), F.sum("every").alias("every")
    counted = stored(parts.groupBy("kind", "name").agg(*sums), "counts")
    words = counted.filter("kind = 0").select("name", "n")
    tokens, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("n")).first()
    seen = counted.filter("kind = 1").agg(F.coalesce(F.sum("every"), F.lit(0))).first()[0]
    chances = states(counted.filter("kind = 1"), least)

    # both are bounded by the inverse of a share, whatever the corpus
    frequent, likely = F.col("n") >= COMMON_SHARE * tokens, F.col("every") >= COMMON_WINDOWS * seen
    value = F.log10("p").alias("value")
    common = _sorted(words.filter(frequent))
    table = spark.sparkContext.broadcast((*common, *_sorted(chances.filter(likely).select("pair", value))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _scored(*table.value)(batches)

    id_type = docs.schema[id].dataType.simpleString()
    shape = (
        f"doc_id {id_type}, n_tokens bigint, n_known bigint, base double, score double, "
        "kind array<tinyint>, rare array<bigint>, times array<int>"
    )
    scored = rows.mapInArrow(run, shape).withColumn("row", F.monotonically_increasing_id())
    scored = stored(scored, "scored")
    asked = scored.select("row", F.explode(F.arrays_zip("kind", "rare", "times")).alias("w"))
    asked = asked.select("row", "w.kind", F.col("w.rare").alias("name"), "w.times")
    zero = F.lit(0)
    others = (
        words.filter(~frequent)
        .select(zero.cast("tinyint").alias("kind"), "name", F.log10(F.col("n") + 1.0).alias("value"))
        .unionByName(
            chances.filter(~likely).select(F.lit(1).cast("tinyint").alias("kind"), F.col("pair").alias("name"), value)
        )
    )
    joined = asked.join(others, ["kind", "name"])
    word, gained = F.col("kind") == 0, F.col("times") * F.col("value")
    more = joined.groupBy("row").agg(
        F.sum(F.when(word, F.col("times"))).alias("more_known"),
        F.sum(F.when(word, gained)).alias("more_base"),
        F.sum(F.when(~word, gained)).alias("more_score"),
    )
    end = words.filter(F.col("name") == END_WORD).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    floor = math.log10(tokens + distinct + 1)
    nothing = F.lit(0.0)
    return (
        scored.drop("kind", "rare", "times")
        .join(more, "row", "left")
        .select(
            "doc_id",
            "n_tokens",
            (F.col("n_known") + F.coalesce("more_known", zero) + (1 if end else 0)).alias("n_known"),
            F.lit(tokens).cast("bigint").alias("train_tokens"),
            (
                F.col("base") + F.coalesce("more_base", nothing) + math.log10(end + 1) - F.col("n_tokens") * floor
            ).alias("base_score"),
            (F.col("score") + F.coalesce("more_score", nothing)).alias("score"),
        )
    )


def held_out_scores(docs: DataFrame) -> DataFrame:
    """Scores with ``held_out``; learns from rows whose fold of 7 is not 2."""
    scored = language_scores(docs, fold(F.col("doc_id"), 7) != 2)
    return scored.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), 7) == 2, F.lit(False)).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
    )
