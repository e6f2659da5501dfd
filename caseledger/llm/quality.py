"""Quality classifier: gated attention over a text's passages (multiple-instance learning).

A text is a bag of passages of 64 words. Each passage is described by shares of kinds of
bytes and words and encoded by a tanh layer; a gated attention layer (tanh times sigmoid)
weighs the passages, and a logistic layer scores the weighted sum. All weights are
learned from labels of whole texts, so a few telling passages can decide for a long one.

The fit runs on the executors: the sample is cut by a hash of the ids into ``SHARDS`` parts,
each takes the same steps from common weights, and the driver averages weights and moments,
some 2,000 numbers a part, after every round. The parts do not depend on partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseledger.llm.scoring import append_score, fold, free_name, labelled_sample
from caseledger.llm.words import blocks, in_parts, text_bytes, word_hashes, word_spans
from caseledger.storage import discard, stored

SAMPLE = 12_000  # labelled rows that are fitted at most
THRESHOLD = 0.5
PASSAGE = 64  # words
_HUGE = 8 << 20  # bytes of a text that is described block by block
_ENCODED, _GATE, _STEPS = 16, 8, 400
SHARDS = 8  # parts of the sample that are fitted beside each other
_ROUNDS = 10  # times that the parts' weights are averaged
_CHUNK = 1 << 15  # passages whose gradient is computed at once

_CLASSES = 12
_CLASS = np.full(256, 10, np.uint8)  # other ASCII signs
_CLASS[128:] = 11
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
for _k, _signs in enumerate((b" \t\r\x0b\x0c", b"\n", b".", b",", b"!?", b"|", b"'\"-()"), 3):
    _CLASS[list(_signs)] = _k
FEATURES = _CLASSES + 8


def describe(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage, and the number of passages before each text.

    A text without words is one passage of zeros.
    """
    n = len(starts) - 1
    first, last = word_spans(data, starts)
    words, at = word_hashes(data, starts)
    size = np.diff(at)
    held = np.maximum(1, -(-size // PASSAGE))
    before = np.concatenate([[0], np.cumsum(held)])
    m = int(before[-1])
    out = np.zeros((m, FEATURES))
    if len(words):
        text = np.repeat(np.arange(n), size)
        place = np.arange(len(words)) - at[text]
        passage = before[text] + place // PASSAGE
        # bytes of a passage: from its first word to the next passage's
        opening = np.flatnonzero(np.diff(passage, prepend=-1))
        ends = np.append(first[opening[1:]], len(data))
        ends = np.minimum(ends, starts[1:][text[opening]])
        length = np.maximum(1, ends - first[opening])
        which = passage[opening]
        kinds = _CLASS[data]
        for c in range(_CLASSES):
            seen = np.concatenate([[0], np.cumsum(kinds == c, dtype=np.int32)])
            out[which, c] = (seen[ends] - seen[first[opening]]) / length
        count = np.bincount(passage, minlength=m)
        some = np.maximum(1, count)
        share = lambda flags: np.bincount(passage[flags], minlength=m) / some
        again = np.zeros(len(words), bool)
        again[1:] = (words[1:] == words[:-1]) & (place[1:] > 0)
        k = _CLASSES
        out[:, k] = share(again)
        out[:, k + 1] = _distinct(passage, words, m) / some
        out[:, k + 2] = np.log1p(np.bincount(passage, last - first, minlength=m) / some)
        head, tail = _CLASS[data[first]], _CLASS[data[last - 1]]
        out[:, k + 3] = share(head == 1)
        out[:, k + 4] = share(tail >= 7)
        out[:, k + 5] = share((last - first == 1) & (tail >= 5))
        out[:, k + 6] = share(tail == 5)
        out[:, k + 7] = np.log1p(count) / 4
    return out, before


def _distinct(passage: np.ndarray, words: np.ndarray, m: int) -> np.ndarray:
    key = np.sort((passage.astype(np.uint64) << np.uint64(40)) | (words >> np.uint64(24)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=m)


def bags(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``describe`` for slices of a column, in order."""
    for part in in_parts(texts):
        data, starts = text_bytes(part)
        if len(part) > 1 or len(data) <= _HUGE:
            yield describe(data, starts)
            continue
        rows = [describe(data[a:b], np.array([0, b - a]))[0] for a, b in blocks(data)]
        yield np.concatenate(rows), np.array([0, sum(map(len, rows))])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    parts: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, before: np.ndarray) -> dict[str, np.ndarray]:
        """Everything the network computes for bags of standardised passages."""
        p, at = self.parts, before[:-1]
        h = np.tanh(x @ p["W"] + p["w"])
        t, s = np.tanh(h @ p["V"] + p["v"]), 1 / (1 + np.exp(-(h @ p["U"] + p["u"])))
        e = (t * s) @ p["a"]
        bag = np.repeat(np.arange(len(at)), np.diff(before))
        e = np.exp(e - np.maximum.reduceat(e, at)[bag])
        weight = e / np.add.reduceat(e, at)[bag]
        z = np.add.reduceat(h * weight[:, None], at, axis=0)
        logit = z @ p["c"] + p["b"][0]
        return {"h": h, "t": t, "s": s, "weight": weight, "z": z, "bag": bag, "p": 1 / (1 + np.exp(-logit))}

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def score(self, texts: pa.Array) -> np.ndarray:
        """Probability of label 1."""
        found = [self.forward(self.standard(x), before)["p"] for x, before in bags(texts)]
        return np.concatenate(found) if found else np.zeros(0)


_SHAPES = {
    "W": (FEATURES, _ENCODED), "w": (_ENCODED,), "V": (_ENCODED, _GATE), "v": (_GATE,),
    "U": (_ENCODED, _GATE), "u": (_GATE,), "a": (_GATE,), "c": (_ENCODED,), "b": (1,),
}
_ENDS = np.cumsum([int(np.prod(shape)) for shape in _SHAPES.values()])


def _parts(weights: np.ndarray) -> dict[str, np.ndarray]:
    cut = np.split(weights, _ENDS[:-1])
    return {k: part.reshape(shape) for (k, shape), part in zip(_SHAPES.items(), cut, strict=True)}


def _start() -> np.ndarray:
    """Weights, their first and their second moments; the same every time."""
    rng = np.random.default_rng(8)
    drawn = [
        rng.normal(0, shape[0] ** -0.5, shape) if k in "WVUac" else np.zeros(shape) for k, shape in _SHAPES.items()
    ]
    weights = np.concatenate([d.ravel() for d in drawn])
    return np.stack([weights, np.zeros_like(weights), np.zeros_like(weights)])


def gradient(weights: np.ndarray, x: np.ndarray, before: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Gradient of the summed log loss of bags of standardised passages."""
    p = _parts(weights)
    f = Model(np.zeros(FEATURES), np.ones(FEATURES), p).forward(x, before)
    dlogit = f["p"] - y
    h, weight, t, s = f["h"], f["weight"], f["t"], f["s"]
    dzb = (dlogit[:, None] * p["c"])[f["bag"]]
    toward = (dzb * h).sum(axis=1)
    mean = np.add.reduceat(toward * weight, before[:-1])[f["bag"]]
    de = weight * (toward - mean)
    dt, ds = de[:, None] * p["a"] * s * (1 - t * t), de[:, None] * p["a"] * t * s * (1 - s)
    dh = (dzb * weight[:, None] + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
    found = {
        "W": x.T @ dh, "w": dh.sum(axis=0), "V": h.T @ dt, "v": dt.sum(axis=0), "U": h.T @ ds, "u": ds.sum(axis=0),
        "a": (t * s).T @ de, "c": f["z"].T @ dlogit, "b": dlogit.sum(keepdims=True),
    }
    return np.concatenate([found[k].ravel() for k in _SHAPES])


def advance(
    state: np.ndarray, x: np.ndarray, sizes: np.ndarray, y: np.ndarray, steps: range, total: int = _STEPS
) -> np.ndarray:
    """``state`` after Adam's ``steps`` on the mean log loss of all bags.

    The gradient is summed over chunks of ``_CHUNK`` passages, or one longer bag.
    """
    before = np.concatenate([[0], np.cumsum(sizes)])
    chunk = before[:-1] // _CHUNK
    edges = np.concatenate([[0], np.flatnonzero(np.diff(chunk)) + 1, [len(sizes)]])
    w, m1, m2 = state.copy()
    for step in steps:
        g = 1e-4 * w
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            part = x[before[i] : before[j]].astype(float)
            g = g + gradient(w, part, before[i : j + 1] - before[i], y[i:j]) / len(y)
        m1 = 0.9 * m1 + 0.1 * g
        m2 = 0.999 * m2 + 0.001 * g * g
        rate = 0.02 * (1 - step / (total + 1)) + 0.001
        w = w - rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return np.stack([w, m1, m2])


def fit_bags(x: np.ndarray, sizes: np.ndarray, y: np.ndarray, steps: int = _STEPS) -> Model:
    """The fit of one part, in one piece."""
    scale = x.std(axis=0) if len(x) else np.ones(FEATURES)
    mean = x.mean(axis=0) if len(x) else np.zeros(FEATURES)
    model = Model(mean, np.where(scale > 1e-6, scale, 1.0), _parts(_start()[0]))
    if len(y):
        state = advance(_start(), model.standard(x), sizes, y, range(1, steps + 1), steps)
        model.parts = _parts(state[0])
    return model


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for x, before in bags(batch.column(3)):
            rows = [x[a:b].astype(np.float32).tobytes() for a, b in zip(before[:-1], before[1:], strict=True)]
            given = [batch.column(i).slice(at, len(rows)) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*given, pa.array(rows, pa.binary())], names=["shard", "key", "label", "bag"])
            at += len(rows)


def _read(bags: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passages, their number a text, and labels, in the order of the keys."""
    bags = bags.sort_by("key")
    raw = bags.column("bag").to_pylist()
    sizes = np.array([len(r) // (4 * FEATURES) for r in raw], int)
    return np.frombuffer(b"".join(raw), np.float32).reshape(-1, FEATURES), sizes, bags.column("label").to_numpy()


def _row(texts: int, numbers: np.ndarray) -> pa.Table:
    return pa.table({"texts": pa.array([texts], pa.int64()), "numbers": pa.array([numbers.tobytes()], pa.binary())})


def _each_shard(bags: DataFrame, shards: int, work: Callable[[pa.Table], pa.Table]) -> list[tuple[int, np.ndarray]]:
    """What ``work`` makes of each part: a count and an array of doubles, in a fixed order.

    Four times as many partitions as parts, so that few tasks get two of them.
    """

    def each(part: pa.Table) -> pa.Table:  # Spark reads the hints, which a partial does not have
        return work(part)

    split = bags.repartition(4 * shards, "shard").groupBy("shard")
    found = split.applyInArrow(each, "texts bigint, numbers binary").collect()
    return sorted(((r.texts, np.frombuffer(r.numbers)) for r in found), key=lambda r: (r[0], r[1].tobytes()))


def _advanced(
    bags: pa.Table, state: np.ndarray, mean: np.ndarray, scale: np.ndarray, steps: range
) -> pa.Table:
    x, sizes, y = _read(bags)
    x = Model(mean, scale, {}).standard(x).astype(np.float32)
    return _row(len(y), advance(state, x, sizes, y, steps))


def _moments(bags: pa.Table) -> pa.Table:
    x = _read(bags)[0].astype(float)
    return _row(bags.num_rows, np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)]))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    train: Column,
    id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    sample: int = SAMPLE,
    shards: int = SHARDS,
) -> Model:
    """Fit on at most ``sample`` labelled texts of the fold ``train``, a condition on ``_id``.

    Only weights and sums of features reach the driver. Without texts, all score alike.
    """
    rows = labelled_sample(docs, labels, id, text, label, sample, train)
    key = F.xxhash64("_id")
    rows = rows.select(
        F.pmod(F.xxhash64(key), F.lit(shards)).cast("int").alias("shard"), key.alias("key"), F.col("_label").alias("label"), "_text"
    )
    bags = stored(rows.mapInArrow(_passages, "shard int, key bigint, label int, bag binary"), "passages")
    model, state = Model(np.zeros(FEATURES), np.ones(FEATURES), {}), _start()
    sums = _each_shard(bags, shards, _moments)
    if sums:
        count, first, second = np.split(sum(numbers for _, numbers in sums), [1, 1 + FEATURES])
        model.mean = first / count
        scale = np.sqrt(np.maximum(second / count - model.mean**2, 0))
        model.scale = np.where(scale > 1e-6, scale, 1.0)
        for done in range(0, _STEPS, _STEPS // _ROUNDS):
            steps = range(done + 1, done + 1 + _STEPS // _ROUNDS)
            work = partial(_advanced, state=state, mean=model.mean, scale=model.scale, steps=steps)
            found = _each_shard(bags, shards, work)
            state = sum(n * numbers for n, numbers in found) / sum(n for n, _ in found)
            state = state.reshape(3, -1)
    discard(bags)
    model.parts = _parts(state[0])
    return model


def with_score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """All rows and columns and the probability of good quality; null texts count as empty."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    return append_score(docs, text, name, lambda texts: shipped.value.score(texts))


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted``; learns from rows whose fold of 3 is not 1.

    Rows without an id are scored too; they have no label and are not held out.
    """
    model = fit(docs, labels, fold(F.col("_id"), 3) != 1)
    scored = with_score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def good_only(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score at the threshold or above, with their columns.

    Learns from the same fold as ``classified``.
    """
    model = fit(docs, labels, fold(F.col("_id"), 3) != 1, id, text)
    name = free_name(docs, "_quality")
    return with_score(docs, model, text, name).filter(F.col(name) >= THRESHOLD).drop(name)
