"""Toxicity: a counterfactually regularised classifier of words.

A logistic model over which words, and which beginnings of words, a text has. Beside the log loss, fitting penalises how
far the logit moves when identity terms of a labelled text are swapped for others of
their kind, so a group's mere mention, which labels often go with, gains no weight that
another group's mention has not. Identity terms count as whole words only: with features
for their beginnings a swap would change but a part of what a mention adds. An L1 term, scaled to what chance would give a word of
the same frequency, leaves out words without a provable bearing on the label; the words
that remain are fitted again without it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseledger.llm.scoring import append_score, fold, free_name, labelled_sample
from caseledger.llm.words import PUNCTUATION, distinct, in_parts, stem_hashes, text_bytes, word_hashes
from caseledger.storage import discard, stored

SAMPLE = 16_000  # labelled rows that are fitted at most
THRESHOLD = 0.3
LEAST_TEXTS = 4  # texts of the sample that a word must be in
SCREEN = 3.0  # standard deviations that a word's bearing by itself must exceed
CHANCE = 2.0  # and those of its bearing beside the other words
PAIRING = 1.0  # weight of the counterfactual penalty
RIDGE = 3e-4
STEMS = (7, 8)  # bytes of a word's beginning that count like words

# Identity terms by kind, of English, German, French and Spanish (the default of a
# parameter); a swap puts the next of its kind in a term's place.
IDENTITY = (
    ("women", "men"),
    ("woman", "man"),
    ("female", "male"),
    ("girls", "boys"),
    ("girl", "boy"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("asians", "latinos", "africans", "europeans"),
    ("immigrant", "native", "refugee"),
    ("immigrants", "natives", "refugees"),
    ("old", "young"),
    ("disabled", "blind", "deaf"),
    ("frauen", "männer"),
    ("frau", "mann"),
    ("muslime", "christen", "juden"),
    ("einwanderer", "einheimische", "flüchtlinge"),
    ("femmes", "hommes"),
    ("femme", "homme"),
    ("musulmans", "chrétiens", "juifs"),
    ("immigrés", "réfugiés"),
    ("mujeres", "hombres"),
    ("mujer", "hombre"),
    ("musulmanes", "cristianos", "judíos"),
    ("inmigrantes", "refugiados"),
)


def short(hashes: np.ndarray) -> np.ndarray:
    """The first 32 bits of a hash are enough to name a feature."""
    return (hashes >> np.uint64(32)).astype(np.uint32)


def hashes_of(terms: list[str]) -> np.ndarray:
    data, starts = text_bytes(pa.array(terms))
    return short(word_hashes(data, starts, PUNCTUATION)[0])


def _swaps(identity: tuple[tuple[str, ...], ...]) -> dict[int, int]:
    out = {}
    for kind in identity:
        own = hashes_of(list(kind)).tolist()
        out |= dict(zip(own, [*own[1:], own[0]], strict=True))
    return out


def _features(texts: pa.Array, terms: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of words and of their beginnings, 0 for those of identity terms."""
    data, starts = text_bytes(texts)
    kinds, at = stem_hashes(data, starts, PUNCTUATION, STEMS)
    maybe = np.zeros(1 << 16, bool)
    maybe[terms >> np.uint32(16)] = True
    places = np.flatnonzero(maybe[(kinds[0] >> np.uint64(48)).astype(np.int64)])
    places = places[np.isin(short(kinds[0][places]), terms)]
    for stems in kinds[1:]:
        stems[places] = 0
    return kinds, at


def _words_of(batches: Iterator[pa.RecordBatch], terms: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, label, texts in _aligned(batch):
            kinds, at = _features(texts, terms)
            lists = []
            for a, b in zip(at[:-1], at[1:], strict=True):
                own = distinct(np.concatenate([k[a:b] for k in kinds]))
                lists.append(distinct(short(own[own != 0])).view(np.int32))
            yield pa.RecordBatch.from_arrays(
                [key, label, pa.array(lists, pa.list_(pa.int32()))], names=["key", "label", "words"]
            )


def _aligned(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.Array, pa.Array]]:
    at = 0
    for texts in in_parts(batch.column(2)):
        yield batch.column(0).slice(at, len(texts)), batch.column(1).slice(at, len(texts)), texts
        at += len(texts)


@dataclass(frozen=True)
class Model:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float
    terms: np.ndarray  # identity terms, of which no beginnings count

    def score(self, texts: pa.Array) -> np.ndarray:
        """Probability of label 1; a text without a known word has that of the bias."""
        out = []
        seen = np.zeros(1 << 16, bool)  # by the first bits of a hash: may it be known?
        seen[self.words >> np.uint32(16)] = True
        for part in in_parts(texts):
            kinds, at = _features(part, self.terms)
            pairs = []
            for words in kinds:
                places = np.flatnonzero(seen[(words >> np.uint64(48)).astype(np.int64)])
                found = short(words[places])
                row = np.minimum(np.searchsorted(self.words, found), max(0, len(self.words) - 1))
                known = self.words[row] == found if len(self.words) else np.zeros(0, bool)
                text = np.searchsorted(at, places[known], "right") - 1
                pairs.append(text * max(1, len(self.words)) + row[known])
            both = np.unique(np.concatenate(pairs))  # a word counts once
            text, word = np.divmod(both, max(1, len(self.words)))
            logit = self.bias + np.bincount(text, self.weights[word], minlength=len(part))
            out.append(1 / (1 + np.exp(-logit)))
        return np.concatenate(out) if out else np.zeros(0)


class _Rows:
    """Sparse 0/1 rows with a weight per entry of -1 or 1 (for differences)."""

    def __init__(self, row: np.ndarray, col: np.ndarray, val: np.ndarray, n: int, m: int) -> None:
        self.row, self.col, self.val, self.n, self.m = row, col, val, n, m

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col] * self.val, minlength=self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, r[self.row] * self.val, minlength=self.m)

    def only(self, keep: np.ndarray) -> _Rows:
        place = np.cumsum(keep) - 1
        e = keep[self.col]
        return _Rows(self.row[e], place[self.col[e]], self.val[e], self.n, int(keep.sum()))


def _descend(x: _Rows, y: np.ndarray, swap: _Rows, l1: np.ndarray, steps: int, pairing: float) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient on log loss, ridge, L1 and the counterfactual penalty."""
    n = max(1, x.n)
    w, bias = np.zeros(x.m), 0.0
    v, c, t = w.copy(), 0.0, 1.0
    probe = np.ones(x.m) / max(1.0, np.sqrt(x.m))
    top = 1.0
    for _ in range(12):  # largest curvature, by power iteration
        probe = x.back(x.dot(probe)) / (4 * n) + 2 * pairing * swap.back(swap.dot(probe)) / n
        top = float(np.linalg.norm(probe)) or 1.0
        probe = probe / top
    step = 1 / (1.3 * top + 0.25 + RIDGE)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x.dot(v) + c)))
        grad = x.back(p - y) / n + RIDGE * v + 2 * pairing * swap.back(swap.dot(v)) / n
        new = v - step * grad
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        new_bias = c - step * float((p - y).mean()) if x.n else 0.0
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / after * (new - w), new_bias + (t - 1) / after * (new_bias - bias)
        w, bias, t = new, new_bias, after
    return w, bias


def fit_words(
    labels: list[int],
    words: list[np.ndarray],
    identity: tuple[tuple[str, ...], ...] = IDENTITY,
    pairing: float = PAIRING,
) -> Model:
    """Fit on texts given as their distinct word hashes. Without texts, all score 0.5.

    Texts of equal words and label count once, so copies prove nothing.
    """
    once = {(y, hash(w.tobytes())): w for y, w in zip(labels, words, strict=True)}
    return _fitted([label for label, _ in once], list(once.values()), identity, pairing)


def _fitted(
    labels: list[int], words: list[np.ndarray], identity: tuple[tuple[str, ...], ...], pairing: float, screened: bool = False
) -> Model:
    """The fit on texts no two of which are equal; if ``screened``, words without bearing may be left out."""
    y = np.array(labels, float)
    n = len(y)
    swaps = _swaps(identity)
    terms = np.array(sorted(swaps), np.uint32)
    if not n:
        return Model(np.zeros(0, np.uint32), np.zeros(0), 0.0, terms)
    flat = np.concatenate([*words, np.zeros(0, np.uint32)]).astype(np.uint32)
    row = np.repeat(np.arange(n, dtype=np.int32), [len(x) for x in words])
    names, texts = np.unique(flat, return_counts=True)
    vocabulary = np.union1d(names[(texts >= LEAST_TEXTS) & (texts < n)], np.intersect1d(terms, names))
    m = len(vocabulary)
    if not m and not screened:
        rate = min(max(float(y.mean()), 1e-6), 1 - 1e-6)
        return Model(vocabulary, np.zeros(0), float(np.log(rate / (1 - rate))), terms)
    col = np.minimum(np.searchsorted(vocabulary, flat), m - 1).astype(np.int32)
    kept = vocabulary[col] == flat
    x = _Rows(row[kept], col[kept], np.ones(int(kept.sum()), np.float32), n, m)
    rate = y.mean() * (1 - y.mean())
    df = np.bincount(x.col, minlength=m)
    bearing = np.abs(x.back(y - y.mean())) >= SCREEN * np.sqrt(rate * df)
    bearing |= np.isin(vocabulary, terms)
    x, vocabulary, df = x.only(bearing), vocabulary[bearing], df[bearing]
    m = len(vocabulary)
    # the difference between each text and its counterfactual
    index = {int(h): k for k, h in enumerate(vocabulary)}
    is_term = np.isin(flat, terms)
    moved = [(r, h) for r, h in zip(row[is_term].tolist(), flat[is_term].tolist(), strict=True)]
    entries = [(r, index[h], 1.0) for r, h in moved] + [
        (r, index[swaps[h]], -1.0) for r, h in moved if swaps[h] in index
    ]
    r, c, e = (np.array(a) for a in zip(*entries, strict=True)) if entries else (np.zeros(0, int),) * 3
    swap = _Rows(r.astype(int), c.astype(int), e.astype(float), n, m)
    chance = CHANCE * np.sqrt(rate * df / n / n)
    first, _ = _descend(x, y, swap, chance, 250, pairing)
    keep = first != 0
    weights, bias = _descend(x.only(keep), y, swap.only(keep), np.zeros(int(keep.sum())), 400, pairing)
    return Model(vocabulary[keep], weights, bias, terms)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    train: Column,
    id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    sample: int = SAMPLE,
    identity: tuple[tuple[str, ...], ...] = IDENTITY,
    pairing: float = PAIRING,
) -> Model:
    """Fit on at most ``sample`` labelled texts of the fold ``train``, a condition on ``_id``.

    Words are counted and screened on the executors; of each text only the hashes of those
    with a bearing, and of identity terms, reach the driver.
    """
    rows = labelled_sample(docs, labels, id, text, label, sample, train)
    rows = rows.select(F.xxhash64("_id").alias("key"), F.col("_label").alias("label"), "_text")
    terms = np.array(sorted(_swaps(identity)), np.uint32)
    found = rows.mapInArrow(lambda batches: _words_of(batches, terms), "key bigint, label int, words array<int>")
    once = stored(found.groupBy("label", "words").agg(F.min("key").alias("key")), "words")
    known, any_word = _screened(once, terms)
    texts = once.select("key", "label", "words").mapInArrow(
        lambda batches: _only(batches, known), "key bigint, label int, words array<int>"
    )
    texts = texts.toArrow().sort_by("key")
    discard(once)
    lists = texts.column("words").combine_chunks()
    ends, values = np.asarray(lists.offsets), np.asarray(lists.values).view(np.uint32)
    words = [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return _fitted(texts.column("label").to_pylist(), words, identity, pairing, any_word)


def _screened(once: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, bool]:
    """Words in enough texts whose bearing may pass the screen, and identity terms; whether any is in enough texts.

    The fit screens again: the margin here is for its rounding.
    """
    n, positive = once.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    mean = positive / max(1, n)
    held, of_ones = F.col("texts"), F.col("ones")
    counted = once.select("label", F.explode("words").alias("word")).groupBy("word")
    counted = counted.agg(F.count(F.lit(1)).alias("texts"), F.sum("label").alias("ones"))
    term = F.col("word").isin(terms.view(np.int32).tolist())
    counted = counted.filter(((held >= LEAST_TEXTS) & (held < n)) | term)
    least = SCREEN * F.sqrt(mean * (1 - mean) * held) * (1 - 1e-6) - 1e-6
    known = counted.filter((F.abs(of_ones - held * mean) >= least) | term).select("word").toArrow()
    known = np.sort(np.asarray(known.column("word").combine_chunks()))
    return known, bool(len(known)) or not counted.isEmpty()


def _only(batches: Iterator[pa.RecordBatch], known: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(2)
        ends, values = np.asarray(lists.offsets), np.asarray(lists.values)
        here = np.isin(values[ends[0] : ends[-1]], known)
        after = np.concatenate([[0], np.cumsum(here)])[ends - ends[0]].astype(np.int32)
        kept = pa.ListArray.from_arrays(pa.array(after), pa.array(values[ends[0] : ends[-1]][here], pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), kept], names=["key", "label", "words"])


def with_score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """All rows and columns and the probability of being toxic; null texts count as empty."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    return append_score(docs, text, name, lambda texts: shipped.value.score(texts))


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted``; learns from rows whose fold of 4 is not 2.

    Rows without an id are scored too; they have no label and are not held out.
    """
    model = fit(docs, labels, fold(F.col("_id"), 4) != 2)
    rows = docs.select("doc_id", "text")
    scored = with_score(rows, model)
    return scored.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score under the threshold, with their columns.

    Learns from the same fold as ``classified``.
    """
    model = fit(docs, labels, fold(F.col("_id"), 4) != 2, id, text)
    name = free_name(docs, "_toxicity")
    return with_score(docs, model, text, name).filter(F.col(name) < THRESHOLD).drop(name)
