"""Word and shingle hashes of whole Arrow text columns, computed on the UTF-8 bytes.

A word is a run of bytes other than ASCII white space (``[^\\x20\\x09-\\x0D]+``); A-Z
are lower-cased. Both rules touch ASCII bytes only, so they hold on UTF-8 as they do
on characters. Hashes have 64 bits; equal words have equal hashes in every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
# ASCII other than letters and digits; all bytes of other characters belong to words.
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[:128] = [not chr(b).isalnum() for b in range(128)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BLOCK = 1 << 18  # bytes that are hashed at once
_BASE = 0x9E3779B97F4A7C13  # 3 modulo 8, so that swapped letters keep 61 bits apart
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_PLACE = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_tables: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) < n:
        size = max(n, _BLOCK + (_BLOCK >> 2))
        _tables["up"], _tables["down"] = _powers(_BASE, size), _powers(_INVERSE, size)
    return _tables["up"], _tables["down"]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column one after the other, and where each text starts.

    The last entry of the second array is the end. Null counts as empty.
    """
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, starts, data = column.buffers()
    starts = np.frombuffer(starts, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[starts[0] : starts[-1]], starts - starts[0]


def word_spans(data: np.ndarray, starts: np.ndarray, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """First byte of every word, and the byte after its last."""
    inside = ~gaps[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = starts[(starts > 0) & (starts < len(data))]
    first[cut] |= inside[cut]
    last[cut - 1] |= inside[cut - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def blocks(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Blocks of about the block size that end at white space."""
    at = 0
    while at < len(data):
        end = at + _BLOCK
        while end < len(data):
            gap = np.flatnonzero(_SPACE[data[end : end + 4096]])
            if len(gap):
                end += int(gap[0])
                break
            end += 4096
        end = min(end, len(data))
        yield at, end
        at = end


def word_hashes(
    data: np.ndarray, starts: np.ndarray, gaps: np.ndarray = _SPACE
) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the number of words before each text (and in all).

    ``gaps`` tells which bytes are between words; white space always is.
    """
    found, at = stem_hashes(data, starts, gaps, ())
    return found[0], at


def stem_hashes(
    data: np.ndarray, starts: np.ndarray, gaps: np.ndarray, cuts: tuple[int, ...]
) -> tuple[list[np.ndarray], np.ndarray]:
    """As ``word_hashes``, and for each of ``cuts`` that of the words' first so many bytes.

    A word that is not longer than the cut has 0 there.
    """
    hashes: list[list[np.ndarray]] = [[] for _ in range(len(cuts) + 1)]
    begins = []
    for a, b in blocks(data):
        part = data[a:b]
        lo, hi = np.searchsorted(starts, [a, b], "left")
        first, last = word_spans(part, starts[lo:hi] - a, gaps)
        up, down = _power_tables(len(part))
        total = np.cumsum(_LETTER[_LOWER[part]] * up[: len(part)], dtype=np.uint64)
        before = np.where(first > 0, total[np.maximum(first, 1) - 1], np.uint64(0))
        shift = down[first]
        hashes[0].append(mix((total[last - 1] - before) * shift))
        for k, cut in enumerate(cuts, 1):
            stem = mix((total[np.minimum(first + cut, last) - 1] - before) * shift + np.uint64(cut))
            hashes[k].append(np.where(last - first > cut, stem, np.uint64(0)))
        begins.append(first + a)
    if not begins:
        return [np.zeros(0, np.uint64) for _ in hashes], np.zeros(len(starts), np.int64)
    return [np.concatenate(h) for h in hashes], np.searchsorted(np.concatenate(begins), starts)


def sequence_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words, one for every place where a run may start."""
    return pattern_hash(words, tuple(range(n)))


def pattern_hash(words: np.ndarray, places: tuple[int, ...]) -> np.ndarray:
    """Hash of the words at some places after each place where such a pattern may start."""
    m = len(words) - places[-1]
    if m <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(m, len(places), np.uint64)
    for i in places:
        total += words[i : i + m] * _PLACE[i % 64]
    return mix(total)


def whole_hash(words: np.ndarray) -> np.uint64:
    """Hash of a text of fewer words than a shingle has; never that of a full shingle."""
    total = np.uint64(len(words))
    with np.errstate(over="ignore"):
        for i, w in enumerate(words):
            total += w * _PLACE[i % 64]
    return mix(np.array([total], np.uint64))[0]


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the word ``n``-shingles of each text.

    A text of fewer words has one shingle, the whole sequence; one without words none.
    """
    for part in in_parts(column):
        data, starts = text_bytes(part)
        words, at = word_hashes(data, starts)
        runs = sequence_hash(words, n)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= n:
                yield distinct(runs[a : b - n + 1])
            elif b > a:
                yield np.array([whole_hash(words[a:b])], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def distinct(values: np.ndarray) -> np.ndarray:
    out = np.sort(values)
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    return out[keep]


def in_parts(column: pa.Array, most: int = 4 * _BLOCK) -> Iterator[pa.Array]:
    """Slices of a column of about ``most`` bytes; a longer text is a slice of its own."""
    if not len(column):
        return
    sizes = np.asarray(pa.compute.binary_length(column).fill_null(0)).astype(np.int64)
    group = np.cumsum(sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(column)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield column.slice(a, b - a)
