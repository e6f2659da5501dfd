"""BPE encoding and decoding as streaming transducers.

Encoding reads a vocabulary file of the word-end kind (merges in order, ``</w>`` at the
end of a word) and emits a token as soon as no later text can change it. How much later
text that takes is computed from the merge list:

*Sufficient lookahead.* Compare the merges of one prefix under two continuations. The
place where they differ moves left only when, in one of the two, a rule (a, b) merges the
token ``a`` just before that place with a ``b`` that begins there; it moves by the length
of ``a``, and from then on ``a`` begins there. The next such rule (a', b') comes later in
the list and its ``b'`` begins with ``a``. So the way to the left is at most the heaviest
chain of rules, in list order, in which each rule's ``b`` has the one before's ``a`` on
its left edge, weighed by the length of ``a``. One pass over the list finds it. A token
that ends further than that from the last symbol known (whose form depends on whether
the word goes on) is final, and encoding may start afresh behind it, as no merge crosses
a final boundary.

Words of ordinary length are shorter than that window and are final at their end; they
are looked up in a bounded table of words seen before. Longer ones pass through the
window. Decoding maps tokens to bytes and bytes to text by an incremental UTF-8 state
machine that holds an unfinished character only.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS_KEPT = 250_000  # entries of a worker's table of words; it is cleared when full
_PIECE = 1 << 16  # characters that are normalised and cut into words at once
_SHORT = 48  # symbols up to which scanning all pairs beats a heap

# What the vocabulary's regular expressions take for white space (fixed values).
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_GAP = regex.compile("[\\t-\\r ]")


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in plain}
    rest = (b for b in range(256) if b not in letters)
    letters |= {b: chr(256 + k) for k, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


class Vocabulary:
    """Merges, ids, special tokens and the word pattern of a vocabulary file."""

    def __init__(self, data: str) -> None:
        spec = json.loads(data)
        model = spec["model"]
        self.suffix: str = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {pair: k for k, pair in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        splits = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        pattern = splits[0]["pattern"]["Regex"].replace("\\s", _WHITE)
        self.word = regex.compile(pattern)
        # the same pattern for text of ASCII characters, for the faster standard engine
        plain = pattern.replace("\\p{L}", "a-zA-Z").replace("\\p{N}", "0-9")
        self.plain_word = self.word if "\\p" in plain else re.compile(plain)
        self.letters = _byte_letters()
        self.byte = {c: b for b, c in enumerate(self.letters)}
        self.bytes_of = {i: self._bytes(t) for i, t in self.token.items()}
        self.longest = max(map(len, self.ids))
        self.lookahead = self._lookahead(pairs)

    def _bytes(self, token: str) -> tuple[bytes, bool, str]:
        """A token's bytes, whether it ends a word, and its name if it is a special one."""
        if token in self.special:
            return b"", True, token
        data = bytes(self.byte[c] for c in token.removesuffix(self.suffix))
        return data, token.endswith(self.suffix), ""

    def cut(self, text: str) -> list[str]:
        """The words of a normalised piece of text."""
        return (self.plain_word if text.isascii() else self.word).findall(text)

    def _size(self, token: str) -> int:
        return len(token.removesuffix(self.suffix))

    def _lookahead(self, pairs: list[tuple[str, str]]) -> int:
        left: dict[str, str] = {}  # what a merged token begins with
        chain: dict[str, int] = {}  # the heaviest chain so far that ends in a rule with this a
        most = 0
        for a, b in pairs:
            if a + b in left or any(self._size(x) > 1 and x not in left for x in (a, b)):
                raise ValueError("each token of the merge list must be made once, before it is used")
            edge: str | None = b
            before = 0
            while edge is not None:
                before = max(before, chain.get(edge, 0))
                edge = left.get(edge)
            weight = self._size(a) + before
            chain[a] = max(chain.get(a, 0), weight)
            most = max(most, weight)
            left[a + b] = a
        return most + 1

    def merge(self, symbols: list[str]) -> list[str]:
        """All merges of a list of symbols: the lowest rank first, from the left."""
        return self._merge_short(symbols) if len(symbols) <= _SHORT else self._merge_long(symbols)

    def _merge_short(self, symbols: list[str]) -> list[str]:
        rank, none = self.rank, len(self.rank)
        while len(symbols) > 1:
            ranks = [rank.get(pair, none) for pair in zip(symbols, symbols[1:])]  # noqa: B905
            low = min(ranks)
            if low == none:
                break
            i = ranks.index(low)
            symbols = [*symbols[:i], symbols[i] + symbols[i + 1], *symbols[i + 2 :]]
        return symbols

    def _merge_long(self, symbols: list[str]) -> list[str]:
        n = len(symbols)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        sym: list[str | None] = list(symbols)
        heap = [(r, i) for i in range(n - 1) if (r := self.rank.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if sym[i] is None or j < 0 or self.rank.get((sym[i], sym[j])) != r:
                continue
            sym[i], sym[j] = sym[i] + sym[j], None
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if (q := self.rank.get((sym[i], sym[after[i]]))) is not None:
                    heapq.heappush(heap, (q, i))
            if (k := before[i]) >= 0 and (q := self.rank.get((sym[k], sym[i]))) is not None:
                heapq.heappush(heap, (q, k))
        return [s for s in sym if s is not None]


class Encoder:
    """Bytes of one word in, tokens out; holds a window of constant size."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.held: list[str] = []
        self.room = 4 * (vocabulary.lookahead + vocabulary.longest)

    def push(self, data: bytes) -> Iterator[str]:
        letters, at = self.v.letters, 0
        while at < len(data):
            free = self.room - len(self.held)
            self.held += [letters[b] for b in data[at : at + free]]
            at += free
            if len(self.held) >= self.room:
                yield from self._stable()

    def _stable(self) -> Iterator[str]:
        """Tokens of the held symbols that no continuation can change."""
        limit, at = len(self.held) - self.v.lookahead, 0
        for token in self.v.merge(self.held):
            if at + len(token) > limit:
                break
            at += len(token)
            yield token
        del self.held[:at]

    def whole(self, data: bytes) -> list[str]:
        """A word that is known to its end."""
        symbols = [self.v.letters[b] for b in data]
        symbols[-1] += self.v.suffix
        return self.v.merge(symbols)

    def end(self) -> list[str]:
        if not self.held:
            return []
        out = self.v.merge([*self.held[:-1], self.held[-1] + self.v.suffix])
        self.held = []
        return out


class Decoder:
    """Token ids in, readable text out; holds the bytes of an unfinished character at most."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, token: int) -> str:
        data, ends, special = self.v.bytes_of[token]
        if special:
            return self.state.decode(b"", True) + special + " "
        return self.state.decode(data, True) + " " if ends else self.state.decode(data)

    def end(self) -> str:
        return self.state.decode(b"", True)


class Codec:
    """Encodes and decodes whole texts, piece by piece."""

    def __init__(self, vocabulary: Vocabulary, kept: int = WORDS_KEPT) -> None:
        self.v, self.kept = vocabulary, kept
        self.words: dict[str, tuple[bytes, str]] = {}
        self.encoder, self.decoder = Encoder(vocabulary), Decoder(vocabulary)
        names = sorted(vocabulary.special, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None

    def pieces(self, text: str) -> Iterator[str]:
        """Special tokens by themselves, and between them normalised text, cut at white space."""
        parts = self.marks.split(text) if self.marks and any(m in text for m in self.v.special) else [text]
        for k, part in enumerate(parts):
            if k % 2:
                yield part
                continue
            at = 0
            while at < len(part):
                end = at + _PIECE
                if end < len(part):
                    gap = _GAP.search(part, end)
                    end = gap.start() if gap else len(part)
                yield self.normal(part[at:end])
                at = end

    @staticmethod
    def normal(text: str) -> str:
        """NFC, then lower case letter by letter (a final sigma is no special case)."""
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("\u03a3", "\u03c3")
        return text.lower()

    def known(self, word: str) -> tuple[bytes, str, str]:
        """Ids of a word as little-endian 32-bit integers, and what decoding these gives:
        their names, and the readable text.

        A word whose bytes do not come back is an error.
        """
        found = self.words.get(word)
        if found is None:
            data = word.encode("utf-8")
            if len(data) <= _SHORT:  # final at its end
                tokens = self.encoder.whole(data)
            else:
                tokens = [*self.encoder.push(data), *self.encoder.end()]
            ids = [self.v.ids[t] for t in tokens]
            # at a word's end the decoder is back in its first state
            text = "".join([self.decoder.push(i) for i in ids])
            if text != word + " ":
                raise ValueError(f"{word!r} does not decode to itself")
            found = (struct.pack(f"<{len(ids)}I", *ids), self.names(ids), text)
            if len(word) <= 64:
                if len(self.words) >= self.kept:
                    self.words.clear()
                self.words[word] = found
        return found

    def _runs(self, text: str) -> Iterator[list[tuple[bytes, str, str]]]:
        """For each piece of the text its words' (or special token's) ids and what they decode to."""
        get, known = self.words.get, self.known
        for piece in self.pieces(text):
            if piece in self.v.special:
                token = self.v.special[piece]
                yield [(np.array([token], "<u4").tobytes(), self.names([token]), self.decoder.push(token))]
            else:
                yield [get(word) or known(word) for word in self.v.cut(piece)]

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join([r[0] for runs in self._runs(text) for r in runs]), "<u4")

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """Readable text: words in their normal form, a blank after each."""
        decoder = Decoder(self.v)
        return "".join([decoder.push(int(i)) for i in ids]) + decoder.end()

    def names(self, ids: np.ndarray | list[int]) -> str:
        """Tokens joined by blanks: what a vocabulary file without a decoder decodes to."""
        return " ".join([self.v.token[int(i)] for i in ids])

    def digests(self, text: str, with_ids: bool) -> tuple[bytes, int, str, str, str]:
        """The ids if asked for, their number, and three digests that grow piece by piece."""
        ids, names, plain = hashlib.sha256(), hashlib.sha256(), hashlib.sha256()
        kept, n, blank = [], 0, ""
        for runs in self._runs(text):
            if runs:
                data = b"".join([r[0] for r in runs])
                ids.update(data)
                n += len(data) // 4
                names.update((blank + " ".join([r[1] for r in runs])).encode())
                plain.update("".join([r[2] for r in runs]).encode())
                blank = " "
                if with_ids:
                    kept.append(data)
        return b"".join(kept), n, ids.hexdigest(), names.hexdigest(), plain.hexdigest()


_codecs: dict[str, Codec] = {}


def codec(data: str, kept: int = WORDS_KEPT) -> Codec:
    """The codec of a vocabulary file's content; each worker builds it once."""
    key = f"{hashlib.sha256(data.encode()).hexdigest()} {kept}"
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(Vocabulary(data), kept)
    return _codecs[key]


def vocabulary_file(path: str | None = None) -> str:
    """Content of a vocabulary file; by default the public word-end BPE of 49k tokens."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return Path(path).read_text(encoding="utf-8")


def encode(docs: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``doc_id, ids`` of every row; null and empty texts have an empty list."""
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary_file(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shipped.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                lists = [own.encode(t or "").astype(np.int32) for t in part.column(1).to_pylist()]
                ends = pa.array(np.cumsum([0, *map(len, lists)], dtype=np.int32))
                values = pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(ends, values)], names=["doc_id", "ids"]
                )

    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, id: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """``doc_id, text`` in normal form; a null list gives a null text."""
    shipped = encoded.sparkSession.sparkContext.broadcast(vocabulary_file(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shipped.value)
        for batch in batches:
            texts = [None if x is None else own.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = encoded.schema[id].dataType.simpleString()
    rows = encoded.select(F.col(id).alias("doc_id"), F.col(ids).alias("ids"))
    return rows.mapInArrow(run, f"doc_id {kind}, text string")


def round_trip(
    docs: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None, with_ids: bool = False,
    kept: int = WORDS_KEPT,
) -> DataFrame:
    """Digests of every row's ids, of the tokens' names joined by blanks (which is what
    the vocabulary file, having no decoder, decodes to) and of the readable text.

    One pass without a shuffle. Null texts are empty: no tokens, the digest of nothing.
    Ids are handed through, null and repeated ones too. ``with_ids`` adds the token ids
    as little-endian unsigned 32-bit integers. ``kept`` bounds each worker's table of words:
    a smaller one takes less memory and more time, the result is the same.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary_file(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shipped.value, kept)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                found = [own.digests(t or "", with_ids) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([f[1] for f in found], pa.int64()),
                        *(pa.array([f[i] for f in found], pa.string()) for i in (2, 3, 4)),
                        *([pa.array([f[0] for f in found], pa.binary())] if with_ids else []),
                    ],
                    names=names,
                )

    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    shape = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, text_sha256 string"
    shape += ", ids binary" if with_ids else ""
    names = [column.split()[0] for column in shape.split(", ")]
    return rows.mapInArrow(run, shape)
