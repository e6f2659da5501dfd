"""Token-id output: documents packed into rows of one length, as binary matrices.

Texts become token ids of a public byte-level BPE and end in one end id. A document
longer than a row is cut into rows and a rest, nothing is lost; what is left is packed
best fit decreasing: the longest first, each into the fullest row that has room. Which
remaining capacity is the smallest that fits is found in a segment tree over capacities.

Packing needs no order among documents, so each task packs what it scans, in blocks of
bounded size, and nothing is shuffled. A row's length is at most the block's, so at most
the last rows of a block stay partly empty.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseledger.llm.warc import SharedFile, opened
from caseledger.storage import new_folder, stored

ROW = 2_048  # tokens of a row
BLOCK = 4_000_000  # tokens that are packed together
_PIECE = 1 << 20  # characters that are encoded at once
# Between letter and blank-and-letter every piece of the pattern ends.
_CUT = re.compile(r"(?<=[^\W\d_]) (?=[^\W\d_])")


class Capacities:
    """Segment tree over remaining capacities 0..size; a leaf holds how many bins have it."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << size.bit_length()
        self.held = [0] * (2 * self.leaves)

    def add(self, capacity: int, change: int) -> None:
        node = self.leaves + capacity
        while node:
            self.held[node] += change
            node >>= 1

    def least_from(self, need: int) -> int:
        """The smallest capacity of a bin that is not below ``need``; -1 if there is none."""
        node = self.leaves + need
        if self.held[node]:
            return need
        while node > 1:  # up until something lies to the right
            if not node & 1 and self.held[node + 1]:
                node += 1
                break
            node >>= 1
        else:
            return -1
        while node < self.leaves:
            node = 2 * node if self.held[2 * node] else 2 * node + 1
        return node - self.leaves


def best_fit_decreasing(sizes: list[int], row: int) -> list[list[int]]:
    """Items of each row, in the order they went in. Sizes are from 1 to ``row``.

    Equal sizes go in their given order; of rows with equal room the latest is taken.
    """
    tree, rows = Capacities(row), []
    with_room: dict[int, list[int]] = {}
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        room = tree.least_from(sizes[item])
        if room < 0:
            room, place = row, len(rows)
            rows.append([])
        else:
            place = with_room[room].pop()
            tree.add(room, -1)
        rows[place].append(item)
        left = room - sizes[item]
        with_room.setdefault(left, []).append(place)
        tree.add(left, 1)
    return rows


class Tokens:
    """Ids of texts by a vocabulary of ranks; the id after the last rank ends a text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.end = max(ranks.values()) + 1
        self.kind = np.dtype("<u2" if self.end < 1 << 16 else "<u4")

    def encode(self, text: str) -> np.ndarray:
        if len(text) <= _PIECE:
            ids = self.coder.encode_ordinary(text)
            ids.append(self.end)
            return np.array(ids, self.kind)
        parts, at = [], 0
        while at < len(text):
            cut = _CUT.search(text, at + _PIECE)
            to = cut.start() if cut else len(text)
            parts.append(np.array(self.coder.encode_ordinary(text[at:to]), self.kind))
            at = to
        return np.concatenate([*parts, np.array([self.end], self.kind)])

    def decode(self, ids: np.ndarray) -> str:
        return self.coder.decode_bytes(ids[:-1].tolist()).decode("utf-8")


def ranks_file(path: str | None = None) -> tuple[dict[bytes, int], str]:
    """Ranks and pattern; by default of the public byte-level BPE of 50k tokens."""
    import public_tokenizers

    lines = Path(path or public_tokenizers.path("byte_bpe_50k.tiktoken")).read_bytes().splitlines()
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in lines)}, public_tokenizers.PATTERN


_PACKED = (
    "part int, row bigint, n_tokens int, ids binary, cu_seqlens array<int>, resets array<int>, "
    "doc_ids array<bigint>, offsets array<bigint>"
)
_NAMES = [c.split()[0] for c in _PACKED.split(", ")]


def pack_block(docs: list[tuple[int | None, np.ndarray]], row: int, pad: int) -> Iterator[dict[str, object]]:
    """Packed rows of some documents' ids."""
    segments: list[tuple[int | None, int, np.ndarray]] = []
    for doc, ids in docs:
        segments += [(doc, at, ids[at : at + row]) for at in range(0, len(ids), row)]
    for members in best_fit_decreasing([len(s[2]) for s in segments], row):
        own = [segments[i] for i in members]
        ends = np.cumsum([0, *(len(s[2]) for s in own)])
        ids = np.full(row, pad, own[0][2].dtype)
        ids[: ends[-1]] = np.concatenate([s[2] for s in own])
        yield {
            "n_tokens": int(ends[-1]),
            "ids": ids.tobytes(),
            "cu_seqlens": ends.tolist(),
            "resets": ends[:-1].tolist(),
            "doc_ids": [s[0] for s in own],
            "offsets": [s[1] for s in own],
        }


def packed(
    docs: DataFrame, id: str = "doc_id", text: str = "text", row: int = ROW, block: int = BLOCK, path: str | None = None
) -> DataFrame:
    """Rows of packed ids: ``ids`` is one row of the matrix, little-endian, padded with the
    end id; segment k is ``ids[cu_seqlens[k]:cu_seqlens[k + 1]]``, from token ``offsets[k]``
    of document ``doc_ids[k]``; ``resets`` are the places where positions begin at 0 again.

    Null and empty texts are the end id alone. Ids are handed through, null and repeated
    ones too. An empty table gives no rows.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(ranks_file(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(*shipped.value)
        part, done, held, room = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal done, held, room
            rows = list(pack_block(held, row, tokens.end))
            held, room = [], 0
            for k in range(0, len(rows), 256):
                some = [r | {"part": part, "row": done + k + i} for i, r in enumerate(rows[k : k + 256])]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in some], t) for c, t in kinds], names=_NAMES)
            done += len(rows)

        many = pa.list_(pa.int32())
        types = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), many, many, pa.list_(pa.int64()), pa.list_(pa.int64())]
        kinds = list(zip(_NAMES, types, strict=True))
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                some = batch.slice(k, 500)
                for doc, words in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    ids = tokens.encode(words or "")
                    held.append((doc, ids))
                    room += len(ids)
                    if room >= block:
                        yield from flush()
        if held:
            yield from flush()

    rows = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, _PACKED)


def positions(cu_seqlens: np.ndarray) -> np.ndarray:
    """Position of every token of a row, counted from 0 in each segment."""
    size = np.diff(cu_seqlens)
    return np.arange(int(cu_seqlens[-1])) - np.repeat(cu_seqlens[:-1], size)


_FILES = ("ids", "cu", "resets", "docs")
_WRITTEN = "part int, " + ", ".join(f"{f} string" for f in _FILES) + ", rows bigint, tokens bigint, item_bytes int"


def write_matrices(rows: DataFrame, folder: str, row: int = ROW) -> DataFrame:
    """Write packed rows as raw files; tells each task's files with their rows and tokens.

    ``ids-<part>.bin`` is the matrix, row after row of ids. The others hold for each row
    the number of entries and the entries, little-endian: ``cu`` the cumulative lengths
    and ``resets`` the resets, 32 bits each; ``docs`` for every segment whether it has an
    id, the id and the offset, 64 bits each. A task that runs twice leaves the same files.
    """
    system, path = opened(folder)
    system.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, files, n, tokens, wide = TaskContext.get().partitionId(), [], 0, 0, 0
        for batch in batches:
            for used, raw, ends, resets, docs, offsets in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not files:
                    files, wide = [SharedFile(folder, f"{w}-{part:06d}.bin") for w in _FILES], len(raw) // row
                segments = np.array([(d is not None, d or 0, o) for d, o in zip(docs, offsets, strict=True)], "<i8")
                files[0].put(raw)
                files[1].put(np.array([len(ends), *ends], "<i4").tobytes())
                files[2].put(np.array([len(resets), *resets], "<i4").tobytes())
                files[3].put(np.array([len(docs)], "<i8").tobytes() + segments.tobytes())
                n, tokens = n + 1, tokens + used
        for file in files:
            file.close()
        if files:
            found = (part, *(f.name for f in files), n, tokens, wide)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in zip(found, [pa.int32(), *[pa.string()] * 4, pa.int64(), pa.int64(), pa.int32()], strict=True)],
                names=[c.split()[0] for c in _WRITTEN.split(", ")],
            )

    some = rows.select("n_tokens", "ids", "cu_seqlens", "resets", "doc_ids", "offsets")
    return some.mapInArrow(run, _WRITTEN)


def read_matrices(written: DataFrame, folder: str, row: int = ROW) -> DataFrame:
    """The packed rows that files hold, from what ``write_matrices`` told; one task a part."""
    many = pa.list_(pa.int32())
    types = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), many, many, pa.list_(pa.int64()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = opened(folder)
        for batch in batches:
            for told in batch.to_pylist():
                files = {w: system.open_input_stream(f"{path}/{told[w]}") for w in _FILES}

                def entries(file: str, kind: str, each: int = 1) -> np.ndarray:
                    size = np.dtype(kind).itemsize
                    n = int(np.frombuffer(files[file].read(size), kind)[0])  # noqa: B023
                    return np.frombuffer(files[file].read(size * n * each), kind)  # noqa: B023

                for first in range(0, told["rows"], 256):
                    out = []
                    for k in range(first, min(first + 256, told["rows"])):
                        ids = files["ids"].read(row * told["item_bytes"])
                        ends, resets, segments = entries("cu", "<i4"), entries("resets", "<i4"), entries("docs", "<i8", 3).reshape(-1, 3)
                        docs = [int(d) if there else None for there, d, _ in segments]
                        out.append((told["part"], k, int(ends[-1]), ids, ends.tolist(), resets.tolist(), docs, segments[:, 2].tolist()))
                    columns = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=_NAMES)
                for file in files.values():
                    file.close()

    parts = max(1, written.count())
    return written.repartitionByRange(parts, "part").mapInArrow(run, _PACKED)


def packed_files(docs: DataFrame, id: str = "doc_id", text: str = "text", row: int = ROW) -> DataFrame:
    """Pack all documents into files of the shared folder; the rows read back from them."""
    folder = new_folder(docs.sparkSession, "packed")
    return read_matrices(stored(write_matrices(packed(docs, id, text, row), folder, row), "matrices"), folder, row)
