"""N-gram Jaccard join: an exact join in the metric space of shingle sets.

The Jaccard distance is a metric, yet between unrelated texts it is 1 whatever the
pivot, so pivots drawn from the whole corpus would put every text on every border and
replicate all of them everywhere. The join therefore starts from pivots that do tell
unrelated texts apart, and uses texts as pivots only where distances vary:

1. Equal sets are one class; from here on one member stands for a class.
2. First pivots are the cells of the shingle universe cut into ``m`` ranges of the hash.
   Restricted to one range, the size of the symmetric difference is again a metric, and
   those of all ranges add up. Two sets within the threshold differ by at most ``d``
   shingles, so with more than ``d`` ranges they coincide in one: a Voronoi region is
   the sets with one and the same restriction, and its window is 0 wide. ``m`` and
   ``d`` depend on a band of sizes; a set near the border of two bands, by the triangle
   inequality on sizes (the distance to the empty set), goes to both.
3. In each region of two classes or more, the member that meets most others is the pivot;
   every member is measured against it and linked where it is near enough.
4. Regions whose members are not all connected by then are joined again: members
   outside a region's main component are the next pivots, and meet the members of
   other components, except where sizes or the distances to the region's pivot differ
   by more than the threshold allows (triangle inequality).

Before shingles are counted, a pair must pass a bound: each class has 1,024 parity bits,
a bit telling whether an odd number of its shingles falls on it. A shingle that only one
of two sets has flips one bit, so the bits that differ are never more than the shingles
that differ. Pairs that pass are measured on their whole sets.

Members already in one component need no further measurement to find the components, so
a group of thousands of near copies costs a star of links there. The number of each
document's links takes all pairs of a component's classes: they are counted block by block
inside tasks, so their number costs time, but neither rows nor memory.

Identity of shingles, sets and regions is that of 64-bit hashes; sizes and
intersections are counted exactly on them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseledger.llm.components import components
from caseledger.llm.scoring import free_name
from caseledger.llm.words import mix, shingle_sets
from caseledger.operators.skew import join_back
from caseledger.storage import discard, freed_shuffles, stored

_BAND_RATIO = 1.5
_PARTS = 4  # ranges of the regions' hash, each a column of its own
_AT_ONCE = 8_000_000  # region rows; more go range by range, so that only one range's rows are shuffled at a time


@lru_cache(maxsize=8)
def _bands(percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First size, number of ranges and most empty ranges that are safe, per band.

    The last is how many ranges a set may leave empty and still coincide with any
    partner in a range that is not empty.
    """
    firsts, ranges, safe = [1], [], []
    while firsts[-1] < 1 << 40:
        first = firsts[-1]
        after = max(first + 1, int(first * _BAND_RATIO))
        small = after - 1
        large = small * 100 // percent
        d = (100 - percent) * (small + large) // (100 + percent)
        spare = 0
        for _ in range(30):  # the ranges left empty depend on the number of ranges
            m = d + 1 + spare
            empty = m * math.exp(-first / m)
            spare = math.ceil(empty + 4 * math.sqrt(empty) + 1) if d else 0
        firsts.append(after)
        ranges.append(d + 1 + spare)
        safe.append(spare)
    return np.array(firsts[:-1]), np.array(ranges), np.array(safe)


def region_keys(shingles: np.ndarray, percent: int) -> np.ndarray:
    """Regions that a sorted set of shingle hashes belongs to.

    A set that differs from any partner in ``d`` ranges at most shares all others with
    it; where that leaves ``c`` sure ones, the last ``c - 1`` ranges are not needed.
    """
    n = len(shingles)
    firsts, ranges, safe = _bands(percent)
    own = int(np.searchsorted(firsts, n, "right")) - 1
    out = []
    least = -(-n * percent // 100)  # the smallest partner
    for band in range(own, -1, -1):
        if band < own and firsts[band + 1] <= least:
            break
        m = int(ranges[band])
        if m == 1:  # only equal sets are near
            continue
        largest_small = int(firsts[band + 1]) - 1
        partner = n * 100 // percent if band == own else min(n, largest_small)
        d = (100 - percent) * (n + partner) // (100 + percent)
        sure = m - d - int(safe[band])
        cell = ((shingles >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        edge = np.flatnonzero(np.diff(cell, prepend=np.uint64(m)))
        sums = np.add.reduceat(mix(shingles), edge)
        cells = cell[edge]
        if m - len(edge) > safe[band]:  # empty ranges may be all that coincides
            cells = np.arange(m, dtype=np.uint64)
            full = np.zeros(m, np.uint64)
            full[cell[edge].astype(np.int64)] = sums
            sums = full
        if sure > 1:
            needed = cells < np.uint64(m - sure + 1)
            cells, sums = cells[needed], sums[needed]
        out.append(mix(sums ^ mix(cells * np.uint64(1 << 20) + np.uint64(band + 1))))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def parity(shingles: np.ndarray) -> np.ndarray:
    """The parity bits of a set, as 16 words."""
    bits = np.bincount((mix(shingles) >> np.uint64(54)).astype(np.int64), minlength=1024) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def set_class(shingles: np.ndarray) -> int:
    """Identity of a whole set."""
    return int(mix(np.array([mix(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles))]))[0].astype(np.int64))


def _long(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64).view(np.int64)


_SIGNED = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("text_key", pa.int64()),
        ("n_shingles", pa.int64()),
        ("cls", pa.int64()),
        ("parity", pa.list_(pa.int64())),
        *((f"regions_{k}", pa.list_(pa.int64())) for k in range(_PARTS)),
    ]
)


def _with_regions(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            sizes, classes, bits, lists = [], [], [], [[] for _ in range(_PARTS)]
            named = batch.column(0).is_valid().to_pylist()
            for has_id, shingles in zip(named, shingle_sets(batch.column(1), n), strict=True):
                size = len(shingles)
                sizes.append(size)
                cls = set_class(shingles) if size else None
                classes.append(cls)
                bits.append(parity(shingles))
                # copies in one task need their regions once; rows without an id take no part
                if size and has_id and cls not in seen:
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(cls)
                    regions = region_keys(shingles, percent)
                else:
                    regions = np.zeros(0, np.uint64)
                part = regions >> np.uint64(62)  # of four
                for k in range(_PARTS):
                    lists[k].append(_long(regions[part == k]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array(sizes, pa.int64()),
                    pa.array(classes, pa.int64()),
                    _lists(bits),
                    *map(_lists, lists),
                ],
                schema=_SIGNED,
            )

    return run


def _lists(lists: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *(len(x) for x in lists)], dtype=np.int32)
    values = np.concatenate(lists) if lists else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def _all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


_FILTER_WORDS = 1 << 17  # of 64 bits: 1 MB, whatever the number of ids


def _maybe_in(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose 64-bit key may be among ``keys``: a bitmap of fixed size tells; a join decides.

    The bitmap is broadcast as a table of at most ``_FILTER_WORDS`` rows.
    """
    word = F.expr(f"cast(shiftrightunsigned({key}, 6) & {_FILTER_WORDS - 1} as int)")
    bit = F.expr(f"shiftleft(1L, cast({key} & 63 as int))")
    bitmap = keys.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    found = rows.withColumn("_word", word).join(F.broadcast(bitmap), "_word")
    return found.filter(F.col("_bits").bitwiseAND(bit) != 0).drop("_word", "_bits")


def _id_filter(ids: DataFrame) -> np.ndarray:
    """A bit for the hash of every id in a bitmap of fixed size."""
    hashed = ids.select(F.xxhash64("doc_id").alias("h"))
    word = F.col("h").bitwiseAND((_FILTER_WORDS - 1) << 6)
    bit = F.expr("shiftleft(1L, cast(h & 63 as int))")
    rows = hashed.groupBy(word.alias("w")).agg(F.bit_or(bit).alias("bits")).toArrow()  # arrays, not a row object each
    table = np.zeros(_FILTER_WORDS, np.uint64)
    table[rows.column("w").to_numpy() >> 6] = rows.column("bits").to_numpy().view(np.uint64)
    return table


def _packed_where(table: np.ndarray):
    """``_packed`` of the rows whose hash may be in the filter; the join decides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.asarray(batch.column(2)).view(np.uint64)
            word = table[(h >> np.uint64(6)) & np.uint64(_FILTER_WORDS - 1)]
            there = (word >> (h & np.uint64(63))) & np.uint64(1)
            batch = batch.filter(pa.array(there.astype(bool)))
            if batch.num_rows:
                yield from _packed(iter([batch.select([0, 1])]))

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for the way through a shuffle."""
    for batch in batches:
        packed = [pa.compress((t or "").encode("utf-8"), "zstd", asbytes=True) for t in batch.column(1).to_pylist()]
        sizes = pa.compute.binary_length(batch.column(1)).fill_null(0).cast(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), sizes, pa.array(packed, pa.binary())], names=["doc_id", "size", "packed"]
        )


_SETS = "doc_id bigint, first boolean, second boolean, cls bigint, shingles array<bigint>"


def _with_sets(n: int):
    names = [c.split()[0] for c in _SETS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, set[int]] = (0, set())
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                texts = [
                    pa.decompress(p, size, "zstd", asbytes=True).decode("utf-8") if size else ""
                    for size, p in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)
                ]
                kept, at = [], []
                for i, (doc, s) in enumerate(zip(part.column(0).to_pylist(), shingle_sets(pa.array(texts), n), strict=True)):
                    if last[0] != doc:
                        last = (doc, set())
                    cls = set_class(s) if len(s) else None
                    if cls is not None and cls not in last[1]:  # rows that repeat a document
                        last[1].add(cls)
                        kept.append((cls, s))
                        at.append(i)
                own = [part.column(k).take(pa.array(at, pa.int64())) for k in (0, 3, 4)]
                classes = pa.array([c for c, _ in kept], pa.int64())
                yield pa.RecordBatch.from_arrays([*own, classes, _lists([_long(s) for _, s in kept])], names=names)

    return run


_BLOCK = 256  # classes of a component that meet as many others at a time
_COLUMNS = 4096  # shingles at a time
_COUNTED = "cls bigint, links bigint"


def near_counts(
    sets: list[np.ndarray], rows: np.ndarray, first: np.ndarray, second: np.ndarray, percent: int
) -> tuple[np.ndarray, np.ndarray]:
    """For each ``first`` set the rows of ``second`` ones near it, and the other way round."""
    sizes = np.array([len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    several = times[column] > 1
    owner, column = owner[several], column[several]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    a, b = np.flatnonzero(first), np.flatnonzero(second)
    common = np.zeros((len(a), len(b)), np.int64)
    for low in range(0, len(times), _COLUMNS):
        lo, hi = np.searchsorted(column, [low, low + _COLUMNS])
        if lo == hi:
            continue
        held = np.zeros((len(sets), _COLUMNS), np.float32)
        held[owner[lo:hi], column[lo:hi] - low] = 1
        common += (held[a] @ held[b].T).astype(np.int64)
    union = sizes[a][:, None] + sizes[b][None, :] - common
    near = (common * 100 >= union * percent) & (a[:, None] != b[None, :])
    return near @ rows[b], near.T @ rows[a]


def _counted(percent: int):
    """Links between the sets of two blocks of a component, rows of a pair of blocks coming one after another."""

    def told(sets: list, infos: list, pair: tuple) -> pa.RecordBatch:
        classes, rows, own = (np.array(x, np.int64) for x in zip(*infos, strict=True))
        first, second = own == pair[1], own == pair[2]
        one, other = near_counts(sets, rows, first, second, percent)
        found = [(classes[first], one)] + ([(classes[second], other)] if pair[1] != pair[2] else [])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["cls", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sets, infos = None, [], []
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(6)]
            lists = batch.column(6)
            values, ends = np.asarray(lists.values), np.asarray(lists.offsets)
            for k, pair in enumerate(zip(*columns[:3], strict=True)):
                if pair != now:
                    if len(sets) > 1:
                        yield told(sets, infos, now)
                    now, sets, infos = pair, [], []
                sets.append(values[ends[k] : ends[k + 1]].copy())
                infos.append((columns[3][k], columns[4][k], columns[5][k]))
        if len(sets) > 1:
            yield told(sets, infos, now)

    return run


def jaccard_components(
    docs: DataFrame, id: str = "doc_id", text: str = "text", n: int = 4, percent: int = 85
) -> DataFrame:
    """``doc_id, n_shingles, component_id, links`` for every row of ``docs``.

    Two documents link when ``100 * |A & B| >= percent * |A | B|`` on their sets of word
    ``n``-shingles. ``component_id`` is the smallest id reachable by links. ``links`` is
    the number of other rows that the row links with, copies among them.

    A text of fewer than ``n`` words has one shingle, the whole sequence. Empty, blank
    and null texts have none and link with nothing. A row without an id keeps its size
    and has a null component and no links; it takes no part in the join. Rows with one id are each
    placed by their own text. Other columns are ignored.
    """
    with freed_shuffles(docs.sparkSession):
        found = _placed(docs, id, text, n, percent, F.lit(None).cast("bigint"), count_links=True)
    return found.select("doc_id", "n_shingles", "component_id", "links")


def _placed(
    docs: DataFrame, id: str, text: str, n: int, percent: int, text_key: Column, count_links: bool = False
) -> DataFrame:
    """As ``jaccard_components``, with each row's ``text_key`` and the class ``root`` of its component.

    ``links`` only on demand; components do not need them.
    """
    keyed = docs.select(
        F.col(id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), text_key.alias("text_key")
    )
    rows = keyed.select("doc_id", "text")
    lists = [f"regions_{k}" for k in range(_PARTS)]
    signed = stored(
        keyed.mapInArrow(
            _with_regions(n, percent),
            "doc_id bigint, text_key bigint, n_shingles bigint, cls bigint, parity array<bigint>, "
            + ", ".join(f"{c} array<bigint>" for c in lists),
        ),
        "regions",
    )
    placed = signed.filter("doc_id is not null and cls is not null")
    dealt_rows, volume = signed.agg(F.sum(reduce(Column.__add__, map(F.size, lists))), F.sum("n_shingles")).first()
    ranges_of = [[c] for c in lists] if (dealt_rows or 0) > _AT_ONCE else [lists]

    # 2. regions of two classes or more
    held_by = []
    for part in ranges_of:
        dealt = placed.select("cls", F.explode(F.concat(*part)).alias("region"))
        shared = dealt.groupBy("region").agg(F.min("cls").alias("least"), F.max("cls").alias("most"), F.count(F.lit(1)).alias("held"))
        shared = stored(shared.filter("least < most").select("region", "held"), "shared")
        held_by.append(stored(join_back(_maybe_in(dealt, shared, "region"), shared, "region").distinct(), "members"))
        discard(shared)
    narrow = stored(signed.select("doc_id", "text_key", "n_shingles", "cls"), "classes")
    classes = narrow.filter("doc_id is not null and cls is not null")
    classes = classes.groupBy("cls").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows"))
    meets_most = _all(held_by).groupBy("cls").agg(F.sum("held").alias("met"))
    meets_most = stored(meets_most, "met")
    bits = placed.join(meets_most.select("cls"), "cls", "left_semi")
    bits = bits.select("cls", F.col("n_shingles").alias("size"), "parity").dropDuplicates(["cls"])
    bits = stored(bits, "parity")
    discard(signed)
    members, star = [], []
    for held in held_by:
        ranked = stored(join_back(held, meets_most, "cls").select("region", "cls", "met"), "ranked")
        discard(held)
        pivots = ranked.groupBy("region").agg(F.max_by("cls", F.struct("met", "cls")).alias("pivot"))
        members.append(stored(join_back(ranked.drop("met"), pivots, "region"), "members"))
        discard(ranked)
        own = members[-1].filter("cls <> pivot").select(F.col("cls").alias("x"), F.col("pivot").alias("y"))
        star.append(stored(own.distinct(), "star"))
    discard(meets_most)

    differ = F.floor((F.col("size_x") + F.col("size_y")) * (100 - percent) / (100 + percent))
    flipped = reduce(
        Column.__add__,
        (F.bit_count(F.col("parity_x")[i].bitwiseXOR(F.col("parity_y")[i])) for i in range(16)),
    )
    fits = (F.col("size_x") * 100 >= F.col("size_y") * percent) & (
        F.col("size_y") * 100 >= F.col("size_x") * percent
    )
    may_be_near = fits & (flipped <= differ)

    def side(table: DataFrame, key: str, s: str) -> DataFrame:
        return table.select(F.col(key).alias(s), *(F.col(c).alias(f"{c}_{s}") for c in table.columns if c != key))

    def sets_of(ends: DataFrame) -> DataFrame:
        """``_SETS`` of the ends ``cls, first, second``, stored; a document's other classes come with them."""
        chosen = ends.join(classes, "cls").groupBy(F.col("least").alias("doc_id"))
        chosen = stored(chosen.agg(F.bool_or("first").alias("first"), F.bool_or("second").alias("second")), "chosen")
        wanted = rows.filter("doc_id is not null").withColumn("h", F.xxhash64("doc_id"))
        packed = wanted.mapInArrow(_packed_where(_id_filter(chosen)), "doc_id bigint, size bigint, packed binary")
        sets = packed.join(chosen, "doc_id").sortWithinPartitions("doc_id")
        sets = stored(sets.mapInArrow(_with_sets(n), _SETS), "sets")
        discard(chosen)
        return sets

    def measured(pairs: DataFrame) -> DataFrame:
        """Stored pairs ``x, y, size_x`` of classes with their distance, and whether they link.

        Each pair moves the set of its ``x``; where these would be more than half of all
        sets, they go in parts by ``y``.
        """
        moved = pairs.agg(F.sum("size_x")).first()[0] or 0
        steps = max(1, math.ceil(2 * moved / max(1, volume or 0)))
        part = F.pmod(F.xxhash64("y"), F.lit(steps))
        return _all([_measured(pairs.filter(part == k).select("x", "y")) for k in range(steps)])

    def _measured(pairs: DataFrame) -> DataFrame:
        sides = (("x", True), ("y", False))
        sides = (pairs.select(F.col(c).alias("cls"), F.lit(a).alias("first"), F.lit(not a).alias("second")) for c, a in sides)
        ends = _all(list(sides)).groupBy("cls").agg(F.bool_or("first").alias("first"), F.bool_or("second").alias("second"))
        sets = sets_of(ends)
        both = join_back(pairs, sets.filter("first").select(F.col("cls").alias("x"), F.col("shingles").alias("s")), "x")
        both = join_back(both, sets.filter("second").select(F.col("cls").alias("y"), F.col("shingles").alias("t")), "y")
        common = F.size(F.array_intersect("s", "t")).cast("bigint")
        union = F.size("s").cast("bigint") + F.size("t") - F.col("common")
        found = (
            both.withColumn("common", common)
            .withColumn("union", union)
            .select(
                "x",
                "y",
                (1 - F.col("common") / F.col("union")).alias("distance"),
                (F.col("common") * 100 >= F.col("union") * percent).alias("near"),
            )
        )
        found = stored(found.distinct(), "distances")
        discard(sets)
        return found

    def linked(grouped: DataFrame) -> DataFrame:
        """``cls, links`` from ``cls, root, least, rows``: rows of the other classes near a class.

        A component's classes are cut into blocks by hash, and every two of its blocks meet in
        one group of at most some ``2 * _BLOCK`` sets, so a class is moved once for each block.
        """
        grouped = grouped.join(bits.select("cls", "size"), "cls")
        blocks = grouped.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / _BLOCK).alias("blocks"))
        grouped = join_back(grouped, blocks, "root").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")))
        grouped = stored(grouped, "grouped")
        moved = grouped.agg(F.sum(F.col("size") * F.col("blocks"))).first()[0] or 0
        steps = max(1, math.ceil(2 * moved / max(1, volume or 0)))
        part = F.pmod(F.xxhash64("root"), F.lit(steps))
        found = []
        for k in range(steps):
            these = grouped.filter(part == k)
            own_sets = sets_of(these.select("cls", F.lit(True).alias("first"), F.lit(False).alias("second")))
            sets = own_sets.select("cls", F.col("doc_id").alias("least"), "shingles").join(these, ["cls", "least"])
            other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other")
            sets = sets.select("root", "cls", "rows", "own", "shingles", other)
            low, high = F.least("own", "other"), F.greatest("own", "other")
            sets = sets.select("root", low.alias("i"), high.alias("j"), "cls", "rows", "own", "shingles")
            met = sets.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(_counted(percent), _COUNTED)
            found.append(stored(met.groupBy("cls").agg(F.sum("links").alias("links")), "linked"))
            discard(own_sets)
        return _all(found)

    # 3. members against their region's pivot
    to_pivot = _all(star).distinct()
    to_pivot = join_back(join_back(to_pivot, side(bits, "cls", "x"), "x"), side(bits, "cls", "y"), "y")
    bound = 2 * flipped / (F.col("size_x") + F.col("size_y") + flipped)  # no nearer than that
    to_pivot = stored(to_pivot.select("x", "y", "size_x", bound.alias("bound"), may_be_near.alias("may")), "pairs")
    for own in star:
        discard(own)
    first = measured(to_pivot.filter("may"))
    links = first.filter("near").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()
    roots = components(links, "x", "y")

    # 4. what is left between components of one region
    ranges = to_pivot.join(first, ["x", "y"], "left").select(
        F.col("x").alias("cls"),
        F.col("y").alias("pivot"),
        F.coalesce("distance", "bound").alias("from"),
        F.coalesce("distance", F.lit(1.0)).alias("to"),
    )
    ranges = stored(ranges, "ranges")
    reach = 1 - percent / 100 + 1e-9

    def between(members: DataFrame) -> DataFrame:
        """Pairs of a part's regions that are not one component and may be near."""
        known = (
            members.join(ranges, ["cls", "pivot"], "left")
            .join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left")
            .select(
                "region",
                "cls",
                F.coalesce("from", F.lit(0.0)).alias("from"),
                F.coalesce("to", F.lit(0.0)).alias("to"),
                F.coalesce("root", "cls").alias("root"),
            )
        )
        mixed = known.groupBy("region").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi")
        mixed = known = stored(join_back(known, mixed.select("region"), "region"), "mixed")
        parts = known.groupBy("region", "root").agg(F.count(F.lit(1)).alias("held"))
        main = parts.groupBy("region").agg(F.max_by("root", F.struct("held", "root")).alias("main"))
        known = join_back(join_back(known, main, "region"), bits, "cls")
        outer = side(known.filter("root <> main"), "cls", "x")
        other = side(known, "cls", "y")
        meets = (
            (F.col("region_x") == F.col("region_y"))
            & (F.col("root_x") != F.col("root_y"))
            & ((F.col("root_y") == F.col("main_y")) | (F.col("x") < F.col("y")))
            & (F.col("from_x") - F.col("to_y") <= reach)
            & (F.col("from_y") - F.col("to_x") <= reach)
            & may_be_near
        )
        ordered = F.when(F.col("x") > F.col("y"), F.struct("x", "y", "size_x"))
        ordered = F.coalesce(ordered, F.struct(F.col("y").alias("x"), F.col("x").alias("y"), F.col("size_y").alias("size_x")))
        found = stored(outer.join(other, meets).select(ordered.alias("pair")).select("pair.*").distinct(), "pairs")
        discard(mixed)
        discard(members)
        return found

    second = measured(stored(_all([between(part) for part in members]).distinct(), "pairs"))
    links = stored(links.union(second.filter("near").select("x", "y")), "links")

    roots = components(links, "x", "y").select(F.col("node").alias("cls"), "root")
    placing = classes.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = placing.groupBy("root").agg(F.min("least").alias("component_id"))
    placing = join_back(placing, least, "root").select("cls", "root", "component_id", "rows")
    if count_links:
        counted = stored(linked(join_back(roots, classes, "cls")), "counted")
        placing = placing.join(counted, "cls", "left")
    else:
        placing = placing.withColumn("links", F.lit(None).cast("bigint"))
    return join_back(narrow, placing, "cls", "left").select(
        "doc_id",
        "text_key",
        "n_shingles",
        "root",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.when(F.col("doc_id").isNull(), 0)
        .otherwise(F.coalesce("links", F.lit(0)) + F.coalesce(F.col("rows") - 1, F.lit(0)))
        .alias("links"),
    )


def keep_one_of_each(
    docs: DataFrame, id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80
) -> DataFrame:
    """One row of ``docs`` of each component, of those with its smallest id.

    Rows without an id stay, and those without a shingle. Rows that repeat an id are each
    judged by their own text; of rows that repeat both, one stays.
    """
    with freed_shuffles(docs.sparkSession):
        found = _placed(docs, id, text, n, percent, F.xxhash64(text))
        found = found.filter("doc_id is not null and n_shingles > 0").select("root", F.struct("doc_id", "text_key").alias("row"))
        found = stored(found, "placed")
    kept = found.groupBy("root").agg(F.min("row").alias("kept"))
    found = join_back(found, kept, "root")
    doc, key = free_name(docs, "_losing_id"), free_name(docs, "_losing_text")
    losers = found.filter("row <> kept").select(F.col("row.doc_id").alias(doc), F.col("row.text_key").alias(key))
    losers = losers.distinct()
    again = found.filter("row = kept").groupBy("row").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    again = stored(again.select(F.col("row.doc_id").alias(doc), F.col("row.text_key").alias(key)), "repeated")
    same = (docs[id].cast("bigint") == F.col(doc)) & (F.xxhash64(docs[text]) == F.col(key))
    if again.isEmpty():
        return docs.join(losers, same, "left_anti")
    one = docs.join(again, same, "left_semi").dropDuplicates([id, text])
    return docs.join(losers.union(again), same, "left_anti").union(one)
