"""Joins of the merge, reference and intake steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseledger import rules
from caseledger.functions.text import strip, word_tokens
from caseledger.operators.skew import join_back
from caseledger.storage import reliable


def _suffixed(columns: list[str], taken: set[str], suffix: str) -> dict[str, str]:
    return {c: f"{c}{suffix}" for c in columns if c in taken}


def _without_partner(rows: DataFrame, key: str, others: DataFrame, other_key: str) -> DataFrame:
    """Rows whose key the other side lacks; all it needs of that side is distinct keys."""
    keys = others.select(F.col(f"`{other_key}`").alias("_key")).distinct()
    return rows.join(keys, rows[f"`{key}`"] == F.col("_key"), "left_anti")


def outer_join(left: DataFrame, right: DataFrame, key: str, suffix: str) -> DataFrame:
    """Full outer join; every pair of equal keys is kept, a null key has no partner.

    Colliding columns of the right side get ``suffix``. Written as an inner join plus
    the rows of either side without a partner: adaptive execution can split a hot key
    on both sides of an inner join, but on neither side of a full outer join.
    """
    taken = set(left.columns) - {key}
    right = right.withColumnsRenamed(
        _suffixed([c for c in right.columns if c != key], taken, suffix)
    )
    rest = [F.col(f"r.`{c}`") for c in right.columns if c != key]
    same = F.col(f"l.`{key}`") == F.col(f"r.`{key}`")
    paired = left.alias("l").join(right.alias("r"), same).select("l.*", *rest)
    for alone in (
        _without_partner(left, key, right, key), _without_partner(right, key, left, key)
    ):
        paired = paired.unionByName(alone, allowMissingColumns=True)
    return paired


def left_join(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str,
    left_suffix: str, right_suffix: str,
) -> DataFrame:
    """Left join on differently named keys; both sides of a collision are renamed and a
    null key has no partner.

    In two parts for the same reason: the right side of a left join is never split.
    """
    shared = set(left.columns) & set(right.columns)
    left_names = _suffixed(left.columns, shared, left_suffix)
    right_names = _suffixed(right.columns, shared, right_suffix)
    left = left.withColumnsRenamed(left_names)
    right = right.withColumnsRenamed(right_names)
    lk, rk = left_names.get(left_key, left_key), right_names.get(right_key, right_key)
    paired = left.join(right, left[f"`{lk}`"] == right[f"`{rk}`"])
    alone = _without_partner(left, lk, right, rk)
    return paired.unionByName(alone, allowMissingColumns=True)


def drop_provenance(table: DataFrame) -> DataFrame:
    """A merged kind without the columns that tell where its rows came from."""
    return table.drop(*rules.PROVENANCE)


def find_key_column(columns: list[str]) -> str | None:
    """First column whose name speaks of a report id."""
    return next((c for c in columns if "report" in c.lower() and "id" in c.lower()), None)


def join_kinds(tables: dict[str, DataFrame]) -> tuple[DataFrame | None, dict[str, DataFrame]]:
    """Outer-join all kinds that have a report key, left to right.

    Also returns the state after each step, for the accounting. Fewer than two such
    kinds give no joined table. A step's result is read several times by the next one,
    so it is stored in between.
    """
    keyed = {}
    for kind, table in tables.items():
        table = drop_provenance(table)
        key = find_key_column(table.columns)
        if key:
            keyed[kind] = table.withColumnRenamed(key, rules.REPORT_KEY)
    if len(keyed) < 2:
        return None, {}
    steps: dict[str, DataFrame] = {}
    joined = None
    for kind, table in keyed.items():
        if joined is None:
            joined = table
        else:
            suffix = "_" + kind.replace("-", "_")
            joined = outer_join(joined, table, rules.REPORT_KEY, suffix)
            if kind != list(keyed)[-1]:
                joined = reliable(joined)
        steps[kind] = joined
    return joined, steps


def join_accounting(tables: dict[str, DataFrame], steps: dict[str, DataFrame]) -> DataFrame:
    """Rows of each kind, and rows of the joined table before and after it."""
    rows, previous = None, None
    for position, (kind, after) in enumerate(steps.items()):
        counts = after.agg(F.count(F.lit(1)).alias("rows_after_join"))
        before = previous.agg(F.count(F.lit(1))).scalar() if previous is not None else F.lit(0)
        line = counts.select(
            F.lit(position).alias("step"),
            F.lit(kind).alias("kind"),
            tables[kind].agg(F.count(F.lit(1))).scalar().alias("original_rows"),
            before.cast("bigint").alias("rows_before"),
            "rows_after_join",
        ).withColumn("rows_added", F.col("rows_after_join") - F.col("rows_before"))
        rows = line if rows is None else rows.unionByName(line)
        previous = after
    return rows


def verify_species(species: DataFrame, reference: DataFrame) -> DataFrame:
    """Adds ``verified``: a reference pair has this common and scientific name.

    ``species`` carries one row per named species, ``reference`` pairs
    (common_name, sci_name). The scientific name is compared without case.
    """
    pairs = reference.select(
        F.col("common_name").alias("_common"), F.lower("sci_name").alias("_sci"),
        F.lit(True).alias("_known"),
    ).distinct()
    named = species.withColumns(
        {"_common": F.col("speciesCommonName"), "_sci": F.lower("scientificName")}
    )
    return (
        join_back(named, pairs, ["_common", "_sci"], "left")
        .withColumn("verified", F.coalesce("_known", F.lit(False)))
        .drop("_common", "_sci", "_known")
    )


def verify_species_lists(
    records: DataFrame, key: str, lists: str, reference: DataFrame
) -> DataFrame:
    """The nested form: each element of the list column gains ``verified``.

    Lists are taken apart and put together per record, so a group is never larger than
    the list it came from.
    """
    parts = records.select(key, F.posexplode(lists).alias("_at", "_species"))
    flagged = verify_species(parts.select(key, "_at", "_species.*"), reference)
    fields = [c for c in flagged.columns if c not in (key, "_at")]
    rebuilt = flagged.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("_at", F.struct(*fields).alias("s")))).alias("_l")
    )
    rebuilt = rebuilt.select(key, F.transform("_l", lambda e: e["s"]).alias("_rebuilt"))
    return (
        records.join(rebuilt, key, "left")
        .withColumn(lists, F.coalesce("_rebuilt", F.array()))
        .drop("_rebuilt")
    )


def flag_listed_names(rows: DataFrame, name: str, reference: DataFrame, listed: str) -> DataFrame:
    """Adds ``listed``: the name is in the reference list, case and edges ignored."""
    known = reference.select(F.lower(strip(F.col(listed))).alias("_name")).distinct()
    known = known.withColumn("_known", F.lit(True))
    named = rows.withColumn("_name", F.lower(strip(F.col(name))))
    return (
        join_back(named, known, "_name", "left")
        .withColumn("listed", F.coalesce("_known", F.lit(False)))
        .drop("_name", "_known")
    )


def flag_existing(rows: DataFrame, stored: DataFrame, key: str, stored_id: str) -> DataFrame:
    """Adds ``existing_id``: the smallest stored id with an equal key, else null.

    The stored side is one row per key, so a hot key on the incoming side is only a
    long probe, which adaptive execution splits.
    """
    known = stored.groupBy(key).agg(F.min(stored_id).alias("existing_id"))
    return join_back(rows, known, key, "left")


def exclude_known(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return join_back(rows, known.select(key).distinct(), key, "left_anti")


def rows_with_accepted(rows: DataFrame, accepted: DataFrame, key: str) -> DataFrame:
    return join_back(rows, accepted.select(key).distinct(), key, "left_semi")


def same_vessel(incidents: DataFrame, vessel: str, name: str, key: str = "id") -> DataFrame:
    """Incidents that may be duplicates of one concerning vessel ``name``."""
    return incidents.filter(F.col(vessel) == F.lit(name)) if name else incidents.limit(0)


def duplicate_groups(incidents: DataFrame, vessel: str, key: str = "id") -> DataFrame:
    """The same check for a whole table, without writing out pairs.

    Each incident that shares its vessel with another gets the group's size and first
    member. A vessel named in a third of all incidents adds one row to the small side.
    """
    named = incidents.filter(F.coalesce(F.col(vessel), F.lit("")) != "")
    groups = (
        named.groupBy(vessel)
        .agg(F.count(F.lit(1)).alias("group_size"), F.min(key).alias("first_id"))
        .filter(F.col("group_size") > 1)
    )
    return join_back(named.select(key, vessel), groups, vessel).select(
        key, vessel, "group_size", "first_id"
    )


_PLACES = 1 << 20  # hash buckets of words and phrases; the most rows that are broadcast


def _slot(value: Column) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(_PLACES)).cast("int")


def dictionary_hits(
    documents: DataFrame, terms: DataFrame, key: str, text: str, term: str
) -> DataFrame:
    """(document, term, hits) for a dictionary of any size, by equi-join on phrases.

    A term matches whole words in sequence, case ignored. A place in a text is a
    candidate where some term begins with its word: tables of hash buckets, at most
    ``_PLACES`` rows whatever the dictionary, tell that and which lengths begin so, and
    then which of the phrases there may be terms. Only those phrases, counted per document,
    are shuffled to meet the dictionary; texts and other words never are.
    """
    tokens = word_tokens(F.col(term))
    wanted = terms.select(F.col(term), tokens.alias("_tokens")).filter(F.size("_tokens") > 0).distinct()
    wanted = wanted.select(
        term, F.array_join("_tokens", " ").alias("_phrase"), F.size("_tokens").alias("_words"),
        _slot(F.get("_tokens", F.lit(0))).alias("_first"),
    )
    starts = wanted.groupBy("_first").agg(F.collect_set("_words").alias("_lengths"))  # as many as a term has words
    phrases = wanted.select(_slot(F.col("_phrase")).alias("_slot")).distinct()
    found = documents.select(key, word_tokens(F.col(text)).alias("_all"))
    places = found.select(key, "_all", F.posexplode("_all").alias("_at", "_word"))
    places = places.withColumn("_first", _slot(F.col("_word"))).join(F.broadcast(starts), "_first")
    lengths = F.filter("_lengths", lambda n: F.col("_at") + n <= F.size("_all"))
    phrase = F.transform(lengths, lambda n: F.array_join(F.slice("_all", F.col("_at") + 1, n), " "))
    here = places.select(key, F.explode(phrase).alias("_phrase")).withColumn("_slot", _slot(F.col("_phrase")))
    here = here.join(F.broadcast(phrases), "_slot", "left_semi")
    counted = here.groupBy(key, "_phrase").agg(F.count(F.lit(1)).alias("hits"))
    return join_back(counted, wanted.select("_phrase", term), "_phrase").select(key, term, "hits")
