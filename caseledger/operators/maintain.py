"""Table maintenance: each operator returns the new state of a table.

``write_version`` stores a state as a version folder of its own, so readers of an older
version are not disturbed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseledger import rules
from caseledger.functions.text import default_if_missing, sha256_hex
from caseledger.operators.links import remove_incidents
from caseledger.operators.skew import join_back
from caseledger.storage import new_folder, reliable

CHANGE = "map<string, struct<old_value: string, new_value: string>>"


def with_hash(sources: DataFrame, text: str = "article_text") -> DataFrame:
    """The hash always follows the text, whatever was stored before."""
    hashed = F.when(F.coalesce(F.col(text), F.lit("")) != "", sha256_hex(F.col(text)))
    if "article_hash" in sources.columns:
        hashed = F.coalesce(hashed, F.col("article_hash"))
    return sources.withColumn("article_hash", hashed)


def fingerprint(vessel: Column, date: Column, location: Column) -> Column:
    parts = (
        default_if_missing(vessel, rules.DEFAULT_VESSEL),
        default_if_missing(date, rules.DEFAULT_DATE),
        default_if_missing(location, rules.DEFAULT_LOCATION),
    )
    return sha256_hex(F.concat_ws("_", *parts))


def with_fingerprint(incidents: DataFrame) -> DataFrame:
    """Fill in a missing fingerprint; one that is there stays."""
    info = "extracted_information"
    made = fingerprint(
        F.col(f"{info}.catchSourceInformation.vesselName"),
        F.col(f"{info}.eventData.eventDate"),
        F.col(f"{info}.eventData.eventLocation"),
    )
    given = F.nullif(F.col("incident_fingerprint"), F.lit(""))
    return incidents.withColumn("incident_fingerprint", F.coalesce(given, made))


def known_keys(stored: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Stored keys that occur in the batch.

    The stored table is filtered by the batch, not the other way round: its keys are
    only scanned when the batch is small enough to be broadcast.
    """
    wanted = batch.select(key).filter(F.col(key).isNotNull()).distinct()
    return stored.select(key).join(wanted, key, "left_semi").distinct()


def insert_unique(
    stored: DataFrame, batch: DataFrame, seq: str
) -> tuple[DataFrame, DataFrame]:
    """Accepted rows of a batch, and rejected ones with their ``reason``.

    The hash is unique, and no hash is one value of it; so is the url, but only where
    there is one. Rows count in the order of the unique column ``seq``: a row is rejected
    when a stored row or an earlier accepted row has its hash (``reason`` is then
    ``article_hash``) or its url (``url``).
    """
    def hashed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_hash", F.coalesce("article_hash", F.lit("")))

    keys, older = hashed(batch).select(seq, "_hash", "url"), hashed(stored)
    known = {key: known_keys(older, keys, key) for key in ("_hash", "url")}
    open_keys = keys
    for key, values in known.items():
        open_keys = join_back(open_keys, values, key, "left_anti")
    accepted = _settle(open_keys.select(seq, "_hash", "url"), seq)
    firsts = accepted.select("_hash", F.col(seq).alias("_since"), F.lit(False).alias("_old"))
    nothing = F.lit(None).cast(dict(firsts.dtypes)["_since"])
    taken = firsts.unionByName(known["_hash"].select("_hash", nothing.alias("_since"), F.lit(True).alias("_old")))
    taken = taken.groupBy("_hash").agg(F.min("_since").alias("_since"), F.max("_old").alias("_old"))
    rest = join_back(hashed(batch), accepted.select(seq), seq, "left_anti")
    rest = join_back(rest, taken, "_hash", "left")
    same_hash = F.coalesce(F.col("_old") | (F.col("_since") < F.col(seq)), F.lit(False))
    reason = F.when(same_hash, "article_hash").otherwise("url")
    rejected = rest.withColumn("reason", reason).select(*batch.columns, "reason")
    return join_back(batch, accepted.select(seq), seq, "left_semi"), rejected


def _settle(rows: DataFrame, seq: str) -> DataFrame:
    """``seq, _hash, url`` of every accepted row.

    Rows that are first for both keys are certain, rows sharing a key with a certain
    row are out, and the few left over ask the same question again, now with those that
    wait for one earlier row only (``_chained``), so a chain of any length is settled in
    one round. The first row left is always certain, so every round ends with fewer.
    Each round's accepted rows are written, not kept as a growing union.
    """
    spark, folder, number = rows.sparkSession, new_folder(rows.sparkSession, "accepted"), 0
    rows, shape = reliable(rows), rows.schema
    while True:
        path = f"{folder}/round={number}"
        settled = _chained(rows, seq) if number else _first_for_both(rows, seq)
        settled.write.parquet(path)
        certain = spark.read.schema(shape).parquet(path)
        for key in ("_hash", "url"):
            taken = certain.filter(F.col(key).isNotNull()).select(key).distinct()
            rows = join_back(rows, taken, key, "left_anti")
        rows, number = reliable(rows.select(seq, "_hash", "url")), number + 1
        if rows.isEmpty():
            return spark.read.schema(shape).parquet(*(f"{folder}/round={i}" for i in range(number)))


def _chained(rows: DataFrame, seq: str) -> DataFrame:
    """Rows that are certain, and those whose fate follows from a certain row along a chain.

    A row that is first for one key and second for the other waits for one row, the
    first of that other key: it is accepted just if that one is not. Chains of such rows
    are followed by doubling: each row holds a row further up and whether the way there
    negates, and takes over what that row holds, until the chain's end is reached. A row
    has at most two others waiting for it, so no key is hot.
    """
    placed = rows
    for key, first, second in (("_hash", "_h1", "_h2"), ("url", "_u1", "_u2")):
        given = placed.filter(F.col(key).isNotNull())
        firsts = given.groupBy(key).agg(F.min(seq).alias(first))
        placed = join_back(placed, firsts, key, "left")
        later = placed.filter(F.col(seq) > F.col(first)).groupBy(key).agg(F.min(seq).alias(second))
        placed = join_back(placed, later, key, "left")
    here = F.col(seq)
    first_hash, first_url = here == F.col("_h1"), F.col("url").isNull() | (here == F.col("_u1"))
    waits_for = F.when(first_hash & (here == F.col("_u2")), F.col("_u1")).when(first_url & (here == F.col("_h2")), F.col("_h1"))
    placed = reliable(
        placed.select(seq, "_hash", "url", waits_for.alias("_up"), F.coalesce(first_hash & first_url, F.lit(False)).alias("_sure"))
    )
    ways = placed.filter("_up is not null").select(seq, "_up", F.lit(True).alias("_not"))
    while True:
        further = ways.select(F.col(seq).alias("_up"), F.col("_up").alias("_top"), F.col("_not").alias("_flip"))
        ways = join_back(ways, further, "_up", "left").select(
            seq, F.coalesce("_top", "_up").alias("_up"), (F.col("_not") != F.coalesce("_flip", F.lit(False))).alias("_not"),
            F.col("_top").isNotNull().alias("_moved"),
        )
        ways = reliable(ways)
        if ways.filter("_moved").isEmpty():
            break
    sure = placed.filter("_sure").select(F.col(seq).alias("_up"))
    followed = join_back(ways.filter("not _not"), sure, "_up", "left_semi").select(seq)
    accepted = followed.unionByName(placed.filter("_sure").select(seq))
    return join_back(placed.select(seq, "_hash", "url"), accepted, seq, "left_semi")


def _first_for_both(rows: DataFrame, seq: str) -> DataFrame:
    by_hash = rows.groupBy("_hash").agg(F.min(seq).alias(seq)).select(seq)
    by_url = rows.filter("url is not null").groupBy("url").agg(F.min(seq).alias(seq))
    without_url = rows.filter("url is null").select(seq)
    firsts = by_hash.join(by_url.select(seq).unionByName(without_url), seq, "left_semi")
    return rows.join(firsts, seq, "left_semi")


def update_by_id(
    table: DataFrame, updates: DataFrame, key: str = "id", order: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """New state of the table, and what could not be applied.

    ``updates`` has rows of an id and ``changes map<string, string>``. A key that is
    present sets its field, to null if its value is null; a key that names no column is
    ignored. Of several updates of one field of one id the last in ``order`` counts, and
    among equals (or without an order) the one with the greatest value. A value that its
    column's type cannot hold changes nothing. Errors are ``key, field, value, reason``:
    ``invalid_value`` for such a value, ``unknown_id`` (field and value null) once for
    each id that the table lacks.
    """
    kinds = {f.name: f.dataType for f in table.schema if f.name != key}

    def typed(value: Column, kind: T.DataType) -> Column:
        simple = kind.typeName() not in ("struct", "array", "map")
        return value.try_cast(kind) if simple else F.from_json(value, kind.simpleString())

    at = F.col(order) if order else F.lit(0)
    entries = updates.select(F.col(key), at.alias("_at"), F.explode("changes").alias("field", "value"))
    entries = entries.filter(F.col("field").isin(*kinds))
    fits = F.lit(False)
    for name, kind in kinds.items():
        here = F.col("field") == name
        fits = F.when(here, typed(F.col("value"), kind).isNotNull()).otherwise(fits)
    fits = F.col("value").isNull() | fits
    last = F.max_by(F.struct("value"), F.struct("_at", "value"))["value"]
    folded = entries.filter(fits).groupBy(key, "field").agg(last.alias("value"))
    changed = folded.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("_changes")
    )
    joined = join_back(table, changed, key, "left")
    columns = []
    for name in table.columns:
        here = F.col(f"`{name}`")
        if name in kinds:
            given = F.coalesce(F.map_contains_key("_changes", name), F.lit(False))
            new = typed(F.element_at("_changes", name), kinds[name])
            here = F.when(given, new).otherwise(here).alias(name)
        columns.append(here)
    invalid = entries.filter(~fits).select(key, "field", "value", F.lit("invalid_value").alias("reason"))
    unknown = join_back(updates.select(key).distinct(), table.select(key).distinct(), key, "left_anti")
    nothing = F.lit(None).cast("string")
    unknown = unknown.select(
        key, nothing.alias("field"), nothing.alias("value"), F.lit("unknown_id").alias("reason")
    )
    return joined.select(*columns), invalid.unionByName(unknown)


def accepted_fields(updates: DataFrame, table: DataFrame) -> DataFrame:
    """Updates cut down to fields the table has."""
    names = F.array(*[F.lit(c) for c in table.columns])
    kept = F.map_filter("changes", lambda name, _: F.array_contains(names, name))
    return updates.withColumn("changes", kept)


def delete_ids(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return join_back(table, ids.select(key).distinct(), key, "left_anti")


def clear_references(table: DataFrame, column: str, ids: DataFrame, key: str = "id") -> DataFrame:
    """Null a 1:1 link wherever its target is among the deleted ids."""
    gone = ids.select(F.col(key).alias(column), F.lit(True).alias("_gone")).distinct()
    cleared = F.when(F.col("_gone").isNull(), F.col(column))
    joined = join_back(table, gone, column, "left").withColumn(column, cleared)
    return joined.select(table.columns)


def set_reference(table: DataFrame, column: str, links: DataFrame, key: str = "id") -> DataFrame:
    """Set a 1:1 link from ``(key, target)`` rows; others keep theirs."""
    joined = table.join(links.select(key, "target"), key, "left")
    return joined.withColumn(column, F.coalesce("target", column)).select(table.columns)


def delete_incidents(
    incidents: DataFrame, edges: DataFrame, ids: DataFrame
) -> tuple[DataFrame, DataFrame]:
    return delete_ids(incidents, ids), remove_incidents(edges, ids)


def audit_rows(
    before: DataFrame, after: DataFrame, key: str, collection: str,
    action: str | None = None, user: str | None = None, source: str | None = None,
) -> DataFrame:
    """Audit rows that lead from one version of a table to the next.

    Only fields of the new state are compared. A row that stayed equal leaves no trace.
    """
    old_fields = [c for c in before.columns if c != key]
    new_fields = [c for c in after.columns if c != key]
    old = before.select(F.col(key), F.struct(*before.columns).alias("_old"))
    new = after.select(F.col(key), F.struct(*after.columns).alias("_new"))
    both = old.join(new, key, "full_outer")
    kinds = {f.name: f.dataType for f in after.schema}
    compared = []
    for name in new_fields:
        was = F.col(f"_old.`{name}`") if name in old_fields else F.lit(None)
        now = F.col(f"_new.`{name}`")
        entry = F.struct(
            F.lit(name).alias("field"),
            F.struct(
                _as_text(was, kinds.get(name)).alias("old_value"),
                _as_text(now, kinds[name]).alias("new_value"),
            ).alias("change"),
        )
        compared.append(F.when(~was.eqNullSafe(now), entry))
    changed = F.filter(F.array(*compared), lambda e: e.isNotNull())
    is_update = F.col("_old").isNotNull() & F.col("_new").isNotNull()
    operation = (
        F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete")
    ).otherwise("update")
    rows = both.withColumn("_changed", F.when(is_update, changed))
    rows = rows.filter(~is_update | (F.size("_changed") > 0))
    changes = F.map_from_arrays(
        F.transform("_changed", lambda e: e["field"]),
        F.transform("_changed", lambda e: e["change"]),
    )
    return rows.select(
        F.col(key).cast("string").alias("document_id"),
        F.lit(collection).alias("collection_name"),
        operation.alias("operation"),
        F.current_timestamp().alias("timestamp"),
        changes.cast(CHANGE).alias("changes"),
        F.to_json("_old").alias("before_state"),
        F.to_json("_new").alias("after_state"),
        F.struct(
            F.lit(user).cast("string").alias("user_id"),
            F.lit(action).cast("string").alias("action"),
            F.lit(source).cast("string").alias("source"),
        ).alias("context"),
    )


def _as_text(value: Column, kind: T.DataType | None) -> Column:
    nested = kind is not None and kind.typeName() in ("struct", "array", "map")
    return F.to_json(value) if nested else value.cast("string")


def write_version(table: DataFrame, folder: str, version: int) -> None:
    """Store a state. Writing the same version again replaces it, so retries are safe."""
    table.write.mode("overwrite").parquet(f"{folder}/version={version:010d}")


def read_version(spark, folder: str, version: int, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{folder}/version={version:010d}")
