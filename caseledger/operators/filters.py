"""Predicates over case records, and the incident listing built on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseledger import rules
from caseledger.functions.text import all_of, any_of

ALL = "all"
EVENT_DATE = "extracted_information.eventData.eventDate"


def _check(name: str, value, allowed) -> None:
    if value not in allowed:
        raise ValueError(f"{name}: {value!r} is not one of {tuple(allowed)}")


@dataclass(frozen=True)
class IncidentFilters:
    """One listing request. ``all`` leaves a field unfiltered."""

    limit: int = rules.MAX_PAGE
    skip: int = 0
    sort_by: str = "event_date"
    source_type: str = ALL
    verified: str = ALL
    status: str = ALL
    IUU_type: str = ALL

    def __post_init__(self) -> None:
        if not 0 < self.limit <= rules.MAX_PAGE:
            raise ValueError(f"limit: {self.limit} is not within 1..{rules.MAX_PAGE}")
        if self.skip < 0:
            raise ValueError(f"skip: {self.skip} is negative")
        _check("sort_by", self.sort_by, rules.SORT_FIELDS)
        _check("source_type", self.source_type, (ALL, *rules.SOURCE_CATEGORIES[:3]))
        _check("verified", self.verified, (ALL, "true", "false"))
        _check("status", self.status, (ALL, *rules.RECORD_STATUSES))
        _check("IUU_type", self.IUU_type, (ALL, *rules.IUU_TYPES))

    def predicate(self) -> Column:
        """Conditions on the incident record itself."""
        conditions = []
        if self.verified != ALL:
            conditions.append(F.col("verified") == F.lit(self.verified == "true"))
        if self.status != ALL:
            conditions.append(F.col("status") == self.status)
        if self.IUU_type != ALL:
            conditions.append(has_iuu_type(self.IUU_type))
        return all_of(conditions)


def has_iuu_type(wanted: str) -> Column:
    """Some element of the classification list has this type."""
    listed = F.col("incident_classification.iuuClassifications")
    return F.coalesce(F.exists(listed, lambda c: c["IUUType"] == wanted), F.lit(False))


def matching_incidents(
    incidents: DataFrame, sources: DataFrame, filters: IncidentFilters
) -> DataFrame:
    found = incidents.filter(filters.predicate())
    if filters.source_type != ALL:
        wanted = sources.filter(F.col("category") == filters.source_type)
        wanted = wanted.select(F.col("id").alias("primary_source"))
        found = found.join(wanted, "primary_source", "left_semi")
    return found


def sort_key(name: str) -> Column:
    """Only the event date is stored; the other two fall back to it."""
    if name != "event_date":
        _check("sort_by", name, rules.SORT_FIELDS)
    return F.expr(f"try_cast({EVENT_DATE} as date)")


def page_of(found: DataFrame, filters: IncidentFilters) -> DataFrame:
    """Newest first, undated last, ties by id."""
    order = [sort_key(filters.sort_by).desc_nulls_last(), F.col("id")]
    return found.orderBy(*order).offset(filters.skip).limit(filters.limit)


def page_totals(found: DataFrame, filters: IncidentFilters) -> DataFrame:
    total = F.count(F.lit(1))
    return found.agg(
        total.alias("total"),
        F.lit(filters.limit).alias("limit"),
        F.lit(filters.skip).alias("skip"),
        (F.lit(filters.skip + filters.limit) < total).alias("has_more"),
    )


def list_incidents(
    incidents: DataFrame, sources: DataFrame, filters: IncidentFilters
) -> tuple[DataFrame, DataFrame]:
    """Page and totals, both from the same filtered rows."""
    found = matching_incidents(incidents, sources, filters)
    return page_of(found, filters), page_totals(found, filters)


def find_by_id(table: DataFrame, value, key: str = "id") -> DataFrame:
    """No row when the id is unknown; the caller decides whether that is an error."""
    return table.filter(F.col(key) == F.lit(value))


def take_page(table: DataFrame, skip: int, limit: int, *order: str) -> DataFrame:
    """Skip and limit over a stated order, so that pages never overlap."""
    return table.orderBy(*order).offset(skip).limit(limit)


def intake_verdict(url: Column, text: Column) -> Column:
    """Which request is acceptable: something given, and any text long enough."""
    nothing = (F.coalesce(url, F.lit("")) == "") & (F.coalesce(text, F.lit("")) == "")
    short = F.length(text) < rules.MIN_ARTICLE_CHARS
    return (
        F.when(nothing, "rejected")
        .when(F.coalesce(short, F.lit(False)) & (text != ""), "invalid_input")
        .otherwise("ok")
    )


@dataclass(frozen=True)
class Check:
    """A named condition every good row meets; a null verdict counts as failing."""

    name: str
    holds: Column


def one_of(column: str, allowed) -> Check:
    return Check(column, F.col(column).isin(*allowed))


def with_failed_checks(table: DataFrame, checks: list[Check]) -> DataFrame:
    """Adds ``reason``: the names of failed checks, null for a good row."""
    failed = [
        F.when(~F.coalesce(c.holds, F.lit(False)), F.lit(c.name)) for c in checks
    ]
    listed = F.concat_ws(",", *failed)
    return table.withColumn("reason", F.nullif(listed, F.lit("")))


def split_valid(table: DataFrame, checks: list[Check]) -> tuple[DataFrame, DataFrame]:
    checked = with_failed_checks(table, checks)
    valid = checked.filter(F.col("reason").isNull()).drop("reason")
    return valid, checked.filter(F.col("reason").isNotNull())


Query = str | tuple
"""A term, or ``("and" | "or", part, part, ...)`` with parts of the same kind."""


def matches(text: Column, query: Query, whole_words: bool = False) -> Column:
    """Boolean keyword search over free text, case ignored."""
    if isinstance(query, str):
        term = query.lower()
        if whole_words:
            quoted = "".join("\\" + c if not c.isalnum() and c.isascii() else c for c in term)
            return F.lower(text).rlike(rf"(?U)(?<!\w){quoted}(?!\w)")
        return F.contains(F.lower(text), F.lit(term))
    kind, *parts = query
    _check("query", kind, ("and", "or"))
    combine = all_of if kind == "and" else any_of
    return combine([matches(text, part, whole_words) for part in parts])


def keyword_category(term: Column) -> Column:
    lowered = F.lower(term)
    return (
        F.when(lowered.isin(*rules.FISH_TERMS), "fish")
        .when(lowered.isin(*rules.ENFORCEMENT_TERMS), "enforcement")
        .otherwise("other")
    )
