"""Counts and summaries that accompany the merge and URL jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseledger import rules
from caseledger.functions.urls import netloc
from caseledger.operators.ordering import keep_first


def dedup_accounting(table: DataFrame, keys: list[str], by: str | None = None) -> DataFrame:
    """Initial, final and removed row counts, from one pass over the keys.

    Groups with equal keys are counted first, so the shuffle carries distinct keys.
    """
    group = [f"`{by}`"] if by else []
    distinct = table.groupBy(*group, *[f"`{k}`" for k in keys]).agg(F.count(F.lit(1)).alias("_copies"))
    counted = distinct.groupBy(*group).agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("initial_rows"),
        F.count(F.lit(1)).alias("final_rows"),
    )
    return counted.withColumn("removed", F.col("initial_rows") - F.col("final_rows"))


def file_summary(table: DataFrame) -> DataFrame:
    """Rows per input file, with the column list of the merged table."""
    data = [c for c in table.columns if c not in rules.PROVENANCE]
    return table.groupBy(*rules.PROVENANCE).agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(data)).alias("columns"),
        F.lit(", ".join(data)).alias("column_list"),
    )


def merge_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """Per kind: files, rows in, duplicates, rows out, columns."""
    lines = None
    for kind, table in tables.items():
        data = [c for c in table.columns if c not in rules.PROVENANCE]
        files = table.select(*rules.PROVENANCE).distinct().agg(F.count(F.lit(1))).scalar()
        line = dedup_accounting(table, data).select(
            F.lit(kind).alias("kind"),
            files.alias("files"),
            "initial_rows", "removed", "final_rows",
            F.lit(len(data)).alias("columns"),
        )
        lines = line if lines is None else lines.unionByName(line)
    return lines


def merge_kind(table: DataFrame) -> DataFrame:
    """Keep-first over the data columns; the kept row keeps its origin."""
    data = [c for c in table.columns if c not in rules.PROVENANCE and c != "row_number"]
    order = [*rules.PROVENANCE, "row_number"]
    return keep_first(table, data, order).drop("row_number")


def date_span(table: DataFrame, date: Column) -> DataFrame:
    day = date.cast("date")
    days = F.date_diff(F.max(day), F.min(day))
    return table.agg(
        F.min(day).alias("first_date"),
        F.max(day).alias("last_date"),
        days.alias("days"),
        F.round(days / 365.25, 1).alias("years"),
    )


def unique_count(table: DataFrame, column: str) -> DataFrame:
    """Distinct values, all nulls together counting as one more."""
    has_null = F.coalesce(F.max(F.col(column).isNull().cast("int")), F.lit(0))
    return table.agg(
        (F.count_distinct(F.col(column)) + has_null).cast("bigint").alias("unique_values")
    )


def top_hosts(table: DataFrame, url: str, n: int = 5) -> DataFrame:
    counted = table.groupBy(netloc(F.col(url)).alias("host")).count()
    return counted.orderBy(F.desc("count"), "host").limit(n)


def query_statistics(queries: DataFrame, query: str = "query") -> DataFrame:
    size = F.length(query)
    zero = F.lit(0)
    return queries.agg(
        F.count(query).alias("total_queries"),
        F.coalesce(F.max(size), zero).alias("max_length"),
        F.coalesce(F.min(size), zero).alias("min_length"),
        F.coalesce(F.avg(size), F.lit(0.0)).alias("avg_length"),
        F.count_if(size > rules.QUERY_CHARS).alias("over_limit"),
    )


def concat_kinds(tables: list[DataFrame]) -> DataFrame:
    """Rows of all tables; a column missing in one is null there."""
    merged = tables[0]
    for table in tables[1:]:
        merged = merged.unionByName(table, allowMissingColumns=True)
    return merged
