"""Case records seen in the given tables.

Orders stand for incidents, customers for their sources, the return flags of an order's
lines for the classifications of an incident.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseledger.plans.registry import Tables

STATUS_OF = {"O": "extracted", "F": "user_input", "P": "modified"}
TYPE_OF = {"R": "Illegal Fishing", "A": "Unreported Catch", "N": "Other"}
CATEGORY_OF = {
    "AUTOMOBILE": "url", "BUILDING": "text_upload", "FURNITURE": "pdf",
    "HOUSEHOLD": "url", "MACHINERY": "academic",
}

INCIDENTS_SQL = """
incident_rows AS (
  SELECT o_orderkey AS id, o_custkey AS primary_source, o_totalprice > 250000 AS verified,
    CASE o_orderstatus WHEN 'O' THEN 'extracted' WHEN 'F' THEN 'user_input'
      WHEN 'P' THEN 'modified' END AS status,
    CASE WHEN o_orderpriority <> '4-NOT SPECIFIED'
      THEN strftime(o_orderdate, '%Y-%m-%d') END AS event_date
  FROM orders),
incident_types AS (
  SELECT DISTINCT l_orderkey AS id, CASE l_returnflag WHEN 'R' THEN 'Illegal Fishing'
    WHEN 'A' THEN 'Unreported Catch' WHEN 'N' THEN 'Other' END AS iuu_type
  FROM lineitem),
source_rows AS (
  SELECT c_custkey AS id, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'url'
    WHEN 'BUILDING' THEN 'text_upload' WHEN 'FURNITURE' THEN 'pdf'
    WHEN 'HOUSEHOLD' THEN 'url' WHEN 'MACHINERY' THEN 'academic' END AS category
  FROM customer)
"""


def mapped(column: str, names: dict[str, str]) -> Column:
    out = None
    for value, name in names.items():
        hit = F.col(column) == value
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def incidents(t: Tables) -> DataFrame:
    """Nested incident records; their classifications are a set of three at most."""
    found = {flag: F.max(F.col("l_returnflag") == flag).alias(flag) for flag in TYPE_OF}
    flags = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(*found.values())
    listed = [
        F.when(F.col(flag), F.struct(
            F.lit(name).alias("IUUType"), F.lit("reported").alias("IUUTypeReason")
        ))
        for flag, name in TYPE_OF.items()
    ]
    kinds = flags.select("id", F.array_compact(F.array(*listed)).alias("_listed"))
    day = F.when(
        F.col("o_orderpriority") != "4-NOT SPECIFIED", F.date_format("o_orderdate", "yyyy-MM-dd")
    ).otherwise("Not specified")
    base = t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("primary_source"),
        (F.col("o_totalprice") > 250000).alias("verified"),
        mapped("o_orderstatus", STATUS_OF).alias("status"),
        F.struct(F.struct(day.alias("eventDate")).alias("eventData")).alias(
            "extracted_information"
        ),
    )
    return base.join(kinds, "id", "left").select(
        *base.columns, F.struct(F.col("_listed").alias("iuuClassifications")).alias(
            "incident_classification"
        )
    )


def sources(t: Tables) -> DataFrame:
    return t.customer.select(
        F.col("c_custkey").alias("id"), mapped("c_mktsegment", CATEGORY_OF).alias("category"),
        F.col("c_name").alias("publisher"),
    )


def articles(t: Tables) -> DataFrame:
    """Documents as intake rows, in order of their id."""
    pages = t.pages.select(F.col("page_id").alias("doc_id"), "url")
    return t.documents.join(pages, "doc_id", "left").select(
        F.col("doc_id").alias("seq"), F.col("text").alias("article_text"), "url",
        F.col("source").alias("author"), "lang",
    )
