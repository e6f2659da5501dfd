"""Nested payloads to flat rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseledger.functions.text import default_if_missing, join_non_empty

# Output columns in order
TAXON_FIELDS = (
    "id", "full_name", "author_year", "rank", "name_status", "active", "cites_listing",
    "updated_at",
)
HIGHER_TAXA = ("kingdom", "phylum", "class", "order", "family")
TAXON_COLUMNS = (*TAXON_FIELDS, *HIGHER_TAXA, "common_name_en", "all_common_names")
ASSESSMENT_FIELDS = (
    "taxon_scientific_name", "year_published", "latest", "red_list_category_code",
    "possibly_extinct", "possibly_extinct_in_the_wild", "sis_taxon_id", "assessment_id",
    "url",
)
ASSESSMENT_COLUMNS = (*ASSESSMENT_FIELDS, "scope_descriptions", "scope_codes")
TARIFF_COLUMNS = (
    "htsno", "indent", "description", "superior", "units", "general", "special", "other",
    "footnotes", "quotaQuantity", "additionalDuties", "addiitionalDuties",
)


def flatten_taxa(taxa: DataFrame) -> DataFrame:
    names = F.col("common_names")
    english = F.filter(names, lambda n: n["language"] == "EN")
    labelled = F.transform(
        names, lambda n: F.format_string("%s (%s)", n["name"], n["language"])
    )
    return taxa.select(
        *TAXON_FIELDS,
        *[F.col(f"higher_taxa.`{level}`").alias(level) for level in HIGHER_TAXA],
        F.get(english, F.lit(0))["name"].alias("common_name_en"),
        join_non_empty(labelled, "; ").alias("all_common_names"),
    )


def _present(values: Column) -> Column:
    return F.filter(values, lambda v: v.isNotNull() & (v != ""))


def flatten_assessments(assessments: DataFrame) -> DataFrame:
    scopes = F.col("scopes")
    described = _present(F.transform(scopes, lambda s: s["description"]["en"]))
    codes = _present(F.transform(scopes, lambda s: s["code"]))
    return assessments.select(
        *ASSESSMENT_FIELDS,
        join_non_empty(described, "; ").alias("scope_descriptions"),
        join_non_empty(codes, "; ").alias("scope_codes"),
    )


def flatten_footnotes(notes: Column) -> Column:
    lines = F.transform(
        notes,
        lambda n: F.concat(
            F.lit("["), F.coalesce(n["type"], F.lit("")),
            F.lit("] "), F.coalesce(n["value"], F.lit("")),
            F.lit(" (cols: "), F.coalesce(F.array_join(n["columns"], ", "), F.lit("")),
            F.lit(")"),
        ),
    )
    return F.coalesce(F.array_join(lines, " | "), F.lit(""))


def flatten_tariffs(rows: DataFrame) -> DataFrame:
    """Twelve text columns; anything missing becomes the empty string."""
    written = {
        "units": F.array_join("units", ", "),
        "footnotes": flatten_footnotes(F.col("footnotes")),
    }
    return rows.select(
        *[
            F.coalesce(written.get(c, F.col(c)).cast("string"), F.lit("")).alias(c)
            for c in TARIFF_COLUMNS
        ]
    )


DISTRIBUTION_FIELDS = ("id", "iso_code2", "name", "type")


def distributions_long(rows: DataFrame) -> DataFrame:
    """One row per reference of a distribution; one without any is kept."""
    return rows.select(
        *DISTRIBUTION_FIELDS,
        F.array_join("tags", " ").alias("tags"),
        F.posexplode_outer("references").alias("_at", "reference"),
    ).select("*", (F.col("_at") + 1).alias("reference_number")).drop("_at")


def distributions_wide(rows: DataFrame, n: int) -> DataFrame:
    numbered = [
        F.get("references", F.lit(i)).alias(f"reference_{i + 1}") for i in range(n)
    ]
    return rows.select(
        *DISTRIBUTION_FIELDS, F.array_join("tags", " ").alias("tags"), *numbered
    )


def without_links(answer: DataFrame) -> DataFrame:
    """The answer to a caller: link fields of source, incidents and overview left out.

    Expects ``source`` and ``overview`` structs and an ``incidents`` array of structs.
    """
    return answer.withColumns(
        {
            "source": F.col("source").dropFields("incidents", "overview"),
            "incidents": F.transform(
                "incidents", lambda i: i.dropFields("sources", "primary_source")
            ),
            "overview": F.col("overview").dropFields("source"),
        }
    )


def assemble_report(payload: Column, schema: str) -> Column:
    """Parse a model's answer; null when it is not an object of that shape."""
    parsed = F.from_json(payload, schema, {"mode": "PERMISSIVE"})
    complete = F.get_json_object(payload, "$").isNotNull()
    return F.when(complete, parsed)


def fill_missing(table: DataFrame, defaults: dict[str, str]) -> DataFrame:
    return table.withColumns(
        {name: default_if_missing(F.col(name), value) for name, value in defaults.items()}
    )
