"""JSON payloads: plain arrays, envelopes and paged answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseledger import schemas

TAXA_PER_PAGE = 500
ASSESSMENTS_PER_PAGE = 100
ARTICLES_PER_PAGE = 100


_BAD = "_corrupt_record"


def _parted(read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sound rows, and ``file, record, fields`` of those that are no valid JSON.

    ``fields`` is what could be read of the record.
    """
    bad = F.col(_BAD).isNotNull()
    fields = F.to_json(F.struct(*[F.col(f"`{c}`") for c in read.columns if c not in (_BAD, "_file")]))
    # true of every record; names a field, as Spark asks of queries that look for rejects
    read_at_all = ~fields.eqNullSafe(F.lit(""))
    rejected = read.filter(bad & read_at_all).select(F.col("_file").alias("file"), F.col(_BAD).alias("record"), fields.alias("fields"))
    return read.filter(~bad & read_at_all).drop(_BAD, "_file"), rejected


def read_rows(
    spark: SparkSession, path: str, schema: str, multi_line: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Rows of files that hold one array of objects (or with ``multi_line`` off one per
    line), and the records that could not be read.

    Arrays per line are the form for large data: a file of many lines can be split. A
    record with a malformed element is rejected, never turned into blanks.
    """
    reader = spark.read.schema(f"{schema}, `{_BAD}` string").option("columnNameOfCorruptRecord", _BAD)
    read = reader.json(path, multiLine=multi_line)
    return _parted(read.select("*", F.col("_metadata.file_path").alias("_file")))


def _envelopes(
    spark: SparkSession, path: str, fields: tuple[str, ...], multi_line: bool
) -> tuple[DataFrame, DataFrame]:
    # read as text: an array arrives as its JSON, and so does an array that was
    # itself stored as a JSON string
    schema = ", ".join(f"`{f}` string" for f in fields)
    return read_rows(spark, path, schema, multi_line)


def explode_arrays(
    envelopes: DataFrame, names: tuple[str, ...], element: str, *keep: str
) -> DataFrame:
    """One row per element of the first present array; none when no array is there."""
    text = F.coalesce(*[F.col(f"`{n}`") for n in names])
    items = F.from_json(text, f"array<{element}>")
    found = envelopes.select(*keep, F.posexplode(items).alias("position", "item"))
    return found.select(*keep, "position", "item.*")


def read_envelope(
    spark: SparkSession, path: str, names: tuple[str, ...], element: str, multi_line: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Elements of the envelopes' arrays, and what could not be read."""
    envelopes, rejected = _envelopes(spark, path, names, multi_line)
    return explode_arrays(envelopes, names, element).drop("position"), rejected


def read_assessments(
    spark: SparkSession, path: str, multi_line: bool = True
) -> tuple[DataFrame, DataFrame]:
    """The merged form names its array ``result``, the service ``assessments``."""
    names = ("result", "assessments")
    return read_envelope(spark, path, names, schemas.ASSESSMENT, multi_line)


def read_taxa(
    spark: SparkSession, path: str, multi_line: bool = True
) -> tuple[DataFrame, DataFrame]:
    pages, rejected = read_rows(spark, path, schemas.TAXA_PAGE, multi_line)
    return pages.select(F.explode("taxon_concepts").alias("t")).select("t.*"), rejected


def read_pages(
    spark: SparkSession, path: str, number: str, total: str, items: str, element: str, multi_line: bool = True
) -> tuple[DataFrame, DataFrame]:
    """``page, total_entries, items`` of page files, and what could not be read.

    A page's number is in its payload (``number`` and the other two name fields), not in
    the file name or the order of files. A page that cannot be read, or names no number,
    is missing. A page that is there twice counts once.
    """
    schema = f"`{number}` bigint, `{total}` bigint, `{items}` array<{element}>"
    pages, rejected = read_rows(spark, path, schema, multi_line)
    pages = pages.toDF("page", "total_entries", "items").filter("page is not null")
    return pages.withColumn("items", F.coalesce("items", F.array().cast(f"array<{element}>"))).dropDuplicates(["page"]), rejected


def merge_pages(
    pages: DataFrame, per_page: int, items: str = "items"
) -> tuple[DataFrame, DataFrame]:
    """Elements of a paged answer in order, and its totals block.

    ``pages(page, total_entries, items)``. Reading stops where a client would: after the
    first short page, once the total announced by page 1 is reached, or before a
    missing page; an announced total of 0 gives nothing. ``total_entries`` may be null
    when the service announces none.
    """
    numbers = pages.select("page", F.size(items).alias("_size"), "total_entries")
    after = numbers.select((F.col("page") - 1).alias("page")).distinct()
    last_in_row = numbers.join(after, "page", "left_anti").agg(F.min("page")).scalar()
    announced = F.max(F.when(F.col("page") == 1, F.col("total_entries")))
    full = F.greatest(F.ceil(announced / per_page), F.lit(1))
    ends = numbers.agg(
        F.min(F.when(F.col("_size") < per_page, F.col("page"))).alias("short"),
        F.when(announced.isNotNull(), full).alias("full"),
    )
    last = ends.select(F.least("short", "full", last_in_row)).scalar()
    nothing = F.coalesce(numbers.agg(announced).scalar() == 0, F.lit(False))
    read = pages.filter(F.col("page") <= last)
    read = read.withColumn(items, F.when(nothing, F.slice(items, 1, 0)).otherwise(F.col(items)))
    elements = read.select("page", F.posexplode(items).alias("position", "item"))
    totals = read.agg(
        F.max(F.when(F.col("page") == 1, F.col("total_entries"))).alias("total_entries"),
        F.max("page").alias("pages_fetched"),
        F.lit(per_page).alias("per_page"),
        F.coalesce(F.sum(F.size(items)), F.lit(0)).alias("actual_entries"),
    )
    return elements, totals
