"""Raw pages to titles, simplified HTML and text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseledger.functions import html as markup
from caseledger.functions.text import fold_to_ascii

PAGE_COLUMNS = (
    "page_id bigint, url string, title string, filtered_html string, text string, "
    "stage1_kept boolean, stage2_kept boolean, stage3_kept boolean, error string"
)
LISTING_COLUMNS = (
    "page_id bigint, position int, title string, link string, excerpt string, "
    "date string, region string, error string"
)


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
SLICE = 32  # pages that are Python objects at once; a batch itself may hold thousands


def _by_slices(pages: DataFrame, columns: str, rows_of: Callable[..., Iterator[dict]]) -> DataFrame:
    """The rows that ``rows_of`` makes of each page, given out slice by slice."""
    schema = pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in columns.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                rows = [row for page in batch.slice(start, SLICE).to_pylist() for row in rows_of(**page)]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return pages.mapInArrow(run, columns)


def _clean(page_id: int, url: str, html: str) -> Iterator[dict]:
    row = {"page_id": page_id, "url": url}
    try:
        simple, kept = markup.simplify(html)
        row |= {"title": markup.title_of(html), "filtered_html": simple, "text": markup.plain_text(simple)}
        row |= {f"stage{n}_kept": k for n, k in enumerate(kept, 1)}
    except Exception as problem:  # one bad page must not stop the others
        row = {"page_id": page_id, "url": url, "error": f"{type(problem).__name__}: {problem}"}
    yield row


def clean_pages(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` cleaned in stages; failures carry ``error``."""
    return _by_slices(pages.select("page_id", "url", "html"), PAGE_COLUMNS, _clean)


def _list(page_id: int, html: str) -> Iterator[dict]:
    try:
        for at, found in enumerate(markup.listing_rows(html)):
            yield {"page_id": page_id, "position": at, **found}
    except Exception as problem:
        yield {"page_id": page_id, "error": f"{type(problem).__name__}: {problem}"}


def listing_entries(pages: DataFrame) -> DataFrame:
    """Result blocks of listing pages; title and excerpt folded to ASCII."""
    found = _by_slices(pages.select("page_id", "html"), LISTING_COLUMNS, _list)
    return found.withColumns(
        {"title": fold_to_ascii(F.col("title")), "excerpt": fold_to_ascii(F.col("excerpt"))}
    )
