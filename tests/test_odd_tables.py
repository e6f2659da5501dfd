"""Queries against their SQL on tables with what the small ones lack."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from caseledger.plans.catalog import REGISTRY  # noqa: E402
from tools.check_oracle import TABLES, rows_of  # noqa: E402

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables here")


@pytest.fixture
def same(spark, tmp_path):
    """Whether a query agrees with its SQL when some tables are replaced by SQL over the given ones."""

    def run(name, **replaced):
        con = duckdb.connect()
        for table in TABLES:
            source = f"select * from '{FOLDER}/{table}.parquet'"
            path = tmp_path / f"{table}.parquet"
            if table in replaced:
                con.execute(f"copy ({replaced[table].format(f'({source})')}) to '{path}' (format parquet)")
            else:
                path.symlink_to(FOLDER / f"{table}.parquet")
            con.execute(f"create view {table} as select * from '{path}'")
        frame = REGISTRY[name].run(spark, str(tmp_path))
        got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
        cursor = con.execute(REGISTRY[name].sql)
        return got == rows_of([d[0] for d in cursor.description], cursor.fetchall())

    return run


def test_comments_and_bare_entities_of_a_short_page(same):
    odd = "'<body><p>Some &quot<b>x</b> &amp y &lt z<!-- ad 7 --><h1>short</h1></body>'"
    pages = f"select page_id, url, case when page_id % 3 = 0 then {odd} else html end as html from {{}}"
    assert same("h06_simplified_html", pages=pages)


def test_pages_that_share_a_url(same):
    assert same("j06_existing_url", pages="select page_id, 'http://a/' || page_id % 5 as url, html from {}")


def test_a_batch_whose_rows_share_urls(same):
    pages = "select page_id, 'http://a/' || page_id % 50 as url, html from {}"
    documents = "select doc_id, 'text ' || doc_id * 7 % 60 as text, lang, source, n_chars from {}"
    labels = "select doc_id, quality | (doc_id % 9 <> 0)::int as quality, toxic from {}"
    assert same("m01_insert_unique", pages=pages, documents=documents, labels=labels)


ODD_TEXTS = (
    "select doc_id, case doc_id % 13 when 0 then null when 1 then '' when 2 then ' ' when 3 then '  lead' "
    "when 4 then 'trail ' when 5 then chr(10) when 6 then 'a' || chr(13) when 7 then '\"' when 8 then 'a,\"b\" ' "
    "when 9 then chr(9) || 'x' || chr(13) || chr(10) when 10 then 'null' else text end as text, "
    "nullif(lang, 'de') as lang, source, n_chars from {}"
)


def test_hashes_of_null_and_empty_texts(same):
    assert same("m07_content_hash", documents=ODD_TEXTS)


def test_odd_texts_through_csv(same):
    assert same("s08_csv_round_trip", documents=ODD_TEXTS)


def test_odd_texts_through_csv_in_small_blocks(same, spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert same("s08_csv_round_trip", documents=ODD_TEXTS)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
