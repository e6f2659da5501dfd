"""Files, merging, joins and their accounting, the URL job."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseledger import schemas
from caseledger.functions import urls
from caseledger.functions.text import sha256_hex
from caseledger.operators import accounting as ac
from caseledger.operators import joins as jn
from caseledger.operators import ordering as od
from caseledger.operators.flatten import flatten_assessments, flatten_tariffs
from caseledger.plans.listing import HOST, HTTP, TITLE_SQL
from caseledger.plans.registry import Tables, query
from caseledger.sources import payloads, spreadsheets, tables
from caseledger.storage import new_folder


def _section():
    """Scheme, host and first path segment: several pages share one."""
    return F.regexp_extract("url", "^https?://[^/]+/[a-z]+", 0)


def _spreadsheets(t: Tables, notes: bool = False) -> str:
    """Customers, suppliers and nations as a folder of folders of spreadsheets; if ``notes``,
    one more whose header repeats a name, as it is and in capitals."""
    base = new_folder(t.spark, "spreadsheets")
    people = t.customer.select(
        F.col("c_custkey").alias("Report ID"), F.col("c_mktsegment").alias("Subject"),
        F.col("c_nationkey").alias("Country"),
    )
    places = t.supplier.select(
        F.col("s_suppkey").alias("Report ID"), F.col("s_name").alias("Place"),
        F.col("s_nationkey").alias("Country"),
    )
    first = people.filter("`Subject` <> 'BUILDING'")
    second = people.filter("`Subject` <> 'MACHINERY'").withColumn("Outcome", F.lit("open"))
    spreadsheets.write_csv(first, f"{base}/east/incident-data-1.csv")
    spreadsheets.write_csv(first, f"{base}/west/incident-data-1.csv")
    spreadsheets.write_csv(second, f"{base}/west/incident-data-2.csv")
    spreadsheets.write_csv(places, f"{base}/east/incident-summary-and-locations-1.csv")
    spreadsheets.write_csv(t.nation, f"{base}/west/nations.csv")
    if notes:
        lines = t.region.select(F.concat_ws(",", "r_regionkey", F.lit('"a, b"'), "r_name", F.concat(F.lit("x"), "r_regionkey")))
        head = t.region.limit(1).select(F.lit("Report ID,note,note,NOTE"))
        head.unionByName(lines.toDF(head.columns[0])).coalesce(1).write.text(f"{base}/east/notes.csv")
    return base


SHEETS_SQL = """
people AS (SELECT c_custkey::VARCHAR AS report_id, c_mktsegment AS subject,
  c_nationkey::VARCHAR AS country FROM customer),
data_rows AS (
  SELECT 'east' AS source_folder, 'incident-data-1.csv' AS source_file, *, NULL::VARCHAR AS outcome
    FROM people WHERE subject <> 'BUILDING'
  UNION ALL SELECT 'west', 'incident-data-1.csv', *, NULL FROM people WHERE subject <> 'BUILDING'
  UNION ALL SELECT 'west', 'incident-data-2.csv', *, 'open' FROM people WHERE subject <> 'MACHINERY'),
place_rows AS (SELECT s_suppkey::VARCHAR AS report_id, s_name AS place,
  s_nationkey::VARCHAR AS country FROM supplier)
"""


@query(f"""
WITH {SHEETS_SQL}
SELECT 'incident-data' AS kind, source_folder, source_file, report_id, outcome FROM data_rows
UNION ALL SELECT 'incident-summary-and-locations', 'east', 'incident-summary-and-locations-1.csv',
  report_id, NULL FROM place_rows
UNION ALL SELECT 'other', 'west', 'nations.csv', n_nationkey::VARCHAR, NULL FROM nation
UNION ALL SELECT 'other', 'east', 'notes.csv', r_regionkey::VARCHAR, r_name FROM region
""")
def s01_folder_scan(spark, folder):
    found = spreadsheets.scan_kinds(spark, _spreadsheets(Tables(spark, folder), notes=True))
    own = {"other": ("coalesce(`Report ID`, n_nationkey)", "`note.1`"), "incident-data": ("`Report ID`", "Outcome")}
    out = None
    for kind, rows in found.items():
        key, outcome = own.get(kind, ("`Report ID`", "string(null)"))
        part = rows.select(
            F.lit(kind).alias("kind"), "source_folder", "source_file",
            F.expr(key).alias("report_id"), F.expr(outcome).alias("outcome"),
        )
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT 'odd' AS source_folder, 'not UTF-8' AS reason, count(*) AS files FROM nation")
def s01_skipped_files(spark, folder):
    """A file for each nation whose header holds a byte that is no UTF-8."""
    t = Tables(spark, folder)
    base = _spreadsheets(t)
    heads = t.nation.select(F.concat(F.lit("caf"), F.unhex(F.lit("E9")).cast("string"), F.lit(","), "n_name"))
    heads.coalesce(1).write.option("maxRecordsPerFile", 1).text(f"{base}/odd/incident-data-9.csv")
    skipped = spreadsheets.skipped_files(spark, base)
    place = F.regexp_extract("path", "([^/]+)/[^/]+/[^/]+$", 1).alias("source_folder")
    return skipped.groupBy(place, "reason").agg(F.count(F.lit(1)).alias("files"))


@query("SELECT p_brand, count(*) AS parts FROM part GROUP BY p_brand")
def s02_column_by_position(spark, folder):
    path = new_folder(spark, "parts")
    spreadsheets.write_csv(Tables(spark, folder).part, path)
    column = spreadsheets.column_at(spreadsheets.read_csv(spark, path), 2)
    return column.groupBy("p_brand").agg(F.count(F.lit(1)).alias("parts"))


@query("SELECT p_name AS term, count(*) AS times FROM part GROUP BY p_name")
def s03_keyword_list(spark, folder):
    path = new_folder(spark, "terms")
    lines = Tables(spark, folder).part.select(F.concat(F.lit("  "), "p_name", F.lit("\t")))
    blank = lines.select(F.lit("Keyword ").alias("value")).unionByName(
        lines.select(F.lit("").alias("value"))
    )
    lines.toDF("value").unionByName(blank).write.text(path)
    terms = spreadsheets.read_keywords(spark, path)
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("times"))


@query("""
SELECT l_orderkey || '.' || l_linenumber AS htsno, l_returnflag || ', ' || l_linestatus AS units,
  l_orderkey::VARCHAR AS description FROM lineitem
UNION ALL SELECT l_orderkey || '.' || l_linenumber || 'x', '', '' FROM lineitem
""")
def s04_json_rows(spark, folder):
    path = new_folder(spark, "tariffs")
    number = F.concat_ws(".", "l_orderkey", "l_linenumber")
    full = F.struct(
        number.alias("htsno"), F.array("l_returnflag", "l_linestatus").alias("units"),
        F.col("l_orderkey").cast("string").alias("description"),
    )
    bare = F.struct(
        F.concat(number, F.lit("x")).alias("htsno"),
        F.lit(None).cast("array<string>").alias("units"),
        F.lit(None).cast("string").alias("description"),
    )
    lines = Tables(spark, folder).lineitem.select(F.to_json(F.array(full, bare)))
    lines.write.text(path)
    rows, _ = payloads.read_rows(spark, path, schemas.TARIFF_ROW, multi_line=False)
    return flatten_tariffs(rows).select("htsno", "units", "description")


@query("""
SELECT event_id AS sis_taxon_id, event_type AS taxon_scientific_name,
  (props ->> '$.k') AS scope_codes
FROM events WHERE event_type <> 'error'
""")
def s05_json_envelope(spark, folder):
    path = new_folder(spark, "envelopes")
    item = F.struct(
        F.col("event_id").alias("sis_taxon_id"),
        F.col("event_type").alias("taxon_scientific_name"),
        F.array(F.struct(F.get_json_object("props", "$.k").alias("code"))).alias("scopes"),
    )
    items = F.array(item)
    as_text = F.to_json(items)
    kind = F.col("event_type")
    envelope = (
        F.when(kind == "click", F.to_json(F.struct(items.alias("result"))))
        .when(kind == "view", F.to_json(F.struct(items.alias("assessments"))))
        .when(kind == "purchase", F.to_json(F.struct(as_text.alias("result"))))
        .when(kind == "signup", F.to_json(F.struct(as_text.alias("assessments"))))
        .otherwise(F.to_json(F.struct(kind.alias("message"))))
    )
    Tables(spark, folder).events.select(envelope).write.text(path)
    rows, _ = payloads.read_assessments(spark, path, multi_line=False)
    return flatten_assessments(rows).select("sis_taxon_id", "taxon_scientific_name", "scope_codes")


@query("""
SELECT '{"htsno": "' || l_orderkey || '.' || l_linenumber || '", "units": [' AS record, count(*) AS n
FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1
UNION ALL SELECT 'sound', count(*) FROM lineitem WHERE l_returnflag <> 'R'
""")
def s04_rejected_rows(spark, folder):
    """Returned lines are cut off in the middle of a record."""
    path = new_folder(spark, "tariffs")
    number = F.concat_ws(".", "l_orderkey", "l_linenumber")
    cut = F.concat(F.lit('{"htsno": "'), number, F.lit('", "units": ['))
    whole = F.to_json(F.struct(number.alias("htsno"), F.array("l_linestatus").alias("units")))
    lines = Tables(spark, folder).lineitem
    lines.select(F.when(F.col("l_returnflag") == "R", cut).otherwise(whole)).write.text(path)
    rows, rejected = payloads.read_rows(spark, path, schemas.TARIFF_ROW, multi_line=False)
    count = F.count(F.lit(1)).alias("n")
    return rejected.groupBy("record").agg(count).unionByName(rows.agg(count).select(F.lit("sound").alias("record"), "n"))


PAGE_SIZE = 100


def _order_pages(t: Tables, broken: bool = False):
    """Orders as page files, read again; if ``broken``, page 8 of ten is not there and 7 is cut off."""
    path = new_folder(t.spark, "pages")
    page = (F.floor(F.col("o_orderkey") / PAGE_SIZE) + 1).alias("page")
    item = F.struct("o_orderkey", "o_orderstatus")
    pages = t.orders.groupBy(page).agg(F.array_sort(F.collect_list(item)).alias("items"))
    total, last = t.orders.agg(F.count(F.lit(1))).scalar(), t.orders.agg(F.max("o_orderkey")).scalar()
    pages = pages.withColumn("payload", F.to_json(F.struct("page", total.alias("total_entries"), "items")))
    if broken:
        tenth = F.floor(last / PAGE_SIZE / 10)
        cut = F.expr("substr(payload, 1, length(payload) - 9)")
        pages = pages.filter(F.col("page") != 8 * tenth)
        pages = pages.withColumn("payload", F.when(F.col("page") == 7 * tenth, cut).otherwise(F.col("payload")))
    pages.select("payload").write.text(path)
    return payloads.read_pages(
        t.spark, path, "page", "total_entries", "items", "struct<o_orderkey: bigint, o_orderstatus: string>", multi_line=False
    )


@query(f"""
WITH cut AS (SELECT 7 * (max(o_orderkey) // {PAGE_SIZE} // 10) AS page FROM orders)
SELECT o_orderkey // {PAGE_SIZE} + 1 AS page, o_orderkey % {PAGE_SIZE} AS position, o_orderkey,
  o_orderstatus FROM orders WHERE o_orderkey // {PAGE_SIZE} + 1 < (SELECT page FROM cut)
""")
def s06_paged_merge(spark, folder):
    """Pages up to the first that is not to be had."""
    pages, _ = _order_pages(Tables(spark, folder), broken=True)
    elements, _ = payloads.merge_pages(pages, PAGE_SIZE)
    return elements.select("page", F.col("position").cast("bigint").alias("position"), "item.*")


@query(f"""
SELECT 7 * (max(o_orderkey) // {PAGE_SIZE} // 10) AS page, count(*) AS pages FROM orders
WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders)
""")
def s06_unreadable_pages(spark, folder):
    _, rejected = _order_pages(Tables(spark, folder), broken=True)
    number = F.get_json_object("fields", "$.page").cast("bigint")
    number = F.coalesce(number, F.regexp_extract("record", '"page":(\\d+)', 1).cast("bigint"))
    return rejected.groupBy(number.alias("page")).agg(F.count(F.lit(1)).alias("pages"))


@query(f"""
SELECT count(*) AS total_entries, max(o_orderkey // {PAGE_SIZE} + 1) AS pages_fetched,
  {PAGE_SIZE} AS per_page, count(*) AS actual_entries FROM orders
""")
def a14_entries_per_envelope(spark, folder):
    return payloads.merge_pages(_order_pages(Tables(spark, folder))[0], PAGE_SIZE)[1]


@query("""
SELECT doc_id::VARCHAR AS id, lang AS publisher, NULL::VARCHAR AS overview,
  sha256(text) AS article_hash FROM documents
""")
def s07_collection_scan(spark, folder):
    base = new_folder(spark, "collections")
    docs = Tables(spark, folder).documents.select(
        F.col("doc_id").cast("string").alias("id"), F.col("text").alias("article_text"),
        F.col("lang").alias("publisher"), sha256_hex(F.col("text")).alias("article_hash"),
    )
    tables.write_collection(docs, base, "sources")
    stored = tables.read_collection(spark, base, "sources")
    return stored.select("id", "publisher", "overview", "article_hash")


@query("SELECT doc_id::VARCHAR AS doc_id, lang, sha256(text) AS text_hash FROM documents")
def s08_csv_round_trip(spark, folder):
    path = new_folder(spark, "csv")
    docs = Tables(spark, folder).documents.select("doc_id", "text", "lang")
    spreadsheets.write_csv(docs, path)
    back = spreadsheets.read_csv(spark, path, "doc_id string, text string, lang string", keep_empty=True)
    return back.select("doc_id", "lang", sha256_hex(F.col("text")).alias("text_hash"))


@query(f"SELECT url, {TITLE_SQL} AS title, {HOST.format('url')} AS site FROM pages")
def s09_json_rows_sink(spark, folder):
    path = new_folder(spark, "articles")
    articles = Tables(spark, folder).pages.select(
        "url", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"),
        urls.netloc(F.col("url")).alias("site"),
    )
    tables.write_rows(articles, path)
    return spark.read.schema("url string, title string, site string").json(path)


@query("""
SELECT page_id, url FROM pages WHERE page_id NOT IN (SELECT doc_id FROM labels)
""")
def s11_resume_from_progress(spark, folder):
    t = Tables(spark, folder)
    base = new_folder(spark, "progress")
    done = t.pages.select("page_id").join(
        t.labels.select(F.col("doc_id").alias("page_id")), "page_id", "left_semi"
    )
    tables.save_progress(done, base, 1)
    tables.save_progress(done, base, 1)
    return tables.remaining_work(t.pages.select("page_id", "url"), spark, base, "page_id")


@query(f"""
WITH {SHEETS_SQL},
ranked AS (SELECT *, row_number() OVER (PARTITION BY report_id, subject, country, outcome
  ORDER BY source_folder, source_file) AS rn FROM data_rows)
SELECT report_id, subject, country, outcome, source_folder, source_file FROM ranked WHERE rn = 1
""")
def w01_merge_keep_first(spark, folder):
    rows = spreadsheets.scan_kinds(spark, _spreadsheets(Tables(spark, folder)))["incident-data"]
    return ac.merge_kind(rows).toDF(
        "report_id", "subject", "country", "outcome", "source_folder", "source_file"
    )


@query("SELECT lang, sha256(text) AS text_hash, min(doc_id) AS doc_id FROM documents GROUP BY ALL")
def w01_keep_first_text(spark, folder):
    docs = Tables(spark, folder).documents.select(
        "doc_id", "lang", sha256_hex(F.col("text")).alias("text_hash")
    )
    return od.keep_first(docs, ["lang", "text_hash"], ["doc_id"])


@query("SELECT DISTINCT lang, source, sha256(text) AS text_hash FROM documents")
def w02_drop_duplicates(spark, folder):
    docs = Tables(spark, folder).documents
    rows = docs.select("lang", "source", sha256_hex(F.col("text")).alias("text_hash"))
    return od.keep_first(rows, rows.columns, rows.columns)


@query("""
SELECT 'Q' || lpad(n::VARCHAR, greatest(3, length(n::VARCHAR))::INTEGER, '0') AS label, p_partkey
FROM (SELECT row_number() OVER (ORDER BY p_name, p_partkey) AS n, p_partkey FROM part)
""")
def w03_running_labels(spark, folder):
    parts = Tables(spark, folder).part.select("p_name", "p_partkey")
    numbered = od.number_rows(parts, ["p_name", "p_partkey"])
    return numbered.select(od.query_label(F.col("position")).alias("label"), "p_partkey")


@query("""
SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey
    ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rank FROM lineitem)
WHERE rank <= 3
""")
def w04_top_per_group(spark, folder):
    lines = Tables(spark, folder).lineitem.select(
        "l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey"
    )
    order = [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey"]
    return od.top_per_group(lines, ["l_suppkey"], order, 3).drop("l_partkey")


@query("""
SELECT p_partkey, (row_number() OVER (ORDER BY p_name, p_partkey) - 1) //
  greatest(1, (SELECT count(*) FROM part) // 64) AS chunk FROM part
""")
def w05_chunks(spark, folder):
    parts = Tables(spark, folder).part.select("p_name", "p_partkey")
    numbered = od.number_rows(parts, ["p_name", "p_partkey"])
    total = parts.agg(F.count(F.lit(1))).scalar()
    size = F.greatest(F.lit(1), F.floor(total / 64))
    return od.assign_chunks(numbered, size).select("p_partkey", "chunk")


@query(f"""
SELECT site, url, arg_min(title, page_id) AS title FROM (
  SELECT page_id, {TITLE_SQL} AS title, {HOST.format('url')} AS site,
    regexp_extract(url, '^https?://[^/]+/[a-z]+') AS url FROM pages) GROUP BY site, url
""")
def w06_first_title_per_url(spark, folder):
    links = Tables(spark, folder).pages.select(
        "page_id", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"),
        urls.netloc(F.col("url")).alias("site"), _section().alias("url"),
    )
    return od.keep_first(links, ["site", "url"], ["page_id"]).drop("page_id")


def _kinds(t: Tables):
    incident = t.customer.select(
        F.col("c_custkey").alias("Report ID"), F.col("c_name").alias("name"),
        F.col("c_acctbal").alias("balance"), F.lit("f").alias("source_file"),
    )
    location = t.supplier.select(
        F.col("s_suppkey").alias("report_id"), F.col("s_name").alias("name"),
        F.col("s_acctbal").alias("balance"), F.lit("f").alias("source_file"),
    )
    species = t.orders.select(
        F.col("o_custkey").alias("REPORT ID"), F.col("o_orderkey").alias("order"),
        F.col("o_orderstatus").alias("name"),
    )
    return {
        "incident-data": incident,
        "incident-summary-and-locations": location,
        "incident-summary-and-species": species,
        "other": t.nation.select("n_name"),
    }


@query("""
WITH a AS (SELECT coalesce(c_custkey, s_suppkey) AS k, c_name, c_acctbal, s_name, s_acctbal
  FROM customer FULL OUTER JOIN supplier ON c_custkey = s_suppkey)
SELECT coalesce(k, o_custkey) AS "Report_ID", c_name AS name, c_acctbal AS balance,
  s_name AS name_incident_summary_and_locations,
  s_acctbal AS balance_incident_summary_and_locations, o_orderkey AS "order",
  o_orderstatus AS name_incident_summary_and_species
FROM a FULL OUTER JOIN orders ON k = o_custkey
""")
def j01_outer_join_kinds(spark, folder):
    return jn.join_kinds(_kinds(Tables(spark, folder)))[0]


@query("""
SELECT 'incident-data' AS kind, 0 AS step, (SELECT count(*) FROM customer) AS original_rows,
  0 AS rows_before, (SELECT count(*) FROM customer) AS rows_after_join,
  (SELECT count(*) FROM customer) AS rows_added
UNION ALL SELECT 'incident-summary-and-locations', 1, (SELECT count(*) FROM supplier), b, a, a - b
FROM (SELECT (SELECT count(*) FROM customer) AS b,
  (SELECT count(*) FROM customer FULL OUTER JOIN supplier ON c_custkey = s_suppkey) AS a)
UNION ALL SELECT 'incident-summary-and-species', 2, (SELECT count(*) FROM orders), b, a, a - b
FROM (SELECT (SELECT count(*) FROM customer FULL OUTER JOIN supplier ON c_custkey = s_suppkey) AS b,
  (SELECT count(*) FROM (SELECT coalesce(c_custkey, s_suppkey) AS k
    FROM customer FULL OUTER JOIN supplier ON c_custkey = s_suppkey)
    FULL OUTER JOIN orders ON k = o_custkey) AS a)
""")
def a04_join_accounting(spark, folder):
    kinds = _kinds(Tables(spark, folder))
    return jn.join_accounting(kinds, jn.join_kinds(kinds)[1])


@query("""
SELECT c_custkey, c_name, nation_isscaap, nation_asfis, name_asfis FROM (
  SELECT c_custkey, c_name, c_nationkey AS nation_isscaap, n_nationkey AS nation_asfis,
    n_name AS name_asfis FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
    AND n_regionkey <> 0)
""")
def j02_left_join_suffixes(spark, folder):
    t = Tables(spark, folder)
    left = t.customer.select("c_custkey", "c_name", F.col("c_nationkey").alias("nation"))
    right = t.nation.filter("n_regionkey <> 0").select(
        F.col("n_nationkey").alias("nation"), F.col("n_name").alias("name_asfis")
    )
    return jn.left_join(left, right, "nation", "nation", "_isscaap", "_asfis")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT event_id FROM events)")
def j08_exclude_checked(spark, folder):
    t = Tables(spark, folder)
    checked = t.events.select(F.col("event_id").alias("o_orderkey"))
    return jn.exclude_known(t.orders.select("o_orderkey"), checked, "o_orderkey")


@query("""
SELECT event_id, user_id FROM events
WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 49.5)
""")
def j10_rows_of_accepted(spark, folder):
    events = Tables(spark, folder).events
    accepted = events.filter("event_type = 'purchase' and value > 49.5").select("user_id").distinct()
    return jn.rows_with_accepted(events.select("event_id", "user_id"), accepted, "user_id")


@query("""
SELECT p_partkey, p_name, group_size, first_id FROM part JOIN (
  SELECT p_name, count(*) AS group_size, min(p_partkey) AS first_id FROM part GROUP BY p_name)
USING (p_name) WHERE group_size > 1 AND p_name <> 'small ring'
""")
def j11_potential_duplicates(spark, folder):
    vessel = F.when(F.col("p_name") != "small ring", F.col("p_name")).alias("p_name")
    incidents = Tables(spark, folder).part.select("p_partkey", vessel)
    return jn.duplicate_groups(incidents, "p_name", "p_partkey")


@query("SELECT p_partkey FROM part WHERE p_name = 'red bolt'")
def j11_same_vessel(spark, folder):
    found = jn.same_vessel(Tables(spark, folder).part, "p_name", "red bolt", "p_partkey")
    return found.select("p_partkey")


@query("""
SELECT lang, count(*) AS initial_rows, count(DISTINCT text) AS final_rows,
  count(*) - count(DISTINCT text) AS removed FROM documents GROUP BY lang
""")
def a02_dedup_accounting(spark, folder):
    docs = Tables(spark, folder).documents.select("lang", sha256_hex(F.col("text")).alias("h"))
    return ac.dedup_accounting(docs, ["h"], "lang")


@query(f"""
WITH {SHEETS_SQL}
SELECT source_folder, source_file, count(*) AS "rows", 4 AS columns,
  'Report ID, Subject, Country, Outcome' AS column_list FROM data_rows GROUP BY ALL
""")
def a03_file_summary(spark, folder):
    rows = spreadsheets.scan_kinds(spark, _spreadsheets(Tables(spark, folder)))["incident-data"]
    return ac.file_summary(rows.drop("row_number"))


@query(f"""
WITH {SHEETS_SQL}
SELECT 'incident-data' AS kind, 3 AS files, count(*) AS initial_rows,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT report_id, subject, country, outcome FROM data_rows)) AS removed,
  (SELECT count(*) FROM (SELECT DISTINCT report_id, subject, country, outcome FROM data_rows)) AS final_rows,
  4 AS columns FROM data_rows
UNION ALL SELECT 'incident-summary-and-locations', 1, count(*), 0, count(*), 3 FROM place_rows
UNION ALL SELECT 'other', 1, count(*), 0, count(*), 3 FROM nation
""")
def a03_merge_summary(spark, folder):
    found = spreadsheets.scan_kinds(spark, _spreadsheets(Tables(spark, folder)))
    return ac.merge_summary({k: v.drop("row_number") for k, v in found.items()})


@query("""
SELECT strftime(min(o_orderdate), '%Y-%m-%d') AS first_date,
  strftime(max(o_orderdate), '%Y-%m-%d') AS last_date,
  date_diff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE) AS days,
  round(date_diff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE) / 365.25, 1) AS years
FROM orders
""")
def a05_date_span(spark, folder):
    span = ac.date_span(Tables(spark, folder).orders, F.col("o_orderdate"))
    return span.select(
        F.col("first_date").cast("string").alias("first_date"),
        F.col("last_date").cast("string").alias("last_date"),
        F.col("days").cast("bigint").alias("days"), "years",
    )


@query("""
SELECT count(DISTINCT u) + max((u IS NULL)::INT) AS unique_values
FROM (SELECT CASE WHEN starts_with(url, 'https') THEN regexp_extract(url, '^https?://[^/]+/[a-z]+') END AS u
  FROM pages)
""")
def a06_unique_urls(spark, folder):
    secure = F.when(F.col("url").startswith("https"), _section())
    return ac.unique_count(Tables(spark, folder).pages.select(secure.alias("url")), "url")


@query(f"""
SELECT {HOST.format('url')} AS host, count(*) AS count FROM pages GROUP BY 1
ORDER BY count DESC, host LIMIT 5
""")
def a07_top_hosts(spark, folder):
    return ac.top_hosts(Tables(spark, folder).pages, "url")


@query(f"""
WITH urls AS (SELECT regexp_extract(url, '^https?://[^/]+/[a-z]+') AS url, count(*) AS n FROM pages GROUP BY 1),
walk AS (SELECT url, n * starts_with(url, 'https')::INT AS accepted_rows FROM urls
  WHERE {HTTP.format('url')} ORDER BY length(url), url LIMIT 100),
sums AS (SELECT *, coalesce(sum(accepted_rows) OVER (ORDER BY length(url), url
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM walk)
SELECT url, accepted_rows > 0 AS accepted, accepted_rows::BIGINT AS accepted_rows
FROM sums WHERE before < 40
""")
def o05_take_until_target(spark, folder):
    pages = Tables(spark, folder).pages.select(_section().alias("url"))
    candidates = pages.groupBy("url").agg(F.count(F.lit(1)).alias("n"))
    # stands in for the live check, whose outcome is an input column here
    alive = F.col("url").startswith("https").cast("int")
    return od.take_until(
        candidates, "url", urls.is_valid_format(F.col("url")), F.col("n") * alive,
        target=40, max_attempts=100, order=[F.length("url"), "url"],
    )
