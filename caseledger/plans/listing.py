"""Listing, filters, sorting, paging and simple projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseledger import rules
from caseledger.functions import text as tx
from caseledger.functions import urls
from caseledger.operators import filters as fl
from caseledger.operators import ordering as od
from caseledger.operators.accounting import concat_kinds
from caseledger.operators.flatten import fill_missing
from caseledger.operators.joins import exclude_known
from caseledger.operators.search import search
from caseledger.plans import records
from caseledger.plans.registry import Tables, query

HTTP = "regexp_matches({0}, '^(?i:https?)://[^/?#]+')"
HOST = "regexp_extract({0}, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)', 1)"
TITLE_SQL = "regexp_extract(html, '<title>(.*?)</title>', 1)"
BLOCKED = ("blog.tionsh.example.net", "thther.example.org")


@query(f"""
WITH {records.INCIDENTS_SQL},
found AS (SELECT i.* FROM incident_rows i
  WHERE status = 'extracted' AND verified
    AND EXISTS (SELECT 1 FROM incident_types x WHERE x.id = i.id AND iuu_type = 'Illegal Fishing')
    AND EXISTS (SELECT 1 FROM source_rows s WHERE s.id = i.primary_source AND category = 'url'))
SELECT id, event_date, status, verified, (SELECT count(*) FROM found) AS total,
  (SELECT count(*) FROM found) > 35 AS has_more
FROM found ORDER BY TRY_CAST(event_date AS DATE) DESC NULLS LAST, id LIMIT 25 OFFSET 10
""")
def listing_page(spark, folder):
    """The flagship: filtered, newest first, one page with its totals."""
    t = Tables(spark, folder)
    request = fl.IncidentFilters(
        limit=25, skip=10, source_type="url", verified="true", status="extracted",
        IUU_type="Illegal Fishing",
    )
    page, totals = fl.list_incidents(records.incidents(t), records.sources(t), request)
    page = page.withColumn("_totals", totals.select(F.struct("total", "has_more")).scalar())
    return page.select(
        "id",
        F.nullif(F.col(fl.EVENT_DATE), F.lit("Not specified")).alias("event_date"),
        "status", "verified", "_totals.total", "_totals.has_more",
    )


@query(f"""
WITH {records.INCIDENTS_SQL}
SELECT i.id, i.status FROM incident_rows i JOIN source_rows s ON s.id = i.primary_source
WHERE s.category = 'pdf' AND NOT i.verified AND i.status = 'modified'
""")
def f01_optional_filters(spark, folder):
    t = Tables(spark, folder)
    request = fl.IncidentFilters(source_type="pdf", verified="false", status="modified")
    found = fl.matching_incidents(records.incidents(t), records.sources(t), request)
    return found.select("id", "status")


@query(f"""
WITH {records.INCIDENTS_SQL} SELECT id FROM incident_types WHERE iuu_type = 'Illegal Fishing'
""")
def f02_classification_match(spark, folder):
    found = records.incidents(Tables(spark, folder)).filter(fl.has_iuu_type("Illegal Fishing"))
    return found.select("id")


@query("""
SELECT doc_id, CASE WHEN length(text) = 0 AND url IS NULL THEN 'rejected'
  WHEN length(text) BETWEEN 1 AND 49 THEN 'invalid_input' ELSE 'ok' END AS verdict
FROM documents LEFT JOIN pages ON page_id = doc_id
""")
def f03_intake_validity(spark, folder):
    rows = records.articles(Tables(spark, folder))
    verdict = fl.intake_verdict(F.col("url"), F.col("article_text"))
    return rows.select(F.col("seq").alias("doc_id"), verdict.alias("verdict"))


@query(f"""
SELECT page_id, {HTTP.format('url')} AS as_given,
  {HTTP.format("regexp_replace(url, '^https?', 'ftp')")} AS as_ftp,
  {HTTP.format("upper(url)")} AS as_upper,
  {HTTP.format("regexp_replace(url, '^https?://', '')")} AS without_scheme,
  {HTTP.format("regexp_replace(url, '//.*$', '//')")} AS without_host
FROM pages
""")
def f04_url_validity(spark, folder):
    url = F.col("url")
    forms = {
        "as_given": url,
        "as_ftp": F.regexp_replace(url, "^https?", "ftp"),
        "as_upper": F.upper(url),
        "without_scheme": F.regexp_replace(url, "^https?://", ""),
        "without_host": F.regexp_replace(url, "//.*$", "//"),
    }
    return Tables(spark, folder).pages.select(
        "page_id", *[urls.is_valid_format(c).alias(n) for n, c in forms.items()]
    )


def _skips(patterns: tuple[str, ...], column: str) -> str:
    return " AND ".join(f"NOT contains(lower({column}), '{p}')" for p in patterns)


_NAV = ", ".join(f"'{t}'" for t in rules.NAVIGATION_TITLES)


@query(f"""
WITH links AS (SELECT page_id, url, trim({TITLE_SQL}) AS title FROM pages)
SELECT page_id,
  {_skips(rules.TRADE_NEWS_LINKS.skip_in_href, 'url')} AND lower(title) NOT IN ({_NAV})
    AND length(title) > 5 AS trade_news,
  {_skips(rules.PROSECUTOR_LINKS.skip_in_href, 'url')} AND lower(title) NOT IN ({_NAV})
    AND length(title) > 10 AND contains(lower(url), 'justice.gov') AS prosecutor,
  {_skips(rules.ANY_SITE_LINKS.skip_in_href, 'url')} AND length(url) > 10 AS any_site
FROM links
""")
def f05_article_links(spark, folder):
    links = Tables(spark, folder).pages.withColumn(
        "title", F.regexp_extract("html", "<title>(.*?)</title>", 1)
    )
    looks = {
        "trade_news": rules.TRADE_NEWS_LINKS,
        "prosecutor": rules.PROSECUTOR_LINKS,
        "any_site": rules.ANY_SITE_LINKS,
    }
    return links.select(
        "page_id",
        *[urls.looks_like_article(F.col("url"), F.col("title"), r).alias(n) for n, r in looks.items()],
    )


@query(f"SELECT page_id, url FROM pages WHERE {HOST.format('url')} NOT IN {BLOCKED}")
def f06_host_blacklist(spark, folder):
    pages = Tables(spark, folder).pages
    return pages.filter(~urls.is_blocked(F.col("url"), BLOCKED)).select("page_id", "url")


TERM_OF = {
    "ECONOMY": "Fish", "STANDARD": "IUU", "PROMO": "fraud", "SMALL": "shark fin",
    "MEDIUM": "Closed Area", "LARGE": "vessel",
}


@query("""
WITH terms AS (SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'Fish' WHEN 'STANDARD' THEN 'IUU'
  WHEN 'PROMO' THEN 'fraud' WHEN 'SMALL' THEN 'shark fin' WHEN 'MEDIUM' THEN 'Closed Area'
  WHEN 'LARGE' THEN 'vessel' END AS term FROM part)
SELECT p_partkey, term, CASE WHEN term IN ('Fish', 'shark fin') THEN 'fish'
  WHEN term IN ('fraud', 'Closed Area') THEN 'enforcement' ELSE 'other' END AS category
FROM terms
""")
def f07_keyword_categories(spark, folder):
    terms = Tables(spark, folder).part.select(
        "p_partkey", records.mapped("p_type", TERM_OF).alias("term")
    )
    return terms.withColumn("category", fl.keyword_category(F.col("term")))


@query("""
SELECT doc_id, len(list_filter(string_split(text, ' '), lambda w: length(trim(w)) > 2)) AS long_words
FROM documents
""")
def f08_drop_short(spark, folder):
    kept = tx.long_enough(F.split("text", " "))
    return Tables(spark, folder).documents.select("doc_id", F.size(kept).cast("bigint").alias("long_words"))


@query("""
SELECT lang, count(*) AS readable,
  count(*) FILTER (regexp_matches(regexp_replace(text, '[^\\s]{1,6}', '', 'g'), '\\S')) AS with_long_words
FROM documents WHERE regexp_matches(text, '\\S') GROUP BY lang
""")
def f09_skip_blank(spark, folder):
    docs = Tables(spark, folder).documents.filter(tx.has_content(F.col("text")))
    rest = F.regexp_replace("text", r"[^\s]{1,6}", "")
    return docs.groupBy("lang").agg(
        F.count(F.lit(1)).alias("readable"),
        F.count_if(tx.has_content(rest)).alias("with_long_words"),
    )


@query("""
SELECT DISTINCT nullif(o_orderpriority, '4-NOT SPECIFIED') AS priority FROM orders
WHERE o_orderpriority <> '4-NOT SPECIFIED'
""")
def f10_drop_null_keys(spark, folder):
    missing = F.nullif(F.col("o_orderpriority"), F.lit("4-NOT SPECIFIED"))
    rows = Tables(spark, folder).orders.select(missing.alias("priority"))
    return od.distinct_values(rows, "priority")


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 777")
def f11_point_lookup(spark, folder):
    found = fl.find_by_id(Tables(spark, folder).orders, 777, "o_orderkey")
    return found.select("o_orderkey", "o_custkey", "o_orderstatus")


@query("""
SELECT event_id, nullif(concat_ws(',',
  CASE WHEN event_type NOT IN ('view', 'click', 'purchase') THEN 'event_type' END,
  CASE WHEN value NOT BETWEEN 1 AND 50 THEN 'value' END), '') AS reason
FROM events
""")
def f12_quarantine(spark, folder):
    checks = [
        fl.one_of("event_type", ("view", "click", "purchase")),
        fl.Check("value", F.col("value").between(1, 50)),
    ]
    valid, quarantined = fl.split_valid(Tables(spark, folder).events, checks)
    good = valid.select("event_id", F.lit(None).cast("string").alias("reason"))
    return good.unionByName(quarantined.select("event_id", "reason"))


_SEARCH = ("or", "death", ("and", "with", ("or", "that", "whi")))


@query(r"""
SELECT doc_id, contains(lower(text), 'death') OR (contains(lower(text), 'with')
    AND (contains(lower(text), 'that') OR contains(lower(text), 'whi'))) AS anywhere,
  list_contains(string_split_regex(lower(text), '[^\p{L}\p{N}_]+'), 'death')
    OR (list_contains(string_split_regex(lower(text), '[^\p{L}\p{N}_]+'), 'with')
    AND (list_contains(string_split_regex(lower(text), '[^\p{L}\p{N}_]+'), 'that')
      OR list_contains(string_split_regex(lower(text), '[^\p{L}\p{N}_]+'), 'whi'))) AS whole_words
FROM documents
""")
def f13_boolean_search(spark, folder):
    docs, text = Tables(spark, folder).documents, F.col("text")
    return docs.select(
        "doc_id",
        fl.matches(text, _SEARCH).alias("anywhere"),
        fl.matches(text, _SEARCH, whole_words=True).alias("whole_words"),
    )


@query(r"""
WITH words AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}_]+'),
  lambda w: w <> '') AS w FROM benchmark WHERE text IS NOT NULL),
tokens AS (SELECT doc_id, ' ' || array_to_string(list_filter(string_split_regex(lower(text),
  '[^\p{L}\p{N}_]+'), lambda w: w <> ''), ' ') || ' ' AS t FROM documents)
SELECT doc_id, item_id FROM tokens, words WHERE len(w) >= 9 AND
  (contains(t, ' ' || w[1] || ' ' || w[2] || ' ') OR contains(t, ' ' || w[3] || ' ' || w[4] || ' ')
    OR (contains(t, ' ' || w[5] || ' ') AND (contains(t, ' ' || w[6] || ' ') OR contains(t, ' ' || w[7] || ' ' || w[8] || ' '))))
""")
def f13_query_table(spark, folder):
    """A search query for each benchmark item, made of its first words, against all documents."""
    t = Tables(spark, folder)
    words = t.benchmark.select("item_id", tx.word_tokens(F.col("text")).alias("w")).filter(F.size("w") >= 9)
    w = [F.get("w", F.lit(k)) for k in range(8)]
    query = F.format_string('("%s %s" OR "%s %s") OR (%s AND (%s OR "%s %s"))', *w)
    return search(t.documents, words.select("item_id", query.alias("query")), "doc_id", "text", "item_id", "query")


@query(f"""
WITH {records.INCIDENTS_SQL}
SELECT count(*) AS total, 25 AS "limit", 50 AS skip, count(*) > 75 AS has_more FROM incident_rows
WHERE status = 'user_input'
""")
def a01_total_and_more(spark, folder):
    t = Tables(spark, folder)
    request = fl.IncidentFilters(skip=50, status="user_input")
    return fl.list_incidents(records.incidents(t), records.sources(t), request)[1]


@query(f"""
WITH {records.INCIDENTS_SQL} SELECT id, event_date FROM incident_rows
ORDER BY TRY_CAST(event_date AS DATE) DESC NULLS LAST, id LIMIT 25 OFFSET 100
""")
def o01_sorted_page(spark, folder):
    t = Tables(spark, folder)
    page, _ = fl.list_incidents(
        records.incidents(t), records.sources(t), fl.IncidentFilters(skip=100)
    )
    return page.select("id", F.col(fl.EVENT_DATE).alias("event_date"))


@query("SELECT doc_id, lang, source FROM documents ORDER BY doc_id LIMIT 25 OFFSET 50")
def o02_skip_limit(spark, folder):
    docs = Tables(spark, folder).documents.select("doc_id", "lang", "source")
    return fl.take_page(docs, 50, 25, "doc_id")


@query("""
SELECT doc_id, lang, CASE WHEN length(text) > 80 THEN left(text, 77) || '...' ELSE text END AS text
FROM documents ORDER BY doc_id LIMIT 3
""")
def o03_sample_head(spark, folder):
    docs = Tables(spark, folder).documents.select("doc_id", "lang", "text", "source", "n_chars")
    head = od.sample_head(docs, ["doc_id"], rows=3, columns=3)
    return head.withColumn("text", tx.cut_with_dots(F.col("text")))


@query("SELECT url FROM pages")
def o04_random_order(spark, folder):
    return od.shuffled(Tables(spark, folder).pages.select("url"), "url", seed=42)


@query("""
SELECT 'supplier' AS kind, s_suppkey AS key, s_name AS name, s_acctbal AS balance,
  NULL::VARCHAR AS segment FROM supplier
UNION ALL SELECT 'customer', c_custkey, c_name, NULL, c_mktsegment FROM customer
""")
def u01_concat_differing(spark, folder):
    t = Tables(spark, folder)
    suppliers = t.supplier.select(
        F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("key"),
        F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"),
    )
    customers = t.customer.select(
        F.lit("customer").alias("kind"), F.col("c_custkey").alias("key"),
        F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"),
    )
    return concat_kinds([suppliers, customers])


@query("""
SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem
  WHERE l_returnflag = 'R' AND l_quantity > 48)
""")
def u02_difference(spark, folder):
    t = Tables(spark, folder)
    returned = t.lineitem.filter("l_returnflag = 'R' and l_quantity > 48")
    returned = returned.select(F.col("l_partkey").alias("p_partkey"))
    return exclude_known(t.part.select("p_partkey"), returned, "p_partkey")


@query("""
SELECT url, 'a' AS site FROM pages UNION ALL
SELECT replace(url, 'http://', 'https://'), 'b' FROM pages
""")
def u03_append_sites(spark, folder):
    pages = Tables(spark, folder).pages
    first = pages.select("url", F.lit("a").alias("site"))
    second = pages.select(
        F.replace("url", F.lit("http://"), F.lit("https://")).alias("url"), F.lit("b").alias("site")
    )
    return concat_kinds([first, second])


@query("""
SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'N/A' ELSE c_mktsegment END AS filled,
  CASE WHEN c_mktsegment NOT IN ('BUILDING') THEN c_mktsegment END AS unified
FROM customer
""")
def p09_default_fill(spark, folder):
    given = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).otherwise("")
    rows = Tables(spark, folder).customer.select("c_custkey", given.alias("filled"))
    rows = rows.withColumn("unified", tx.null_if_spelled(F.col("filled")))
    return fill_missing(rows, {"filled": rules.MISSING_TEXT})


@query("""
SELECT doc_id, sha256(text || lang || chr(10) || 'x') AS clean_hash FROM documents
""")
def p10_control_characters(spark, folder):
    noisy = F.concat(
        "text", F.lit("\x00\x0b"), "lang", F.lit("\x1f\n"), F.lit("x\x07"),
    )
    clean = tx.drop_control_chars(noisy)
    return Tables(spark, folder).documents.select("doc_id", tx.sha256_hex(clean).alias("clean_hash"))


@query(r"""
SELECT doc_id, sha256(regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g')) AS ascii_hash
FROM documents
""")
def p11_ascii_fold(spark, folder):
    folded = tx.fold_to_ascii(F.col("text"))
    return Tables(spark, folder).documents.select("doc_id", tx.sha256_hex(folded).alias("ascii_hash"))


@query(f"""
SELECT page_id, CASE WHEN {HOST.format('url')} IN {BLOCKED} THEN 'BLACKLISTED'
  WHEN l.doc_id IS NULL THEN 'SCRAPING_FAILED' ELSE sha256(d.text) END AS scraped
FROM pages LEFT JOIN documents d ON d.doc_id = page_id LEFT JOIN labels l ON l.doc_id = page_id
""")
def p14_fetch_outcome(spark, folder):
    t = Tables(spark, folder)
    fetched = t.documents.select(
        F.col("doc_id").alias("page_id"), tx.sha256_hex(F.col("text")).alias("text")
    )
    done = t.labels.select(F.col("doc_id").alias("page_id"), F.lit(False).alias("failed"))
    rows = t.pages.select("page_id", "url").join(fetched, "page_id", "left")
    rows = rows.join(done, "page_id", "left")
    failed = F.coalesce("failed", F.lit(True))
    scraped = urls.fetch_outcome(F.col("url"), F.col("text"), failed, BLOCKED)
    return rows.select("page_id", scraped.alias("scraped"))


@query("""
SELECT page_id, replace(url_encode(url || ' ~*'), '%2F', '/') AS encoded FROM pages
""")
def x03_percent_encode(spark, folder):
    encoded = urls.percent_encode(F.concat("url", F.lit(" ~*")))
    return Tables(spark, folder).pages.select("page_id", encoded.alias("encoded"))


@query(r"""
WITH b AS (SELECT page_id, url, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS site,
  regexp_extract(url, '^(https?):', 1) AS scheme,
  regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '[^/]*$', '') AS folder
  FROM pages)
SELECT page_id, site || '/a/c' AS rooted, scheme || '://other.example.org/x' AS other_host,
  site || CASE WHEN folder = '' THEN '/' ELSE folder END || 'story?id=1' AS beside,
  'https://full.example.org/y' AS absolute
FROM b
""")
def x05_resolve_links(spark, folder):
    hrefs = {
        "rooted": "/a/b/../c", "other_host": "//other.example.org/x",
        "beside": "./story?id=1", "absolute": "https://full.example.org/y",
    }
    return Tables(spark, folder).pages.select(
        "page_id", *[urls.resolve(F.col("url"), F.lit(h)).alias(n) for n, h in hrefs.items()]
    )


@query("""
SELECT page_id, 'https://' || regexp_replace(url, '^https?://', '') AS completed, url AS unchanged
FROM pages
""")
def x06_add_scheme(spark, folder):
    bare = F.regexp_replace("url", "^https?://", "")
    return Tables(spark, folder).pages.select(
        "page_id", urls.with_scheme(bare).alias("completed"),
        urls.with_scheme(F.col("url")).alias("unchanged"),
    )
