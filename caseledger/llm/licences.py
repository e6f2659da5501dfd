"""Licence scans: canonical digests of texts and lines, joined with known digests.

Canonical form: A-Z lower-cased, copyright lines left out, every run of other ASCII
signs one blank, equivalent spellings made one. The whole text's digest is looked up
among licence texts; a text's lines, as wholes, among one-line notices. Only built-in
functions are used. Known texts and notices are tables: the fixed lists by default, or
larger ones that are given. A copyright line has its mark, then a year (or a place for
one) or a second mark; words of a licence that a line break puts first are none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseledger.llm.licence_texts import MARKS, NAMES, PHRASES, SHORT_NAMES, SPELLINGS, TEXTS
from caseledger.operators.skew import join_back
from caseledger.storage import stored

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_YEAR = r"(?:\d{4}|<year>|\[year\]|\[yyyy\]|\{yyyy\}|yyyy)"
_COPYRIGHT = (  # signs of a comment may come before it
    rf"(?m)^[^a-z0-9\n©(]*(?:(?:copyright[ \t:,]*(?:\(c\)|©|{_YEAR})|(?:\(c\)|©)[ \t]*(?:copyright|{_YEAR}))[^\n]*"
    r"|all rights reserved\.?[^a-z0-9\n]*)$"
)
_SIGNS = r"[^a-z0-9\n\x{80}-\x{10ffff}]+"


def canonical_lines(text: Column) -> Column:
    """Canonical text that still has its line breaks."""
    lower = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    plain = F.regexp_replace(F.regexp_replace(lower, _COPYRIGHT, ""), _SIGNS, " ")
    return reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), SPELLINGS, plain)


def as_one(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, r"[ \n]+", " "))


def text_list() -> list[tuple[str, str]]:
    """The known whole texts, with and without their titles."""
    return [(name, text) for name, _, text in TEXTS] + [(name, f"{title}\n\n{text}") for name, title, text in TEXTS if title]


def notice_list() -> list[tuple[str, str]]:
    """Every phrase with every name, with and without the article, and short forms after their marks."""
    starts = [s for phrase in PHRASES for s in (phrase, phrase.removesuffix(" the"))]
    long = [(name, f"{start} {called}") for start in starts for name, called in NAMES]
    short = [(name, f"{start} {called}") for start in (*starts, *MARKS) for name, called in SHORT_NAMES]
    return sorted({*long, *short, *((name, f"{text} License") for name, text in short)})


def _digests(table: DataFrame) -> DataFrame:
    """``license, digest, size`` in canonical form; of licences with one text the first by name."""
    lines = as_one(canonical_lines(F.col("text")))
    made = table.select("license", lines.alias("lines")).filter("lines <> ''")
    made = made.select("license", F.sha2("lines", 256).alias("digest"), F.length("lines").alias("size"))
    return made.groupBy("digest").agg(F.min("license").alias("license"), F.max("size").alias("size"))


def scan(
    docs: DataFrame, id: str = "doc_id", text: str = "text", texts: DataFrame | None = None, notices: DataFrame | None = None
) -> DataFrame:
    """``doc_id, text_digest, license, n_notices, notices`` for every row.

    ``license`` is the licence that the whole text is, null for none. ``n_notices``
    counts the lines that are notices; ``notices`` lists their licences, each once, in
    order, with commas. Null and empty texts have the digest of the empty text and no
    licence. Ids are handed through, null and repeated ones too. ``texts`` and ``notices``
    are tables ``license, text`` of what is known, by default the fixed lists.
    """
    spark = docs.sparkSession
    known = _digests(spark.createDataFrame(text_list(), "license string, text string") if texts is None else texts)
    lines_known = _digests(spark.createDataFrame(notice_list(), "license string, text string") if notices is None else notices)
    longest = lines_known.agg(F.coalesce(F.max("size"), F.lit(0))).first()[0]
    rows = docs.select(F.col(id).alias("doc_id"), canonical_lines(F.col(text)).alias("lines"))
    lines = F.filter(
        F.transform(F.split("lines", "\n"), lambda line: F.trim(line)),
        lambda line: (F.length(line) > 0) & (F.length(line) <= longest),
    )
    digests = stored(
        rows.select(
            "doc_id",
            F.sha2(as_one(F.col("lines")), 256).alias("text_digest"),
            F.sha2("lines", 256).alias("lines_digest"),
            F.transform(lines, lambda line: F.sha2(line, 256)).alias("of_lines"),
        ),
        "digests",
    )
    # texts of equal lines have equal notices, so copies are looked up once
    once = digests.groupBy("lines_digest").agg(F.first("of_lines").alias("of_lines"))
    found = (
        once.select("lines_digest", F.explode("of_lines").alias("digest"))
        .join(lines_known, "digest")
        .groupBy("lines_digest")
        .agg(
            F.count(F.lit(1)).alias("n_notices"),
            F.array_join(F.sort_array(F.collect_set("license")), ",").alias("notices"),
        )
    )
    whole = known.select(F.col("digest").alias("text_digest"), "license")
    named = join_back(digests.drop("of_lines"), whole, "text_digest", "left")
    return join_back(named, found, "lines_digest", "left").select(
        "doc_id",
        "text_digest",
        "license",
        F.coalesce("n_notices", F.lit(0)).alias("n_notices"),
        F.coalesce("notices", F.lit("")).alias("notices"),
    )


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _sql_lines(text: str) -> str:
    plain = f"translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}')"
    plain = f"regexp_replace({plain}, {_quoted(_COPYRIGHT)}, '', 'g')"
    plain = f"regexp_replace({plain}, {_quoted(_SIGNS)}, ' ', 'g')"
    for a, b in SPELLINGS:
        plain = f"replace({plain}, '{a}', '{b}')"
    return plain


def scan_sql() -> str:
    """The same scan of ``documents`` in DuckDB's SQL."""
    rows, notices = text_list(), notice_list()
    values = lambda pairs: ", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in pairs)
    one = lambda lines: f"trim(regexp_replace({lines}, '[ \\n]+', ' ', 'g'))"
    return f"""
    WITH texts AS (SELECT min(license) AS license, sha256({one(_sql_lines('t'))}) AS digest FROM (VALUES {values(rows)}) v(license, t) GROUP BY 2),
    notices AS (SELECT min(license) AS license, sha256({one(_sql_lines('t'))}) AS digest FROM (VALUES {values(notices)}) v(license, t) GROUP BY 2),
    docs AS (SELECT row_number() OVER () AS r, doc_id, {_sql_lines('text')} AS lines FROM documents),
    line AS (SELECT r, trim(unnest(string_split(lines, chr(10)))) AS line FROM docs),
    found AS (
        SELECT r, count(*) AS n_notices, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
        FROM line JOIN notices ON sha256(line) = digest GROUP BY r
    )
    SELECT doc_id, sha256({one('lines')}) AS text_digest, license, coalesce(n_notices, 0) AS n_notices,
        coalesce(notices, '') AS notices
    FROM docs LEFT JOIN found USING (r) LEFT JOIN texts ON texts.digest = sha256({one('lines')})
    """
