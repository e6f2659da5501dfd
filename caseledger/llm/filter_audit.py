"""How filters interact: every order of five filters, audited from the sets of filters that texts fail.

A text's failures do not depend on the order in which filters are applied, so all orders
follow from how many documents fail each set of filters. One pass over the texts finds
the failures; documents are then counted by part and set, at most 32 cells a part. Each
cell is folded across all 120 orders with ``transform`` and ``aggregate`` into 600
structs weighted by the cell's counts, and the structs of a part's cells are summed
element by element. The orders are one constant array, so no join multiplies rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseledger.operators.skew import join_back
from caseledger.storage import stored

FILTERS = "ABCDE"
ORDERS = " ".join("".join(p) for p in permutations(FILTERS))

_MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
_STEP = "struct<letter:string," + ",".join(f"{m}:bigint" for m in _MEASURES) + ">"

# one cell across one order ``o``: the documents are alive until the first filter they fail
_HIT = "instr(c.failed, substr(o, k, 1)) > 0"
_WALK = f"""aggregate(sequence(1, {len(FILTERS)}),
  named_struct('alive', true, 'steps', cast(array() as array<{_STEP}>)),
  (walk, k) -> named_struct(
    'alive', walk.alive and not {_HIT},
    'steps', array_append(walk.steps, named_struct(
      'letter', substr(o, k, 1),
      'kept', if(walk.alive and not {_HIT}, c.n, 0L),
      'removed', if(walk.alive and {_HIT}, c.n, 0L),
      'redundant', if(not walk.alive and {_HIT}, c.n, 0L),
      'unique_fails', if(c.failed = substr(o, k, 1), c.n, 0L),
      'good_lost', if(walk.alive and {_HIT}, c.good, 0L),
      'toxic_lost', if(walk.alive and {_HIT}, c.toxic, 0L)))),
  walk -> walk.steps)"""
_FOLDED = f"transform(cells, c -> flatten(transform(split('{ORDERS}', ' '), o -> {_WALK})))"
_SUMMED = (
    "aggregate(slice(folded, 2, size(folded)), folded[0], (total, cell) -> zip_with(total, cell, (x, y) ->"
    " named_struct('letter', x.letter, " + ", ".join(f"'{m}', x.{m} + y.{m}" for m in _MEASURES) + ")))"
)
_SHAPLEY = (
    f"transform(split('{' '.join(FILTERS)}', ' '), l -> aggregate(filter(steps, s -> s.letter = l),"
    " 0L, (total, s) -> total + s.removed))"
)


def _letters(conditions: dict[str, Column]) -> Column:
    return F.concat(*(F.when(c, F.lit(letter)).otherwise(F.lit("")) for letter, c in conditions.items()))


def failures(docs: DataFrame, id: str, text: str, part: str) -> DataFrame:
    """``doc_id, part, digest, failed`` per row: the filters A to D that the text fails."""
    whole = docs.select(
        F.col(id).alias("doc_id"), F.coalesce(part, F.lit("")).alias("part"), F.coalesce(text, F.lit("")).alias("text")
    )
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    n_words, n_distinct = F.size("words"), F.size(F.array_distinct("words"))
    capitals = F.char_length(F.regexp_replace("text", "[^A-Z]+", ""))
    failed = _letters(
        {
            "A": n_words < 200,
            "B": 100 * n_distinct.cast("bigint") < 50 * n_words.cast("bigint"),
            "C": 100 * capitals.cast("bigint") > 3 * F.char_length("text").cast("bigint"),
            "D": F.col("text").rlike(r"[#$%&*|]"),
        }
    )
    return whole.withColumn("words", words).select(
        "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), failed.alias("failed")
    )


def cells(docs: DataFrame, labels: DataFrame, id: str, text: str, part: str) -> DataFrame:
    """``part, failed, n, good, toxic``: documents of a part that fail exactly a set of filters.

    Copies are counted before they are compared: a text's rows differ in part and labels
    only, so the row of the smallest id among them is found between a few counts.
    """
    keys = ["doc_id", "part", "digest", "failed"]
    rows = failures(docs, id, text, part).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    marks = labels.filter(F.col(id).isNotNull()).groupBy(F.col(id).alias("doc_id"))
    marks = marks.agg(
        F.max(F.col("quality").eqNullSafe(1)).alias("good"), F.max(F.col("toxic").eqNullSafe(1)).alias("toxic")
    )
    marked = join_back(rows, marks, "doc_id", "left")
    texts = marked.groupBy(
        "digest", "part", "failed", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")
    ).agg(
        F.sum("n").alias("n"),
        F.min("doc_id").alias("least"),
        F.coalesce(F.min_by("n", "doc_id"), F.lit(0)).alias("at_least"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("unnamed"),
    )
    texts = stored(texts, "counted")  # read twice, the texts once
    first = texts.groupBy("digest").agg(F.min("least").alias("first"))
    texts = join_back(texts, first, "digest")
    fresh = F.col("unnamed") + F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0)
    either = F.array(
        F.struct(F.col("failed"), fresh.alias("n")),
        F.struct(F.concat("failed", F.lit("E")).alias("failed"), (F.col("n") - fresh).alias("n")),
    )
    split = texts.select("part", "good", "toxic", F.inline(either)).filter("n > 0")
    return split.groupBy("part", "failed").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"),
    )


def audit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """One row per part, order of the five filters and step, with what happens there.

    Failures: A fewer than 200 words, B distinct words under half of the words, C over
    3 % capitals ``[A-Z]``, D any of ``#$%&*|``, E a text that a smaller id has as well,
    in whatever part. ``kept``, ``removed``, ``redundant`` (fail here, removed before),
    ``unique_fails`` (fail this filter only), ``good_lost`` and ``toxic_lost`` (removed
    here, labelled 1) count rows of the part; ``shapley`` sums what the step's filter
    removes over all orders.

    A null text is empty, a null part is the empty string. A row without an id has no
    smaller id and is smaller than none, so it never fails E; it has no label. Rows that
    repeat an id with the same text are equally small, each counts. Of several labels
    for one id any 1 counts. Parts without a row are not listed: an empty table gives
    no rows. Other columns are ignored.
    """
    parts = cells(docs, labels, id, text, part).groupBy("part")
    # at most 32 sets of failed filters a part
    walked = parts.agg(F.collect_list(F.struct("failed", "n", "good", "toxic")).alias("cells"))
    walked = walked.select("part", F.expr(_FOLDED).alias("folded")).select("part", F.expr(_SUMMED).alias("steps"))
    walked = walked.select("part", F.expr(_SHAPLEY).alias("totals"), F.posexplode("steps").alias("at", "s"))
    order = F.split(F.lit(ORDERS), " ")[F.floor(F.col("at") / len(FILTERS)).cast("int")]
    return walked.select(
        "part",
        order.alias("filter_order"),
        (F.col("at") % len(FILTERS) + 1).cast("int").alias("step"),
        *(F.col(f"s.{m}").alias(m) for m in _MEASURES),
        F.expr(f"totals[instr('{FILTERS}', s.letter) - 1]").alias("shapley"),
    )


def audit_sql() -> str:
    """The same result in plain SQL: every document meets every order."""
    return r"""
WITH marks AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), firsts AS (SELECT t, min(doc_id) AS first FROM texts GROUP BY t),
docs AS (
  SELECT x.part, coalesce(m.good, false) AS good, coalesce(m.toxic, false) AS toxic,
    [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
     100 * length(regexp_replace(x.t, '[^A-Z]', '', 'g')) > 3 * length(x.t),
     regexp_matches(x.t, '[#$%&*|]'), coalesce(x.doc_id > f.first, false)] AS fails
  FROM texts x JOIN firsts f ON x.t = f.t LEFT JOIN marks m ON x.doc_id = m.doc_id
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 3, 4, 5]) AS i),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS o
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), steps AS (SELECT filter_order, o, unnest([1, 2, 3, 4, 5]) AS step FROM orders),
groups AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM docs GROUP BY part, fails
), met AS (
  SELECT part, filter_order, step, o[step] AS f, n, good, toxic, fails[o[step]] AS hit,
    list_bool_or([fails[k] FOR k IN o[1:step - 1]]) AS gone,
    len([x FOR x IN fails IF x]) AS n_fails
  FROM groups, steps
), told AS (
  SELECT part, filter_order, step, any_value(f) AS f,
    sum(CASE WHEN NOT hit AND NOT coalesce(gone, false) THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN hit AND NOT coalesce(gone, false) THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN hit AND coalesce(gone, false) THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN hit AND n_fails = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN hit AND NOT coalesce(gone, false) THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN hit AND NOT coalesce(gone, false) THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM met GROUP BY part, filter_order, step
)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM told
"""
