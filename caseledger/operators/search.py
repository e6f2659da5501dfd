"""Boolean search queries as a table: which documents match which queries.

A query is what the news service takes: words and quoted phrases with ``AND``, ``OR`` and
parentheses; ``AND`` binds closer. Terms match whole words in sequence, case ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseledger.operators.filters import Query
from caseledger.operators.joins import dictionary_hits
from caseledger.operators.skew import join_back
from caseledger.storage import stored

_TOKEN = re.compile(r'\s*(?:"([^"]*)"|([()])|([^\s()"]+))')


@lru_cache(maxsize=4096)
def read_query(text: str) -> Query:
    """The nested form of a query text; ValueError where it is none."""
    tokens, at = [], 0
    while text[at:].strip():
        found = _TOKEN.match(text, at)
        if not found:
            raise ValueError(f"unclosed quotes in {text!r}")
        phrase, mark, word = found.groups()
        tokens.append(("term", phrase) if phrase is not None else (mark or (word if word in ("AND", "OR") else ("term", word))))
        at = found.end()
    place = 0

    def joined(kind: str, part: Callable[[], Query]) -> Query:
        nonlocal place
        parts = [part()]
        while place < len(tokens) and tokens[place] == kind.upper():
            place += 1
            parts.append(part())
        return parts[0] if len(parts) == 1 else (kind, *parts)

    def operand() -> Query:
        nonlocal place
        if place == len(tokens) or (isinstance(tokens[place], str) and tokens[place] != "("):
            raise ValueError(f"a term is missing in {text!r}")
        place += 1
        if tokens[place - 1] != "(":
            return tokens[place - 1][1]
        inner = whole()
        if place == len(tokens) or tokens[place] != ")":
            raise ValueError(f"unclosed parenthesis in {text!r}")
        place += 1
        return inner

    def whole() -> Query:
        return joined("or", lambda: joined("and", operand))

    query = whole()
    if place < len(tokens):
        raise ValueError(f"{text!r} goes on after its end")
    return query


def terms_of(query: Query) -> set[str]:
    return {query} if isinstance(query, str) else set().union(*map(terms_of, query[1:]))


def holds(query: Query, present: set[str]) -> bool:
    if isinstance(query, str):
        return query in present
    return (all if query[0] == "and" else any)(holds(part, present) for part in query[1:])


def required(query: Query, frequency: dict[str, int]) -> set[str]:
    """Terms of which every match holds at least one, chosen to be in few documents."""
    if isinstance(query, str):
        return {query}
    parts = [required(part, frequency) for part in query[1:]]
    if query[0] == "or":
        return set().union(*parts)
    return min(parts, key=lambda terms: (sum(frequency.get(t, 0) for t in terms), sorted(terms)))


def _on_query(rows: DataFrame, schema: str, answer: Callable[[str, list], Iterator[tuple]]) -> DataFrame:
    """Rows ``(keys.., query, list)`` to rows ``(keys.., found)`` for each answer of a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *keys, texts, lists = (c.to_pylist() for c in batch.columns)
            out = [(*key, found) for *key, text, given in zip(*keys, texts, lists, strict=True) for found in answer(text, given)]
            names = [c.split()[0] for c in schema.split(", ")]
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            kinds = [*(batch.schema.types[: len(keys)]), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return rows.mapInArrow(run, schema)


def _parsed(text: str | None) -> Query | None:
    try:
        return read_query(text) if text is not None else None
    except ValueError:
        return None


def unreadable_queries(queries: DataFrame, query: str) -> DataFrame:
    """Rows whose query text cannot be read; they match nothing."""
    bad = F.udf(lambda text: _parsed(text) is None, "boolean", useArrow=True)
    return queries.filter(bad(query))


def search(documents: DataFrame, queries: DataFrame, key: str, text: str, query_key: str, query: str) -> DataFrame:
    """``key, query_key`` of every document and query that match.

    Queries are filed under terms that every match must hold, the rarest ones where a
    query leaves a choice, so a document meets only queries whose filed term it has.
    What it holds of such a query's other terms then decides. Terms are looked up in
    all documents at once (``dictionary_hits``), whatever the number of queries.
    """
    kind, doc_kind = (f.dataType.simpleString() for f in (queries.schema[query_key], documents.schema[key]))
    given = queries.select(F.col(query_key).alias("_q"), F.col(query).alias("_query"))

    def each_term(text: str, _) -> Iterator[tuple]:
        parsed = _parsed(text)
        return iter(sorted(terms_of(parsed))) if parsed is not None else iter(())

    named = _on_query(given.select("_q", "_query", F.array().alias("_none")), f"_q {kind}, _term string", each_term)
    hits = dictionary_hits(documents, named.select("_term").distinct(), key, text, "_term")
    # three steps read the hits; left to the plan, texts would be cut into words for each anew
    hits = stored(hits.select(F.col(key).alias("_d"), "_term"), "hits")
    counts = hits.groupBy("_term").agg(F.count(F.lit(1)).alias("_n"))
    weighed = named.join(counts, "_term", "left").groupBy("_q").agg(  # a query's own terms
        F.collect_list(F.struct("_term", F.coalesce("_n", F.lit(0)).alias("_n"))).alias("_counts")
    )

    def filed(text: str, counted: list) -> Iterator[tuple]:
        return iter(sorted(required(read_query(text), {c["_term"]: c["_n"] for c in counted})))

    index = _on_query(given.join(weighed, "_q").select("_q", "_query", "_counts"), f"_q {kind}, _term string", filed)
    met = join_back(hits, index, "_term").select("_d", "_q").distinct()
    asked = met.join(named, "_q").join(hits, ["_d", "_term"], "left_semi")
    present = asked.groupBy("_d", "_q").agg(F.collect_set("_term").alias("_present"))

    def verified(text: str, present: list) -> Iterator[tuple]:
        return iter(["yes"] if holds(read_query(text), set(present)) else [])

    found = _on_query(present.join(given, "_q").select("_d", "_q", "_query", "_present"), f"_d {doc_kind}, _q {kind}, _yes string", verified)
    return found.select(F.col("_d").alias(key), F.col("_q").alias(query_key))
