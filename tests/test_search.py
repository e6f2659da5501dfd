import random
import re

import pytest

from caseledger.operators import joins, search

NEWS = (
    '("illegal fishing" OR "unregulated fishing" OR "IUU fishing") OR '
    '(fishing AND (arrest OR seizure OR "black market"))'
)


def test_reading_queries():
    assert search.read_query("a") == "a"
    assert search.read_query('"a b" OR c AND d') == ("or", "a b", ("and", "c", "d"))
    assert search.read_query(NEWS) == (
        "or", ("or", "illegal fishing", "unregulated fishing", "IUU fishing"),
        ("and", "fishing", ("or", "arrest", "seizure", "black market")),
    )
    assert search.read_query('"OR" AND and') == ("and", "OR", "and")


@pytest.mark.parametrize("text", ["", "a AND", "OR a", "(a", "a)", "a b", 'a AND "b', "()", "a AND (OR b)"])
def test_texts_that_are_no_query(text):
    with pytest.raises(ValueError):
        search.read_query(text)


def test_rarest_required_terms():
    query = search.read_query(NEWS)
    rare = search.required(query, {"fishing": 50, "arrest": 1, "seizure": 2, "black market": 0})
    assert rare == {"illegal fishing", "unregulated fishing", "IUU fishing", "arrest", "seizure", "black market"}
    assert "fishing" in search.required(query, {"fishing": 1, "arrest": 9})


def test_search_equals_reading_every_text(spark):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(12)]
    texts = [(k, " ".join(rng.choices(words, k=rng.randrange(30))).title()) for k in range(60)] + [(98, None), (99, "")]

    def term():
        return rng.choice(words) if rng.random() < 0.6 else f'"{rng.choice(words)} {rng.choice(words)}"'

    def made(depth):
        if not depth or rng.random() < 0.2:
            return term()
        kind = rng.choice([" AND ", " OR "])
        return "(" + kind.join(made(depth - 1) for _ in range(rng.randint(2, 3))) + ")"

    queries = [(f"q{k}", made(3)) for k in range(25)] + [("bad", "a AND"), ("none", None), ("common", "W1 OR w2")]

    def says(query, text):
        if isinstance(query, str):
            return re.search(rf"\b{query.lower()}\b", (text or "").lower()) is not None
        return (all if query[0] == "and" else any)(says(part, text) for part in query[1:])

    docs = spark.createDataFrame(texts, "id int, body string")
    asked = spark.createDataFrame(queries, "name string, q string")
    got = {tuple(r) for r in search.search(docs, asked, "id", "body", "name", "q").collect()}
    want = {(d, n) for d, t in texts for n, q in queries if search._parsed(q) is not None and says(search.read_query(q), t)}
    assert got == want
    assert {r["name"] for r in search.unreadable_queries(asked, "q").collect()} == {"bad", "none"}


def test_only_candidate_places_are_shuffled(spark):
    """Words that begin no term, and phrases that are none, go before the texts' phrases are counted."""
    docs = spark.createDataFrame([(k, f"alpha beta gamma alpha delta {k} " * 20) for k in range(30)], "id int, body string")
    terms = spark.createDataFrame([("Alpha beta",), ("delta",), ("beta",), ("alpha x",), ("gamma alpha delta",), ("!",)], "term string")
    hits = joins.dictionary_hits(docs, terms, "id", "body", "term")
    got = {(r["id"], r["term"]): r["hits"] for r in hits.collect()}
    assert got == {(k, t): 20 for k in range(30) for t in ("Alpha beta", "delta", "beta", "gamma alpha delta")}
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("LeftSemi")  # what is counted is cut first


def test_texts_are_cut_into_words_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c"), (2, "b x"), (3, "c a")], "id int, body string")
    docs.write.parquet(f"{tmp_path}/docs")
    asked = spark.createDataFrame([(7, "a AND c"), (8, '"b x"')], "name int, q string")
    found = search.search(spark.read.parquet(f"{tmp_path}/docs"), asked, "id", "body", "name", "q")
    assert {tuple(r) for r in found.collect()} == {(1, 7), (3, 7), (2, 8)}
    assert not [f for f in found.inputFiles() if "/docs/" in f]  # its steps read the stored hits, no text
