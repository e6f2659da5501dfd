import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseledger import rules
from caseledger.operators import accounting as ac
from caseledger.operators import keywords as kw
from caseledger.operators import ranking as rk
from caseledger.operators import reports as rp


def terms_frame(spark, terms):
    return spark.createDataFrame(list(enumerate(terms)), "position bigint, term string").repartition(3)


def expected_queries(terms, limit):
    """The builder's rule as a plain loop over lists."""
    fish = [t for t in terms if t.lower() in rules.FISH_TERMS]
    law = list(dict.fromkeys(t for t in terms if t.lower() in rules.ENFORCEMENT_TERMS))
    rest = [t for t in terms if t not in fish and t not in law]
    pairs = [(f, e) for f in fish for e in law]
    size = max(1, len(rest) // len(pairs)) if pairs else 1
    used, out = set(), []

    def fill(base, offered):
        length, taken = len(base), []
        for at, term in enumerate(offered):
            if length + len(term) + 6 < limit - 20:
                taken.append(at)
                length += len(term) + 6
        chosen = [offered[at] for at in taken]
        extra = " OR ".join(f'"{t}"' for t in chosen)
        return taken, chosen, f"({base}) AND ({extra})" if chosen else base

    for number, (f, e) in enumerate(pairs):
        base = f'"{f}" AND "{e}"'
        _, chosen, text = fill(base, rest[number * size : (number + 1) * size])
        used |= set(chosen)
        if len(text) <= limit:
            out.append(text)
            used |= {f, e}
    return out, [t for t in terms if t not in used]


def built(spark, terms, limit=500):
    queries, unused = kw.build_queries(terms_frame(spark, terms), limit)
    return (
        [r["query"] for r in queries.orderBy("query_number").collect()],
        [r["term"] for r in unused.orderBy("position").collect()],
    )


def test_a_list_like_the_usual_one(spark):
    law = [t for t in rules.ENFORCEMENT_TERMS if t == t.lower()] + ["falsify"]
    terms = [*rules.FISH_TERMS, *law, "IUU", *(f"term {i}" for i in range(64))]
    queries, unused = built(spark, terms)
    # one word of the list is in it twice, which gives no second set of equal queries
    assert len(queries) == 264 and max(map(len, queries)) <= 500 and unused == []
    assert (queries, unused) == expected_queries(terms, 500)


@pytest.mark.parametrize("seed, limit", [(1, 90), (2, 120), (3, 500)])
def test_builder_equals_plain_loop(spark, seed, limit):
    rng = random.Random(seed)
    terms = ["Fish", "fraud", "caviar", "x" * 200] + ["t" * rng.randint(1, 40) + str(i) for i in range(60)]
    rng.shuffle(terms)
    assert built(spark, terms, limit) == expected_queries(terms, limit)


def test_no_pairs_leaves_all_unused(spark):
    terms = ["boat", "fish", "port"]
    assert built(spark, terms) == ([], terms)


def test_query_table_marks(spark):
    frame = spark.createDataFrame([(1, "q" * 500), (2, "q" * 501)], "query_number bigint, query string")
    got = [tuple(r) for r in kw.query_table(frame).orderBy("query_id").select("query_id", "length", "valid").collect()]
    assert got == [("Q001", 500, "✓"), ("Q002", 501, "⚠")]
    assert ac.query_statistics(frame).first()["over_limit"] == 1


DOCS = [
    (1, "Big Red fish fish fish at Bay", "en"), (2, "fish and boat boat", "en"), (3, "   ", "en"),
    (4, "boat", "fr"), (5, "", "fr"),
]


@pytest.fixture
def documents(spark):
    return spark.createDataFrame(DOCS, "doc_id int, text string, lang string")


def test_frequency_ranking(documents):
    ranked = kw.ranked_by_frequency(documents, "doc_id", "text", k=2)
    got = {(r["doc_id"], r["rank"]): (r["keyword"], round(r["score"], 9)) for r in ranked.collect()}
    assert {d for d, _ in got} == {1, 2}
    assert got[1, 1] == ("fish", round(3 * (math.log(4 / 3) + 1), 9))
    assert got[2, 1] == ("boat", round(2 * (math.log(4 / 3) + 1), 9))
    assert kw.ranked_by_frequency(documents, "doc_id", "text", k=1).count() == 2


def test_corpus_report(spark, documents):
    keywords = kw.ranked_by_frequency(documents, "doc_id", "text")
    labels = spark.createDataFrame([(1, 0), (2, 0), (4, 1)], "doc_id int, cluster int")
    report = rp.corpus_report(documents, keywords, labels, "doc_id")
    summary = report.summary.first()
    assert summary["language_distribution"] == "en: 2, fr: 1"
    clusters = {r["cluster_id"]: r for r in report.clusters.collect()}
    assert clusters[0]["document_count"] == 2 and clusters[1]["top_keywords"] == ""
    assert clusters[0]["top_keywords"].startswith("fish")
    lines = {r["document_id"]: r for r in report.document_keywords.collect()}
    assert set(lines) == {1, 2, 4} and lines[4]["top_keywords"] == ""
    assert lines[2]["keyword_scores"].startswith("boat(")
    counts = Counter({r["keyword"]: r["frequency"] for r in report.global_keywords.collect()})
    assert counts["fish"] == 2
    assert report.cluster_members.count() == 3


VECTORS = "doc int, id int, vector array<double>, score double"


def chosen(frame, **options):
    rows = rk.select_diverse(frame, "doc", "id", "vector", **options).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r["doc"], r["rank"])):
        out.setdefault(r["doc"], []).append(r["id"])
    return out


def test_diverse_selection_skips_near_copies(spark):
    rows = [(1, 1, [1.0, 0.0], 0.9), (1, 2, [1.0, 0.01], 0.8), (1, 3, [0.0, 1.0], 0.7)]
    frame = spark.createDataFrame(rows, VECTORS)
    assert chosen(frame) == {1: [1, 3]}


def test_selecting_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    data, expected = [], {}
    for doc in range(4):
        vectors = rng.normal(size=(40 if doc == 0 else 8, 3))
        scores = np.round(rng.random(len(vectors)), 1)
        data += [(doc, i, v.tolist(), float(s)) for i, (v, s) in enumerate(zip(vectors, scores))]
        kept = []
        for i in sorted(range(len(vectors)), key=lambda i: (-scores[i], i)):
            unlike = all(
                vectors[i] @ vectors[j] / np.linalg.norm(vectors[i]) / np.linalg.norm(vectors[j]) < 0.7
                for j in kept
            )
            if unlike and len(kept) < 5:
                kept.append(i)
        expected[doc] = kept
    frame = spark.createDataFrame(data, VECTORS)
    assert chosen(frame, k=5) == expected


def test_lone_candidates_have_no_ranking(spark):
    candidates = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 1, [1.0, 0.0]), (2, 2, [0.0, 1.0])], "g int, id int, v array<double>")
    documents = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0])], "g int, d array<double>")
    ranked = rk.rank_candidates(rk.score_candidates(candidates, documents, "g", "v", "d"), "g", "id", 5)
    assert sorted((r["g"], r["id"], r["rank"]) for r in ranked.collect()) == [(2, 1, 1), (2, 2, 2)]


def test_clusters(spark):
    rng = np.random.default_rng(1)
    centres = np.eye(5) * 10
    rows = [(i, (centres[i % 5] + rng.normal(scale=0.1, size=5)).tolist()) for i in range(50)]
    frame = spark.createDataFrame(rows, "id int, v array<double>")
    labels, middles = rk.cluster_documents(frame, "id", "v")
    sizes = labels.groupBy("cluster").count().collect()
    assert sum(r["count"] for r in sizes) == 50 and len(sizes) == middles.count() == 5
    found = {r["cluster"]: np.array(r["centre"]) for r in middles.collect()}
    for r in labels.join(frame, "id").collect():
        distances = {c: np.linalg.norm(np.array(r["v"]) - m) for c, m in found.items()}
        assert min(distances, key=distances.get) == r["cluster"]
    assert rk.cluster_documents(frame.limit(2), "id", "v") is None
    small = rk.cluster_documents(frame.filter("id < 3"), "id", "v")
    assert small[1].count() == 3


def test_centroids_are_means(spark):
    frame = spark.createDataFrame([(1, [1.0, 3.0]), (1, [3.0, 5.0])], "g int, v array<float>")
    assert rk.centroids(frame, "g", "v").first()["centroid"] == [2.0, 4.0]
    labels = spark.createDataFrame([(1, 7)], "g int, cluster int")
    assert rk.with_cluster(frame, labels, "g").filter(F.col("cluster") == 7).count() == 2


def test_selecting_in_small_blocks_is_the_same(spark, monkeypatch):
    rng = np.random.default_rng(9)
    data = [(d, i, rng.normal(size=3).tolist(), float(np.round(rng.random(), 1))) for d in range(3) for i in range(50)]
    frame = spark.createDataFrame(data, VECTORS)
    whole = chosen(frame, k=7)
    monkeypatch.setattr(rk, "BLOCK", 4)
    assert chosen(frame, k=7) == whole


def test_centres_are_at_rest(spark):
    rng = np.random.default_rng(3)
    frame = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(3000)], "id int, v array<double>")
    labels, middles = rk.cluster_documents(frame, "id", "v")
    found = {r["cluster"]: np.array(r["centre"]) for r in middles.collect()}
    for r in rk.centroids(labels.join(frame, "id"), "cluster", "v").collect():
        assert np.abs(np.array(r["centroid"]) - found[r["cluster"]]).max() < 1e-6


def test_words_are_counted_where_they_are_read(spark):
    frame = spark.createDataFrame([(1, ["b", "a", "b", "c", "b"]), (2, []), (3, ["x"]), (4, None)], "id int, w array<string>")
    got = {r["id"]: r["c"] and [tuple(e) for e in r["c"]] for r in frame.select("id", kw.word_counts(F.col("w")).alias("c")).collect()}
    assert got == {1: [("a", 1), ("b", 3), ("c", 1)], 2: None, 3: [("x", 1)], 4: None}
    documents = spark.createDataFrame([(1, "some words and more words"), (2, "more")], "id int, t string")
    plan = kw.ranked_by_frequency(documents, "id", "t")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [id" not in plan  # no shuffle for the counts of a document
