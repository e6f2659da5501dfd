import random

from pyspark.sql import functions as F

from caseledger.operators import accounting as ac
from caseledger.operators import joins as jn
from caseledger.operators import ordering as od


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_numbers_are_consecutive_over_partitions(spark):
    frame = spark.range(0, 1000, 1, 7).select((F.col("id") % 3).alias("a"), "id")
    got = od.number_rows(frame, ["a", "id"]).collect()
    expected = sorted((r["a"], r["id"]) for r in got)
    assert [(r["a"], r["id"]) for r in sorted(got, key=lambda r: r["position"])] == expected
    assert sorted(r["position"] for r in got) == list(range(1, 1001))


def test_keep_first_merges_nulls_and_keeps_origin(spark):
    frame = spark.createDataFrame(
        [("x", None, "b", 1), ("x", None, "a", 9), (None, None, "a", 1), (None, None, "b", 2), ("y", "z", "c", 1)],
        "p string, q string, file string, row int",
    )
    kept = od.keep_first(frame, ["p", "q"], ["file", "row"])
    assert rows(kept) == rows(
        spark.createDataFrame(
            [("x", None, "a", 9), (None, None, "a", 1), ("y", "z", "c", 1)], kept.schema
        )
    )
    again = od.keep_first(kept, ["p", "q"], ["file", "row"])
    assert rows(again) == rows(kept)


def test_keep_first_cuts_copies_before_the_shuffle(spark):
    frame = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    plan = od.keep_first(frame, ["k"], ["id"])._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_chunks(spark):
    numbered = spark.range(1, 8).withColumnRenamed("id", "position")
    chunks = {r["position"]: r["chunk"] for r in od.assign_chunks(numbered, 3).collect()}
    assert chunks == {1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 6: 1, 7: 2}


def walk(spark, outcomes, target, attempts):
    frame = spark.createDataFrame(
        [(i, ok, fmt, n) for i, (ok, fmt, n) in enumerate(outcomes)], "url int, ok boolean, fmt boolean, n int"
    )
    accepted = F.when(F.col("ok"), F.col("n")).otherwise(0)
    found = od.take_until(frame, "url", F.col("fmt"), accepted, target, attempts, ["url"])
    return [(r["url"], r["accepted"]) for r in found.orderBy("url").collect()]


def test_walk_stops_at_target_or_attempts(spark):
    outcomes = [(True, True, 1), (False, True, 1), (True, True, 1), (True, True, 1)]
    assert walk(spark, outcomes, 2, 100) == [(0, True), (1, False), (2, True)]
    assert walk(spark, outcomes, 2, 2) == [(0, True), (1, False)]
    skipping = [(True, False, 1), (True, True, 5), (True, True, 1)]
    assert walk(spark, skipping, 3, 1) == [(1, True)]


def test_walk_matches_a_plain_loop(spark):
    rng = random.Random(3)
    for _ in range(5):
        outcomes = [(rng.random() < 0.5, rng.random() < 0.8, rng.randint(1, 3)) for _ in range(30)]
        target, attempts, total, checked, expected = 9, 12, 0, 0, []
        for i, (ok, fmt, n) in enumerate(outcomes):
            if total >= target or checked >= attempts:
                break
            if not fmt:
                continue
            checked += 1
            total += n if ok else 0
            expected.append((i, ok))
        assert walk(spark, outcomes, target, attempts) == expected


def test_outer_join_leaves_null_keys_alone_and_fans_out(spark):
    left = spark.createDataFrame([(None, "l0"), (1, "l1")], "Report_ID int, c string")
    right = spark.createDataFrame([(None, "r0"), (2, "r2")], "Report_ID int, c string")
    joined = jn.outer_join(left, right, "Report_ID", "_species")
    assert joined.columns == ["Report_ID", "c", "c_species"]
    assert rows(joined) == rows(
        spark.createDataFrame([(None, "l0", None), (None, None, "r0"), (1, "l1", None), (2, None, "r2")], joined.schema)
    )
    two = spark.createDataFrame([(7, "a"), (7, "b")], "Report_ID int, x string")
    three = spark.createDataFrame([(7, i) for i in range(3)], "Report_ID int, y int")
    assert jn.outer_join(two, three, "Report_ID", "_s").count() == 6


def test_join_kinds_needs_two_keys_and_drops_provenance(spark):
    one = spark.createDataFrame([("1", "a", "f")], "`Report ID` string, x string, source_file string")
    other = spark.createDataFrame([("1", "b")], "`The report id` string, x string")
    keyless = spark.createDataFrame([("z",)], "z string")
    joined, steps = jn.join_kinds({"a": one, "incident-b": other, "c": keyless})
    assert joined.columns == ["Report_ID", "x", "x_incident_b"]
    assert list(steps) == ["a", "incident-b"]
    assert jn.join_kinds({"a": one, "c": keyless}) == (None, {})
    lines = {r["kind"]: r for r in jn.join_accounting({"a": one, "incident-b": other}, steps).collect()}
    assert lines["incident-b"]["rows_added"] == 0 and lines["a"]["rows_before"] == 0


def test_left_join_keeps_unmatched_rows(spark):
    left = spark.createDataFrame([(1, "a"), (3, "b")], "code int, name string")
    right = spark.createDataFrame([(1, "x")], "group int, name string")
    joined = jn.left_join(left, right, "code", "group", "_isscaap", "_asfis")
    assert joined.columns == ["code", "name_isscaap", "group", "name_asfis"]
    assert rows(joined) == rows(spark.createDataFrame([(1, "a", 1, "x"), (3, "b", None, None)], joined.schema))


def test_species_check(spark):
    records = spark.createDataFrame(
        [(1, [("Tuna", "thunnus X"), (None, "thunnus X"), ("Cod", None)]), (2, []), (3, [("Tuna", "gadus")])],
        "id int, s array<struct<speciesCommonName: string, scientificName: string>>",
    )
    reference = spark.createDataFrame(
        [("Tuna", "Thunnus x"), ("Tuna", "THUNNUS X")], "common_name string, sci_name string"
    )
    checked = jn.verify_species_lists(records, "id", "s", reference)
    got = {r["id"]: [e["verified"] for e in r["s"]] for r in checked.collect()}
    assert got == {1: [True, False, False], 2: [], 3: [False]}


def test_listed_names(spark):
    names = spark.createDataFrame([(" gadus Morhua",), ("x",), (None,)], "name string")
    listed = spark.createDataFrame([("Gadus morhua ",), ("gadus morhua",)], "sci string")
    got = {r["name"]: r["listed"] for r in jn.flag_listed_names(names, "name", listed, "sci").collect()}
    assert got == {" gadus Morhua": True, "x": False, None: False}


def test_vessel_groups_write_no_pairs(spark):
    frame = spark.createDataFrame(
        [(1, "Aurora"), (2, "Aurora"), (3, None), (4, None), (5, ""), (6, "Solo")], "id int, vessel string"
    )
    assert rows(jn.duplicate_groups(frame, "vessel")) == [(1, "Aurora", 2, 1), (2, "Aurora", 2, 1)]
    assert jn.same_vessel(frame, "vessel", "Aurora").count() == 2
    assert jn.same_vessel(frame, "vessel", None).count() == 0


def test_dictionary_terms_of_any_length(spark):
    docs = spark.createDataFrame(
        [(1, "Shark fin, shark-fin and sharks"), (2, "fin"), (3, ""), (4, "see The RED, fish!")], "id int, text string"
    )
    terms = spark.createDataFrame([("Shark Fin",), ("fin",), ("fin",), ("sharks",), ("--",), ("the red fish",)], "term string")
    assert rows(jn.dictionary_hits(docs, terms, "id", "text", "term")) == [
        (1, "Shark Fin", 2), (1, "fin", 2), (1, "sharks", 1), (2, "fin", 1), (4, "the red fish", 1)
    ]
    assert rows(jn.dictionary_hits(docs, terms.limit(0), "id", "text", "term")) == []


def test_existing_keys(spark):
    new = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "n int, url string")
    stored = spark.createDataFrame([(9, "a"), (8, "a"), (7, None)], "id int, url string")
    assert rows(jn.flag_existing(new, stored, "url", "id")) == rows(
        spark.createDataFrame([("a", 1, 8), ("b", 2, None), (None, 3, None)], "u string, n int, e int")
    )
    assert jn.exclude_known(new, stored, "url").count() == 2


def test_accounting_identities(spark):
    frame = spark.createDataFrame([("a", 1), ("a", 1), ("b", None), ("b", None), ("b", 2)], "k string, v int")
    total = ac.dedup_accounting(frame, ["k", "v"]).first()
    assert (total["initial_rows"], total["final_rows"], total["removed"]) == (5, 3, 2)
    empty = ac.dedup_accounting(frame.limit(0), ["k"]).first()
    assert (empty["initial_rows"], empty["removed"]) == (0, 0)
    by_kind = {r["k"]: r["removed"] for r in ac.dedup_accounting(frame, ["v"], "k").collect()}
    assert by_kind == {"a": 1, "b": 1}


def test_unique_count_counts_null_once(spark):
    frame = spark.createDataFrame([("a",), (None,), (None,), ("a",)], "u string")
    assert ac.unique_count(frame, "u").first()[0] == 2


def test_statistics_of_no_queries_are_zero(spark):
    empty = spark.createDataFrame([], "query string")
    assert tuple(ac.query_statistics(empty).first()) == (0, 0, 0, 0.0, 0)


def test_concat_of_differing_columns(spark):
    one = spark.createDataFrame([(1, 2)], "a int, b int")
    two = spark.createDataFrame([(3, 4)], "b int, c int")
    merged = ac.concat_kinds([one, two])
    assert merged.columns == ["a", "b", "c"]
    assert rows(merged) == rows(spark.createDataFrame([(1, 2, None), (None, 3, 4)], merged.schema))
