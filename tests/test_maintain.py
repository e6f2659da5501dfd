import hashlib
import itertools
import random

from pyspark.sql import functions as F

from caseledger.operators import links as lk
from caseledger.operators import maintain as mt

EDGE = "incident_id int, source_id string, position bigint, is_primary boolean"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def edge_set(frame):
    return {(r["incident_id"], r["source_id"]): r["is_primary"] for r in frame.collect()}


def test_hash_follows_text(spark):
    frame = spark.createDataFrame([("é", "old"), ("", "old"), (None, None)], "article_text string, article_hash string")
    assert [r["article_hash"] for r in mt.with_hash(frame).collect()] == [sha("é"), "old", None]


def incident(vessel, date, place, fingerprint=None):
    return (fingerprint, ((vessel,), (date, place)))


INCIDENT = (
    "incident_fingerprint string, extracted_information struct<"
    "catchSourceInformation: struct<vesselName: string>, "
    "eventData: struct<eventDate: string, eventLocation: string>>"
)


def test_fingerprint_fills_defaults_and_keeps_given(spark):
    rows = [incident(None, "", "p"), incident("v", "d", "p", "given"), incident("v", "d", "p", "")]
    got = [r[0] for r in mt.with_fingerprint(spark.createDataFrame(rows, INCIDENT)).collect()]
    assert got == [sha("default_vessel_default_date_p"), "given", sha("v_d_p")]
    empty = spark.createDataFrame([(None, (None, None))], INCIDENT)
    assert mt.with_fingerprint(empty).first()[0] == sha("default_vessel_default_date_default_location")


BATCH = "seq int, article_hash string, url string"


def accepted(spark, stored, batch):
    stored = spark.createDataFrame(stored, "article_hash string, url string")
    good, bad = mt.insert_unique(stored, spark.createDataFrame(batch, BATCH), "seq")
    good, bad = {r["seq"] for r in good.collect()}, {r["seq"] for r in bad.collect()}
    assert good | bad == {b[0] for b in batch} and not good & bad
    return good


def in_order(stored, batch):
    hashes, links, out = {s[0] for s in stored}, {s[1] for s in stored if s[1]}, set()
    for seq, h, u in sorted(batch):
        if h not in hashes and (u is None or u not in links):
            out.add(seq)
            hashes.add(h)
            links |= {u} - {None}
    return out


def test_uniqueness_of_hash_and_url(spark):
    assert accepted(spark, [], [(1, "a", None), (2, "a", None)]) == {1}
    assert accepted(spark, [], [(1, "a", None), (2, "b", None)]) == {1, 2}
    assert accepted(spark, [], [(1, "a", "u"), (2, "b", "u")]) == {1}
    assert accepted(spark, [("a", "u")], [(1, "b", "u"), (2, "a", None), (3, "c", "w")]) == {3}


def test_uniqueness_equals_one_by_one_inserts(spark):
    # row 2 loses its url to row 1, so its hash is free again for row 3
    chain = [(1, "a", "u"), (2, "b", "u"), (3, "b", "w"), (4, "c", "w"), (5, "c", None)]
    assert accepted(spark, [], chain) == in_order([], chain) == {1, 3, 5}
    combos = itertools.product("abc", ["u", "w", None])
    batch = [(i, h, u) for i, (h, u) in enumerate(itertools.islice(itertools.cycle(combos), 18))]
    assert accepted(spark, [("c", "x")], batch) == in_order([("c", "x")], batch)


def test_update_sets_nulls_ignores_unknown_fields_reports_unknown_ids(spark):
    table = spark.createDataFrame(
        [(1, "a", 5, ["x"]), (2, "b", 6, None)], "id int, name string, n int, tags array<string>"
    )
    updates = spark.createDataFrame(
        [(1, {"name": None, "n": "7", "nope": "z"}), (2, {"tags": '["p","q"]'}), (9, {"name": "z"})],
        "id int, changes map<string, string>",
    )
    state, errors = mt.update_by_id(table, updates)
    assert sorted(map(tuple, state.collect())) == [(1, None, 7, ["x"]), (2, "b", 6, ["p", "q"])]
    assert list(map(tuple, errors.collect())) == [(9, None, None, "unknown_id")]
    kept = {r["id"]: set(r["changes"]) for r in mt.accepted_fields(updates, table).collect()}
    assert kept[1] == {"name", "n"}


def test_updates_lose_nothing(spark):
    table = spark.createDataFrame([(1, 5, ["x"]), (2, 6, None)], "id int, n int, tags array<string>")
    updates = spark.createDataFrame(
        [(1, 2, {"n": "9"}), (1, 1, {"n": "8", "tags": "not a list"}), (2, 1, {"n": "abc"}), (2, 0, {"n": None}), (2, 2, {"n": "7"})],
        "id int, at int, changes map<string, string>",
    )
    state, errors = mt.update_by_id(table, updates, order="at")
    assert sorted(map(tuple, state.collect())) == [(1, 9, ["x"]), (2, 7, None)]
    assert sorted(map(tuple, errors.collect())) == [(1, "tags", "not a list", "invalid_value"), (2, "n", "abc", "invalid_value")]


def test_rows_without_hash_and_url_end(spark):
    batch = spark.createDataFrame([(1, None, None), (2, None, None), (3, None, "u"), (4, "a", "u")], "seq int, article_hash string, url string")
    accepted, rejected = mt.insert_unique(batch.limit(0), batch, "seq")
    assert sorted(r["seq"] for r in accepted.collect()) == [1, 4]
    assert {r["seq"]: r["reason"] for r in rejected.collect()} == {2: "article_hash", 3: "article_hash"}


def test_delete_incident_takes_its_links(spark):
    incidents = spark.createDataFrame([(1,), (2,)], "id int")
    edges = spark.createDataFrame([(1, "s", 0, True), (2, "s", 0, True)], EDGE)
    kept, links = mt.delete_incidents(incidents, edges, incidents.filter("id = 1"))
    assert [r["id"] for r in kept.collect()] == [2]
    assert edge_set(links) == {(2, "s"): True}


def test_one_to_one_links(spark):
    table = spark.createDataFrame([(1, None), (2, "o2")], "id int, overview string")
    linked = mt.set_reference(table, "overview", spark.createDataFrame([(1, "o1")], "id int, target string"))
    assert sorted(map(tuple, linked.collect())) == [(1, "o1"), (2, "o2")]
    gone = spark.createDataFrame([("o2",)], "id string")
    cleared = mt.clear_references(linked, "overview", gone)
    assert sorted(map(tuple, cleared.collect())) == [(1, "o1"), (2, None)]


def test_adding_links_is_idempotent(spark):
    edges = spark.createDataFrame([(1, "a", 0, True)], EDGE)
    added = spark.createDataFrame(
        [(1, "a", 0, False), (1, "b", 1, False), (2, "c", 2, True), (2, "d", 3, True)],
        "incident_id int, source_id string, seq int, make_primary boolean",
    )
    once = lk.add_links(edges, added)
    assert edge_set(once) == {(1, "a"): True, (1, "b"): False, (2, "c"): False, (2, "d"): True}
    assert edge_set(lk.add_links(once, added)) == edge_set(once)


def test_intake_makes_the_first_link_primary(spark):
    none = spark.createDataFrame([], EDGE)
    added = spark.createDataFrame([(1, "b", 0), (1, "a", 1)], "incident_id int, source_id string, seq int")
    assert edge_set(lk.add_with_default_primary(none, added)) == {(1, "b"): True, (1, "a"): False}


def test_removing_the_primary_promotes_the_next(spark):
    edges = spark.createDataFrame(
        [(1, "a", 0, True), (1, "b", 1, False), (1, "c", 2, False), (2, "a", 0, True), (3, "a", 0, False), (3, "b", 1, False)],
        EDGE,
    )
    gone = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a")], "incident_id int, source_id string")
    left = edge_set(lk.remove_links(edges, gone))
    assert left == {(1, "b"): True, (1, "c"): False, (3, "b"): False}


def test_edges_of_records(spark):
    records = spark.createDataFrame([(1, ["a", "b"], "b"), (2, [], None)], "id int, sources array<string>, primary_source string")
    assert edge_set(lk.edges_of(records)) == {(1, "a"): False, (1, "b"): True}


STATE = "id int, name string, info struct<a: int>"


def test_audit_rows(spark):
    before = spark.createDataFrame([(1, "x", (1,)), (2, None, None), (3, "same", (3,)), (4, "gone", None)], STATE)
    after = spark.createDataFrame([(1, "y", (2,)), (2, "new", None), (3, "same", (3,)), (5, "born", None)], STATE)
    log = {r["document_id"]: r for r in mt.audit_rows(before, after, "id", "incidents", action="edit").collect()}
    assert {k: r["operation"] for k, r in log.items()} == {"1": "update", "2": "update", "4": "delete", "5": "insert"}
    assert log["1"]["changes"]["info"].asDict() == {"old_value": '{"a":1}', "new_value": '{"a":2}'}
    assert log["2"]["changes"]["name"].asDict() == {"old_value": None, "new_value": "new"}
    assert log["4"]["after_state"] is None and log["5"]["before_state"] is None
    assert log["1"]["context"]["action"] == "edit"


def test_replaying_the_log_gives_the_new_version(spark):
    before = spark.createDataFrame([(i, f"n{i % 4}", (i,)) for i in range(20)], STATE)
    after = spark.createDataFrame([(i, f"n{i % 3}", (i,)) for i in range(5, 25)], STATE)
    log = mt.audit_rows(before, after, "id", "t")
    schema = after.schema.simpleString()
    written = log.filter("after_state is not null").select(F.from_json("after_state", schema).alias("s")).select("s.*")
    gone = log.select(F.col("document_id").cast("int").alias("id"))
    replayed = before.join(gone, "id", "left_anti").unionByName(written)
    assert sorted(map(tuple, replayed.collect())) == sorted(map(tuple, after.collect()))


def test_versions_can_be_written_again(spark, tmp_path):
    frame = spark.createDataFrame([(1, "a")], "id int, name string")
    for _ in range(2):
        mt.write_version(frame, str(tmp_path), 3)
    assert mt.read_version(spark, str(tmp_path), 3, frame.schema).count() == 1


def test_long_chains_take_few_rounds(spark, monkeypatch):
    """A chain of 1,000 rows that share hash and url in turn: every other row is accepted."""
    steps = []
    plain = mt.reliable

    def counted(frame):
        steps.append(1)
        return plain(frame)

    monkeypatch.setattr(mt, "reliable", counted)
    chain = [(k, f"h{k // 2}", f"u{(k + 1) // 2}") for k in range(1_000)]
    assert accepted(spark, [], chain) == in_order([], chain) == set(range(0, 1_000, 2))
    assert len(steps) <= 15


def test_settling_equals_one_by_one_inserts_on_random_rows(spark):
    rng = random.Random(12)
    for keys in (8, 25, 60):
        batch = [(k, f"h{rng.randrange(keys)}", rng.choice([None, f"u{rng.randrange(keys)}"])) for k in range(120)]
        assert accepted(spark, [("h1", "u1")], batch) == in_order([("h1", "u1")], batch)
