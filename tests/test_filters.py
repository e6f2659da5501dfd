import pytest
from pyspark.sql import functions as F

from caseledger.operators import filters as fl

SCHEMA = (
    "id int, primary_source int, verified boolean, status string, "
    "extracted_information struct<eventData: struct<eventDate: string>>, "
    "incident_classification struct<iuuClassifications: array<struct<IUUType: string>>>"
)


@pytest.fixture
def incidents(spark):
    def row(i, date, types, source=1, verified=False, status="extracted"):
        listed = None if types is None else [(t,) for t in types]
        return (i, source, verified, status, ((date,),), (listed,))

    rows = [
        row(1, "2024-01-01", ["Other"]),
        row(2, "2024-03-01", [], verified=True),
        row(3, None, None, source=2),
        row(4, "Not specified", ["Illegal Fishing", "Other"], status="modified"),
        row(5, "2024-02-01", ["Illegal Fishing"]),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def sources(spark):
    return spark.createDataFrame([(1, "url"), (2, "pdf")], "id int, category string")


def listing(incidents, sources, **request):
    page, totals = fl.list_incidents(incidents, sources, fl.IncidentFilters(**request))
    return [r["id"] for r in page.collect()], totals.first().asDict()


def test_sorted_newest_first_undated_last(incidents, sources):
    ids, totals = listing(incidents, sources)
    assert ids == [2, 5, 1, 3, 4]
    assert totals == {"total": 5, "limit": 25, "skip": 0, "has_more": False}


def test_paging(incidents, sources):
    assert listing(incidents, sources, skip=3, limit=3) == (
        [3, 4], {"total": 5, "limit": 3, "skip": 3, "has_more": False}
    )
    assert listing(incidents, sources, limit=2)[1]["has_more"] is True


def test_element_match(incidents, sources):
    assert listing(incidents, sources, IUU_type="Illegal Fishing")[0] == [5, 4]


def test_conjunction_and_linked_category(incidents, sources):
    assert listing(incidents, sources, verified="true")[0] == [2]
    assert listing(incidents, sources, source_type="pdf") == (
        [3], {"total": 1, "limit": 25, "skip": 0, "has_more": False}
    )
    assert listing(incidents, sources, status="modified", verified="false")[0] == [4]


@pytest.mark.parametrize(
    "bad",
    [{"limit": 0}, {"limit": 26}, {"skip": -1}, {"sort_by": "title"}, {"status": "x"},
     {"verified": "yes"}, {"IUU_type": "Fraud or Mislabeling of Species"}, {"source_type": "academic"}],
)
def test_requests_outside_the_domain_are_refused(bad):
    with pytest.raises(ValueError):
        fl.IncidentFilters(**bad)


def test_intake_verdict(spark):
    rows = [(None, None), ("", ""), ("u", None), (None, "x" * 49), (None, "x" * 50)]
    frame = spark.createDataFrame(rows, "url string, text string").coalesce(1)
    got = [r[0] for r in frame.select(fl.intake_verdict(F.col("url"), F.col("text"))).collect()]
    assert got == ["rejected", "rejected", "ok", "invalid_input", "ok"]


def test_quarantine_names_failed_checks(spark):
    frame = spark.createDataFrame(
        [(1, "Other", 0.5), (2, "Fraud or Mislabeling of Species", 2.0), (3, None, 0.1)],
        "id int, IUUType string, confidence double",
    )
    checks = [
        fl.one_of("IUUType", ("Other",)), fl.Check("confidence", F.col("confidence").between(0, 1)),
    ]
    valid, bad = fl.split_valid(frame, checks)
    assert [r["id"] for r in valid.collect()] == [1]
    assert {(r["id"], r["reason"]) for r in bad.collect()} == {
        (2, "IUUType,confidence"), (3, "IUUType")
    }


def test_boolean_search(values):
    query = ("or", "shark fin", ("and", "boat", ("or", "port", "sea")))
    texts = ["Shark Fin soup", "a BOAT at sea", "boat only", "seaport boats"]
    assert values(fl.matches(F.col("v"), query), texts) == [True, True, False, True]
    assert values(fl.matches(F.col("v"), query, True), texts) == [True, True, False, False]
    assert values(fl.matches(F.col("v"), "c++ (x)", True), ["in c++ (x)!", "cxx"]) == [True, False]


def test_keyword_categories(values):
    assert values(fl.keyword_category(F.col("v")), ["IUU", "Fish", "fraud", "boat"]) == [
        "other", "fish", "enforcement", "other"
    ]


def test_lookup(incidents):
    assert fl.find_by_id(incidents, 4).count() == 1
    assert fl.find_by_id(incidents, 99).isEmpty()
