import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from caseledger import schemas
from caseledger.operators import accounting as ac
from caseledger.operators import flatten as ft
from caseledger.operators import pages
from caseledger.operators.pages import clean_pages, listing_entries
from caseledger.sources import payloads, spreadsheets, tables


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_folder_scan_types_files_and_bridges_columns(spark, tmp_path):
    write(tmp_path / "b" / "incident-data-1.csv", "Report ID,Subject\n1,x\n2,\n")
    write(tmp_path / "a" / "incident-data-2.csv", 'Report ID,Subject,Outcome\n1,x,\n3,"a ""q"",\nline",o\n')
    write(tmp_path / "a" / "incident-summary-and-species-9.csv", "Report ID,Genus / Species?\n1,g\n")
    write(tmp_path / "a" / "notes.csv", "n\n1\n")
    write(tmp_path / "a" / "skipped.txt", "n\n1\n")
    found = spreadsheets.scan_kinds(spark, str(tmp_path))
    assert list(found) == ["incident-data", "incident-summary-and-species", "other"]
    data = found["incident-data"]
    assert data.count() == 4
    assert data.filter("Outcome = 'o'").first()["Subject"] == 'a "q",\nline'
    merged = ac.merge_kind(data)
    kept = {(r["Report ID"], r["source_folder"], r["source_file"]) for r in merged.collect()}
    assert kept == {("1", "a", "incident-data-2.csv"), ("2", "b", "incident-data-1.csv"), ("3", "a", "incident-data-2.csv")}
    summary = ac.merge_summary({"incident-data": data.drop("row_number")}).first()
    assert (summary["files"], summary["initial_rows"], summary["removed"], summary["final_rows"]) == (2, 4, 1, 3)


def test_keyword_file(spark, tmp_path):
    write(tmp_path / "k.txt", "Keyword \nfish\n\n IUU \nfish\r\n")
    terms = spreadsheets.read_keywords(spark, str(tmp_path / "k.txt")).orderBy("position")
    assert [r["term"] for r in terms.collect()] == ["fish", "IUU", "fish"]


def test_csv_round_trip_and_column_by_position(spark, tmp_path):
    rows = [("a", 'say "x", y'), ("b", "two\nlines"), ("c", None)]
    spreadsheets.write_csv(spark.createDataFrame(rows, "k string, t string"), str(tmp_path / "c"))
    back = spreadsheets.read_csv(spark, str(tmp_path / "c"))
    assert sorted(map(tuple, back.collect())) == rows
    assert spreadsheets.column_at(back, 1).columns == ["t"]


ITEM = {"sis_taxon_id": 1, "scopes": [{"description": {"en": "Global"}, "code": "1"}, {"code": "2"}]}


@pytest.mark.parametrize(
    "envelope, n",
    [({"result": [ITEM]}, 1), ({"assessments": [ITEM, ITEM]}, 2), ({"result": json.dumps([ITEM])}, 1), ({"other": 1}, 0), ([], 0)],
)
def test_envelopes(spark, tmp_path, envelope, n):
    write(tmp_path / "e.json", json.dumps(envelope, indent=1))
    rows, rejected = payloads.read_assessments(spark, str(tmp_path / "e.json"))
    assert rows.count() == n and rejected.count() == 0
    if n:
        flat = ft.flatten_assessments(rows).first()
        assert (flat["scope_descriptions"], flat["scope_codes"]) == ("Global", "1; 2")


def test_broken_json_is_rejected(spark, tmp_path):
    write(tmp_path / "e.json", '{"result": [{"sis_taxon_id": 1}')
    rows, rejected = payloads.read_assessments(spark, str(tmp_path / "e.json"))
    assert rows.count() == 0 and rejected.first()["file"].endswith("e.json")
    write(tmp_path / "h.json", '{"htsno": "1"}\n{"htsno": "2", "units": [\n{"htsno": "3"}\n')
    rows, rejected = payloads.read_rows(spark, str(tmp_path / "h.json"), schemas.TARIFF_ROW, multi_line=False)
    assert {r["htsno"] for r in rows.collect()} == {"1", "3"}
    assert [r["record"] for r in rejected.collect()] == ['{"htsno": "2", "units": [']


def test_announced_total_of_none_gives_nothing(spark):
    pages = spark.createDataFrame([(1, 0, ["a"])], "page bigint, total_entries bigint, items array<string>")
    elements, totals = payloads.merge_pages(pages, 10)
    assert elements.count() == 0 and tuple(totals.select("pages_fetched", "actual_entries").first()) == (1, 0)


def test_taxa_payload(spark, tmp_path):
    taxon = {"id": 1, "higher_taxa": {"order": "o"}, "common_names": [
        {"name": "a", "language": "FR"}, {"name": "b", "language": "EN"}, {"name": "c", "language": "EN"}]}
    page = {"pagination": {"current_page": 1}, "taxon_concepts": [taxon, {"id": 2, "common_names": []}]}
    write(tmp_path / "t.json", json.dumps(page))
    flat = ft.flatten_taxa(payloads.read_taxa(spark, str(tmp_path / "t.json"))[0]).orderBy("id").collect()
    assert tuple(flat[0].asDict()) == ft.TAXON_COLUMNS
    assert (flat[0]["common_name_en"], flat[0]["all_common_names"], flat[0]["order"]) == ("b", "a (FR); b (EN); c (EN)", "o")
    assert (flat[1]["common_name_en"], flat[1]["all_common_names"], flat[1]["order"]) == (None, None, None)


def test_tariff_rows(spark, tmp_path):
    note = {"columns": ["a", "b"], "value": "v", "type": "t"}
    rows = [{"htsno": "1", "units": ["kg", "No."], "footnotes": [note, note]}, {"htsno": "2", "footnotes": None}]
    write(tmp_path / "h.json", json.dumps(rows))
    flat = ft.flatten_tariffs(payloads.read_rows(spark, str(tmp_path / "h.json"), schemas.TARIFF_ROW)[0])
    flat = {r["htsno"]: r.asDict() for r in flat.collect()}
    assert flat["1"]["footnotes"] == "[t] v (cols: a, b) | [t] v (cols: a, b)"
    assert flat["1"]["units"] == "kg, No."
    assert set(flat["2"].values()) == {"2", ""} and tuple(flat["2"]) == ft.TARIFF_COLUMNS


def pages_frame(spark, sizes, total):
    rows = [(p, total, [f"{p}-{i}" for i in range(n)]) for p, n in sizes.items()]
    return spark.createDataFrame(rows, "page bigint, total_entries bigint, items array<string>")


@pytest.mark.parametrize(
    "sizes, total, read, entries",
    [
        ({1: 3, 2: 3, 3: 1}, 7, 3, 7),
        ({1: 3, 2: 2, 3: 3}, 8, 2, 5),
        ({1: 3, 2: 3, 3: 3}, 6, 2, 6),
        ({1: 3, 2: 3, 4: 3}, None, 2, 6),
        ({1: 0}, 0, 1, 0),
    ],
)
def test_paged_merge_stops_where_a_client_would(spark, sizes, total, read, entries):
    elements, totals = payloads.merge_pages(pages_frame(spark, sizes, total), 3)
    assert elements.count() == entries
    line = totals.first()
    assert (line["total_entries"], line["pages_fetched"], line["actual_entries"]) == (total, read, entries)


def test_report_assembly(values):
    schema = "a int"
    got = values(ft.assemble_report(F.col("v"), schema)["a"], ['{"a": 1}', '{"a": ', None, "{}"])
    assert got == [1, None, None, None]


def test_answer_leaves_links_out(spark):
    frame = spark.createDataFrame(
        [((1, ["i"], "o"), [(1, ["s"], "s", "x")], ("sum", "s"))],
        "source struct<id: int, incidents: array<string>, overview: string>, "
        "incidents array<struct<id: int, sources: array<string>, primary_source: string, status: string>>, "
        "overview struct<summary: string, source: string>",
    )
    row = ft.without_links(frame).first()
    assert row["source"].asDict() == {"id": 1}
    assert row["incidents"][0].asDict() == {"id": 1, "status": "x"}
    assert row["overview"].asDict() == {"summary": "sum"}


def test_distributions(spark):
    frame = spark.createDataFrame(
        [(1, "NO", "Norway", "C", ["x", "y"], ["r1", "r2"]), (2, "SE", "Sweden", "C", [], [])],
        "id int, iso_code2 string, name string, type string, tags array<string>, references array<string>",
    )
    long = {(r["id"], r["reference_number"], r["reference"]) for r in ft.distributions_long(frame).collect()}
    assert long == {(1, 1, "r1"), (1, 2, "r2"), (2, None, None)}
    wide = ft.distributions_wide(frame, 3).orderBy("id").collect()
    assert (wide[0]["reference_2"], wide[0]["reference_3"], wide[1]["reference_1"]) == ("r2", None, None)


def test_collections_have_their_fixed_schema(spark, tmp_path):
    old = spark.createDataFrame([("1", "text")], "id string, article_text string")
    tables.write_collection(old, str(tmp_path), "sources")
    stored = tables.read_collection(spark, str(tmp_path), "sources")
    assert stored.columns == schemas.table_schema("sources").names
    assert stored.first()["publisher"] is None


def test_schema_export(spark):
    rows = {r["record"]: json.loads(r["schema"]) for r in schemas.describe(schemas.empty_tables(spark)).collect()}
    assert set(rows) == {"sources", "incidents", "industry_overviews", "logs"}
    assert "incident_fingerprint" in [f["name"] for f in rows["incidents"]["fields"]]


def test_crawl_report(spark, tmp_path):
    articles = spark.createDataFrame([("u", "t", "s")], "url string, title string, site string")
    tables.write_crawl_report(articles, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r/articles")).first()["url"] == "u"
    assert spark.read.json(str(tmp_path / "r/report")).first()["total_articles"] == 1


def test_progress_resumes(spark, tmp_path):
    work = spark.createDataFrame([(i,) for i in range(5)], "id bigint")
    folder = str(tmp_path / "p")
    assert tables.remaining_work(work, spark, folder, "id").count() == 5
    tables.save_progress(work.filter("id < 2"), folder, 1)
    tables.save_progress(work.filter("id < 2"), folder, 1)
    tables.save_progress(work.filter("id = 4"), folder, 2)
    assert sorted(r[0] for r in tables.remaining_work(work, spark, folder, "id").collect()) == [2, 3]


def test_one_broken_page_does_not_stop_the_others(spark):
    pages = spark.createDataFrame(
        [(1, "u1", "<body><p>fine</p></body>"), (2, "u2", None)], "page_id bigint, url string, html string"
    )
    got = {r["page_id"]: r for r in clean_pages(pages).collect()}
    assert got[1]["error"] is None and got[1]["text"] == "fine"
    assert got[2]["error"] is not None and got[2]["filtered_html"] is None


def test_listing_pages(spark):
    html = '<div class="ucn-search-entry"><a rel="bookmark" href="/a">Pêche</a></div>'
    pages = spark.createDataFrame([(1, html), (2, "<p>none</p>"), (3, None)], "page_id bigint, html string")
    got = sorted(map(tuple, listing_entries(pages).collect()))
    assert got[0] == (1, 0, "Peche", "/a", "N/A", "N/A", "N/A", None)
    assert len(got) == 2 and got[1][0] == 3 and got[1][-1] is not None


def test_page_files(spark, tmp_path):
    """Numbers come from the payload; a cut-off page is missing and is told."""
    def page(number, items):
        return json.dumps({"page": number, "total": 9, "items": items}, indent=1)

    for name, text in {
        "z.json": page(1, ["a", "b"]), "y.json": page(2, ["c", "d"]), "copy.json": page(2, ["c", "d"]),
        "x.json": page(3, ["e", "f"])[:-12], "w.json": page(4, ["g"]), "v.json": '{"total": 9}',
    }.items():
        write(tmp_path / "p" / name, text)
    pages, rejected = payloads.read_pages(spark, str(tmp_path / "p"), "page", "total", "items", "string")
    elements, totals = payloads.merge_pages(pages, 2)
    assert [r["item"] for r in elements.orderBy("page", "position").collect()] == ["a", "b", "c", "d"]
    assert tuple(totals.select("total_entries", "pages_fetched", "actual_entries").first()) == (9, 2, 4)
    assert [r["file"].rpartition("/")[2] for r in rejected.collect()] == ["x.json"]


def test_merge_summary_of_a_repeated_header_name(spark, tmp_path):
    write(tmp_path / "a" / "notes.csv", "n,note,note\n1,x,y\n1,x,y\n1,x,z\n")
    found = spreadsheets.scan_kinds(spark, str(tmp_path))["other"].drop("row_number")
    line = ac.merge_summary({"other": found}).first()
    assert tuple(line) == ("other", 1, 3, 1, 2, 3)


def test_pages_become_objects_slice_by_slice():
    """However many pages a batch holds, its rows come out a slice at a time."""
    made = []

    class Pages:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            html = ["<body><h1>Title of it</h1></body>"] * 99 + [None]
            made.extend(run([pa.RecordBatch.from_pydict({"page_id": list(range(100)), "url": ["u"] * 100, "html": html})]))

    pages.clean_pages(Pages())
    assert [b.num_rows for b in made] == [pages.SLICE] * 3 + [100 - 3 * pages.SLICE]
    last = made[-1].to_pylist()
    assert last[0]["title"] == "Title of it" and last[-1]["title"] is None and last[-1]["error"]
