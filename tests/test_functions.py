import html as stdlib_html
from urllib.parse import quote, urljoin

import pytest
from pyspark.sql import functions as F

from caseledger import rules
from caseledger.functions import html as markup
from caseledger.functions import text as tx
from caseledger.functions import urls
from caseledger.functions import vectors as vec

def v():
    return F.col("v")



def test_strip_removes_all_white_space(values):
    cases = ["  a b\t\n", " x ", "", " \r\n", None]
    assert values(tx.strip(v()), cases) == [c if c is None else c.strip() for c in cases]


def test_blank_texts(values):
    assert values(tx.has_content(v()), ["a", " \n\t", "", None, " "]) == [True, False, False, False, False]


def test_control_characters(values):
    assert values(tx.drop_control_chars(v()), ["a\x00b\x0bc\td\n", None]) == ["abc\td\n", None]


def test_ascii_fold(values):
    cases = ["Érétre 叉 ok", "ﬁsh ½", None, ""]
    assert values(tx.fold_to_ascii(v()), cases) == ["Eretre  ok", "fish 12", None, ""]


def test_defaults_and_null_spellings(values):
    assert values(tx.default_if_missing(v(), "d"), ["x", "", None]) == ["x", "d", "d"]
    cases = ["", "None", "N/A", "Not specified", "Not applicable", "x", None]
    assert values(tx.null_if_spelled(v()), cases) == [None] * 5 + ["x", None]


def test_cutting(values):
    assert values(tx.cut_with_dots(v()), ["a" * 80, "a" * 81]) == ["a" * 80, "a" * 77 + "..."]
    assert values(tx.cut(v(), 50), ["b" * 60]) == ["b" * 50]


def test_candidates(values):
    found = values(tx.keyword_candidates(v()), ["Big Red fish at Bay", "At no", "Café Olé Big caféx"])
    assert set(found[0]) == {"Big Red", "Bay", "big", "red", "fish", "bay"}
    assert found[1] == []
    assert set(found[2]) == {"Big", "big"}


def test_url_format(values):
    cases = ["HTTP://a.b", "ftp://a", "a.b/c", "http://", None, "https://a b/c", " http://x"]
    assert values(urls.is_valid_format(v()), cases) == [True, False, False, False, False, True, True]


def test_netloc_keeps_user_and_port(values):
    assert values(urls.netloc(v()), ["http://u@h.x:80/p?q", "//h/x", "x/y"]) == ["u@h.x:80", "h", ""]


def test_blocked_hosts_match_exactly(values):
    cases = ["https://twitter.com/x", "https://www.twitter.com/x"]
    assert values(urls.is_blocked(v()), cases) == [True, False]


def test_add_scheme(values):
    assert values(urls.with_scheme(v()), ["a.b", "http://a.b"]) == ["https://a.b", "http://a.b"]


def test_percent_encode_matches_quote(values):
    cases = ["Panthera leo/x", "a+b&c=d", "é~*_.-", "100%"]
    assert values(urls.percent_encode(v()), cases) == [quote(c) for c in cases]


@pytest.mark.parametrize(
    "base", ["https://h.org/a/b/c?q=1#f", "http://h.org", "http://h.org:8080/x/", "http://h.org/x?y=1"]
)
def test_resolve_matches_urljoin(values, base):
    hrefs = [
        "/x/y", "z", "../z", "../../z", "../../../z", "./z", ".", "..", "?k=v", "#top", "//o.org/p",
        "https://full.org/a", "mailto:a@b", "z/../w?x=1#y", "", "a/./b/",
    ]
    got = values(urls.resolve(F.lit(base), v()), hrefs)
    assert got == [urljoin(base, h) for h in hrefs]


def test_link_rules(spark):
    rows = [
        ("/2025/x", "Title"), ("/2025/x", "Title6"), ("/tag/x", "Long title"), ("/2025/x", " About "),
        ("https://www.justice.gov/case/1", "Long enough title"), ("https://www.justice.gov/case/1", "Short one."),
        ("/a.jpg?long=enough", ""), ("/article-1x", ""), ("/article-1", ""),
    ]
    frame = spark.createDataFrame(rows, "href string, title string").coalesce(1)
    def verdicts(rule):
        return [r[0] for r in frame.select(urls.looks_like_article(F.col("href"), F.col("title"), rule)).collect()]

    assert verdicts(rules.TRADE_NEWS_LINKS)[:4] == [False, True, False, False]
    assert verdicts(rules.PROSECUTOR_LINKS)[4:6] == [True, False]
    assert verdicts(rules.ANY_SITE_LINKS)[6:] == [False, True, False]


def test_fetch_outcomes(values):
    outcome = urls.fetch_outcome(v(), F.lit("text"), v().endswith("bad"))
    cases = [None, "ftp://x", "https://twitter.com/a", "http://[::1/x", "http://x/bad", "http://x/ok"]
    assert values(outcome, cases) == ["", "", "BLACKLISTED", "INVALID_URL", "SCRAPING_FAILED", "text"]


def test_cosine(spark):
    frame = spark.createDataFrame(
        [([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>"
    )
    got = [round(r[0], 6) for r in frame.select(vec.cosine(F.col("a"), F.col("b"))).collect()]
    assert sorted(got) == [0.0, 0.707107]


LONG = "x" * 200


def test_title_falls_through_short_heading():
    assert markup.title_of("<title>Long title</title><h1>Hi</h1>") == "Long title"
    assert markup.title_of('<meta property="og:title" content="Social title">') == "Social title"
    assert markup.title_of('<p class="x post-title">Some <b>post</b></p>') == "Somepost"
    assert markup.title_of("<p>none</p>") is None


def test_stage_is_undone_when_little_is_left():
    page = f"<body><nav>{LONG}</nav><p>short</p></body>"
    simple, kept = markup.simplify(page)
    assert LONG in simple and kept[0] is False


def test_stages_remove_structure_media_and_comments():
    page = (
        f"<body><nav>menu</nav><script>code</script><!-- note --><p>{LONG}</p><img src=a>"
        "<form>f</form></body>"
    )
    assert markup.simplify(page) == (f"<body><p>{LONG}</p></body>", [True, True, True])


def test_widget_marks_match_as_substrings():
    page = (
        f'<body><p>{LONG}</p><div class="research">gone</div><div class="ad">stays</div>'
        '<div id="share-x">gone</div></body>'
    )
    simple, _ = markup.simplify(page)
    assert "gone" not in simple and "stays" in simple


def test_links_and_other_tags_are_unwrapped():
    page = "<html><body><div><a href=x>t</a><p>q</p></div></body></html>"
    assert markup.simplify(page)[0] == "<body>t<p>q</p></body>"


def test_page_without_body_is_returned_whole():
    assert markup.simplify("<p>a &amp; b</p>")[0] == "<p>a &amp; b</p>"


def test_unclosed_tags_swallow_what_follows():
    page = f"<body><p>{LONG}</p><div class='sidebar'>x<p>also gone</body>"
    assert markup.simplify(page)[0] == f"<body><p>{LONG}</p></body>"


def test_plain_text():
    page = "<body><p> a </p>\n<p>b<br>c</p><script>s</script></body>"
    assert markup.plain_text(page) == "a\n\nb\n\nc"


def test_entities_survive_simplifying():
    page = f"<body><p>{LONG} &lt;b&gt; &eacute;</p></body>"
    simple = markup.simplify(page)[0]
    assert stdlib_html.unescape(simple).endswith("<b> é</p></body>")


def test_listing_rows():
    page = (
        '<div class="ucn-search-entry"><a rel="bookmark" href="/a"> Big <b>catch</b> </a>'
        '<span class="ucn-tag-gray"></span><span class="ucn-tag-gray"><a>Asia</a></span></div>'
        '<div class="other"></div><div class="ucn-search-entry"></div>'
    )
    rows = markup.listing_rows(page)
    assert rows[0] == {"title": "Big catch", "link": "/a", "excerpt": "N/A", "date": "N/A", "region": "Asia"}
    assert set(rows[1].values()) == {"N/A"}


def test_deep_pages_do_not_overflow():
    page = "<body>" + "<div>" * 5000 + LONG
    assert markup.simplify(page)[0] == f"<body>{LONG}</body>"
