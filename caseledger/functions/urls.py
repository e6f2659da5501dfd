"""URL expressions, all built in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseledger import rules
from caseledger.functions.text import all_of, strip

# Regular expressions rather than parse_url: the latter throws on the blanks and
# brackets that real link columns contain.
_HTTP = r"^[\x00-\x20]*(?i)https?://[^/?#]+"
_NETLOC = r"^[\x00-\x20]*(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)"
_SPLIT = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):(//[^/?#]*)?([^?#]*)(\?[^#]*)?"


def is_valid_format(url: Column) -> Column:
    return F.coalesce(url.rlike(_HTTP), F.lit(False))


def netloc(url: Column) -> Column:
    """Host with user and port as written; empty when there is none."""
    return F.regexp_extract(url, _NETLOC, 1)


def with_scheme(url: Column) -> Column:
    has_one = url.startswith("http://") | url.startswith("https://")
    return F.when(has_one, url).otherwise(F.concat(F.lit("https://"), url))


def percent_encode(text: Column) -> Column:
    """Form encoding turned into path encoding: blanks as %20, slashes kept."""
    out = F.url_encode(text)
    for written, wanted in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        out = F.replace(out, F.lit(written), F.lit(wanted))
    return out


def _without_dot_segments(path: Column) -> Column:
    pieces = F.split(path, "/")
    kept = F.aggregate(
        pieces,
        F.expr("cast(array() as array<string>)"),
        lambda done, piece: F.when(piece == ".", done)
        .when(
            piece == "..",
            F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done),
        )
        .otherwise(F.concat(done, F.array(piece))),
    )
    ends_in_folder = F.element_at(pieces, -1).isin(".", "..")
    joined = F.array_join(kept, "/")
    return F.when(ends_in_folder, F.concat(joined, F.lit("/"))).otherwise(joined)


def resolve(base: Column, href: Column) -> Column:
    """Absolute form of a link found on the page ``base``."""
    scheme = F.regexp_extract(base, _SPLIT, 1)
    site = F.concat(scheme, F.lit(":"), F.regexp_extract(base, _SPLIT, 2))
    base_path = F.regexp_extract(base, _SPLIT, 3)
    query = F.regexp_extract(base, _SPLIT, 4)
    folder = F.regexp_replace(base_path, r"[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    href_path = F.regexp_extract(href, r"^([^?#]*)", 1)
    href_rest = F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    rooted = F.when(href.startswith("/"), href_path).otherwise(F.concat(folder, href_path))
    return (
        F.when(F.coalesce(href, F.lit("")) == "", base)
        .when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("#"), F.concat(site, base_path, query, href))
        .when(href.startswith("?"), F.concat(site, base_path, href))
        .otherwise(F.concat(site, _without_dot_segments(rooted), href_rest))
    )


def looks_like_article(href: Column, title: Column, rule: rules.LinkRules) -> Column:
    lowered = F.lower(href)
    clean_title = strip(title)
    checks = [~F.contains(lowered, F.lit(p)) for p in rule.skip_in_href]
    if rule.skip_titles:
        checks.append(~F.lower(clean_title).isin(*rule.skip_titles))
    if rule.title_longer_than is not None:
        checks.append(F.length(clean_title) > rule.title_longer_than)
    if rule.href_longer_than is not None:
        checks.append(F.length(href) > rule.href_longer_than)
    if rule.href_contains:
        checks.append(F.contains(lowered, F.lit(rule.href_contains)))
    return F.coalesce(all_of(checks), F.lit(False))


def is_blocked(url: Column, hosts: tuple[str, ...] = rules.BLOCKED_HOSTS) -> Column:
    """Exact host match: a ``www.`` in front makes it another host."""
    return netloc(url).isin(*hosts)


def fetch_outcome(
    url: Column, fetched: Column, fetch_failed: Column,
    hosts: tuple[str, ...] = rules.BLOCKED_HOSTS,
) -> Column:
    """The text column a scrape leaves behind, from results fetched elsewhere."""
    unparseable = url.rlike(r"^[^/?#]*//[^/?#]*\[[^\]/?#]*(?:[/?#]|$)")
    return (
        F.when(url.isNull() | ~url.startswith("http"), F.lit(""))
        .when(unparseable, F.lit("INVALID_URL"))
        .when(is_blocked(url, hosts), F.lit("BLACKLISTED"))
        .when(fetch_failed, F.lit("SCRAPING_FAILED"))
        .otherwise(fetched)
    )
