"""Fixed values. Results depend on these exact words, patterns and numbers."""

from __future__ import annotations

from dataclasses import dataclass

# Record domains
ARTICLE_TYPES = (
    "Single Incident",
    "Multiple Incidents",
    "Industry Overview",
    "Unrelated to IUU Fishing",
)
IUU_TYPES = (
    "Illegal Fishing",
    "Illegal Fishing Associated Activities",
    "Unreported Catch",
    "Unreported Catch Associated Activities",
    "Unregulated Actors",
    "Unregulated Areas or Stocks",
    "Seafood Fraud or Mislabeling",
    "Forced Labor or Labor Abuse",
    "Circumventing Prohibitions or Sanctions",
    "Illegal Aquacultural Practices",
    "Other",
)
SOURCE_CATEGORIES = ("url", "text_upload", "pdf", "academic")
RECORD_STATUSES = ("extracted", "user_input", "modified")
INTAKE_STATUSES = (
    "success",
    "invalid_input",
    "failed_extraction",
    "failed_classification",
    "failed_analysis",
    "failed_formatting",
    "unrelated_content",
    "duplicate_hashed_text",
)
# An article whose url is stored already; callers get the existing record instead.
DUPLICATE_URL = "duplicate_url"
SORT_FIELDS = ("created_at", "modified_at", "event_date")

# limits
MAX_PAGE = 25
MIN_ARTICLE_CHARS = 50
MIN_STAGE_CHARS = 150
MIN_TITLE_CHARS = 5
QUERY_CHARS = 500
QUERY_MARGIN = 20
KEYWORDS_PER_DOCUMENT = 10
DIVERSITY_THRESHOLD = 0.7
CLUSTERS = 5
CLUSTER_SEED = 42

# Spellings of a missing value, and defaults
NULL_SPELLINGS = ("", "None", "N/A", "Not specified", "Not applicable")
MISSING_TEXT = "N/A"
DEFAULT_VESSEL = "default_vessel"
DEFAULT_DATE = "default_date"
DEFAULT_LOCATION = "default_location"

# Keyword categories (matched against the lower-cased term, so the
# upper-case member can never match)
FISH_TERMS = (
    "fish", "seafood", "unagi", "fishmeal", "pearls", "liver oil", "surimi",
    "swim bladder", "caviar", "shark fin", "gill raker",
)
ENFORCEMENT_TERMS = (
    "IUU", "illegal", "fraud", "investigation", "enforcement", "arrest", "charges",
    "indicted", "violation", "falsify", "misrepresent", "evasion", "sanctions",
    "unauthorized", "unlicensed", "prohibited gear", "banned gear", "closed area",
    "closed season", "not permitted", "unreported", "underreport", "misreport",
    "unregistered", "unapproved",
)
DEFAULT_FISH_TERM = "fish"
DEFAULT_ENFORCEMENT_TERM = "illegal"
KEYWORD_HEADER = "Keyword"

# Page fetching
BLOCKED_HOSTS = ("twitter.com", "linkedin.com")

# Page cleaning
STRUCTURE_TAGS = ("nav", "header", "footer", "aside")
MEDIA_TAGS = (
    "script", "style", "iframe", "embed", "object", "video", "audio", "canvas", "svg", "img",
)
WIDGET_TAGS = ("figure", "form", "input", "button")
WIDGET_MARKS = (
    "advertisement", "ad-", "ads-", "banner", "promo", "promotion", "sidebar", "widget",
    "social", "share", "comment", "related", "recommended", "trending", "popular",
    "navigation", "nav-", "menu", "breadcrumb", "logo", "brand", "cookie", "popup",
    "modal", "overlay", "subscription", "newsletter", "signup", "login", "search",
    "filter", "pagination", "pager", "tags", "category", "metadata",
)
KEPT_TAGS = (
    "p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "li", "ul", "ol", "br",
)
TITLE_CLASSES = ("article-title", "post-title", "entry-title")


@dataclass(frozen=True)
class LinkRules:
    """What makes a crawled link look like an article."""

    skip_in_href: tuple[str, ...]
    skip_titles: tuple[str, ...] = ()
    title_longer_than: int | None = None
    href_longer_than: int | None = None
    href_contains: str | None = None


# Link rules of the two known sites and of any other site
NAVIGATION_TITLES = ("search", "archive", "home", "about", "contact", "")
TRADE_NEWS_LINKS = LinkRules(
    skip_in_href=("#", "javascript:", "mailto:", "/feed", "/category", "/tag", "/author"),
    skip_titles=NAVIGATION_TITLES,
    title_longer_than=5,
)
PROSECUTOR_LINKS = LinkRules(
    skip_in_href=("#", "javascript:", "mailto:", "/search"),
    skip_titles=NAVIGATION_TITLES,
    title_longer_than=10,
    href_contains="justice.gov",
)
ANY_SITE_LINKS = LinkRules(
    skip_in_href=(
        "#", "javascript:", "mailto:", ".jpg", ".png", ".pdf", "/feed", "/category", "/tag",
        "/author", "/search", "/archive",
    ),
    href_longer_than=10,
)

# Listing page selectors, as (tag, attribute, value) per field
LISTING_ENTRY = ("div", "class", "ucn-search-entry")
LISTING_FIELDS = {
    "region": (("span", "class", "ucn-tag-gray"), ("a", None, None)),
    "date": (("span", "class", "ucn-search-date"),),
    "link": (("a", "rel", "bookmark"),),
    "excerpt": (("p", "class", "ucn-search-excerpt"),),
}

# File name prefix of each spreadsheet kind
FILE_KINDS = (
    "incident-data",
    "incident-summary-and-locations",
    "incident-summary-and-species",
)
OTHER_KIND = "other"
PROVENANCE = ("source_folder", "source_file")
REPORT_KEY = "Report_ID"

# Patterns of keywords and of characters that texts lose
CAPITALISED_PHRASE = r"(?U)\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"
PLAIN_WORD = r"(?U)\b[a-zA-Z]{3,}\b"
CONTROL_CHARACTERS = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
