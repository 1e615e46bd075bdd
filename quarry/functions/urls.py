"""Column functions over URLs: parts, scope, category, type, title, and what is not worth indexing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: RFC 3986, appendix B; groups 2, 4, 5, 7, 9 are scheme, authority, path, query, fragment.
PARTS = r"^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?"

# Schemes and path fragments that mark a URL as junk.
JUNK_SCHEMES = ("javascript", "mailto", "tel")
JUNK_FRAGMENTS = ("/sitemap", "/contact", "/privacy", "/login", "/news-room", "/news", "/search", "/feedback", "/terms")
# Path fragments of each category, in order of precedence.
CATEGORIES = (("/buying-a-flat/", "buying"), ("/selling-a-flat/", "selling"), ("/managing-my-home/", "living"), ("/renting-a-flat/", "living"))


def part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, PARTS, group)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 2))


def authority(url: Column) -> Column:
    return part(url, 4)


def path(url: Column) -> Column:
    return part(url, 5)


def query(url: Column) -> Column:
    return part(url, 7)


def fragment(url: Column) -> Column:
    return part(url, 9)


def any_of(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def is_junk(url: Column, fragments: Sequence[str] = JUNK_FRAGMENTS) -> Column:
    """Null, empty, of a scheme without pages, with a fragment, a search, or with a junk path (a
    fragment anywhere in the lower-case path counts)."""
    low = F.lower(path(url))
    search = (query(url) != "") & F.contains(low, F.lit("search"))
    return F.coalesce(F.nullif(url, F.lit("")).isNull() | scheme(url).isin(*JUNK_SCHEMES) | (fragment(url) != "") | search | any_of([F.contains(low, F.lit(x)) for x in fragments]), F.lit(True))


def in_scope(url: Column, scopes: Sequence[str]) -> Column:
    """Whether the path begins with one of the scopes; case counts."""
    return any_of([F.startswith(path(url), F.lit(s)) for s in scopes])


def category(url: Column, categories: Sequence[tuple[str, str]] = CATEGORIES, other: str = "uncategorized") -> Column:
    out = F.lit(other)
    for needle, name in reversed(categories):
        out = F.when(F.contains(path(url), F.lit(needle)), name).otherwise(out)
    return out


def doc_type(url: Column) -> Column:
    """By the end of the whole URL, its query included."""
    return F.when(F.endswith(F.lower(url), F.lit(".pdf")), "pdf").otherwise("html")


def title_case(text: Column) -> Column:
    """Upper case after anything that is no letter, lower case elsewhere."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.lower(F.substr(r, F.lit(2))))), "")


def title(url: Column) -> Column:
    """The last path segment without its extension, as words; the segment itself if no word is left;
    the URL if there is no segment."""
    whole = F.regexp_replace(path(url), r"/+$", "")
    last = F.regexp_extract(whole, r"([^/]*)$", 1)
    slug = F.regexp_replace(last, r"\.[^.]*$", "")
    words = F.trim(F.translate(slug, "-_", "  "))
    return F.when(last == "", url).when(words == "", slug).otherwise(title_case(words))
