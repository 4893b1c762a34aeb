"""HTML and URL functions as Column expressions; no pattern needs look-around."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[ \t\r\n\f]+"
#: The target of an anchor, in either kind of quotes or none.
ANCHOR = r"""(?i)<a[ \t\r\n\f][^>]*?href[ \t\r\n\f]*=[ \t\r\n\f]*("[^"]*"|'[^']*'|[^ \t\r\n\f"'>]+)"""
BLOCKS = "p|h[1-6]|li|div|article|section|ul|ol|nav|header|footer|aside|table|body|html"
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def without(html: Column, tags: list[str]) -> Column:
    """HTML without comments and without the given elements."""
    html = F.regexp_replace(F.coalesce(html, F.lit("")), "(?s)<!--.*?-->", " ")
    for tag in tags:
        html = F.regexp_replace(html, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    return html


def plain(html: Column) -> Column:
    """Text without tags, with common entities decoded and white space collapsed."""
    text = F.regexp_replace(html, "(?s)<[^>]*>", " ")
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, SPACE, " "))


def visible_text(html: Column) -> Column:
    return plain(without(html, ["script", "style"]))


def main_text(html: Column) -> Column:
    """The text without scripts, styles and the frame of the page."""
    return plain(without(html, ["script", "style", "header", "footer", "nav", "aside"]))


def content_text(html: Column) -> Column:
    """The page's own text: of its article or main element, if it has one with text, else of its paragraphs that are
    no lists of links (less than half of their letters in links), else ``main_text``."""
    framed = without(html, ["script", "style", "header", "footer", "nav", "aside"])
    marked = plain(F.array_join(F.regexp_extract_all(framed, F.lit(r"(?is)<(?:article|main)\b[^>]*>(.*?)</(?:article|main)>"), F.lit(1)), " "))
    paragraphs = F.regexp_extract_all(framed, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1))
    linked = lambda p: F.length(plain(F.array_join(F.regexp_extract_all(p, F.lit(r"(?is)<a\b[^>]*>(.*?)</a>"), F.lit(1)), " ")))
    own = F.array_join(F.filter(F.transform(F.filter(paragraphs, lambda p: 2 * linked(p) < F.length(plain(p))), plain), lambda p: p != ""), " ")
    return F.when(marked != "", marked).when(own != "", own).otherwise(plain(framed))


def block_text(html: Column) -> Column:
    """Text of paragraphs, headings and list items; each ends where the next block tag stands."""
    marked = F.regexp_replace(without(html, ["script", "style"]), rf"(?i)<(/?)({BLOCKS})\b", "\x01<$1$2")
    blocks = F.filter(F.split(marked, "\x01"), lambda x: x.rlike(r"(?i)^<(p|h[1-6]|li)\b"))
    return F.array_join(F.filter(F.transform(blocks, plain), lambda x: x != ""), " ")


def title(html: Column, default: str = "N/A") -> Column:
    return F.coalesce(F.nullif(plain(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit("")), F.lit(default))


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def authority(url: Column) -> Column:
    """User, host and port as written; empty without a scheme."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def host(url: Column) -> Column:
    """The host alone, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(authority(url), "^.*@", ""), ":[0-9]*$", ""))


def resolved(link: Column, base: Column) -> Column:
    """A link as an absolute URL without fragment, against the page's URL."""
    scheme, origin = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*:)//", 1), F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, "[?#].*$", ""), "[^/]*$", "")
    full = (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("#"), base)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(origin, link))
        .otherwise(F.concat(folder, link))
    )
    return without_fragment(full)


def links(html: Column, base: Column) -> Column:
    """Absolute targets of the anchors, in order, repeats kept; only web addresses."""
    raw = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(ANCHOR), F.lit(1))
    found = F.transform(raw, lambda x: F.trim(F.regexp_replace(x, "^[\"']|[\"']$", "")))
    return F.filter(F.transform(F.filter(found, lambda x: x != ""), lambda x: resolved(x, base)), lambda x: x.rlike("^https?://"))


def url_terms(url: Column) -> Column:
    """Terms between slashes and dots."""
    return F.split(F.trim(F.regexp_replace(F.translate(F.lower(url), "/.", "  "), " +", " ")), " ")


def count_of(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part)))) / len(part)).cast("long")


def any_keyword(text: Column, words: list[str]) -> Column:
    """Whether any of the words is a substring of the lower-cased text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a | b, [low.contains(w) for w in words])


def keyword_hits(text: Column, words: list[str]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))


def keyword_density(text: Column, words: list[str]) -> Column:
    """Occurrences of the words over the number of white-space separated words."""
    low = F.lower(F.coalesce(text, F.lit("")))
    total = reduce(lambda a, b: a + b, [count_of(low, w) for w in words])
    n = F.size(F.filter(F.split(low, SPACE), lambda x: x != ""))
    return F.coalesce(F.try_divide(total.cast("double"), n), F.lit(0.0))


#: Patterns of encyclopedia pages that are no articles, found anywhere in a URL.
NOISE_PATTERNS = ["/w/index.php", "/wiki/Talk:", "/wiki/Special:", "action=edit", "action=history", "action=info", "oldid=", "&action=", "/wiki/File:", "/wiki/Help:"]
#: Encyclopedias of other languages, and the data site.
OTHER_ENCYCLOPEDIAS = [r"https://(?!en\.).*\.wikipedia\.org", r"https://www\.wikidata\.org"]


def encyclopedia_noise(url: Column) -> Column:
    """Administrative or non-English encyclopedia pages, and the data site. Case counts."""
    return reduce(lambda a, b: a | b, [url.rlike(p) for p in [*NOISE_PATTERNS, *OTHER_ENCYCLOPEDIAS]])
