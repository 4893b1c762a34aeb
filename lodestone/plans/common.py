"""Registration of queries with their DuckDB twins, and SQL fragments that the twins share."""

from __future__ import annotations

from collections.abc import Callable

from ..functions.text import LONG_STOP_WORDS, NAVIGATION_WORDS, STOP_WORDS

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, folder) -> DataFrame under a name, with the SQL of the same result."""

    def register(function: Callable) -> Callable:
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return register


def sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


STOP = sql_list(STOP_WORDS)
LONG_STOP = sql_list(LONG_STOP_WORDS)
SPACE = r"[ \t\r\n\f]+"
TEXT = "coalesce(text, '')"
WORDS = rf"regexp_extract_all(lower({TEXT}), '[\p{{L}}\p{{N}}_]{{2,}}')"
TOKENS = f"list_filter({WORDS}, lambda x: NOT list_contains({STOP}, x))"
PUNCT = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"
PIPELINE_TOKENS = f"list_filter(string_split(regexp_replace(translate(lower({TEXT}), '{PUNCT}', ''), '{SPACE}', ' ', 'g'), ' '), lambda x: x <> '' AND NOT list_contains({sql_list(LONG_STOP_WORDS + NAVIGATION_WORDS)}, x))"


def tok(table: str = "documents", key: str = "doc_id", tokens: str = TOKENS) -> str:
    return f"tok AS (SELECT {key}, {tokens} AS toks FROM {table})"


#: Postings of all documents.
POSTINGS = f"{tok()}, post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM tok) GROUP BY ALL)"


def without_sql(html: str, tags: list[str]) -> str:
    html = f"regexp_replace(coalesce({html}, ''), '(?s)<!--.*?-->', ' ', 'g')"
    for tag in tags:
        html = rf"regexp_replace({html}, '(?is)<{tag}\b[^>]*>.*?</{tag}>', ' ', 'g')"
    return html


def plain_sql(html: str) -> str:
    text = f"regexp_replace({html}, '(?s)<[^>]*>', ' ', 'g')"
    for entity, char in [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")]:
        text = f"replace({text}, '{entity}', '{char}')"
    return f"trim(regexp_replace({text}, '{SPACE}', ' ', 'g'))"


MAIN_TEXT = plain_sql(without_sql("html", ["script", "style", "header", "footer", "nav", "aside"]))
VISIBLE_TEXT = plain_sql(without_sql("html", ["script", "style"]))
TITLE = f"coalesce(nullif({plain_sql("regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1)")}, ''), 'N/A')"
AUTHORITY = "regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
HOST = f"lower(regexp_replace(regexp_replace({AUTHORITY}, '^.*@', ''), ':[0-9]*$', ''))"
NO_FRAGMENT = "regexp_replace(url, '#.*$', '')"
RESOLVED = rf"""regexp_replace(CASE WHEN regexp_matches(l, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN l
  WHEN starts_with(l, '#') THEN url WHEN starts_with(l, '//') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*:)//', 1) || l
  WHEN starts_with(l, '/') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || l
  ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') || l END, '#.*$', '')"""
#: Every link of every page, in absolute form.
HREFS = r"""list_transform(regexp_extract_all(coalesce(html, ''), '(?i)<a\s[^>]*?href\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), lambda x: trim(regexp_replace(x, '^["'']|["'']$', '', 'g')))"""
LINKS = rf"""raw AS (SELECT page_id, url, unnest({HREFS}) AS l FROM pages),
links AS (SELECT page_id, url, link FROM (SELECT page_id, url, {RESOLVED} AS link FROM raw WHERE l <> '') WHERE regexp_matches(link, '^https?://'))"""
