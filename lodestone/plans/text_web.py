"""Scans, filters, web and text functions as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import web as W
from ..operators import graph
from ..sources import readers, writers
from ..sources.readers import table
from .common import AUTHORITY, HOST, LINKS, MAIN_TEXT, NO_FRAGMENT, LONG_STOP, PIPELINE_TOKENS, SPACE, STOP, TEXT, TITLE, TOKENS, VISIBLE_TEXT, WORDS, plain_sql, query, sql_list, without_sql

KEYWORDS = ["rean", "onsh", "ingti", "erth", "ndor", "anst"]
EXCLUDED = ["%example.org%", "%.html%", "%page=%"]
#: Frequent short words of each language.
MARKERS = {"de": ["der", "und", "ist", "nicht"], "en": ["the", "and", "is", "of"], "es": ["el", "los", "una", "con"], "fr": ["le", "les", "est", "dans"]}
LOW = f"lower({TEXT})"


@query("scan_project_limit", "SELECT doc_id, lang, source FROM documents ORDER BY doc_id LIMIT 100")
def scan_project_limit(spark, sf):
    return readers.projected(table(spark, sf, "documents"), ["doc_id", "lang", "source"], 100, "doc_id")


@query("filter_keyword_any", f"SELECT doc_id FROM documents WHERE {' OR '.join(f'contains({LOW}, {chr(39)}{w}{chr(39)})' for w in KEYWORDS)}")
def filter_keyword_any(spark, sf):
    return table(spark, sf, "documents").where(W.any_keyword(F.col("text"), KEYWORDS)).select("doc_id")


COUNTED = " + ".join(f"(length({LOW}) - length(replace({LOW}, '{w}', ''))) / {len(w)}" for w in KEYWORDS)


@query("filter_keyword_density", f"SELECT doc_id, density FROM (SELECT doc_id, round(coalesce(({COUNTED})::DOUBLE / nullif(len(list_filter(regexp_split_to_array({LOW}, '{SPACE}'), lambda x: x <> '')), 0), 0), 6) AS density FROM documents) WHERE density >= 0.05")
def filter_keyword_density(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(W.keyword_density(F.col("text"), KEYWORDS), 6).alias("density")).where("density >= 0.05")


@query("keyword_hits", f"SELECT doc_id, array_to_string(list_filter({sql_list(KEYWORDS)}, lambda w: contains({LOW}, w)), ',') AS hits FROM documents")
def keyword_hits(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(W.keyword_hits(F.col("text"), KEYWORDS), ",").alias("hits"))


@query("filter_lang", "SELECT doc_id, source FROM documents WHERE lang = 'en'")
def filter_lang(spark, sf):
    return table(spark, sf, "documents").where("lang = 'en'").select("doc_id", "source")


def _votes(words: list[str], lang: str):
    return F.size(F.filter(T.space_tokens(F.col("text")), lambda t: t.isin(words))).alias(lang)


VOTES = ", ".join(f"len(list_filter(regexp_split_to_array({LOW}, '{SPACE}'), lambda x: list_contains({sql_list(w)}, x))) AS {k}" for k, w in MARKERS.items())


@query("filter_lang_detect", f"SELECT doc_id, CASE WHEN greatest(de, en, es, fr) = 0 THEN 'unknown' WHEN en = greatest(de, en, es, fr) THEN 'en' WHEN de = greatest(de, en, es, fr) THEN 'de' WHEN es = greatest(de, en, es, fr) THEN 'es' ELSE 'fr' END AS detected FROM (SELECT doc_id, {VOTES} FROM documents)")
def filter_lang_detect(spark, sf):
    votes = table(spark, sf, "documents").select("doc_id", *[_votes(w, k) for k, w in MARKERS.items()])
    best = F.greatest(*MARKERS)
    return votes.select("doc_id", F.when(best == 0, "unknown").when(F.col("en") == best, "en").when(F.col("de") == best, "de").when(F.col("es") == best, "es").otherwise("fr").alias("detected"))


@query("filter_cheap_english", f"SELECT doc_id FROM documents WHERE contains({TEXT}, 'the') OR contains({TEXT}, 'and') OR contains({TEXT}, 'is') OR contains({TEXT}, 'in')")
def filter_cheap_english(spark, sf):
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf, "documents").where(text.contains("the") | text.contains("and") | text.contains("is") | text.contains("in")).select("doc_id")


#: Pages of the test data as if some hosts were the encyclopedia.
AS_WIKI = """CASE page_id % 16 WHEN 0 THEN 'https://de.wikipedia.org/wiki/X' WHEN 1 THEN 'https://en.wikipedia.org/wiki/Y' || page_id WHEN 2 THEN 'https://en.wikipedia.org/wiki/Talk:Y'
 WHEN 3 THEN 'https://www.wikidata.org/wiki/Q1' WHEN 4 THEN 'https://en.wikipedia.org/w/index.php?title=Z' WHEN 5 THEN 'https://other.example/wiki/Special:Z' WHEN 6 THEN url || '?oldid=7'
 WHEN 7 THEN url || '&action=x' WHEN 8 THEN url || '?action=x' WHEN 9 THEN 'https://en.wikipedia.org/wiki/User:Z' WHEN 10 THEN 'https://www.wikipedia.org/' WHEN 11 THEN 'http://de.wikipedia.org/wiki/Z'
 WHEN 12 THEN 'https://en.wikipedia.org/wiki/File:Z' WHEN 13 THEN 'https://e.wikipedia.org/' ELSE url END"""
#: Written out for an engine without look-ahead: after https:// anything but "en.".
WIKI_NOISE = r"""regexp_matches(u, '/w/index.php|/wiki/Talk:|/wiki/Special:|/wiki/File:|/wiki/Help:|action=edit|action=history|action=info|oldid=|&action=|https://www\.wikidata\.org')
 OR regexp_matches(u, 'https://(\.|e\.|[^e].*\.|e[^n].*\.|en[^.].*\.)wikipedia\.org')"""


@query("filter_wiki_urls", f"SELECT page_id, u AS url FROM (SELECT page_id, {AS_WIKI} AS u FROM pages) WHERE NOT ({WIKI_NOISE})")
def filter_wiki_urls(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.expr(AS_WIKI).alias("url"))
    return pages.where(~W.encyclopedia_noise(F.col("url")))


@query("filter_like_exclude", "SELECT page_id, url FROM pages WHERE " + " AND ".join(f"url NOT ILIKE '{p}'" for p in EXCLUDED))
def filter_like_exclude(spark, sf):
    out = table(spark, sf, "pages").select("page_id", "url")
    for pattern in EXCLUDED:
        out = out.where(~F.col("url").ilike(pattern))
    return out


@query("filter_content_size", "SELECT page_id, strlen(html) AS size FROM pages WHERE strlen(html) <= 10485760")
def filter_content_size(spark, sf):
    return readers.size_capped(table(spark, sf, "pages"), F.col("html")).select("page_id", F.octet_length("html").cast("long").alias("size"))


@query("filter_in_list", "SELECT page_id, url FROM pages WHERE page_id IN (1, 5, 8, 13, 21)")
def filter_in_list(spark, sf):
    return readers.by_ids(table(spark, sf, "pages"), [1, 5, 8, 13, 21], "page_id").select("page_id", "url")


@query("filter_is_null", "SELECT count(*) FILTER (WHERE text IS NULL) AS missing, count(*) FILTER (WHERE text IS NULL) > 0 AS needed FROM documents")
def filter_is_null(spark, sf):
    return table(spark, sf, "documents").agg(F.count(F.when(F.col("text").isNull(), 1)).alias("missing")).select("missing", (F.col("missing") > 0).alias("needed"))


@query("web_title", f"SELECT page_id, {TITLE} AS title FROM pages")
def web_title(spark, sf):
    return table(spark, sf, "pages").select("page_id", W.title(F.col("html")).alias("title"))


MARKED = rf"regexp_replace({without_sql('html', ['script', 'style'])}, '(?i)<(/?)({W.BLOCKS})\b', chr(1) || '<\1\2', 'g')"


@query("web_block_text", f"SELECT page_id, array_to_string(list_filter(list_transform(list_filter(string_split({MARKED}, chr(1)), lambda x: regexp_matches(x, '(?i)^<(p|h[1-6]|li)\\b')), lambda y: {plain_sql('y')}), lambda z: z <> ''), ' ') AS content FROM pages")
def web_block_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", W.block_text(F.col("html")).alias("content"))


@query("web_visible_text", f"SELECT page_id, {VISIBLE_TEXT} AS content FROM pages")
def web_visible_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", W.visible_text(F.col("html")).alias("content"))


@query("web_main_text", f"SELECT page_id, {MAIN_TEXT} AS content FROM pages")
def web_main_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", W.main_text(F.col("html")).alias("content"))


def _links(spark, sf):
    return table(spark, sf, "pages").select("page_id", "url", F.explode(W.links(F.col("html"), F.col("url"))).alias("link"))


@query("web_links", f"WITH {LINKS} SELECT page_id, link, count(*) AS n FROM links GROUP BY ALL")
def web_links(spark, sf):
    return _links(spark, sf).groupBy("page_id", "link").agg(F.count(F.lit(1)).alias("n"))


@query("web_keyword_links", f"WITH {LINKS} SELECT DISTINCT page_id, link FROM links WHERE contains(lower(link), 'the') OR contains(lower(link), 'and')")
def web_keyword_links(spark, sf):
    return _links(spark, sf).where(W.any_keyword(F.col("link"), ["the", "and"])).select("page_id", "link").distinct()


@query("web_normalized_urls", f"SELECT page_id, {NO_FRAGMENT} AS url FROM pages")
def web_normalized_urls(spark, sf):
    return table(spark, sf, "pages").select("page_id", W.without_fragment(F.col("url")).alias("url"))


@query("web_domain", f"SELECT page_id, {AUTHORITY} AS authority, {HOST} AS host FROM pages")
def web_domain(spark, sf):
    return table(spark, sf, "pages").select("page_id", W.authority(F.col("url")).alias("authority"), W.host(F.col("url")).alias("host"))


@query("web_domain_overview", f"SELECT {HOST} AS host, count(*) AS n FROM pages GROUP BY 1")
def web_domain_overview(spark, sf):
    return table(spark, sf, "pages").groupBy(W.host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "host")


@query("web_internal_external", f"WITH {LINKS} SELECT page_id, count(*) FILTER (WHERE regexp_extract(link, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) = {AUTHORITY}) AS internal, count(*) AS total FROM links GROUP BY page_id")
def web_internal_external(spark, sf):
    own = W.authority(F.col("link")) == W.authority(F.col("url"))
    return _links(spark, sf).groupBy("page_id").agg(F.count(F.when(own, 1)).alias("internal"), F.count(F.lit(1)).alias("total"))


URL_TERMS = "string_split(trim(regexp_replace(translate(lower(url), '/.', '  '), ' +', ' ', 'g')), ' ')"


@query("web_url_features", rf"""SELECT page_id, length(url) - length(replace(url, '/', '')) AS slashes, length(url) AS chars, len({URL_TERMS}) AS terms, coalesce(length({URL_TERMS}[3]), 0) AS third_length,
len(regexp_extract_all(coalesce(html, ''), '(?i)<a[^>]*href="([^"]*)"', 1)) AS outlinks FROM pages""")
def web_url_features(spark, sf):
    terms = W.url_terms(F.col("url"))
    outlinks = F.size(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit('(?i)<a[^>]*href="([^"]*)"'), F.lit(1))).cast("long")
    third = F.coalesce(F.length(F.try_element_at(terms, F.lit(3))), F.lit(0)).cast("long")
    return table(spark, sf, "pages").select("page_id", W.count_of(F.col("url"), "/").alias("slashes"), F.length("url").cast("long").alias("chars"), F.size(terms).cast("long").alias("terms"), third.alias("third_length"), outlinks.alias("outlinks"))


@query("web_incoming_links", f"WITH {LINKS} SELECT link AS url, count(*) AS incoming_count FROM links GROUP BY 1")
def web_incoming_links(spark, sf):
    return graph.incoming_counts(W.links(F.col("html"), F.col("url")), table(spark, sf, "pages"))


@query("web_outlink_union", f"WITH {LINKS} SELECT DISTINCT link FROM links")
def web_outlink_union(spark, sf):
    return _links(spark, sf).select("link").distinct()


@query("web_link_sets", f"WITH {LINKS} SELECT page_id, len(list_distinct(list(link))) AS n FROM links GROUP BY page_id")
def web_link_sets(spark, sf):
    """Internal and external links as one set."""
    links = W.links(F.col("html"), F.col("url"))
    own = F.filter(links, lambda x: W.authority(x) == W.authority(F.col("url")))
    other = F.filter(links, lambda x: W.authority(x) != W.authority(F.col("url")))
    return table(spark, sf, "pages").select("page_id", F.size(F.array_union(own, other)).cast("long").alias("n")).where("n > 0")


SIMPLE = f"string_split(trim(regexp_replace(regexp_replace({LOW}, '[,.!]', ' ', 'g'), '{SPACE}', ' ', 'g')), ' ')"


def _token_query(name, tokens, sql):
    @query(name, f"SELECT doc_id, len({sql}) AS n, md5(array_to_string({sql}, ' ')) AS digest FROM documents")
    def run(spark, sf):
        t = tokens(F.col("text"))
        return table(spark, sf, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.md5(F.array_join(t, " ")).alias("digest"))

    return run


ALPHA = rf"list_filter(string_split(regexp_replace(regexp_replace({LOW}, '<[^>]*>', ' ', 'g'), '{SPACE}|[!-,./:-@\[-`{{-~]+', ' ', 'g'), ' '), lambda x: regexp_full_match(x, '\p{{L}}+') AND NOT list_contains({LONG_STOP}, x))"
SPACED = f"list_filter(regexp_split_to_array({LOW}, '{SPACE}'), lambda x: x <> '')"
_token_query("tok_simple", T.simple_tokens, SIMPLE)
_token_query("tok_pipeline", T.pipeline_tokens, PIPELINE_TOKENS)
_token_query("tok_regex_stop", T.word_tokens, TOKENS)
_token_query("tok_whitespace", T.space_tokens, SPACED)
_token_query("tok_alpha", T.alpha_tokens, ALPHA)
CUT = f"CAST(floor(len({SPACED}) * 0.2) AS INTEGER)"
_token_query("text_trim20", lambda text: T.trimmed(T.space_tokens(text)), f"list_slice({SPACED}, {CUT} + 1, len({SPACED}) - {CUT})")


@query("word_freq_top", f"SELECT term, count(*) AS n FROM (SELECT unnest({TOKENS}) AS term FROM documents) GROUP BY 1 ORDER BY n DESC, term LIMIT 50")
def word_freq_top(spark, sf):
    counts = table(spark, sf, "documents").select(F.explode(T.word_tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "term").limit(50)


@query("vocab_size", f"SELECT count(DISTINCT term) AS terms FROM (SELECT unnest({TOKENS}) AS term FROM documents)")
def vocab_size(spark, sf):
    return table(spark, sf, "documents").select(F.explode(T.word_tokens(F.col("text"))).alias("term")).distinct().agg(F.count(F.lit(1)).alias("terms"))


def _lemma_sql(term: str) -> str:
    cases = [f"WHEN {term} = '{p}' THEN '{s}'" for p, s in T.IRREGULAR.items()]
    for ending, base in T.SUFFIXES:
        extra = "" if ending != "s" else f" AND NOT (ends_with({term}, 'ss') OR ends_with({term}, 'us') OR ends_with({term}, 'is'))"
        cases.append(f"WHEN ends_with({term}, '{ending}') AND length({term}) >= {len(ending) + 3}{extra} THEN left({term}, length({term}) - {len(ending)}) || '{base}'")
    return f"CASE {' '.join(cases)} ELSE {term} END"


@query("lemma_rules", f"SELECT DISTINCT term, {_lemma_sql('term')} AS lemma FROM (SELECT unnest({WORDS}) AS term FROM documents)")
def lemma_rules(spark, sf):
    terms = table(spark, sf, "documents").select(F.explode(T.word_tokens(F.col("text"), stop=False)).alias("term")).distinct()
    return terms.select("term", T.lemma(F.col("term")).alias("lemma"))


@query("count_tables", "SELECT 'pages' AS name, count(*) AS n FROM pages UNION ALL SELECT 'documents', count(*) FROM documents")
def count_tables(spark, sf):
    one = lambda n: table(spark, sf, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n")
    return one("pages").unionByName(one("documents"))


@query("label_histogram", "SELECT quality, count(*) AS n FROM labels GROUP BY quality")
def label_histogram(spark, sf):
    return table(spark, sf, "labels").groupBy("quality").agg(F.count(F.lit(1)).alias("n"))


@query("rename_project", "SELECT doc_id, text AS body FROM documents")
def rename_project(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text").withColumnRenamed("text", "body")


@query("merge_subcorpora", "SELECT concat('docs_', doc_id) AS _id, text FROM documents UNION ALL SELECT concat('bench_', item_id), text FROM benchmark")
def merge_subcorpora(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("_id"), "text")
    bench = table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("_id"), "text")
    return readers.merged_subcorpora({"docs": docs, "bench": bench})


@query("term_point_lookup", "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (3, 14, 15, 92)")
def term_point_lookup(spark, sf):
    return readers.by_ids(table(spark, sf, "documents"), [3, 14, 15, 92]).select("doc_id", "lang", "n_chars")


@query("payload_json", """SELECT page_id, '{"page_id":' || page_id || ',"host":"' || """ + HOST + """ || '"}' AS payload FROM pages""")
def payload_json(spark, sf):
    return table(spark, sf, "pages").select("page_id", W.host(F.col("url")).alias("host")).select("page_id", writers.payload("page_id", "host").alias("payload"))


@query("pipeline_clean_index", f"""WITH first AS (SELECT min(page_id) AS page_id FROM pages GROUP BY sha256(coalesce(html, ''))), kept AS (SELECT page_id, url AS u, html FROM pages SEMI JOIN first USING (page_id)),
clean AS (SELECT page_id, u AS url, {TITLE} AS title, {MAIN_TEXT} AS text FROM kept WHERE NOT ({WIKI_NOISE})) SELECT page_id, url, title, array_to_string({PIPELINE_TOKENS}, ' ') AS tokens FROM clean""")
def pipeline_clean_index(spark, sf):
    from ..operators.corpus import clean_pages

    return clean_pages(table(spark, sf, "pages")).select("page_id", "url", "title", F.array_join("tokens", " ").alias("tokens"))


FIRST_PAGES = f"""first AS (SELECT min(page_id) AS page_id FROM pages GROUP BY sha256(coalesce(html, ''))), kept AS (SELECT page_id, url AS u, html FROM pages SEMI JOIN first USING (page_id)),
clean AS (SELECT page_id, u AS url, {TITLE} AS title, {MAIN_TEXT} AS text FROM kept WHERE NOT ({WIKI_NOISE})), ctok AS (SELECT page_id, url, title, {PIPELINE_TOKENS} AS toks FROM clean)"""
BASES = f"cterms AS (SELECT DISTINCT unnest(toks) AS term FROM ctok), cbase AS (SELECT term, base FROM (SELECT term, {_lemma_sql('term')} AS base FROM cterms) WHERE base <> term AND base IN (SELECT term FROM cterms))"


@query("pipeline_clean_lemma", f"""WITH {FIRST_PAGES}, {BASES}, fl AS (SELECT page_id, unnest(toks) AS term, generate_subscripts(toks, 1) AS i FROM ctok)
SELECT c.page_id, c.url, c.title, coalesce(t.tokens, '') AS tokens FROM ctok c LEFT JOIN (SELECT page_id, string_agg(coalesce(base, term), ' ' ORDER BY i) AS tokens FROM fl LEFT JOIN cbase USING (term) GROUP BY page_id) t USING (page_id)""")
def pipeline_clean_lemma(spark, sf):
    from ..operators.corpus import clean_pages

    return clean_pages(table(spark, sf, "pages"), lemmas=True).select("page_id", "url", "title", F.array_join("tokens", " ").alias("tokens"))


_BITS = ", ".join(f"sum(CASE WHEN (h{i // 32} >> {i % 32}) & 1 = 1 THEN tf ELSE -tf END) AS b{i}" for i in range(64))
_SIM = " | ".join(f"CASE WHEN b{i} > 0 THEN {'(-9223372036854775807 - 1)' if i == 63 else 1 << i}::BIGINT ELSE 0 END" for i in range(64))


@query("pipeline_clean_soft", f"""WITH {FIRST_PAGES}, post AS (SELECT page_id, term, count(*) AS tf FROM (SELECT page_id, unnest(toks) AS term FROM ctok) GROUP BY ALL),
hashed AS (SELECT page_id, tf, ('0x' || substr(md5(term), 1, 8))::BIGINT AS h1, ('0x' || substr(md5(term), 9, 8))::BIGINT AS h0 FROM post), bits AS (SELECT page_id, {_BITS} FROM hashed GROUP BY page_id), sim AS (SELECT page_id, {_SIM} AS simhash FROM bits),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term), w AS (SELECT page_id, term, tf * ln((SELECT count(*) FROM ctok)::DOUBLE / df) AS w FROM post JOIN dfs USING (term)), nm AS (SELECT page_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY page_id),
pairs AS (SELECT a.page_id AS early, b.page_id AS late FROM sim a JOIN sim b ON a.page_id < b.page_id AND bit_count(xor(a.simhash, b.simhash)) <= 2), dots AS (SELECT early, late, sum(x.w * y.w) AS dot FROM pairs JOIN w x ON x.page_id = early JOIN w y ON y.page_id = late AND y.term = x.term GROUP BY ALL),
dup AS (SELECT DISTINCT late AS page_id FROM dots JOIN nm a ON a.page_id = early JOIN nm b ON b.page_id = late WHERE round(coalesce(dot / nullif(a.norm * b.norm, 0), 0), 6) >= 0.95)
SELECT page_id, url, title FROM ctok ANTI JOIN dup USING (page_id)""")
def pipeline_clean_soft(spark, sf):
    """The whole cleaning chain with its last step, the removal of near copies."""
    from ..operators.corpus import clean_pages

    return clean_pages(table(spark, sf, "pages"), soft=True).select("page_id", "url", "title")


_FRAMED = without_sql("html", ["script", "style", "header", "footer", "nav", "aside"])


@query("web_content_text", rf"""WITH f AS (SELECT page_id, {_FRAMED} AS h FROM pages), x AS (SELECT page_id, h, array_to_string(regexp_extract_all(h, '(?is)<(?:article|main)\b[^>]*>(.*?)</(?:article|main)>', 1), ' ') AS m, regexp_extract_all(h, '(?is)<p\b[^>]*>(.*?)</p>', 1) AS ps FROM f),
y AS (SELECT page_id, {plain_sql('m')} AS marked, {plain_sql('h')} AS whole, array_to_string(list_filter(list_transform(list_filter(ps, lambda p: 2 * length({plain_sql("array_to_string(regexp_extract_all(p, '(?is)<a[^>]*>(.*?)</a>', 1), ' ')")}) < length({plain_sql('p')})), lambda p: {plain_sql('p')}), lambda p: p <> ''), ' ') AS own FROM x)
SELECT page_id, CASE WHEN marked <> '' THEN marked WHEN own <> '' THEN own ELSE whole END AS content FROM y""")
def web_content_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", W.content_text(F.col("html")).alias("content"))
