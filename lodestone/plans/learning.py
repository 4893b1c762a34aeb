"""Numbered features and learned ranking as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import web as W
from ..operators import legacy as N
from ..operators import learning as L
from ..operators import ranking as K
from ..sources.readers import table
from ..storage import materialise
from .common import HREFS, MAIN_TEXT, RESOLVED, SPACE, TITLE, query
from .offline import _ranks, pagerank_sql
from .search import features_sql

LEGACY_QUERIES = [(1, "The rean de"), (2, "onsh zzzunknown erth the")]


def _pages(spark, sf):
    """Pages as documents of the older data sets; the rank is that of the document with the page's number."""
    ranks = _ranks(spark, sf).select(F.col("node").alias("doc_id"), F.round("rank", 9).alias("pagerank"))
    pages = table(spark, sf, "pages")
    docs = pages.select(F.col("page_id").alias("doc_id"), W.main_text(F.col("html")).alias("content"), W.title(F.col("html")).alias("title"), "url", F.array_join(W.links(F.col("html"), F.col("url")), ",").alias("outgoing_links"))
    return docs.join(ranks, "doc_id", "left").fillna(0.0, ["pagerank"])


def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '{SPACE}'), lambda x: x <> '')"


def _legacy_sql() -> str:
    split = {q: t.lower().split() for q, t in LEGACY_QUERIES}
    asked = ", ".join(f"({q}, {i}, '{t}')" for q, words in split.items() for i, t in enumerate(words))
    raw = HREFS
    links = f"list_filter(list_transform(list_filter({raw}, lambda l: l <> ''), lambda l: {RESOLVED}), lambda l: regexp_matches(l, '^https?://'))"
    out = [f"""{pagerank_sql(10)}, d AS (SELECT page_id AS doc_id, {MAIN_TEXT} AS content, {TITLE} AS title, url, array_to_string({links}, ',') AS ol FROM pages),
p AS (SELECT doc_id, url, ol, {_words("concat_ws(' ', content, url, ol)")} AS idfw, {_words('content')} AS c0, {_words('title')} AS t_title, {_words("translate(url, '/.', '  ')")} AS t_url, {_words("translate(ol, '/.', '  ')")} AS t_ol FROM d),
parts AS (SELECT doc_id, url, ol, list_distinct(idfw) AS idfw, c0[1 + len(c0) // 5 : len(c0) - len(c0) // 5] AS t_content, t_title, t_url, list_concat(c0, t_url, t_ol) AS t_whole FROM p),
asked(query_id, i, term) AS (VALUES {asked}), n AS (SELECT count(*)::DOUBLE AS n FROM parts),
idf AS (SELECT term, 1.0::DOUBLE / (count(*) + 1) AS idf FROM (SELECT unnest(idfw) AS term FROM parts) WHERE term IN (SELECT term FROM asked) GROUP BY term),
ai AS (SELECT query_id, i, term, coalesce(idf, 0.5::DOUBLE) AS idf, count(*) OVER (PARTITION BY query_id) AS m FROM asked LEFT JOIN idf USING (term)),
x AS (SELECT query_id, doc_id, part, i, idf, m, len(toks) AS sl, CASE WHEN part = 'url' THEN length(coalesce(toks[3], '')) ELSE len(toks) END AS stream, len(list_filter(toks, lambda z: z = term))::DOUBLE AS tf
  FROM (SELECT doc_id, 'content' AS part, t_content AS toks FROM parts UNION ALL SELECT doc_id, 'title', t_title FROM parts UNION ALL SELECT doc_id, 'url', t_url FROM parts UNION ALL SELECT doc_id, 'whole', t_whole FROM parts) CROSS JOIN ai),
s AS (SELECT query_id, doc_id, part, any_value(m) AS m, any_value(stream)::DOUBLE AS stream_length, round(sum(idf) / any_value(m), 6) AS idf, count(*) FILTER (WHERE tf > 0)::DOUBLE AS covered,
  coalesce(list(tf ORDER BY i) FILTER (WHERE tf > 0), []::DOUBLE[]) AS tfs, coalesce(list(tf * idf ORDER BY i) FILTER (WHERE tf > 0), []::DOUBLE[]) AS ws FROM x GROUP BY query_id, doc_id, part)"""]
    stats = []
    for name, column in (("tf", "tfs"), ("tfidf", "ws")):
        mean = f"round(coalesce(list_avg({column}), 0), 6)"
        stats += [
            f"round(coalesce(list_sum({column}), 0), 6) AS {name}_sum", f"round(coalesce(list_min({column}), 0), 6) AS {name}_min", f"round(coalesce(list_max({column}), 0), 6) AS {name}_max", f"{mean} AS {name}_mean",
            f"round(coalesce(list_sum(list_transform({column}, lambda z: (z - {mean}) * (z - {mean}))) / nullif(len({column}), 0), 0), 6) AS {name}_variance",
        ]
    out.append(f"st AS (SELECT query_id, doc_id, part, covered, round(covered / m, 6) AS covered_ratio, stream_length, idf, {', '.join(stats)} FROM s)")
    wide = [f"max({k}) FILTER (WHERE part = '{p}') AS f{base + add}" for p, base in N.PARTS.items() for k, add in N.STATISTICS.items()]
    out.append(f"wide AS (SELECT query_id, doc_id, {', '.join(wide)} FROM st GROUP BY query_id, doc_id)")
    out.append("""bm AS (SELECT query_id, doc_id, part, round(sum(CASE WHEN df > 0 THEN ln((n + 1) / df) * (2.5::DOUBLE * tf / (1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * sl / avgdl) + tf) + 0.5::DOUBLE) ELSE 0 END), 6) AS score
  FROM x JOIN (SELECT query_id, part, i, count(*) FILTER (WHERE tf > 0)::DOUBLE AS df, avg(sl) AS avgdl FROM x GROUP BY ALL) USING (query_id, part, i) CROSS JOIN n GROUP BY query_id, doc_id, part)""")
    bm = ", ".join(f"max(score) FILTER (WHERE part = '{p}') AS f{n}" for p, n in N.BM25_COLUMNS.items())
    out.append(f"bw AS (SELECT query_id, doc_id, {bm} FROM bm GROUP BY ALL)")
    page = "(length(url) - length(replace(url, '/', '')))::DOUBLE AS f126, length(url)::DOUBLE AS f127, len(string_split(ol, ','))::DOUBLE AS f129, round(coalesce(round(rank, 9), 0) * 100000, 6) AS f130"
    return ", ".join(out) + f" SELECT wide.*, {page}, {', '.join(f'f{n}' for n in N.BM25_COLUMNS.values())} FROM wide JOIN bw USING (query_id, doc_id) JOIN parts USING (doc_id) LEFT JOIN r10 ON node = doc_id"


@query("feat_numbered", _legacy_sql())
def feat_numbered(spark, sf):
    """The 64 numbered features of every page for every query."""
    return N.numbered_features(_pages(spark, sf), LEGACY_QUERIES)


@query("feat_inverse_frequency", f"WITH t AS (SELECT page_id, list_distinct({_words('concat_ws(chr(32), ' + MAIN_TEXT + ', url)')}) AS w FROM pages), a(term) AS (VALUES ('the'), ('rean'), ('zzzunknown')) SELECT a.term, CASE WHEN count(page_id) = 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE / (count(page_id) + 1) END AS idf FROM a LEFT JOIN t ON list_contains(w, a.term) GROUP BY a.term")
def feat_inverse_frequency(spark, sf):
    pages = table(spark, sf, "pages").select(W.main_text(F.col("html")).alias("content"), "url", F.lit("").alias("outgoing_links"))
    return N.idf_table(pages, ["the", "rean", "zzzunknown"])


@query("feat_pagerank_scaled", f"{pagerank_sql(10)} SELECT node AS doc_id, round(round(rank, 9) * 100000, 4) AS pagerank FROM r10")
def feat_pagerank_scaled(spark, sf):
    return _ranks(spark, sf).select(F.col("node").alias("doc_id"), F.round(F.round("rank", 9) * N.PAGERANK_SCALE, 4).alias("pagerank"))


#: Queries on pages whose judgements are known by their number, so that a twin can hold the same rows.
LEARN_TERMS = ["the", "rean", "erth", "onsh", "de", "la", "and", "of", "en", "is", "ing", "und"]
LEARN_QUERIES = [(i, f"{a} {b}") for i, (a, b) in enumerate(zip(LEARN_TERMS, LEARN_TERMS[1:] + LEARN_TERMS[:1]))]
LEARN_CANDIDATES = f"cand AS (SELECT query_id, page_id AS doc_id, {MAIN_TEXT} AS body, {TITLE} AS title, url FROM pages, (SELECT unnest(range({len(LEARN_QUERIES)}))::INTEGER AS query_id) WHERE (page_id + query_id) % 4 = 0)"


def _learn_candidates(spark, sf):
    """A first stage by page number: each page is a candidate of a quarter of the queries."""
    pages = table(spark, sf, "pages")
    ids = F.filter(F.sequence(F.lit(0), F.lit(len(LEARN_QUERIES) - 1)), lambda q: (F.col("page_id") + q) % 4 == 0)
    # Texts first, so that a page is read once and not for each of its queries.
    texts = pages.select(ids.alias("ids"), F.col("page_id").alias("doc_id"), W.main_text(F.col("html")).alias("body"), W.title(F.col("html")).alias("title"), "url")
    return texts.select(F.explode("ids").alias("query_id"), "doc_id", "body", "title", "url")


def _judged(rows):
    """Grades 0 to 3 that follow from what a feature sees: which candidates have the query's words in the body."""
    grade = F.when(F.col("body_sum_tf") >= 6, 3).when(F.col("body_sum_tf") >= 3, 2).when(F.col("body_sum_tf") >= 1, 1).otherwise(0)
    return rows.select("query_id", "doc_id", grade.alias("relevance"))


def _training(spark, sf):
    candidates = _learn_candidates(spark, sf)
    features = materialise(K.lexical_features(candidates, spark.createDataFrame(LEARN_QUERIES, "query_id int, text string")), "features")
    scored = features.select("query_id", "doc_id", F.col("title_sum_tfidf").alias("score"))
    return L.training_rows(scored, K.normalized(features, K.FEATURES, written=True), _judged(features))


@query("ltr_training_set", f"WITH {features_sql(LEARN_CANDIDATES, LEARN_QUERIES, [('zzz', 'zzz')])} SELECT query_id, doc_id, (CASE WHEN body_sum_tf >= 6 THEN 3 WHEN body_sum_tf >= 3 THEN 2 WHEN body_sum_tf >= 1 THEN 1 ELSE 0 END)::INTEGER AS label, title_sum_tfidf AS score, " + ", ".join(f"round(coalesce(({c} - min({c}) OVER w) / nullif(max({c}) OVER w - min({c}) OVER w, 0), 0), 6) AS {c}" for c in K.FEATURES) + " FROM allf WINDOW w AS (PARTITION BY query_id)")
def ltr_training_set(spark, sf):
    """Judged candidates with their label, first-stage score and 20 features scaled within the query."""
    return _training(spark, sf)


@query("ltr_lambda_rerank")
def ltr_lambda_rerank(spark, sf):
    """Trees on lambda gradients, taught by the first nine queries, rerank the others' candidates."""
    rows = K.split_by_query(materialise(_training(spark, sf), "training"), 9)
    ranker = L.LambdaRanker(K.FEATURES, rounds=8, depth=3, at=10).fit(rows.where("part = 'train'"))
    return ranker.rerank(rows.where("part = 'test'"), 100)


@query("ltr_importance")
def ltr_importance(spark, sf):
    """How often each feature splits the trees."""
    ranker = L.LambdaRanker(K.FEATURES, rounds=4, depth=3).fit(_training(spark, sf))
    return spark.createDataFrame([*ranker.importance().items()], "feature string, splits int")
