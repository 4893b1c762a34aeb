"""Deduplication, graph, geography, frontier, learning-to-rank, topics, keywords and streaming as queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import web as W
from ..functions.scoring import CENTRE, EARTH_KM, GRADE_WEIGHTS
from ..functions.text import STOP_WORDS
from ..operators import corpus as C
from ..operators import frontier as FR
from ..operators import graph as G
from ..operators import ranking as K
from ..operators import retrieval as R
from ..sources.readers import judged_rows, table
from ..storage import materialise, shared_folder
from ..streaming import ingest
from .common import HOST, LINKS, MAIN_TEXT, NO_FRAGMENT, POSTINGS, TITLE, WORDS, query, sql_list, tok
from .search import BATCH, bm25_sql

# Deduplication


@query("dedup_exact", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY sha256(coalesce(text, ''))")
def dedup_exact(spark, sf):
    return C.exact_dedup(table(spark, sf, "documents")).select("doc_id")


@query("dedup_url", f"SELECT url, min(page_id) AS page_id FROM (SELECT page_id, {NO_FRAGMENT} AS url FROM pages) GROUP BY url")
def dedup_url(spark, sf):
    return table(spark, sf, "pages").groupBy(W.without_fragment(F.col("url")).alias("url")).agg(F.min("page_id").alias("page_id"))


@query("dedup_first_seen", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents) WHERE i = 1")
def dedup_first_seen(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.min("doc_id").alias("doc_id"))


BITS = ", ".join(f"sum(CASE WHEN (h{i // 32} >> {i % 32}) & 1 = 1 THEN tf ELSE -tf END) AS b{i}" for i in range(64))
FOLD = " | ".join(f"CASE WHEN b{i} > 0 THEN {'(-9223372036854775807 - 1)' if i == 63 else 1 << i}::BIGINT ELSE 0 END" for i in range(64))
SIMHASH = f"{POSTINGS}, hashed AS (SELECT doc_id, tf, ('0x' || substr(md5(term), 1, 8))::BIGINT AS h1, ('0x' || substr(md5(term), 9, 8))::BIGINT AS h0 FROM post), bits AS (SELECT doc_id, {BITS} FROM hashed GROUP BY doc_id), sim AS (SELECT doc_id, {FOLD} AS simhash FROM bits)"


@query("dedup_simhashes", f"WITH {SIMHASH} SELECT doc_id, simhash FROM sim")
def dedup_simhashes(spark, sf):
    return C.simhashes(table(spark, sf, "documents")).select("doc_id", "simhash")


@query("dedup_simhash_pairs", f"WITH {SIMHASH} SELECT a.doc_id AS early, b.doc_id AS late FROM sim a JOIN sim b ON a.doc_id < b.doc_id AND bit_count(xor(a.simhash, b.simhash)) <= 2")
def dedup_simhash_pairs(spark, sf):
    return C.simhash_pairs(materialise(C.simhashes(table(spark, sf, "documents")).select("doc_id", "simhash"), "simhashes"))


@query("dedup_soft", f"""WITH {SIMHASH}, dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term), w AS (SELECT doc_id, term, tf * ln((SELECT count(*) FROM documents)::DOUBLE / df) AS w FROM post JOIN dfs USING (term)),
nm AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id), pairs AS (SELECT a.doc_id AS early, b.doc_id AS late FROM sim a JOIN sim b ON a.doc_id < b.doc_id AND bit_count(xor(a.simhash, b.simhash)) <= 2),
dots AS (SELECT early, late, sum(x.w * y.w) AS dot FROM pairs JOIN w x ON x.doc_id = early JOIN w y ON y.doc_id = late AND y.term = x.term GROUP BY ALL),
dup AS (SELECT DISTINCT late AS doc_id FROM dots JOIN nm a ON a.doc_id = early JOIN nm b ON b.doc_id = late WHERE round(coalesce(dot / nullif(a.norm * b.norm, 0), 0), 6) >= 0.95)
SELECT doc_id FROM documents ANTI JOIN dup USING (doc_id)""")
def dedup_soft(spark, sf):
    return C.soft_dedup(table(spark, sf, "documents"))[0].select("doc_id")


# Link graph: a deterministic one over the documents, with repeats, outside targets and dangling nodes.

EDGES = """nodes AS (SELECT doc_id AS node FROM documents), cnt AS (SELECT count(*) AS n FROM documents),
outs AS (SELECT doc_id AS src, CASE WHEN doc_id % 7 = 3 THEN [(doc_id * 7 + 3) % n, (doc_id * 7 + 3) % n, n + doc_id] ELSE [(doc_id * 7 + 3) % n, (doc_id * 13 + 5) % n, doc_id % 50] END AS l FROM documents, cnt WHERE doc_id % 10 <> 0),
raw AS (SELECT src, 1.0::DOUBLE / len(l) AS w, unnest(l) AS dst FROM outs),
edges AS (SELECT src, dst, sum(w) AS w FROM raw WHERE dst IN (SELECT node FROM nodes) GROUP BY src, dst)"""


def _graph(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    n = docs.count()
    i = F.col("doc_id")
    odd = F.array((i * 7 + 3) % n, (i * 7 + 3) % n, i + n)
    even = F.array((i * 7 + 3) % n, (i * 13 + 5) % n, i % 50)
    pages = docs.where("doc_id % 10 <> 0").select(i.alias("url"), F.when(i % 7 == 3, odd).otherwise(even).alias("outgoing_links"))
    return docs.select(i.alias("node")), G.edges_of(pages)


def pagerank_sql(rounds: int, normalise: bool = False) -> str:
    out = [f"WITH {EDGES}", "r0 AS (SELECT node, 1.0::DOUBLE / n AS rank FROM nodes, cnt)"]
    for i in range(rounds):
        flow = f"SELECT node, 0.15::DOUBLE / n + 0.85::DOUBLE * coalesce(f, 0) AS rank FROM nodes CROSS JOIN cnt LEFT JOIN (SELECT dst AS node, sum(w * rank) AS f FROM edges JOIN r{i} ON src = node GROUP BY dst) USING (node)"
        out.append(f"r{i + 1} AS MATERIALIZED (" + (f"SELECT node, rank / sum(rank) OVER () AS rank FROM ({flow})" if normalise else flow) + ")")
    return ", ".join(out)


@query("graph_edges_known", f"WITH {EDGES} SELECT src, dst, round(w, 9) AS w FROM edges")
def graph_edges_known(spark, sf):
    nodes, edges = _graph(spark, sf)
    return G.known_edges(edges, nodes).select("src", "dst", F.round("w", 9).alias("w"))


def _ranks(spark, sf, **settings):
    return G.pagerank(*_graph(spark, sf), rounds=10, tolerance=None, **settings)


@query("graph_pagerank_fixed", f"{pagerank_sql(10)} SELECT node, round(rank, 9) AS rank FROM r10")
def graph_pagerank_fixed(spark, sf):
    return _ranks(spark, sf).select("node", F.round("rank", 9).alias("rank"))


@query("graph_pagerank_normalized", f"{pagerank_sql(10, True)} SELECT node, round(rank, 9) AS rank FROM r10")
def graph_pagerank_normalized(spark, sf):
    return _ranks(spark, sf, normalise=True).select("node", F.round("rank", 9).alias("rank"))


MEMBERS = "raw AS (SELECT DISTINCT src, w, dst FROM (SELECT src, 1.0::DOUBLE / len(l) AS w, unnest(l) AS dst FROM outs))"
MEMBER_EDGES = EDGES.replace("raw AS (SELECT src, 1.0::DOUBLE / len(l) AS w, unnest(l) AS dst FROM outs)", MEMBERS)


@query("graph_edges_members", f"WITH {MEMBER_EDGES} SELECT src, dst, round(w, 9) AS w FROM edges")
def graph_edges_members(spark, sf):
    nodes, edges = _graph(spark, sf)
    return G.member_edges(edges, nodes).select("src", "dst", F.round("w", 9).alias("w"))


@query("graph_pagerank_members", f"{pagerank_sql(10, True).replace(EDGES, MEMBER_EDGES)} SELECT node, round(rank, 9) AS rank FROM r10")
def graph_pagerank_members(spark, sf):
    """The older ranking: distinct links, ranks scaled to one in each round."""
    return _ranks(spark, sf, normalise=True, members=True).select("node", F.round("rank", 9).alias("rank"))


@query("graph_pagerank_stats", f"{pagerank_sql(10)} SELECT round(sum(rank), 9) AS total, round(min(rank), 9) AS least, round(max(rank), 9) AS greatest, round(avg(rank), 9) AS mean, round(median(rank), 9) AS median FROM r10")
def graph_pagerank_stats(spark, sf):
    return G.rank_statistics(_ranks(spark, sf))


@query("graph_pagerank_top10", f"{pagerank_sql(10)} SELECT node, round(rank, 9) AS rank FROM r10 ORDER BY round(rank, 9) DESC, node LIMIT 10")
def graph_pagerank_top10(spark, sf):
    return graph_pagerank_fixed(spark, sf).orderBy(F.desc("rank"), "node").limit(10)


def _converged_sql(rounds: int = 60) -> str:
    """All rounds, and of them the one before the first that changed less than the tolerance in all."""
    every = " UNION ALL ".join(f"SELECT {i} AS i, node, rank FROM r{i}" for i in range(rounds + 1))
    return f"""{pagerank_sql(rounds)}, al AS MATERIALIZED ({every}), d AS (SELECT a.i, sum(abs(b.rank - a.rank)) AS d FROM al a JOIN al b ON b.i = a.i + 1 AND b.node = a.node GROUP BY a.i),
k AS (SELECT coalesce(min(i) FILTER (WHERE d < 1e-6), {rounds}) AS k FROM d) SELECT node, round(rank, 9) AS rank FROM al JOIN k ON i = k"""


@query("graph_pagerank_converged", _converged_sql())
def graph_pagerank_converged(spark, sf):
    return G.pagerank(*_graph(spark, sf), rounds=60, tolerance=1e-6).select("node", F.round("rank", 9).alias("rank"))


@query("update_column_by_key", f"{pagerank_sql(10)} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN round(rank, 9) END AS pagerank FROM documents JOIN r10 ON node = doc_id")
def update_column_by_key(spark, sf):
    docs = G.with_column_if_absent(table(spark, sf, "documents").select("doc_id"), "pagerank")
    changes = graph_pagerank_fixed(spark, sf).where("node % 2 = 0").select(F.col("node").alias("doc_id"), F.col("rank").alias("pagerank"))
    return G.update_by_key(docs, changes, "doc_id", "pagerank")


# Geography

PLACES = [(n, a, o) for n, a, o, c, f in C.GAZETTEER if c == "DE" and f == "P"]
GAZ = "gaz(name, latitude, longitude) AS (VALUES " + ", ".join(f"('{n}', {a}::DOUBLE, {o}::DOUBLE)" for n, a, o in PLACES) + ")"
KM = f"2 * {EARTH_KM}::DOUBLE * asin(sqrt(pow(sin((radians(latitude) - radians({CENTRE[0]}::DOUBLE)) / 2), 2) + cos(radians(latitude)) * cos(radians({CENTRE[0]}::DOUBLE)) * pow(sin((radians(longitude) - radians({CENTRE[1]}::DOUBLE)) / 2), 2)))"
MATCHES = f"{GAZ}, hits AS (SELECT doc_id, name, latitude, longitude FROM (SELECT DISTINCT doc_id, unnest({WORDS}) AS name FROM documents) JOIN gaz USING (name))"


@query("geo_matches", f"WITH {MATCHES} SELECT doc_id, name FROM hits")
def geo_matches(spark, sf):
    return C.place_matches(table(spark, sf, "documents"), C.gazetteer(spark)).select("doc_id", "name")


@query("geo_substring_matches", f"WITH {GAZ} SELECT doc_id, name FROM documents JOIN gaz ON contains(coalesce(text, ''), name)")
def geo_substring_matches(spark, sf):
    return C.place_substrings(table(spark, sf, "documents"), PLACES).select("doc_id", "name")


@query("geo_avg_distance", f"WITH {MATCHES} SELECT doc_id, avg_km FROM documents LEFT JOIN (SELECT doc_id, round(avg({KM}), 3) AS avg_km FROM hits GROUP BY doc_id) USING (doc_id)")
def geo_avg_distance(spark, sf):
    docs = table(spark, sf, "documents")
    return C.mean_distance(docs, C.place_matches(docs, C.gazetteer(spark)))


def _ellipsoid_sql() -> str:
    """Kilometres from the gazetteer's places to the centre on WGS-84: 40 rounds of the inverse problem for each place."""
    step = """SELECT *, sqrt(power(cos(u2) * sin(lam), 2) + power(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2)) AS ss, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs"""
    angles = f"SELECT *, atan2(ss, cs) AS sig, cos(u1) * cos(u2) * sin(lam) / ss AS sa FROM ({step} FROM @)"
    middle = f"SELECT *, 1 - sa * sa AS c2, cs - 2 * sin(u1) * sin(u2) / (1 - sa * sa) AS cm FROM ({angles})"
    whole = f"SELECT *, f / 16 * c2 * (4 + f * (4 - 3 * c2)) AS cc FROM ({middle})"
    return f"""base AS (SELECT name, f, a, atan((1 - f) * tan(radians({CENTRE[0]}::DOUBLE))) AS u1, atan((1 - f) * tan(radians(latitude))) AS u2, radians(longitude - {CENTRE[1]}::DOUBLE) AS l FROM gaz, (SELECT 1 / 298.257223563::DOUBLE AS f, 6378.137::DOUBLE AS a)),
v AS (SELECT *, 0 AS i, l AS lam FROM base UNION ALL SELECT name, f, a, u1, u2, l, i + 1, l + (1 - cc) * f * sa * (sig + cc * ss * (cm + cc * cs * (2 * cm * cm - 1))) FROM ({whole.replace("@", "(SELECT * FROM v WHERE i < 40)")})),
e AS (SELECT *, c2 * (1 / ((1 - f) * (1 - f)) - 1) AS uu FROM ({whole.replace("@", "(SELECT * FROM v WHERE i = 40)")})),
b AS (SELECT *, uu / 1024 * (256 + uu * (uu * (74 - 47 * uu) - 128)) AS bb, 1 + uu / 16384 * (4096 + uu * (uu * (320 - 175 * uu) - 768)) AS aa FROM e),
km AS (SELECT name, a * (1 - f) * aa * (sig - bb * ss * (cm + bb / 4 * (cs * (2 * cm * cm - 1) - bb / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))) AS km FROM b)"""


@query("geo_avg_distance_ellipsoid", f"WITH RECURSIVE {MATCHES}, {_ellipsoid_sql()} SELECT doc_id, avg_km FROM documents LEFT JOIN (SELECT doc_id, round(avg(km), 3) AS avg_km FROM hits JOIN km USING (name) GROUP BY doc_id) USING (doc_id)")
def geo_avg_distance_ellipsoid(spark, sf):
    docs = table(spark, sf, "documents")
    return C.mean_distance(docs, C.place_matches(docs, C.gazetteer(spark)), exact=True)


# Document store and frontier: the pages, split by their number.


def _store(spark, sf, condition, content="'old'"):
    return table(spark, sf, "pages").where(condition).select("url", F.expr(f"concat({content}, '-', page_id)").alias("content"), F.col("page_id").alias("ts"))


STORE = "SELECT url, concat('{}', '-', page_id) AS content, page_id AS ts FROM pages WHERE {}"
#: One row a URL, as a primary key has it.
UNIQUE = "SELECT url, min(content) AS content, max(ts) AS ts FROM ({}) GROUP BY url"
OLD, NEW = UNIQUE.format(STORE.format("old", "page_id % 3 < 2")), STORE.format("new", "page_id % 3 > 0")


def _old(spark, sf):
    return _store(spark, sf, "page_id % 3 < 2").groupBy("url").agg(F.min("content").alias("content"), F.max("ts").alias("ts"))


def _new(spark, sf):
    return _store(spark, sf, "page_id % 3 > 0", "'new'")


@query("sync_unsent", "SELECT page_id, url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 4 = 0)")
def sync_unsent(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    return FR.unsent(pages, pages.where("page_id % 4 = 0"))


@query("sync_upsert", f"WITH o AS ({OLD}), n AS ({UNIQUE.format(NEW)}) SELECT url, content, ts FROM o ANTI JOIN n USING (url) UNION ALL SELECT url, content, ts FROM n")
def sync_upsert(spark, sf):
    changes = _new(spark, sf).groupBy("url").agg(F.min("content").alias("content"), F.max("ts").alias("ts"))
    return FR.upsert(_old(spark, sf), changes)


@query("frontier_insert_ignore", f"WITH o AS ({OLD}), n AS ({NEW}) SELECT url, content, ts FROM o UNION ALL SELECT url, content, ts FROM (SELECT * FROM n ANTI JOIN o USING (url) QUALIFY row_number() OVER (PARTITION BY url ORDER BY ts) = 1)")
def frontier_insert_ignore(spark, sf):
    return FR.insert_or_ignore(_old(spark, sf), _new(spark, sf), order="ts")


@query("frontier_replace_latest", f"SELECT url, content, ts FROM (SELECT * FROM ({STORE.format('old', 'page_id % 3 < 1')}) UNION ALL {STORE.format('new', 'page_id % 3 > 0')}) QUALIFY row_number() OVER (PARTITION BY url ORDER BY ts DESC) = 1")
def frontier_replace_latest(spark, sf):
    return FR.replace_latest(_store(spark, sf, "page_id % 3 < 1"), _new(spark, sf))


def _frontier(spark, sf):
    return table(spark, sf, "pages").groupBy("url").agg((F.min("page_id") % 3 == 0).alias("crawled"), (F.min("page_id") % 11 == 5).alias("error"))


@query("frontier_next_batch", "SELECT url FROM (SELECT url, min(page_id) AS i FROM pages GROUP BY url) WHERE i % 3 <> 0 AND i % 11 <> 5 AND url NOT ILIKE '%example.org%' ORDER BY url LIMIT 100")
def frontier_next_batch(spark, sf):
    return FR.next_batch(_frontier(spark, sf), 100, ["%example.org%"]).select("url")


@query("frontier_mark_crawled", "SELECT url, i % 3 = 0 OR url IN (SELECT url FROM pages WHERE page_id % 5 = 0) AS crawled FROM (SELECT url, min(page_id) AS i FROM pages GROUP BY url)")
def frontier_mark_crawled(spark, sf):
    return FR.mark(_frontier(spark, sf), table(spark, sf, "pages").where("page_id % 5 = 0")).select("url", "crawled")


@query("frontier_new_links", "SELECT DISTINCT url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0 UNION SELECT url FROM pages WHERE page_id % 5 = 0)")
def frontier_new_links(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    return FR.new_links(pages, pages.where("page_id % 3 = 0"), pages.where("page_id % 5 = 0"))


@query("exists_union", "SELECT url FROM pages WHERE page_id = 3 UNION SELECT url FROM pages WHERE page_id % 100 = 3")
def exists_union(spark, sf):
    pages = table(spark, sf, "pages")
    return pages.where("page_id = 3").select("url").union(pages.where("page_id % 100 = 3").select("url")).distinct()


# Learning to rank and evaluation: graded rows from the labels, a run from BM25.

GRADES = "g AS (SELECT (doc_id % 43)::INTEGER AS query_id, doc_id, ((quality + toxic * 2 + doc_id) % 4)::INTEGER AS grade, round(-4.0::DOUBLE - (doc_id * 37 % 101) / 20.0::DOUBLE, 6) AS score FROM labels)"
WEIGHT = "CASE grade " + " ".join(f"WHEN {g} THEN {w!r}::DOUBLE" for g, w in GRADE_WEIGHTS.items()) + " END"


def _graded(spark, sf):
    i = F.col("doc_id")
    grade = ((F.col("quality") + F.col("toxic") * 2 + i) % 4).cast("int")
    return table(spark, sf, "labels").select((i % 43).cast("int").alias("query_id"), "doc_id", grade.alias("grade"), F.round(F.lit(-4.0) - (i * 37 % 101) / 20.0, 6).alias("score"))


@query("ltr_labels", f"WITH {GRADES}, s AS (SELECT *, {WEIGHT} + score AS x FROM g) SELECT query_id, doc_id, (ceil(coalesce((x - min(x) OVER ()) / nullif(max(x) OVER () - min(x) OVER (), 0), 0) * 4) + 1)::INTEGER AS label FROM s")
def ltr_labels(spark, sf):
    return K.labels(_graded(spark, sf)).select("query_id", "doc_id", "label")


@query("ltr_group_sizes", f"WITH {GRADES} SELECT query_id, count(*) AS n FROM g GROUP BY query_id")
def ltr_group_sizes(spark, sf):
    return _graded(spark, sf).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))


@query("ltr_split", f"WITH {GRADES}, r AS (SELECT query_id, dense_rank() OVER (ORDER BY query_id) AS i FROM (SELECT DISTINCT query_id FROM g)) SELECT query_id, doc_id, CASE WHEN i <= 39 THEN 'train' ELSE 'test' END AS part FROM g JOIN r USING (query_id)")
def ltr_split(spark, sf):
    return K.split_by_query(_graded(spark, sf), 39).select("query_id", "doc_id", "part")


@query("ltr_judged_rows", f"SELECT r.query_id, r.doc_id, r.score, l.quality AS relevance, d.n_chars FROM ({bm25_sql('own', k1=1.2, k=100)}) r JOIN labels l USING (doc_id) JOIN documents d USING (doc_id)")
def ltr_judged_rows(spark, sf):
    docs = table(spark, sf, "documents")
    run = R.bm25(docs, BATCH, method="own", k1=1.2, k=100).select("query_id", "doc_id", "score")
    asked = spark.createDataFrame(BATCH, "query_id int, query string")
    judged = run.select("query_id", "doc_id").join(table(spark, sf, "labels").select("doc_id", F.col("quality").alias("relevance")), "doc_id")
    return judged_rows(run, asked, judged, docs.select("doc_id", "n_chars")).select("query_id", "doc_id", "score", "relevance", "n_chars")


@query("ltr_train_predict")
def ltr_train_predict(spark, sf):
    """Boosted trees on graded rows with length features, trained on the first 39 queries, reranking the rest."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("chars"), F.size(F.split("text", " ")).cast("double").alias("words"))
    rows = K.split_by_query(K.labels(_graded(spark, sf)), 39).join(docs, "doc_id").withColumn("label", F.col("label").cast("double"))
    ranker = K.Ranker(["score", "chars", "words"], rounds=5, depth=3).fit(rows.where("part = 'train'"))
    return ranker.rerank(rows.where("part = 'test'"), 100)


RUN = f"run AS ({bm25_sql('own', k1=1.2, k=100)}), rel AS (SELECT query_id, doc_id, (doc_id % 3)::INTEGER AS relevance FROM run WHERE doc_id % 2 = 0 UNION ALL SELECT DISTINCT query_id, -1::BIGINT, 2 FROM run)"


def _run(spark, sf):
    run = R.bm25(table(spark, sf, "documents"), BATCH, method="own", k1=1.2, k=100)
    hit = run.where("doc_id % 2 = 0").select("query_id", "doc_id", (F.col("doc_id") % 3).cast("int").alias("relevance"))
    missed = run.select("query_id").distinct().select("query_id", F.lit(-1).cast("long").alias("doc_id"), F.lit(2).alias("relevance"))
    return run, hit.unionByName(missed)


@query("eval_ndcg", f"""WITH {RUN}, d AS (SELECT query_id, sum((pow(2.0, coalesce(relevance, 0)) - 1) / log2(rank + 1)) AS dcg FROM run LEFT JOIN rel USING (query_id, doc_id) WHERE rank <= 10 GROUP BY query_id),
i AS (SELECT query_id, sum((pow(2.0, relevance) - 1) / log2(r + 1)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, doc_id) AS r FROM rel) WHERE r <= 10 GROUP BY query_id)
SELECT query_id, round(coalesce(dcg / nullif(idcg, 0), 0), 6) AS ndcg FROM d LEFT JOIN i USING (query_id)""")
def eval_ndcg(spark, sf):
    return K.ndcg(*_run(spark, sf))


@query("eval_map", f"""WITH {RUN}, h AS (SELECT query_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM run JOIN rel USING (query_id, doc_id) WHERE relevance > 0),
t AS (SELECT query_id, count(*) AS total FROM rel WHERE relevance > 0 GROUP BY query_id) SELECT query_id, round(coalesce(s, 0) / total, 6) AS ap FROM t LEFT JOIN (SELECT query_id, sum(n / rank) AS s FROM h GROUP BY query_id) USING (query_id)""")
def eval_map(spark, sf):
    return K.average_precision(*_run(spark, sf))


@query("eval_mrr", f"WITH {RUN} SELECT query_id, round(coalesce(1 / min(rank) FILTER (WHERE relevance > 0), 0), 6) AS rr FROM run LEFT JOIN rel USING (query_id, doc_id) GROUP BY query_id")
def eval_mrr(spark, sf):
    return K.reciprocal_rank(*_run(spark, sf))


@query("eval_result_map", f"SELECT query_id, string_agg(doc_id || '=' || printf('%.6f', score), ',' ORDER BY rank) AS results FROM ({bm25_sql('own', k1=1.2, k=10)}) GROUP BY query_id")
def eval_result_map(spark, sf):
    """Results of a query as one map, written in rank order."""
    run = R.bm25(table(spark, sf, "documents"), BATCH, method="own", k1=1.2, k=10)
    entries = F.sort_array(F.collect_list(F.struct("rank", "doc_id", "score")))
    text = F.transform(entries, lambda e: F.concat(e["doc_id"].cast("string"), F.lit("="), F.format_string("%.6f", e["score"])))
    return run.groupBy("query_id").agg(F.array_join(text, ",").alias("results"))


# Topics and keywords

TOPICS = ["t0", "t1", "t2", "t3", "t4"]
GIVEN = "giv AS (SELECT (doc_id % 3)::INTEGER AS query_id, doc_id, round((doc_id * 31 % 97) / 97.0::DOUBLE, 6) AS score, " + ", ".join(f"round((doc_id * {p} % 89) / 400.0::DOUBLE, 6) AS {t}" for t, p in zip(TOPICS, (3, 5, 7, 11, 13))) + " FROM documents)"


def _given(spark, sf):
    """Result rows with given topic shares, so that the formulas can be compared exactly."""
    i = F.col("doc_id")
    shares = [F.round((i * p % 89) / F.lit(400.0), 6).alias(t) for t, p in zip(TOPICS, (3, 5, 7, 11, 13))]
    return table(spark, sf, "documents").select((i % 3).cast("int").alias("query_id"), "doc_id", F.round((i * 31 % 97) / F.lit(97.0), 6).alias("score"), *shares)


DIVERSE = f"{GIVEN}, dv AS (SELECT query_id, doc_id, score, round(" + " + ".join(f"{t} / (sum({t}) OVER w + 1)" for t in TOPICS) + ", 6) AS diversity_score FROM giv WINDOW w AS (PARTITION BY query_id)), cb AS (SELECT *, round(0.7::DOUBLE * score + 0.3::DOUBLE * diversity_score, 7) AS combined_score FROM dv)"


@query("topic_diversity_formula", f"WITH {DIVERSE} SELECT * FROM cb")
def topic_diversity_formula(spark, sf):
    return C.diversified(_given(spark, sf), TOPICS).select("query_id", "doc_id", "score", "diversity_score", "combined_score")


@query("topic_top_combined", f"WITH {DIVERSE} SELECT query_id, doc_id, combined_score, row_number() OVER (PARTITION BY query_id ORDER BY combined_score DESC, doc_id) AS rank FROM cb QUALIFY rank <= 20")
def topic_top_combined(spark, sf):
    return R.top_k(topic_diversity_formula(spark, sf), 20, score="combined_score").select("query_id", "doc_id", "combined_score", "rank")


def _arrays_sql() -> str:
    out, seen = [f"WITH {GIVEN}"], []
    for i, t in enumerate(TOPICS):
        skip = " ".join(f"ANTI JOIN p{j} USING (query_id, doc_id)" for j in seen)
        out.append(f"p{i} AS (SELECT query_id, {i} AS topic, row_number() OVER (PARTITION BY query_id ORDER BY {t} DESC, doc_id) AS rank, doc_id FROM giv {skip} QUALIFY rank <= 5)")
        seen.append(i)
    return ", ".join(out) + " " + " UNION ALL ".join(f"SELECT query_id, topic, rank, doc_id FROM p{i}" for i in seen)


@query("topic_arrays", _arrays_sql())
def topic_arrays(spark, sf):
    return C.topic_arrays(_given(spark, sf), TOPICS)


@query("topic_payload_json", f"SELECT query_id, topic, '[' || string_agg(doc_id::VARCHAR, ',' ORDER BY rank) || ']' AS payload FROM ({_arrays_sql()}) GROUP BY query_id, topic")
def topic_payload_json(spark, sf):
    ids = F.transform(F.sort_array(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"])
    return topic_arrays(spark, sf).groupBy("query_id", "topic").agg(F.to_json(ids).alias("payload"))


@query("topic_best_union", f"WITH {DIVERSE}, r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY combined_score DESC, doc_id) AS rank, doc_id FROM cb QUALIFY rank <= 25) SELECT query_id, rank, doc_id, CASE WHEN rank > 20 THEN rank - 21 ELSE -1 END::INTEGER AS topic FROM r")
def topic_best_union(spark, sf):
    """The best 20 by combined score, and one more for each of five topics."""
    return C.completed_by_topics(topic_diversity_formula(spark, sf), 5, 20)


@query("topic_links_json", f"""WITH a AS ({_arrays_sql()}), u AS (SELECT query_id, topic, '{{"name":"Topic ' || (topic + 1) || '","urls":[' || string_agg('{{"title":"Page ' || doc_id || '","url":"https://page/' || doc_id || '"}}', ',' ORDER BY rank) || '],"color":"' || list_extract(['#f8d7da', '#d4edda', '#d1ecf1', '#fff3cd', '#e8b3f5'], topic + 1) || '"}}' AS t FROM a GROUP BY query_id, topic)
SELECT query_id, '[' || string_agg(t, ',' ORDER BY topic) || ']' AS payload FROM u GROUP BY query_id""")
def topic_links_json(spark, sf):
    named = topic_arrays(spark, sf).select("query_id", "topic", "rank", F.concat(F.lit("Page "), "doc_id").alias("title"), F.concat(F.lit("https://page/"), "doc_id").alias("url"))
    return C.topic_links(named)


@query("topic_lda_rerank")
def topic_lda_rerank(spark, sf):
    """Topics fitted once on all queries' candidates, then diversity and the combined order."""
    docs = table(spark, sf, "documents")
    found = R.bm25(docs, BATCH, method="own", k1=1.2, k=100)
    candidates = docs.join(found, "doc_id").select("query_id", "doc_id", "score", "text")
    topics = C.Topics(k=5, rounds=5).fit(candidates)
    shares = topics.transform(candidates)
    return R.top_k(C.diversified(shares, [f"topic_{i}" for i in range(5)]), 100, score="combined_score").select("query_id", "rank", "doc_id", "combined_score")


RAKE = f"""ws AS (SELECT doc_id, list_filter(string_split(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[ \\t\\r\\n\\f]+', ' ', 'g'), '([.,;:!?()|])', ' . ', 'g'), ' '), lambda w: w <> '') AS w FROM documents),
jn AS (SELECT doc_id, array_to_string(list_transform(w, lambda x: CASE WHEN list_contains({sql_list([*STOP_WORDS, '.'])}, x) THEN chr(1) ELSE x END), ' ') AS j FROM ws),
ph AS (SELECT doc_id, trim(unnest(string_split(j, chr(1)))) AS phrase FROM jn), each AS (SELECT doc_id, phrase, string_split(phrase, ' ') AS words FROM ph WHERE phrase <> ''),
wsc AS (SELECT doc_id, word, sum(deg) / count(*) AS s FROM (SELECT doc_id, len(words) AS deg, unnest(words) AS word FROM each) GROUP BY ALL),
dist AS (SELECT DISTINCT doc_id, phrase, words FROM each), ex AS (SELECT doc_id, phrase, unnest(words) AS word FROM dist),
rake AS (SELECT doc_id, phrase, round(sum(s), 9) AS score FROM ex JOIN wsc USING (doc_id, word) GROUP BY doc_id, phrase)"""


@query("kw_rake", f"WITH {RAKE} SELECT doc_id, phrase, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, phrase) AS rank FROM rake QUALIFY rank <= 50")
def kw_rake(spark, sf):
    return C.rake(table(spark, sf, "documents"), 50).select("doc_id", "phrase", "score", "rank")


@query("kw_gazetteer_entities", f"WITH {GAZ} SELECT name, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest({WORDS}) AS name FROM documents) JOIN gaz USING (name) GROUP BY name")
def kw_gazetteer_entities(spark, sf):
    return geo_matches(spark, sf).groupBy("name").agg(F.count(F.lit(1)).alias("docs"))


@query("kw_union", f"WITH {MATCHES}, {RAKE} SELECT doc_id, phrase AS keyword FROM (SELECT doc_id, phrase FROM rake QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, phrase) <= 3) UNION SELECT doc_id, name FROM hits")
def kw_union(spark, sf):
    best = C.rake(table(spark, sf, "documents"), 3).select("doc_id", F.col("phrase").alias("keyword"))
    return best.union(geo_matches(spark, sf)).distinct()


@query("kw_lda_terms")
def kw_lda_terms(spark, sf):
    return C.Topics(k=10, rounds=5, vocabulary=2000).fit(table(spark, sf, "documents")).terms(10)


@query("w2v_neighbours")
def w2v_neighbours(spark, sf):
    return C.word_neighbours(table(spark, sf, "documents"), ["rean", "onsh", "erth"])


# Streaming


def _scratch(spark) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _stream(spark, sf):
    """A stream over the table of pages, whether it is a file or a folder of files."""
    files = spark.read.parquet(f"{sf}/pages.parquet").inputFiles()
    if len(files) == 1 and files[0].rstrip("/").endswith("pages.parquet"):
        return ingest.page_stream(spark, sf, "pages.parquet")
    return ingest.page_stream(spark, f"{sf}/pages.parquet")


CONTENT = f"SELECT page_id, {NO_FRAGMENT} AS url, {TITLE} AS title, md5({MAIN_TEXT}) AS digest FROM pages"


@query("stream_ingest", CONTENT)
def stream_ingest(spark, sf):
    path = _scratch(spark)
    out = ingest.run_to_table(ingest.documents_of(_stream(spark, sf)), f"{path}/out", f"{path}/checkpoint")
    return out.select("page_id", "url", "title", F.md5("content").alias("digest"))


@query("stream_sync", f"SELECT DISTINCT {NO_FRAGMENT} AS url FROM pages")
def stream_sync(spark, sf):
    path = _scratch(spark)
    return ingest.sync(ingest.documents_of(_stream(spark, sf)), f"{path}/store", f"{path}/checkpoint").select("url")


SYNCED = f"SELECT url, max(page_id) AS page_id FROM (SELECT page_id, {NO_FRAGMENT} AS url FROM pages) GROUP BY url"


@query("stream_upsert", SYNCED)
def stream_upsert(spark, sf):
    """The last page of each URL, whether it came in one batch or another."""
    path = _scratch(spark)
    return ingest.sync(ingest.documents_of(_stream(spark, sf)), f"{path}/store", f"{path}/checkpoint").select("url", "page_id")


@query("stream_frontier", f"WITH {LINKS} SELECT url, bool_or(crawled) AS crawled FROM (SELECT {NO_FRAGMENT} AS url, true AS crawled FROM pages UNION ALL SELECT link, false FROM links) GROUP BY url")
def stream_frontier(spark, sf):
    """The frontier after a crawl of all pages: they are crawled, what they link to is not."""
    path = _scratch(spark)
    ingest.crawl(_stream(spark, sf), f"{path}/crawl", f"{path}/checkpoint")
    return ingest.frontier(spark, f"{path}/crawl").select("url", "crawled")


@query("stream_crawl_relevant", f"WITH d AS (SELECT page_id, {NO_FRAGMENT} AS url FROM pages WHERE contains(lower({MAIN_TEXT}), 'the')) SELECT url, min(page_id) AS page_id FROM d GROUP BY url")
def stream_crawl_relevant(spark, sf):
    path = _scratch(spark)
    ingest.crawl(_stream(spark, sf), f"{path}/crawl", f"{path}/checkpoint", keywords=["the"])
    return ingest.crawled_documents(spark, f"{path}/crawl").select("url", "page_id")


@query("stream_dedup", f"SELECT DISTINCT {NO_FRAGMENT} AS url FROM pages")
def stream_dedup(spark, sf):
    path = _scratch(spark)
    found = ingest.distinct_urls(ingest.documents_of(_stream(spark, sf)).select("url"))
    return ingest.run_to_table(found, f"{path}/out", f"{path}/checkpoint")


# Extras beyond the reference's own operators


@query("extra_cooccurrence", f"WITH {tok()}, x AS (SELECT DISTINCT doc_id, unnest(toks) AS term FROM tok), f AS (SELECT * FROM x WHERE term IN ('rean', 'onsh', 'erth', 'anst')) SELECT a.term AS a, b.term AS b, count(*) AS n FROM f a JOIN f b USING (doc_id) WHERE a.term < b.term GROUP BY ALL")
def extra_cooccurrence(spark, sf):
    from ..functions.text import word_tokens

    found = F.array_distinct(F.filter(word_tokens(F.col("text")), lambda t: t.isin("rean", "onsh", "erth", "anst")))
    terms = table(spark, sf, "documents").select(F.array_sort(found).alias("t"))
    pairs = F.flatten(F.transform("t", lambda a: F.transform(F.filter("t", lambda b: a < b), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return terms.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n"))


@query("extra_window_counts", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def extra_window_counts(spark, sf):
    counts = table(spark, sf, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("start"), "event_type", "n")


@query("extra_pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def extra_pricing_summary(spark, sf):
    items = table(spark, sf, "lineitem").where("l_shipdate <= TIMESTAMP '1998-09-02'")
    return items.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"), F.count(F.lit(1)).alias("n"))


@query("extra_region_revenue", "SELECT r_name, round(sum(o_totalprice), 2) AS total, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def extra_region_revenue(spark, sf):
    t = lambda n: table(spark, sf, n)
    joined = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count(F.lit(1)).alias("orders"))


@query("host_of_results", f"SELECT {HOST} AS host, max(page_id) AS last_page FROM pages GROUP BY 1")
def host_of_results(spark, sf):
    return table(spark, sf, "pages").groupBy(W.host(F.col("url")).alias("host")).agg(F.max("page_id").alias("last_page"))
