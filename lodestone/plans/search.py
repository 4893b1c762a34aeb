"""Index, BM25, vector-space, fusion and feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import web as W
from ..operators import ranking as K
from ..operators import retrieval as R
from ..sources import writers
from ..sources.readers import table
from ..storage import materialise
from .common import HOST, MAIN_TEXT, POSTINGS, SPACE, TITLE, TOKENS, query, tok

#: Demonstration queries: words of the invented test corpus.
BATCH = [(1, "rean onsh ingti"), (2, "erth anst anst"), (3, "enhe atin"), (4, "tion ndor erth zzzunknown")]
ASKED = {q: {t: text.split().count(t) for t in text.split()} for q, text in BATCH}


def asked_sql(batch=None) -> str:
    rows = [(q, t, c) for q, terms in (batch or ASKED).items() for t, c in terms.items()]
    return "q(query_id, term, qtf) AS (VALUES " + ", ".join(f"({q}, '{t}', {float(c)}::DOUBLE)" for q, t, c in rows) + ")"


def idf_sql(method: str) -> str:
    rest = "(n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)"
    return {"own": f"ln(1 + {rest})", "lucene": f"ln(1 + {rest})", "robertson": f"ln(greatest(1.0::DOUBLE, {rest}))", "atire": "ln(n / df)", "bm25l": "ln((n + 1) / (df + 0.5::DOUBLE))", "bm25+": "ln((n + 1) / df)"}[method]


def saturation_sql(method: str, k1: float, b: float, delta: float) -> str:
    norm = f"({1 - b}::DOUBLE + {b}::DOUBLE * dl / avgdl)"
    k, d = f"{k1}::DOUBLE", f"{delta}::DOUBLE"
    plain = f"tf / (tf + {k} * {norm})"
    return {
        "own": plain, "robertson": plain, "lucene": plain, "atire": f"tf * ({k} + 1) / (tf + {k} * {norm})",
        "bm25l": f"({k} + 1) * (tf / {norm} + {d}) / ({k} + tf / {norm} + {d})", "bm25+": f"(({k} + 1) * tf / ({k} * {norm} + tf) + {d})",
    }[method]


STATS = """stat AS (SELECT count(*)::DOUBLE AS n, avg(len(toks)) AS avgdl FROM tok),
dfs AS (SELECT term, count(*)::DOUBLE AS df FROM post GROUP BY term),
lens AS (SELECT doc_id, len(toks)::DOUBLE AS dl FROM tok)"""


def bm25_sql(method: str = "lucene", idf: str | None = None, k: int = 10, k1: float = 1.5, b: float = 0.75, delta: float = 0.5, pad: bool = False, batch=None) -> str:
    """Scores by their definition: every document against every query term, present or not."""
    lack = S.absent(method, k1, delta)
    full = pad or method in S.SHIFTED
    base = "lens CROSS JOIN q" if full else "post JOIN q USING (term) JOIN lens USING (doc_id)"
    if full:
        score = f"sum(coalesce(qtf * {idf_sql(idf or method)} * CASE WHEN tf IS NULL THEN {lack}::DOUBLE ELSE {saturation_sql(method, k1, b, delta)} END, 0))"
        rows = f"{base} LEFT JOIN (SELECT doc_id, term, tf::DOUBLE AS tf FROM post) USING (doc_id, term) LEFT JOIN dfs USING (term) CROSS JOIN stat"
    else:
        score = f"sum(qtf * {idf_sql(idf or method)} * {saturation_sql(method, k1, b, delta)})"
        rows = f"(SELECT query_id, term, qtf, doc_id, dl, tf::DOUBLE AS tf FROM {base}) JOIN dfs USING (term) CROSS JOIN stat"
    return f"""WITH {POSTINGS}, {STATS}, {asked_sql(batch)},
sc AS (SELECT query_id, doc_id, round({score}, 6) AS score FROM {rows} GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM sc QUALIFY rank <= {k}"""


def _bm25(name: str, **settings):
    @query(name, bm25_sql(settings.get("method", "lucene"), settings.get("idf_method"), **{k: v for k, v in settings.items() if k not in ("method", "idf_method")}))
    def run(spark, sf):
        return R.bm25(table(spark, sf, "documents"), BATCH, **settings)

    return run


_bm25("bm25_own_topk", method="own", k1=1.2)
for _m, _n in (("robertson", "bm25_robertson_topk"), ("lucene", "bm25_lucene_topk"), ("atire", "bm25_atire_topk"), ("bm25l", "bm25l_topk"), ("bm25+", "bm25plus_topk")):
    _bm25(_n, method=_m)
for _m in ("robertson", "lucene", "atire", "bm25l", "bm25+"):
    for _i in ("robertson", "lucene", "atire", "bm25l", "bm25+"):
        if _m != _i:
            _bm25(f"bm25_mixed_{_m.replace('+', 'plus')}_{_i.replace('+', 'plus')}", method=_m, idf_method=_i, k=5)
_bm25("bm25_padded_topk", method="own", k1=1.2, pad=True, k=700)


@query("bm25_own_all_scores", bm25_sql("own", k1=1.2, k=1_000_000))
def bm25_own_all_scores(spark, sf):
    """Every scored document. The twin stops at rank 1,000,000, which no test table reaches."""
    return R.bm25(table(spark, sf, "documents"), BATCH, method="own", k1=1.2, k=None)


@query("bm25_batch_run", f"SELECT query_id::VARCHAR AS query_number, rank, concat('doc/', doc_id) AS url, score FROM ({bm25_sql('own', k1=1.2, k=100)})")
def bm25_batch_run(spark, sf):
    found = R.bm25(table(spark, sf, "documents"), BATCH, method="own", k1=1.2, k=100)
    return writers.run_rows(found.select(F.col("query_id").cast("string").alias("query_number"), "rank", F.concat(F.lit("doc/"), "doc_id").alias("url"), "score"))


@query("bm25plus_top10_titles", f"SELECT r.query_id, r.rank, r.doc_id, d.lang, left(coalesce(d.text, ''), 40) AS title FROM ({bm25_sql('bm25+')}) r JOIN documents d USING (doc_id)")
def bm25plus_top10_titles(spark, sf):
    docs = table(spark, sf, "documents")
    found = R.bm25(docs, BATCH, method="bm25+")
    return docs.join(found, "doc_id").select("query_id", "rank", "doc_id", "lang", F.substring(F.coalesce("text", F.lit("")), 1, 40).alias("title"))


@query("idx_postings", f"WITH {POSTINGS} SELECT doc_id, term, tf FROM post")
def idx_postings(spark, sf):
    return R.postings(table(spark, sf, "documents"))


@query("idx_term_stats", f"WITH {POSTINGS} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM post GROUP BY term")
def idx_term_stats(spark, sf):
    return R.term_stats(R.postings(table(spark, sf, "documents")))


@query("idx_doc_stats", f"WITH {tok()} SELECT doc_id, len(toks) AS dl FROM tok")
def idx_doc_stats(spark, sf):
    return R.doc_stats(table(spark, sf, "documents"))


def _impacts(method: str):
    lack = S.absent(method, 1.5, 0.5)
    body = f"round({idf_sql(method)} * ({saturation_sql(method, 1.5, 0.75, 0.5)} - {lack}::DOUBLE), 6)"

    @query(f"idx_impacts_{method.replace('+', 'plus')}", f"WITH {POSTINGS}, {STATS} SELECT term, doc_id, {body} AS impact FROM (SELECT doc_id, term, tf::DOUBLE AS tf, dl FROM post JOIN lens USING (doc_id)) JOIN dfs USING (term) CROSS JOIN stat")
    def run(spark, sf):
        return R.impacts(table(spark, sf, "documents"), method)

    return run


for _m in ("robertson", "lucene", "atire", "bm25l", "bm25+"):
    _impacts(_m)


@query("index_roundtrip", bm25_sql("lucene"))
def index_roundtrip(spark, sf):
    """The persisted index answers as the direct plan does."""
    import uuid

    from ..storage import shared_folder

    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    R.Bm25Index.build(table(spark, sf, "documents")).save(path)
    found = R.Bm25Index.load(spark, path).topk(BATCH, 10)
    return found


VSM_QUERY = "rean onsh erth zzzunknown"
VSM = f"""{tok()}, tf AS (SELECT doc_id, len(toks) AS dl, term, count(*) AS tf FROM (SELECT doc_id, toks, unnest(toks) AS term FROM tok) GROUP BY ALL),
idfs AS (SELECT term, log10((SELECT count(*) FROM tok)::DOUBLE / count(*)) AS idf FROM tf GROUP BY term),
w AS (SELECT doc_id, term, tf::DOUBLE / dl * idf AS w FROM tf JOIN idfs USING (term)),
norms AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id),
qw AS (SELECT term, qtf * idf AS qw FROM (VALUES {", ".join(f"('{t}', 0.25::DOUBLE)" for t in VSM_QUERY.split())}) v(term, qtf) JOIN idfs USING (term)),
vsm AS (SELECT doc_id, round(coalesce(sum(w * qw) / nullif(any_value(norm) * (SELECT sqrt(sum(qw * qw)) FROM qw), 0), 0), 6) AS score FROM w JOIN qw USING (term) JOIN norms USING (doc_id) GROUP BY doc_id)"""


def _vsm(spark, sf):
    return R.VectorSpace.fit(table(spark, sf, "documents")).query(VSM_QUERY)


@query("vsm_cosine", f"WITH {VSM} SELECT doc_id, score FROM vsm")
def vsm_cosine(spark, sf):
    return _vsm(spark, sf)


@query("vsm_parametric", f"WITH {VSM} SELECT doc_id, score FROM vsm SEMI JOIN (SELECT doc_id FROM documents WHERE lang = 'en' AND source = 'src1') USING (doc_id)")
def vsm_parametric(spark, sf):
    return R.parametric(_vsm(spark, sf), table(spark, sf, "documents"), {"lang": "en", "source": "src1"})


@query("vsm_range", f"WITH {VSM} SELECT doc_id, score FROM vsm SEMI JOIN (SELECT doc_id FROM documents WHERE n_chars BETWEEN 1000 AND 2000) USING (doc_id)")
def vsm_range(spark, sf):
    return R.parametric(_vsm(spark, sf), table(spark, sf, "documents"), ranges={"n_chars": (1000, 2000)})


@query("vsm_range_grid", "SELECT part.p_partkey AS doc_id, p_retailprice AS score FROM part WHERE p_retailprice BETWEEN 905 AND 951 AND p_retailprice = floor(p_retailprice)")
def vsm_range_grid(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_retailprice").alias("score"))
    return R.parametric(part, part, ranges={"score": (905.4, 950.2)}, grid=True)


@query("vsm_postings_intersect", f"WITH {POSTINGS} SELECT doc_id FROM post WHERE term = 'rean' INTERSECT SELECT doc_id FROM post WHERE term = 'erth'")
def vsm_postings_intersect(spark, sf):
    from ..functions.text import word_tokens

    found = table(spark, sf, "documents").select("doc_id", F.explode(word_tokens(F.col("text"))).alias("term")).where(F.col("term").isin("rean", "erth"))
    return found.where("term = 'rean'").select("doc_id").intersect(found.where("term = 'erth'").select("doc_id"))


#: Offline rewrites: each query with two variants beside itself.
REWRITES = {1: ["rean onsh", "ingti erth"], 2: ["erth", "anst enhe"]}


def variants(batch=BATCH, rewrites=REWRITES) -> list[tuple[int, int, str]]:
    """(query_id, variant_id, text): the rewrites of each query, and the query itself as the last."""
    out = []
    for q, text in batch:
        texts = [*rewrites.get(q, []), text]
        out += [(q, i, t) for i, t in enumerate(texts)]
    return out


VARIANT_TERMS = {q * 100 + v: {t: text.split().count(t) for t in text.split()} for q, v, text in variants()}


@query("fusion_combsum", f"WITH v AS ({bm25_sql('own', k1=1.2, k=100, batch=VARIANT_TERMS)}), f AS (SELECT query_id // 100 AS query_id, doc_id, round(sum(score), 6) AS score FROM v GROUP BY ALL) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM f QUALIFY rank <= 100")
def fusion_combsum(spark, sf):
    """Every variant's best 100, summed per document; all variants of all queries in one job."""
    flat = [(q * 100 + v, t) for q, v, t in variants()]
    found = R.bm25(table(spark, sf, "documents"), flat, method="own", k1=1.2, k=100)
    split = found.select(F.floor(F.col("query_id") / 100).cast("int").alias("query_id"), (F.col("query_id") % 100).alias("variant_id"), "doc_id", "score")
    return R.combsum(split)


#: A result list per language of the pages, so that hosts repeat.
RESULTS = f"res AS (SELECT (page_id % 3)::INTEGER AS query_id, page_id AS doc_id, CASE WHEN page_id % 3 = 0 AND page_id % 5 > 0 THEN 'hot.example' ELSE {HOST} END AS host, round(1.0::DOUBLE / (1 + page_id % 17), 6) AS score FROM pages)"


def _results(spark, sf):
    pages = table(spark, sf, "pages")
    host = F.when((F.col("page_id") % 3 == 0) & (F.col("page_id") % 5 > 0), "hot.example").otherwise(W.host(F.col("url")))
    return pages.select((F.col("page_id") % 3).cast("int").alias("query_id"), F.col("page_id").alias("doc_id"), host.alias("host"), F.round(1.0 / (1 + F.col("page_id") % 17), 6).alias("score"))


@query("fusion_domain_share", f"WITH {RESULTS} SELECT query_id, host, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY query_id), 6) AS share FROM res GROUP BY query_id, host")
def fusion_domain_share(spark, sf):
    return R.domain_share(_results(spark, sf))


@query("fusion_domain_cap", f"""WITH {RESULTS}, sh AS (SELECT query_id, host, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY query_id) AS share FROM res GROUP BY query_id, host),
top AS (SELECT query_id, host, n // 2 AS open FROM sh WHERE round(share, 6) >= 0.7),
low AS (SELECT query_id, doc_id FROM (SELECT r.query_id, r.doc_id, open, row_number() OVER (PARTITION BY r.query_id, r.host ORDER BY score, r.doc_id DESC) AS i FROM res r JOIN top USING (query_id, host)) WHERE i <= open),
pool AS (SELECT page_id AS doc_id, {HOST} AS host FROM pages),
fill AS (SELECT query_id, doc_id, host FROM (SELECT t.query_id, p.doc_id, p.host, open, row_number() OVER (PARTITION BY t.query_id ORDER BY p.doc_id) AS i FROM pool p JOIN top t ON p.host <> t.host WHERE NOT EXISTS (SELECT 1 FROM res r WHERE r.query_id = t.query_id AND r.doc_id = p.doc_id)) WHERE i <= open)
SELECT query_id, doc_id, host, score FROM res ANTI JOIN low USING (query_id, doc_id) UNION ALL SELECT query_id, doc_id, host, 0.0::DOUBLE FROM fill""")
def fusion_domain_cap(spark, sf):
    pool = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), W.host(F.col("url")).alias("host"))
    return R.domain_cap(_results(spark, sf), pool)


#: Candidates: pages dealt to three queries.
CANDIDATES = f"cand AS (SELECT (page_id % 3)::INTEGER AS query_id, page_id AS doc_id, {MAIN_TEXT} AS body, {TITLE} AS title, url FROM pages)"
FEATURE_QUERIES = [(0, "the rean erth"), (1, "onsh and the the"), (2, "de la zzzunknown")]
SYNONYMS = [("rean", "onsh"), ("rean", "erth"), ("onsh", "the"), ("de", "en")]


def _candidates(spark, sf):
    pages = table(spark, sf, "pages")
    return pages.select((F.col("page_id") % 3).cast("int").alias("query_id"), F.col("page_id").alias("doc_id"), W.main_text(F.col("html")).alias("body"), W.title(F.col("html")).alias("title"), "url")


def _features(spark, sf, wanted=K.FEATURES):
    queries = spark.createDataFrame(FEATURE_QUERIES, "query_id int, text string")
    return K.lexical_features(_candidates(spark, sf), queries, spark.createDataFrame(SYNONYMS, "term string, synonym string"), wanted=wanted)


def _simple(x: str) -> str:
    return f"string_split(trim(regexp_replace(regexp_replace(lower({x}), '[,.!]', ' ', 'g'), '{SPACE}', ' ', 'g')), ' ')"


URL_T = "string_split(trim(regexp_replace(translate(lower(url), '/.', '  '), ' +', ' ', 'g')), ' ')"
def _embedding(tokens: str) -> str:
    """Counts of tokens by the first hexadecimal digit of their md5."""
    return f"list_transform(string_split('0 1 2 3 4 5 6 7 8 9 a b c d e f', ' '), lambda d: len(list_filter({tokens}, lambda x: left(md5(x), 1) = d))::DOUBLE)"


def features_sql(candidates: str, queries: list[tuple[int, str]], synonyms: list[tuple[str, str]]) -> str:
    """CTEs from ``cand`` (query_id, doc_id, body, title, url) to ``allf``, the 20 features."""
    return f"""{candidates}, toks AS (SELECT query_id, doc_id, 'body' AS part, {_simple('body')} AS t FROM cand UNION ALL SELECT query_id, doc_id, 'title', {_simple('title')} FROM cand UNION ALL SELECT query_id, doc_id, 'url', {URL_T} FROM cand),
terms AS (SELECT query_id, doc_id, part, len(t) AS sl, term, count(*) AS tf FROM (SELECT *, unnest(t) AS term FROM toks) GROUP BY query_id, doc_id, part, sl, term),
n AS (SELECT query_id, count(*)::DOUBLE AS n FROM cand GROUP BY query_id),
idf AS (SELECT query_id, part, term, ln(any_value(n) / count(*)) AS idf FROM terms JOIN n USING (query_id) GROUP BY query_id, part, term),
asked(query_id, term, qtf) AS (VALUES {", ".join(f"({q}, '{t}', {text.split().count(t)}::DOUBLE)" for q, text in queries for t in dict.fromkeys(text.split()))}),
qw AS (SELECT a.query_id, p.part, a.term, qtf * coalesce(idf, ln(n)) AS qw FROM asked a JOIN n USING (query_id) CROSS JOIN (VALUES ('body'), ('title'), ('url')) p(part) LEFT JOIN idf i ON i.query_id = a.query_id AND i.part = p.part AND i.term = a.term),
qn AS (SELECT query_id, part, sqrt(sum(qw * qw)) AS qnorm FROM qw GROUP BY ALL),
dw AS (SELECT *, tf * idf AS w FROM terms JOIN idf USING (query_id, part, term)),
nm AS (SELECT query_id, doc_id, part, sl, sqrt(sum(w * w)) AS norm FROM dw GROUP BY ALL),
hit AS (SELECT query_id, doc_id, part, sum(tf) AS sum_tf, sum(w) AS sum_tfidf, sum(w * qw) AS dot FROM dw JOIN qw USING (query_id, part, term) GROUP BY ALL),
syn(term, synonym) AS (VALUES {", ".join(str(x) for x in synonyms)}),
sy AS (SELECT query_id, doc_id, part, sum(tf) AS sc FROM terms JOIN (SELECT DISTINCT query_id, synonym AS term FROM asked JOIN syn USING (term)) USING (query_id, term) GROUP BY ALL),
long AS (SELECT query_id, doc_id, part, coalesce(sum_tf, 0)::DOUBLE AS sum_tf, round(coalesce(sum_tfidf, 0), 6) AS sum_tfidf, sl::DOUBLE AS stream_length, round(coalesce(dot / nullif(norm * qnorm, 0), 0), 6) AS cosine, coalesce(sc, 0)::DOUBLE AS synonym_count
  FROM nm LEFT JOIN hit USING (query_id, doc_id, part) LEFT JOIN qn USING (query_id, part) LEFT JOIN sy USING (query_id, doc_id, part)),
feat AS (SELECT query_id, doc_id, {", ".join(f"max({f}) FILTER (WHERE part = '{p}') AS {p}_{f}" for p in K.PARTS for f in ("sum_tf", "sum_tfidf", "stream_length", "cosine", "synonym_count"))} FROM long GROUP BY ALL),
asked_text(query_id, text) AS (VALUES {", ".join(f"({q}, '{text}')" for q, text in queries)}),
embq AS (SELECT query_id, {_embedding(_simple('text'))} AS v FROM asked_text),
embs AS (SELECT query_id, doc_id, part, round(coalesce(list_dot_product(v, w) / nullif(sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(w, w)), 0), 0), 6) AS c FROM (SELECT * FROM (SELECT query_id, doc_id, part, {_embedding('t')} AS v FROM toks) JOIN (SELECT query_id, v AS w FROM embq) USING (query_id))),
embp AS (SELECT query_id, doc_id, {", ".join(f"max(c) FILTER (WHERE part = '{p}') AS {p}_embedding" for p in K.PARTS)} FROM embs GROUP BY ALL),
allf AS (SELECT feat.*, {", ".join(f"{p}_embedding" for p in K.PARTS)}, (length(url) - length(replace(url, '/', '')))::DOUBLE AS url_slashes, length(url)::DOUBLE AS url_chars FROM feat JOIN cand USING (query_id, doc_id) JOIN embp USING (query_id, doc_id))"""


FEATURES_SQL = features_sql(CANDIDATES, FEATURE_QUERIES, SYNONYMS)

COLUMNS = K.FEATURES


def _feature_query(name: str, wanted: list[str]):
    @query(name, f"WITH {FEATURES_SQL} SELECT query_id, doc_id, {', '.join(wanted)} FROM allf")
    def run(spark, sf):
        return _features(spark, sf, wanted)

    return run


_feature_query("feat_tf_tfidf", [c for c in COLUMNS if not c.endswith(("cosine", "synonym_count", "embedding"))])
_feature_query("feat_synonyms", [c for c in COLUMNS if c.endswith("synonym_count")])
_feature_query("feat_cosine_sparse", [c for c in COLUMNS if c.endswith("cosine")])
_feature_query("feat_embedding", [c for c in COLUMNS if c.endswith("embedding")])


@query("feat_normalized", f"WITH {FEATURES_SQL} SELECT query_id, doc_id, " + ", ".join(f"round(coalesce(({c} - min({c}) OVER w) / nullif(max({c}) OVER w - min({c}) OVER w, 0), 0), 6) AS {c}" for c in COLUMNS) + " FROM allf WINDOW w AS (PARTITION BY query_id)")
def feat_normalized(spark, sf):
    return K.normalized(materialise(_features(spark, sf), "features"), COLUMNS, written=True)


@query("feat_cosine_dense", "SELECT e.vec_id, q.vec_id AS query_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS cosine FROM embeddings e CROSS JOIN (SELECT * FROM embeddings WHERE vec_id < 3) q")
def feat_cosine_dense(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    # Three query vectors against all rows.
    asked = F.broadcast(vectors.where("vec_id < 3").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")))
    return vectors.crossJoin(asked).select("vec_id", "query_id", F.round(S.cosine(F.col("embedding"), F.col("q")), 6).alias("cosine"))


LEGACY_TERMS = ["the", "rean", "de"]


@query("feat_legacy_stats", f"""WITH t AS (SELECT page_id, list_filter(regexp_split_to_array(lower({MAIN_TEXT}), '{SPACE}'), lambda x: x <> '') AS toks FROM pages),
v AS (SELECT page_id, len(toks) AS dl, unnest(['the', 'rean', 'de']) AS q, toks FROM t), c AS (SELECT page_id, dl, len(list_filter(toks, lambda x: x = q))::DOUBLE AS tf FROM v)
SELECT page_id, any_value(dl) AS stream_length, count(*) FILTER (WHERE tf > 0) AS covered, round(count(*) FILTER (WHERE tf > 0) / 3.0, 6)::DOUBLE AS covered_ratio, round(sum(tf), 6) AS tf_sum, round(min(tf), 6) AS tf_min, round(max(tf), 6) AS tf_max, round(avg(tf), 6) AS tf_mean, round(var_pop(tf), 6) AS tf_variance FROM c GROUP BY page_id""")
def feat_legacy_stats(spark, sf):
    from ..functions.text import space_tokens

    toks = table(spark, sf, "pages").select("page_id", space_tokens(W.main_text(F.col("html"))).alias("toks"))
    count = lambda term: F.size(F.filter("toks", lambda x: x == F.lit(term))).cast("double")
    counts = F.array(*map(count, LEGACY_TERMS))
    out = toks.select("page_id", F.size("toks").cast("long").alias("stream_length"), counts.alias("c"))
    covered = F.size(F.filter("c", lambda x: x > 0)).cast("long")
    s = out.select("page_id", "stream_length", covered.alias("covered"), F.round(covered / 3.0, 6).alias("covered_ratio"), K.term_statistics(F.col("c")).alias("s"))
    return s.select("page_id", "stream_length", "covered", "covered_ratio", *[F.col(f"s.{k}").alias(f"tf_{k}") for k in ("sum", "min", "max", "mean", "variance")])


@query("feat_topk_then_features", f"SELECT r.query_id, r.rank, r.doc_id, r.score, len({TOKENS}) AS stream_length, d.n_chars FROM ({bm25_sql('own', k1=1.2, k=20)}) r JOIN documents d USING (doc_id)")
def feat_topk_then_features(spark, sf):
    from ..functions.text import word_tokens

    docs = table(spark, sf, "documents")
    found = R.bm25(docs, BATCH, method="own", k1=1.2, k=20)
    return docs.join(found, "doc_id").select("query_id", "rank", "doc_id", "score", F.size(word_tokens(F.col("text"))).cast("long").alias("stream_length"), "n_chars")


@query("search_flagship", f"""WITH v AS ({bm25_sql('own', k1=1.2, k=100, batch=VARIANT_TERMS)}), f AS (SELECT query_id // 100 AS query_id, doc_id, round(sum(score), 6) AS score FROM v GROUP BY ALL),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM f QUALIFY rank <= 100),
m AS (SELECT *, round(coalesce((score - min(score) OVER w) / nullif(max(score) OVER w - min(score) OVER w, 0), 0), 6) AS relevance FROM r WINDOW w AS (PARTITION BY query_id))
SELECT query_id, rank, doc_id, score, relevance, source, lang FROM m JOIN documents USING (doc_id)""")
def search_flagship(spark, sf):
    """Rewriting, first stage, fusion, normalisation and materialisation of candidates, for all queries at once."""
    docs = table(spark, sf, "documents")
    fused = K.normalized(fusion_combsum(spark, sf).withColumn("relevance", F.col("score")), ["relevance"])
    return docs.select("doc_id", "source", "lang").join(fused, "doc_id").select("query_id", "rank", "doc_id", "score", "relevance", "source", "lang")
