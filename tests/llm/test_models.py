"""SimHash, language model, neighbours, URLs and the pipeline."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import automaton, neighbours, simhash, urls

from .fixtures import TEXTS, documents, empty

SMALL = "/root/testdata/sf0.001"


def test_fingerprint_as_spark_hashes(spark):
    text = "One two three four five five"
    words = text.lower().split()
    shingles = spark.createDataFrame([(" ".join(words[i : i + 3]),) for i in range(4)], "s string")
    want = [r[0] & (1 << 64) - 1 for r in shingles.selectExpr("xxhash64(s)").collect()]
    assert sorted(simhash.shingle_hashes(text.lower().encode(), 3).tolist()) == sorted(want)
    bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in want) > 4)
    assert simhash.simhash(np.array(want, np.uint64)) == bits
    assert simhash.simhash(np.zeros(0, np.uint64)) == 0


@pytest.mark.parametrize("crowd", [1, 128])
def test_close_pairs_connect_what_brute_force_connects(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(crowd)
    centres = [rng.getrandbits(64) for _ in range(20)]
    fps = {0, 1, 3, (1 << 64) - 1}
    for _ in range(300):
        x = rng.choice(centres)
        for _ in range(rng.randrange(5)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps = [x - (1 << 64) if x >> 63 else x for x in fps]
    label = {x: x for x in fps}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    links = [(a, b) for a in fps for b in fps if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 2]
    for a, b in links:
        a, b = sorted((root(a), root(b)))
        label[b] = a
    found = simhash.close_pairs(spark.createDataFrame([(x,) for x in fps], "fp long"))
    pairs = {(r.u, r.v) for r in found.collect()}
    assert pairs <= set(links) and (crowd == 1 or pairs == set(links))
    got = {r.node: r.label for r in simhash.components(found).collect()}
    assert got == {x: root(x) for x in fps if any(x in p for p in links)}


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "u long, v long")
    got = {r.node: r.label for r in simhash.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_groups_of_awkward_rows(spark):
    docs = documents(spark)
    rows = simhash.groups(docs).collect()
    assert len(rows) == len(TEXTS) + 1
    by = {r.doc_id: r for r in rows}
    assert by[0].component == by[1].component == by[3].component == 0 and by[0].fp == 0
    assert by[5].component == by[None].component == 5
    assert simhash.groups(empty(spark)).count() == 0
    kept = simhash.without_copies(docs)
    assert kept.columns == docs.columns and simhash.without_copies(empty(spark)).count() == 0


def test_copies_stay_once(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows, at = [], 0
    alone = set()
    for g in range(30):
        base = [word() for _ in range(200)]
        alone.add(at)
        for c in range(rng.randrange(1, 30 if g == 0 else 4)):
            own = list(base)
            if c:
                own[rng.randrange(200)] = word()
            rows.append((at, " ".join(own)))
            at += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in simhash.without_copies(docs).collect()} == alone


def test_copies_around_a_text_that_is_not_the_first(spark):
    """A crowd of copies, each like the text in its middle but not like each other, is one group."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(200)]
    rows = []
    for i in range(150):
        own = list(base)
        if i != 140:
            for at in rng.sample(range(5, 195), 3):
                own[at] = word()
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, " ".join(word() for _ in range(100))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted(r.doc_id for r in simhash.without_copies(docs).collect())
    assert kept == [0, *range(1000, 1020)]


def test_copies_of_a_crowd_connect_what_brute_force_connects(spark, monkeypatch):
    """Pairs of near copies in a crowd on one template, far from each other pair and from any pivot."""
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    template, rows = [word() for _ in range(150)], []
    for i in range(60):
        own = [*template, *(word() for _ in range(60))]
        rows.append((i, " ".join(own)))
        own[rng.randrange(150)] = word()
        own[rng.randrange(155, 205)] = word()
        rows.append((1000 + i, " ".join(own)))
    sets = {i: set(simhash.shingle_hashes(t.encode(), 5).tolist()) for i, t in rows}
    links = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert links == {(i, 1000 + i) for i in range(60)}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {(r.label, r.node) for r in simhash.copies(docs).collect() if r.label != r.node} == links


class Backoff:
    """The whole automaton in memory: states with arcs and failure arcs, and a path that carries its state."""

    def __init__(self, texts: list[list[bytes]]):
        grams: Counter = Counter()
        for t in texts:
            path = (None, *t)  # None stands before the first word
            for n in (1, 2, 3):
                grams.update(path[i - n : i] for i in range(max(n, 2), len(path) + 1) if i >= n)
        self.total = sum(c for g, c in grams.items() if len(g) == 1)
        self.words = {g[0] for g in grams if len(g) == 1}
        self.size = self.total + len(self.words) + 1
        seen = {(): self.total, (None,): len(texts)} | {g: c for g, c in grams.items() if len(g) < 3}
        self.states = {g[:-1]: seen[g[:-1]] for g in grams}
        self.prior = {1: automaton.PAIR_PRIOR, 2: automaton.TRIPLE_PRIOR}
        self.arcs: dict = {h: {} for h in self.states}
        for g in sorted(grams, key=len):
            h, w = g[:-1], g[-1]
            self.arcs[h][w] = (grams[g] + 1) / self.size if not h else (grams[g] + self.prior[len(h)] * self.probability(h[1:], w)) / (self.states[h] + self.prior[len(h)])

    def failure(self, h) -> float:
        return self.prior[len(h)] / (self.states[h] + self.prior[len(h)])

    def probability(self, h, w) -> float:
        while h not in self.states:
            h = h[1:]
        cost = 1.0
        while w not in self.arcs.get(h, {}):
            if not h:
                return cost / self.size
            cost *= self.failure(h)
            h = h[1:]
            while h not in self.states:
                h = h[1:]
        return cost * self.arcs[h][w]

    def score(self, text: list[bytes]) -> float:
        state, out = (None,), 0.0
        for w in text:
            out += math.log10(self.probability(state, w))
            state = (*state, w)[-2:]
        return out


def words_of(text) -> list[bytes]:
    return [*(text or "").encode().lower().split(), b""]


def test_automaton_is_a_probability():
    rng = random.Random(5)
    m = Backoff([[*rng.choices([b"a", b"b", b"c", b"d"], [5, 3, 2, 1], k=rng.randrange(12)), b""] for _ in range(30)])
    assert sum(len(h) == 2 for h in m.states) > 3
    for h in [*m.states, (b"x",), (b"x", b"a"), (b"a", b"x")]:
        assert sum(m.probability(h, w) for w in [*m.words, b"never seen"]) == pytest.approx(1, abs=1e-9)


def test_planes_round_trip():
    rng = np.random.default_rng(3)
    for top in (1, 2, 255, 256, 1 << 20, 1 << 40, 1 << 63):
        x = rng.integers(0, top, 1000, dtype=np.uint64)
        assert (automaton.unplaned(automaton.planes(x)) == x).all()
        assert (automaton.unplaned_sorted(automaton.sorted_planes(np.sort(x))) == np.sort(x)).all()
    assert len(automaton.unplaned(automaton.planes(np.zeros(0, np.uint64)))) == 0


@pytest.mark.parametrize("sizes", [{}, {"CHUNK": 50, "SEGMENT": 7, "PART_ENTRIES": 100}, {"CHUNK": 1, "SEGMENT": 3, "PART_ENTRIES": 500}])
def test_scores_are_those_of_the_whole_automaton(spark, monkeypatch, sizes):
    """Chunks, parts and segments of any size give the path of one automaton with all n-grams."""
    for name, size in sizes.items():
        monkeypatch.setattr(automaton, name, size)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(30 if sizes else 60).select("doc_id", "text")
    rng = random.Random(23)
    names, weights = [f"w{i}" for i in range(200)], [1 / (i + 1) for i in range(200)]
    made = [(9100 + i, " ".join(rng.choices(names, weights, k=rng.randrange(40)))) for i in range(40)]
    rows = [(r.doc_id, r.text[:2000]) for r in docs.collect()] + made + [(9001, None), (9002, "  "), (9003, "Unseen unseenx w1 w2 Unseen"), (9004, "w1"), (None, "w1 w2 w3")]
    hold = lambda k: zlib.crc32(str(k).encode()) % 7 == 2 if k is not None else False
    train = [words_of(t) for k, t in rows if not hold(k)]
    counts = Counter(w for t in train for w in t)
    n, v = sum(counts.values()), len(counts)
    whole = Backoff(train)
    from pyspark.sql import functions as F

    fixed = spark.createDataFrame(rows, docs.schema).repartition(3)
    got = automaton.scores(fixed, automaton.remainder(F.col("doc_id"), 7) != 2).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for k, text in rows:
        t, g = words_of(text), by[k]
        assert (g.n_tokens, g.n_known, g.train_tokens) == (len(t), sum(counts[w] > 0 for w in t), n)
        assert g.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), abs=1e-6)
        assert g.score == pytest.approx(whole.score(t), abs=1e-6)


def test_scores_of_awkward_rows(spark):
    from pyspark.sql import functions as F

    docs = documents(spark)
    rows = automaton.scores(docs, F.lit(True)).collect()
    assert len(rows) == len(TEXTS) + 1 and all(r.n_known == r.n_tokens for r in rows)
    assert automaton.scores(empty(spark), F.lit(True)).count() == 0
    free = automaton.scores(docs, F.lit(None).cast("boolean")).collect()
    assert len(free) == len(rows) and all(r.n_known == 0 and r.base_score == 0 and r.score == 0 for r in free)


def test_scores_hold_grams_seen_once(spark):
    """A text's pair and triple seen once in training score above the same words in an order never seen."""
    from pyspark.sql import functions as F

    rows = [(0, "a b c"), (1, "c b a"), (2, "b a c"), (3, "x y z"), (10, "x y z"), (11, "z y x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    by = {r.doc_id: r for r in automaton.scores(docs, F.col("doc_id") < 10).collect()}
    assert by[10].base_score == pytest.approx(by[11].base_score) and by[10].score > by[11].score + 0.1


def test_near_copies_at_the_limit_are_found(spark):
    """Pairs at a similarity of 0.8 to 0.9: the ring and its chains lose hardly any, and link nothing below."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    rows = []
    for g in range(400):
        base = [word() for _ in range(300)]
        own = list(base)
        for at in rng.sample(range(300), rng.randrange(2, 9)):
            own[at] = word()
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(own))]
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for _, t in rows]
    want = {2 * g for g in range(400) if len(sets[2 * g] & sets[2 * g + 1]) >= 0.8 * len(sets[2 * g] | sets[2 * g + 1])}
    assert 150 < len(want) < 390
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r.label for r in simhash.copies(docs).collect() if r.label != r.node}
    assert found <= want and len(found) >= 0.99 * len(want)


def test_votes_are_those_of_the_nearest(spark):
    """Scores of a table are exact cosine votes, one text at a time, in plain Python."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    space = neighbours.fit(docs, labels)
    taught = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 != 0}
    assert len(space.labels) == len(taught) and sum(space.labels) == sum(taught.values())
    points = space.points.astype(np.float64)
    got = {r.doc_id: r for r in neighbours.quality(docs, labels).collect()}
    for r in docs.collect():
        at = space.place(neighbours.terms([r.text.encode()]))[0].astype(np.float64)
        near = sorted(((float(at @ p) / float(np.linalg.norm(at) * np.linalg.norm(p)), float(q)) for p, q in zip(points, space.labels)), reverse=True)[: neighbours.NEIGHBOURS]
        weights = [max(c, 0) ** neighbours.SHARPNESS for c, _ in near]
        assert got[r.doc_id].score == pytest.approx(sum(w * q for w, (_, q) in zip(weights, near)) / sum(weights), abs=1e-3)
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_labels_that_differ_teach_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "b c"), (2, "c d"), (3, "d e")] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 0), (3, 0, 0), (3, 0, 0), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    held = {k for k in (1, 2, 3) if zlib.crc32(str(k).encode()) % 5 == 0}
    space = neighbours.fit(docs, labels)
    assert sorted(space.labels.tolist()) == sorted(q for k, q in ((1, 1.0), (3, 0.0)) if k not in held)


def test_long_texts_teach_without_reaching_the_driver(spark):
    """A driver that may receive 8 MB fits 26 MB of labelled texts, to the same space as from the texts themselves."""
    made = "concat_ws(' ', transform(sequence(1, 5500), i -> hex(xxhash64(id, i))))"
    docs = spark.range(350).selectExpr("id AS doc_id", f"{made} AS text")
    labels = spark.range(350).selectExpr("id AS doc_id", "CAST(id % 2 AS int) AS quality")
    rows = [(r.doc_id, r.text) for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 != 0]
    assert sum(len(x) for _, x in rows) > 24 << 20 and max(len(x) for _, x in rows) <= neighbours.SAMPLE_BYTES
    conf = spark.sparkContext._jsc.sc().conf()
    was = conf.get("spark.driver.maxResultSize", "1g")
    conf.set("spark.driver.maxResultSize", "8m")
    try:
        space = neighbours.fit(docs, labels)
    finally:
        conf.set("spark.driver.maxResultSize", was)
    want = neighbours.Space([x.encode() for _, x in rows], [k % 2 for k, _ in rows])
    assert space.labels.tolist() == want.labels.tolist() and (space.rarity == want.rarity).all()
    assert np.allclose(space.points @ space.points.T, want.points @ want.points.T, atol=1e-4)


def test_neighbours_learn_quality(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = neighbours.quality(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50 and np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_neighbours_awkward_rows(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(9)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    rows = neighbours.quality(docs, labels).collect()
    assert len(rows) == len(TEXTS) + 1 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    out = neighbours.filter_documents(docs, docs, labels)
    assert sorted(out.columns) == sorted(docs.columns)
    assert {r.score for r in neighbours.quality(docs, labels.limit(0)).collect()} == {0.5}
    assert neighbours.quality(empty(spark), labels).count() == 0


def test_urls(spark):
    made = [
        (1, "https://A.Example.ORG/es/1?x#y", "a.example.org", "/es/1", "example.org/es/", "block"),
        (2, "http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
        (3, "http://other.org", "other.org", "", None, None),
        (4, "http://other.org/", "other.org", "/", "org/", "allow"),
        (5, "http://x.com/de/a#/q", "x.com", "/de/a", "com/de/", "block"),
        (6, "http://x.com?/fr/", "x.com", "", None, None),
        (7, None, "", "", None, None),
        (8, "no scheme/fr/", "", "", None, None),
        (9, "http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
        (10, "", "", "", None, None),
        (11, "http://" + "a" * 5000 + ".com/fr/" + "9" * 5000, "a" * 5000 + ".com", "/fr/" + "9" * 5000, "com/fr/", "allow"),
        (None, "x://y://z.com/fr/", "y:", "//z.com/fr/", None, None),
    ]
    pages = spark.createDataFrame([(r[0], r[1]) for r in made] * 2, "page_id long, url string")
    got = urls.judge(pages).collect()
    assert len(got) == 2 * len(made)
    by = {r.page_id: r for r in got}
    for page, _, host, path, rule, verdict in made:
        r = by[page]
        assert (r.host, r.path, r.rule) == (host, path, rule) and (verdict or r.verdict) == r.verdict in ("allow", "block")
    assert urls.judge(pages.limit(0)).count() == 0


def test_urls_learn(spark):
    from pyspark.sql import functions as F

    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    # Rules that only look at the top level: the trees must then find it for hosts under rules left out.
    got = urls.judge(pages, [("com/", "block", "com", "/"), ("org/", "allow", "org", "/")])
    assert got.where(F.col("host").endswith(".net")).count()
    # A path seen under blocked hosts only, and one seen under allowed hosts only, decide for hosts without a rule.
    made = [(i, f"http://h{i}.com/shop/buy-{i}?id={i}&ref=9") for i in range(300)] + [(1000 + i, f"http://h{i}.org/wiki/Page{'abcdefgh'[i % 8]}") for i in range(300)]
    asked = [(5000 + i, f"http://n{i}.net/shop/buy-{i}?id={i}&ref=9") for i in range(40)] + [(6000 + i, f"http://n{i}.net/wiki/Page{'abcdefgh'[i % 8]}") for i in range(40)]
    pages = spark.createDataFrame(made + asked, "page_id long, url string").repartition(3)
    got = urls.judge(pages, [("com/", "block", "com", "/"), ("org/", "allow", "org", "/")])
    verdicts = {r.page_id: r.verdict for r in got.where("rule IS NULL").collect()}
    assert len(verdicts) == 80 and all(verdicts[5000 + i] == "block" and verdicts[6000 + i] == "allow" for i in range(40))
