"""Encoding, packing, rules and media: exact round trips and brute force."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestone.llm import bpe, media, packing, rules

from .fixtures import TEXTS, documents, empty


@pytest.fixture(scope="module")
def word_level():
    path = public_tokenizers.path("word_bpe_49k.json")
    return open(path, encoding="utf-8").read(), Tokenizer.from_file(path)


def test_bpe_as_the_library(spark, word_level):
    definition, library = word_level
    rows = bpe.encode_decode(documents(spark), definition).collect()
    assert len(rows) == len(TEXTS) + 1
    want = []
    for i, t in [*enumerate(TEXTS), (5, TEXTS[5])]:
        ids = library.encode(t or "", add_special_tokens=False).ids
        data = np.array(ids, "<u4").tobytes()
        want.append((str(None if i == 4 else i), len(ids), hashlib.sha256(data).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted((str(r[0]), *r[1:]) for r in rows) == sorted(want)
    assert bpe.encode_decode(empty(spark), definition).count() == 0


def test_long_words_merge_as_short_ones(word_level):
    codec = bpe.codec_of(word_level[0])
    rng = np.random.default_rng(1)
    for _ in range(50):
        parts = [codec.inner[x] for x in rng.choice(list(b"theinga"), 60)]
        assert bpe.merge_long(parts, codec.ranks) == bpe.merge_word(parts, codec.ranks)


def test_packing_is_whole_and_tight(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = documents(spark)
    rows = packing.pack(docs, packing.definition()).collect()
    ids = {str(None if i == 4 else i): [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(TEXTS)}
    fill, got = defaultdict(list), defaultdict(list)
    for r in rows:
        own = ids[str(r.doc_id)]
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes())
        fill[r.sequence_id].append((r.offset, r.length))
        got[str(r.doc_id)].append((r.start, r.length))
    for key, pieces in got.items():
        at = [x for s, n in pieces for x in range(s, s + n)]
        assert sorted(at) == sorted([*range(len(ids[key]))] * (2 if key == "5" else 1))
    assert set(got) == set(ids)
    padding = 0
    for pieces in fill.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding <= 0.02 * sum(map(len, ids.values())) + 200
    assert packing.pack(empty(spark), packing.definition()).count() == 0


def cost_of(places, costs, cuts, width, split=False):
    """Padding and penalties of windows that end at ``cuts``."""
    out, inner = 0, cuts[:-1] if split else cuts
    for a, b in zip([0, *inner], inner):
        size = int(places[b] - places[a])
        out += costs[b] + min(width - size, packing.CUT_SHORT if size in packing.SHORT and size < width else width)
    if split:
        out += packing.CUT_INSIDE * (int(places[cuts[-1]] - places[cuts[-2] if len(cuts) > 1 else 0]).bit_count() - 1)
    return out


@pytest.mark.parametrize("short", [(), (4, 2)])
def test_cuts_are_the_cheapest(monkeypatch, short):
    from itertools import combinations

    monkeypatch.setattr(packing, "SHORT", short)
    monkeypatch.setattr(packing, "CUT_INSIDE", 3)
    rng = np.random.default_rng(2)
    for _ in range(60):
        places = np.concatenate(([0], np.cumsum(rng.integers(1, 6, 10))))
        costs, width, n = np.append(0, rng.integers(0, 4, 10)), 9, 10
        fits = lambda cuts: all(places[b] - places[a] <= width for a, b in zip([0, *cuts], cuts))
        every = [[*c, n] for k in range(n) for c in combinations(range(1, n), k) if fits([*c, n])]
        best = min(cost_of(places, costs, c, width, s) for c in every for s in (False, True))
        total, back = packing.ways(places, costs, width)
        cuts, split = packing.last_cuts(places, total, back, width)
        assert fits(cuts) and cuts[-1] == n and cost_of(places, costs, cuts, width, split) == pytest.approx(best)


def test_blocks_change_no_cut():
    """A stream packed in blocks has the windows of the stream packed at once."""
    rng = np.random.default_rng(8)
    for trial in range(20):
        docs = []
        for i in range(120):
            n = int(rng.integers(1, 90)) if rng.random() > 0.02 else int(rng.integers(200, 600))
            docs.append((i, bytes(4 * n), np.unique(rng.integers(1, n + 1, int(rng.integers(0, 8)) if n < 200 else 0))))
        found = []
        for every in (1, 7, 1000):
            packer, out = packing.Packer(64), []
            for i, d in enumerate(docs):
                packer.add(*d)
                if i % every == every - 1:
                    out += packer.pack(False)
            found.append(out + packer.pack(True))
        assert found[0] == found[1] == found[2]
        ends = {}
        for key, start, size, _, whole, sequence, _ in found[0]:
            ends[sequence] = (key, start + size, whole)
        final = max(ends)
        # A cut stands at a document's or sentence's end, or within a sentence longer than a window, or in the tail.
        for sequence, (key, at, whole) in ends.items():
            cuts = [0, *docs[key][2].tolist(), whole]
            before = max(x for x in cuts if x < at)
            long = min(x for x in cuts if x >= at) - before > 64
            assert at in cuts or long or final - sequence <= 6


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 1_000_000, "a" + " \n" * 300_000 + "b c", " " * 9000 + "x" + "\t" * 9000 + "<|endoftext|>" + " " * 7000 + "<|endoftext|>y", "\u3000" * 6000 + "z" + "\x1c" * 6000 + " q", "a" * 200_000])
def test_packing_takes_long_white_space(text):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids, cuts = packing.tokens_of(packing.definition()).document(text)
    assert np.frombuffer(ids, "<u4").tolist() == [*library.encode(text, add_special_tokens=False).ids, 1]
    packer = packing.Packer()
    packer.add(7, ids, cuts)
    assert sum(r[2] for r in packer.pack(True)) == len(ids) // 4


def test_rules_counts():
    assert rules.measure(b"") == (0,) * 8
    n = rules.measure("a b c a b c a\n é|É x\né|É x\n\n".encode())
    assert n[:6] == (11, 15, 2, 1 - 1, 7, 3)
    assert rules.measure(b"l m n\nl m n\n")[3] == 1
    assert rules.measure(b"A b")[6:] == (2, 1)


def test_rules_keep_clean_and_drop_noise(spark):
    import random

    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    clean = [(i, " ".join(word() for _ in range(rng.randrange(60, 200))), "en", "s", 1) for i in range(150)]
    noise = [(1000 + i, " ".join(word() + "###" for _ in range(120)), "en", "s", 1) for i in range(30)]
    docs = spark.createDataFrame([*clean, *noise], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in rules.filter_documents(docs).collect()}
    assert kept == {r[0] for r in clean}


def test_rules_awkward_rows(spark):
    docs = documents(spark)
    rows = rules.quality_rules(docs).collect()
    assert len(rows) == len(TEXTS) + 1 and all(r.base_failed and not r.kept for r in rows if r.n_words < 50)
    out = rules.filter_documents(docs)
    assert out.columns == docs.columns
    assert all(r.kept == "clash" for r in out.collect())
    assert rules.quality_rules(empty(spark)).count() == 0 and rules.filter_documents(empty(spark)).count() == 0


def test_media_round_trip(spark):
    for data in (b"", b"x", bytes(64), bytes(range(200)) * 3):
        payload = media.payload_of(data)
        assert len(payload) % 64 == 0 and payload and payload.startswith(data)
        assert media.load(media.store(payload)).tobytes() == payload


def by_hand(text):
    """(n_bytes, payload bytes, sha256, crc32 of the last 64, media bytes, media sha256) of a text."""
    data = (text or "").encode()
    payload = data + bytes(-len(data) % 64) if data else bytes(64)
    medium = b"P5\n64 %d\n255\n" % (len(payload) // 64) + payload
    return (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(medium), hashlib.sha256(medium).hexdigest())


def feature_by_hand(text):
    data = (text or "").encode()
    payload = data + bytes(-len(data) % 64) if data else bytes(64)
    rows = [payload[i : i + 64] for i in range(0, len(payload), 64)]
    n = len(payload)
    mean = sum(payload) / n
    dev = (sum(x * x for x in payload) / n - mean * mean) ** 0.5 if len(set(payload)) > 1 else 0.0
    across = sum(abs(r[i + 1] - r[i]) for r in rows for i in range(63)) / n
    down = sum(abs(b[i] - a[i]) for a, b in zip(rows, rows[1:]) for i in range(64)) / n
    return [mean, dev, across, down, *(sum(x >> 5 == k for x in payload) / n for k in range(8))]


def test_media_query_against_brute_force(spark):
    got = media.op5_media(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        assert tuple(r)[1:7] == by_hand(texts[r.doc_id])
        # The medium stands after the first paragraph, if that has any text.
        lines = [" ".join(x.split()) for x in texts[r.doc_id].split("\n")]
        assert r.position == int(bool(lines[0])) and r.n_segments == sum(map(bool, lines)) + 1
    for r in got[:20]:
        found = [float(x) for x in r.feature.replace("bands=", "x=").replace(",", ";x=").split(";") for x in x.split("=")[1:]]
        assert found == pytest.approx(feature_by_hand(texts[r.doc_id]), abs=1e-4)


def test_media_of_awkward_rows(spark):
    docs = documents(spark)
    rows = media.media_of(docs).collect()
    want = sorted((str(None if i == 4 else i), *by_hand(t)) for i, t in [*enumerate(TEXTS), (5, TEXTS[5])])
    assert sorted((str(r[0]), *tuple(r)[1:7]) for r in rows) == want
    assert media.media_of(empty(spark)).count() == 0
    kept = media.stored(docs).collect()
    assert {hashlib.sha256(bytes(r.medium)).hexdigest() for r in kept} == {by_hand(t)[5] for t in TEXTS}


def test_interleaved_segments_hold_their_bytes(spark):
    """Real text and media in one sequence: the bytes that each reference resolves to are the text's own."""
    rows = [(1, "one & <two>\nthree"), (2, "alone"), (3, "\n\nlate"), (4, "alone")]
    docs = spark.createDataFrame(rows, "page_id long, text string")
    store = media.stored(docs).dropDuplicates(["digest"])
    got = {r.page_id: r.segments for r in media.interleaved(media.pages_of(docs, "page_id"), store).collect()}
    assert [(s.kind, s.text) for s in got[1]] == [("text", "one & <two>"), ("media", None), ("text", "three")]
    assert [s.kind for s in got[2]] == ["text", "media"] and [s.kind for s in got[3]] == ["media", "text"]
    for key, text in rows:
        found = [s for s in got[key] if s.kind == "media"]
        assert len(found) == 1 and media.load(bytes(found[0].medium)).tobytes().rstrip(b"\0") == text.encode()
        assert found[0].caption == f"{len(text.encode())} bytes"


@pytest.mark.parametrize(
    "html, want",
    [
        ("<figure><img src=a><figcaption>cap<p>rest</p><p>more</p>", [("media", "a", "cap"), ("text", "rest", None), ("text", "more", None)]),
        ("<figure><img src=a><figcaption>cap <p>all</p></figure>after", [("media", "a", "cap all"), ("text", "after", None)]),
        ("<figcaption>no figure</figcaption><img src=a alt=b>", [("text", "no figure", None), ("media", "a", "b")]),
        ("<figure><img src=a><figure><img src=b><figcaption>two</figcaption></figure>", [("media", "a", None), ("media", "b", "two")]),
        ("x <![foo[ y <p>z", None),
        ("<img src=''><img><p", [("text", "<p", None)]),
        ("a<b<c>&amp;&#x41;&bogus;", [("text", "a&A&bogus;", None)]),
        ("<script>never closed <img src=a>", []),
    ],
)
def test_malformed_pages(html, want):
    found = media.parse(html)
    assert [x["position"] for x in found] == [*range(len(found))]
    if want is not None:
        assert [(x["kind"], x["text"] or x["ref"], x["caption"]) for x in found] == want


def test_very_long_and_random_pages():
    assert media.parse("<p>word " * 100_000)[-1]["position"] == 99_999
    assert len(media.parse("x" * 5_000_000)) == 1
    rng = np.random.default_rng(4)
    bits = ["<p>", "<", ">", "</figure>", "<figure>", "<figcaption>", "<img src=q>", "&", "<!", "--", "<![", "[", "]]>", "<?", "text ", "</", "\x00", "'", '"']
    for _ in range(500):
        media.parse("".join(rng.choice(bits, 30)))


def test_interleaving_stays_aligned(spark):
    html = '<body><p>one</p><img src="d1" alt="c1"><script>"</p><img src=no>"</script>two<figure><img src="d2"><figcaption>cap <b>2</b></figcaption></figure><p>three</p></body>'
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<img src='d2'>")], "page_id long, html string")
    found = media.sequences(pages)
    first = [tuple(s) for s in found.where("page_id = 1").first().segments]
    assert first == [(0, "text", "one", None, None), (1, "media", None, "d1", "c1"), (2, "text", "two", None, None), (3, "media", None, "d2", "cap 2"), (4, "text", "three", None, None)]
    catalogue = spark.createDataFrame([("d2", "payload 2")], "digest string, payload string")
    got = sorted((r.page_id, r.position, r.ref, r.caption, r.payload) for r in media.resolve(media.references(found), catalogue).collect())
    assert got == [(1, 1, "d1", "c1", None), (1, 3, "d2", "cap 2", "payload 2"), (3, 0, "d2", None, "payload 2")]


def test_rules_take_huge_words_by_their_group(spark):
    """Where words have 25 characters, a text of huge unbroken strings goes; where all have 3,000, they stay."""
    row = lambda i, source, size: (i, "en", source, " ".join(f"{j:05d}".ljust(size, "x") for j in range(60)))
    rows = [row(i, "a", 23 + i % 5) for i in range(400)] + [row(1000, "a", 5000)] + [row(2000 + i, "b", 2900 + i) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    assert {r.doc_id for r in rules.quality_rules(docs).where("NOT kept").collect()} == {1000}


def styled(rng, i, source, words, lines, symbols, repeats, capitals, length, copies):
    """A text with about the given rates."""
    out = []
    for _ in range(words):
        w = "".join(rng.choice("abcdefghijklmnop") for _ in range(max(1, round(rng.gauss(length, 1)))))
        w = w.capitalize() if rng.random() < capitals else w
        out.append(w + "#" * (rng.random() < symbols))
    for _ in range(round(repeats * words / 6)):
        at = rng.randrange(words - 8)
        out[at + 4 : at + 7] = out[at : at + 3]
    size = max(1, words // lines)
    rows = [" ".join(out[k : k + size]) for k in range(0, words, size)]
    return (i, "\n".join(rows + [rng.choice(rows[:2]) for _ in range(rng.randrange(copies, copies + 3))]), "en", source, 1)


def test_limits_differ_where_groups_differ(spark):
    """Two sources of different rates have different fences for all rates, each in the midst of its own rates."""
    import random

    rng = random.Random(7)
    rows = [styled(rng, i, "plain", 200, 8, 0.02, 0.02, 0.02, 5, 0) for i in range(500)] + [styled(rng, 1000 + i, "dense", 400, 20, 0.3, 0.1, 0.2, 8, 3) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    by = {r.source: r for r in rules.limits(rules.with_counts(docs.select("doc_id", "lang", "source", "text"))).collect()}
    for name in rules.RATES:
        for side in ("low", "high"):
            assert abs(by["plain"][f"{side}_{name}"] - by["dense"][f"{side}_{name}"]) > 5, (name, side)
    assert rules.quality_rules(docs).where("kept").count() >= 990
    # The same text is usual in one source and an outlier in the other.
    odd = styled(rng, 5000, "plain", 400, 20, 0.3, 0.1, 0.2, 8, 3)
    more = docs.unionByName(spark.createDataFrame([odd, (5001, *odd[1:3], "dense", 1)], docs.schema))
    assert {r.doc_id: r.kept for r in rules.quality_rules(more).where("doc_id >= 5000").collect()} == {5000: False, 5001: True}


def test_no_limit_is_a_constant():
    """On the test tables every fence differs between groups."""
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    rows = con.execute(f"WITH {rules.verdict_sql()} SELECT rate, count(*), count(DISTINCT low), count(DISTINCT high) FROM lims GROUP BY rate").fetchall()
    assert len(rows) == 5 and all(low > 10 and high > 10 for _, _, low, high in rows)


def test_sketch_quantiles_and_merging(spark):
    """Bins ascend with the rate and are a hundredth wide; merged sketches are the sketch of all rows."""
    import random

    from pyspark.sql import functions as F

    rng = random.Random(3)
    counts = [(rng.choice("ab"), "s", int(10 ** rng.uniform(0, 9)), int(10 ** rng.uniform(0, 6))) for _ in range(500)]
    df = spark.createDataFrame(counts, "lang string, source string, c long, w long").select("*", rules.bin_of("c", "w").alias("bin"))
    pairs = sorted((((r.c + 1) * rules.UNIT) // (r.w + rules.SMOOTH), r.bin) for r in df.collect())
    assert all(x[1] <= y[1] for x, y in zip(pairs, pairs[1:]))
    assert all(y[1] > x[1] for x, y in zip(pairs, pairs[1:]) if y[0] > 1.01 * x[0] + 1)
    sketch = df.groupBy("lang", "source", F.lit("r").alias("rate"), "bin").agg(F.count(F.lit(1)).alias("n"))
    whole = {(r.rate, r.bin): r.n for r in rules.merged(sketch, []).collect()}
    direct = {("r", r.bin): r["count"] for r in df.groupBy("bin").count().collect()}
    assert whole == direct
