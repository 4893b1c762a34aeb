"""Passage removers against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from lodestone.llm import repeats, sketches, suffixes


def brute(rows, symbols, length):
    """(kept symbols, removed, spans) of each row; rows are (key, text), a smaller key is earlier, None first."""
    null = lambda text: -(1 << 63) + (xxhash.xxh64_intdigest((text or "").encode(), 42) & (1 << 40) - 1)
    order = lambda key, text: null(text) if key is None else key
    first = {}
    for key, text in rows:
        s = symbols(text)
        for i in range(len(s) - length + 1):
            w = tuple(s[i : i + length])
            if w not in first or order(key, text) < first[w]:
                first[w] = order(key, text)
    out = []
    for key, text in rows:
        s, gone, own = symbols(text), set(), set()
        for i in range(len(s) - length + 1):
            w = tuple(s[i : i + length])
            if first[w] < order(key, text) or w in own:
                gone |= set(range(i, i + length))
            own.add(w)
        out.append((key, [x for i, x in enumerate(s) if i not in gone], len(s), len(gone), sum(i - 1 not in gone for i in gone)))
    return out


def texts(rng, alphabet, n, longest):
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(longest))) for _ in range(4)]
    out = [None, "", " ", *base, *base[:2], base[0] + base[1], "a" * 60, "ab" * 40, "abc " * 30]
    while len(out) < n:
        b = rng.choice(base)
        i, j = sorted((rng.randrange(len(b) + 1), rng.randrange(len(b) + 1)))
        out.append("".join(rng.choice(alphabet) for _ in range(rng.randrange(9))) + b[i:j] + "".join(rng.choice(alphabet) for _ in range(rng.randrange(9))))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("hot", [1, 256])
def test_bytes(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    rng = random.Random(hot)
    rows = [(i if i != 7 else None, t) for i, t in enumerate(texts(rng, "ab é", 60, 90))]
    docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, _spans int").repartition(5)
    codec = suffixes.Bytes
    monkeypatch.setattr(suffixes, "Bytes", lambda length: codec(length, 5))
    got = {r.doc_id: r for r in suffixes.remove_repeats(docs, 12).collect()}
    assert len(got) == len(rows)
    for key, kept, n, gone, spans in brute(rows, lambda t: list((t or "").encode()), 12):
        r = got[key]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, gone, spans, hashlib.sha256(bytes(kept)).hexdigest()), key


def test_words(spark):
    rng = random.Random(4)
    rows = list(enumerate(texts(rng, ["a ", "b ", "c\n", "é\t", "x"], 60, 120)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in sketches.remove_repeats(docs, 7).collect()}
    for key, kept, n, gone, _ in brute(rows, lambda t: (t or "").encode().split(), 7):
        r = got[key]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, gone, hashlib.sha256(b" ".join(kept)).hexdigest()), key


def test_rows_that_share_a_key(spark):
    text = "the same forty words " * 3 + " ".join(str(i) for i in range(60))
    rows = [(1, text), (1, text), (2, text), (2, "other " + text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed, r.n_bytes) for r in suffixes.remove_repeats(docs).collect())
    n = len(text)
    assert got == [(1, 0, n), (1, 0, n), (2, n, n), (2, n, n + 6)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.remove_repeats(docs).count() == 0
    assert sketches.remove_repeats(docs).count() == 0


@pytest.mark.parametrize("remove", [suffixes.remove_repeats, sketches.remove_repeats])
def test_null_keys_are_told_apart(spark, remove):
    """Many rows without a key: each is judged by its own text, in the order of its hash; equal rows are equal."""
    rng = random.Random(9)
    shared = " ".join(f"word{rng.randrange(10**6)}" for _ in range(40))
    rows = [(None, f"{i} own start {shared} own end {i}") for i in range(30)] * 2 + [(5, shared), (5, "x " + shared)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = remove(docs).collect()
    assert len(got) == len(rows)
    found = [r.n_removed for r in got if r.doc_id is None]
    assert found.count(0) == 2 and len(set(found) - {0}) <= 3 and min(set(found) - {0}) >= 40
    assert all(r.n_removed >= 40 for r in got if r.doc_id == 5)


def test_common_prefixes_and_own_windows():
    rng = np.random.default_rng(6)
    for _ in range(50):
        data = np.append(rng.integers(1, 3, rng.integers(2, 150)), 0).astype(np.uint8)
        raw, order = data.tobytes(), suffixes.suffix_array(data, 200)
        want = [0] + [next((k for k in range(40) if raw[a + k : a + k + 1] != raw[b + k : b + k + 1] or not raw[a + k : a + k + 1]), 40) for a, b in zip(order[:-1].tolist(), order[1:].tolist())]
        assert suffixes.common_prefixes(data, order, 40).tolist() == want
    text = b"abcabcabcabcx" * 9 + b"y" * 60
    first, last = np.array([0, 7, 80, 100]), np.array([6, 30, 99, len(text) - 12])
    d, w = suffixes.own_windows(np.zeros(4, np.int64), first, last, None, np.frombuffer(text, np.uint8), 12)
    asked = [i for a, b in zip(first, last) for i in range(a, b + 1)]
    assert sorted(w.tolist()) == [i for i in asked if any(text[i : i + 12] == text[j : j + 12] for j in asked if j < i)]


def test_bytes_of_real_texts(spark):
    """The window of 100 bytes, on whole texts of the test tables with passages put into several of them."""
    rng = random.Random(12)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()][:60]
    passage = docs[3][1][:400]
    rows = [(k, t if rng.random() < 0.5 else t[: len(t) // 2] + passage[rng.randrange(150) :] + t[len(t) // 2 :] + passage[:250] * rng.randrange(3)) for k, t in docs]
    rows += [(9000, " " * 30_000), (9001, "\n" * 25_000), (9002, "xy" * 9000), (None, passage), (9003, None)]
    made = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in suffixes.remove_repeats(made).collect()}
    for key, kept, n, gone, spans in brute(rows, lambda t: (t or "").encode(), 100):
        r = got[key]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, gone, spans, hashlib.sha256(bytes(kept)).hexdigest()), key


def test_names_that_clash(spark):
    from .fixtures import documents, empty

    docs = documents(spark)
    for name in ("spans", "_doc", "_spans", "row", "key", "doc", "fold", "p", "a.b"):
        docs = docs.selectExpr("*", f"'clash' AS `{name}`") if name not in docs.columns else docs
    out = suffixes.clean_texts(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    assert all(r.spans == r.row == r["a.b"] == "clash" for r in out.collect())
    assert suffixes.clean_texts(empty(spark)).count() == 0


def test_suffix_array():
    rng = np.random.default_rng(5)
    for _ in range(200):
        data = np.append(rng.integers(0, 4, rng.integers(1, 80)), 0).astype(np.uint8)
        raw = data.tobytes()
        assert suffixes.suffix_array(data, 200).tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])


def test_cleaned_texts_keep_columns(spark):
    line = "one shared passage that is long enough to be cut " * 3
    rows = [(1, "first " + line, "en", "s", 1), (2, "second " + line + " tail", "en", "s", 1), (3, line, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in suffixes.clean_texts(docs).collect()}
    assert got[1].text.startswith("first one shared passage") and 3 not in got
    assert got[2].text.startswith("second") and got[2].text.endswith("tail") and got[2].n_chars == len(got[2].text) < 80
