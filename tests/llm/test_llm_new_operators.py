"""Whitening, URL verdicts and resampling against brute force, on small made tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

import __spark_entry__ as entry
from panelforecast.llm import grams, resampling, spectrum, urls, whitening
from panelforecast.llm.common import read

VEC = "vec_id long, embedding array<float>, label int"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = "id long, vector string, component int, deviation string, whitened int, word string, bucket int, score double, rank int, canonical string, hit boolean, `a.b` int, judged string"
EXTRA = (9, "v", 1, "d", 2, "w", 3, 0.5, 4, "c", True, 5, "j")


# ---- eigenvalues by slices


def _covariance(rng, rows, dim):
    x = rng.standard_normal((rows, dim)) @ rng.standard_normal((dim, dim)) * 20
    x -= x.mean(axis=0)
    return x.T @ x / rows


@pytest.mark.parametrize("rows, dim", [(3000, 40), (12, 30), (200, 5), (2, 3)])
def test_leading_eigenpairs_are_those_of_a_dense_solver(rows, dim):
    v = _covariance(np.random.default_rng(rows), rows, dim)
    want, vectors = np.linalg.eigh(v)
    values, found = spectrum.leading_eigenpairs(v, 16)
    assert len(values) == min(16, dim, rows - 1)
    np.testing.assert_allclose(values, want[::-1][: len(values)], rtol=0, atol=1e-13 * want[-1])
    np.testing.assert_allclose(np.abs((found * vectors[:, ::-1][:, : len(values)]).sum(axis=0)), 1, atol=1e-9)
    np.testing.assert_allclose(found.T @ found, np.eye(len(values)), atol=1e-12)


@pytest.mark.parametrize("values", [[5.0] * 6 + [3.0] * 5 + [1.0] * 4, [2.0] * 15, [1 + 1e-10 * i for i in range(15)], [4.0, 4.0, 1.0] + [0.0] * 12, [7.0] + [1e-9] * 14])
def test_equal_and_near_equal_eigenvalues(values):
    turn = np.linalg.qr(np.random.default_rng(3).standard_normal((15, 15)))[0]
    v = turn @ np.diag(values) @ turn.T
    got, found = spectrum.leading_eigenpairs(v, 8)
    want = [x for x in sorted(values, reverse=True) if x > 0][:8]
    np.testing.assert_allclose(got, want, atol=1e-13 * max(values))
    np.testing.assert_allclose(v @ found, found * got, atol=1e-12 * max(values))
    np.testing.assert_allclose(found.T @ found, np.eye(len(got)), atol=1e-12)


def test_inertia_counts():
    rng = np.random.default_rng(5)
    for size in (1, 2, 7, 30):
        a = rng.standard_normal((size, size))
        a = a + a.T
        for shift in rng.uniform(-8, 8, 20):
            assert spectrum.count_below(a, shift) == (np.linalg.eigvalsh(a) < shift).sum()
    assert spectrum.count_below(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1  # no pivot of one row exists
    assert spectrum.count_below(np.zeros((3, 3)), 0.0) == 0
    assert [len(x) for x in spectrum.leading_eigenpairs(np.zeros((4, 4)), 2)] == [0, 4]


# ---- whitening


def plain_whitening(vectors, components):
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    scaled = n * x - sums
    centred = (scaled / n).astype(float)
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    values, directions = values[::-1], directions[:, ::-1]
    return [int(sum(int(c) ** 2 for c in row)) for row in scaled], centred @ directions[:, :components] / np.sqrt(values[:components]), values


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    vectors = rng.standard_normal((300, 12)) @ np.diag(np.linspace(3, 0.5, 12)) + 2
    rows = [(i, [float(c) for c in v], i % 3) for i, v in enumerate(vectors)]
    broken = [(900, None, 1), (901, [], 1), (902, [1.0] * 11 + [None], 1), (903, [float("nan")] * 12, 1), (904, [float("-inf")] * 12, 1), (905, [1.0] * 11, 1), (906, [1.0] * 13, 1)]
    frame = spark.createDataFrame(rows + broken, VEC).repartition(5)
    got = whitening.whitened_components(frame, components=7).collect()
    deviation, whitened, values = plain_whitening(vectors, 7)
    assert sorted({(r.vec_id, r.component) for r in got}) == [(i, c + 1) for i in range(300) for c in range(7)] and len(got) == 2100
    assert {r.n for r in got} == {300} and all(r.deviation == deviation[r.vec_id] for r in got)
    table = np.zeros((300, 7))
    for r in got:
        table[r.vec_id, r.component - 1] = r.whitened
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-12)
    np.testing.assert_allclose(np.abs(table), np.abs(whitened), atol=1e-9)
    np.testing.assert_allclose(np.abs((table * whitened).sum(axis=0)), 300, rtol=1e-9)  # one sign for all rows of a component
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-10
    assert got[0].identity_error == pytest.approx(np.abs(table.T @ table / 300 - np.eye(7)).max(), abs=1e-12)


def test_whitening_of_equal_few_and_huge_vectors(spark):
    assert whitening.whitened_components(spark.createDataFrame([(1, [1.0, 2.0], 0)] * 4, VEC)).collect() == []
    assert whitening.whitened_components(spark.createDataFrame([(1, [1.0, 2.0], 0)], VEC)).collect() == []
    two = whitening.whitened_components(spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.5, 2.0], 0)], VEC)).collect()
    assert [(r.component, r.n, r.deviation, abs(round(r.whitened, 12)), r.explained) for r in two] == [(1, 2, 32 * 32, 1.0, 1.0)] * 2
    assert two[0].whitened == -two[1].whitened
    huge = [(i, [float(i) * 1e30, -1e38, 3e38], 0) for i in range(5)] + [(None, [1.0, 2.0, 3.0], 0), (None, [1.0, 2.0, 3.0], 0)]
    got = whitening.whitened_components(spark.createDataFrame(huge, VEC)).collect()
    assert {r.vec_id for r in got} == {0, 1, 2, 3, 4, None} and {r.deviation for r in got} == {None}
    assert got[0].identity_error < 1e-4 and all(math.isfinite(r.whitened) for r in got)


def test_exact_sums_and_deviations_beyond_64_bits():
    x = np.array([[2**61, 1], [5, -(2**61)], [7, 3]], np.int64)
    sums = [int(c) for c in x.astype(object).sum(axis=0)]
    assert (whitening._scaled_deviations(x, 3, sums) == 3 * x.astype(object) - np.array(sums, dtype=object)).all()
    small = np.array([[3, 1], [5, 2]], np.int64)
    assert whitening._scaled_deviations(small, 2, [8, 3]).dtype == np.int64
    assert whitening._squared_length(whitening._scaled_deviations(small, 2, [8, 3])) == [5, 5]
    assert whitening._squared_length(np.array([[2**62, 1]], dtype=object)) == [None]


# ---- URLs


def plain_verdict(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, rule in urls.RULES:
        at, rest = rule.split("/", 1)
        if (host == at or host.endswith("." + at)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[1])):
            best = verdict, rule
    return host, path, best


URLS = [
    "http://a.example.net/fr/1", "https://A.Example.NET/en/1?x=1", "http://example.net/en", "http://net/", "http://net", "http://x.net?p=/", "http://x.net#/", "http://notexample.com/de/2",
    "http://example.com/de/2", "http://m.example.com/de/2#top", "http://example.com/DE/2", "http://w.org/fr/9", "http://w.org/en/9", "//a.net/", "a.net/en/", "", None, "ftp://a.net:80/x", "://a.net/x",
    "http://u@a.net/x", "http://a.net./x", "http://u.net:8080/x", "http://a.net//x", "http://a.net/./x", "http://x://a.net/y", "http://Ünet.net/ä\n/b", "HTTP://a.net/x", "http://a.net/x?", "https://a.net:443/x?#q",
    "http://planet/", "http://a.example.net/en/../x", "http:///x", "http://",
]


def test_url_verdicts_against_brute_force(spark):
    rows = [(i, u, "<html>") for i, u in enumerate(URLS * 2)]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert len(got) == len(rows)
    canonical = {r.url: r.c for r in spark.createDataFrame(rows, "page_id long, url string, html string").select("url", urls.canonical_url(urls.F.col("url")).alias("c")).collect()}
    blocked = {canonical[u] for u in URLS if (plain_verdict(u)[2] or ("", ""))[0] == "block"} - {None}
    for i, u, _ in rows:
        host, path, best = plain_verdict(u)
        assert (got[i].judged.host, got[i].judged.path, got[i].judged.rule) == (host, path, best and best[1]), u
        assert got[i].judged.verdict == (best[0] if best else "block" if canonical[u] in blocked else "allow"), u
    spelled = {u: got[i].judged.verdict for i, u, _ in rows}
    assert [spelled[u] for u in ("http://net", "http://a.net./x", "ftp://a.net:80/x", "http://w.org/en/9", "http://x.net#/")] == ["block"] * 3 + ["allow"] * 2


def test_given_list_of_urls_and_no_false_hit(spark):
    listed = spark.createDataFrame([(f"https://h{i}.example.io/p/{i}",) for i in range(0, 6000, 3)] + [(None,), ("no url",)], "link string")
    pages = spark.createDataFrame([(i, f"http://H{i}.example.io:80//p/./{i}#x") for i in range(6000)] + [(7, None), (None, "http://h3.example.io/p/3")], "page_id long, url string")
    got = urls.judge(pages, listed, rules=(), listed_column="link").collect()
    assert len(got) == 6002
    assert {r.page_id for r in got if r.judged.verdict == "block"} == {None, *range(0, 6000, 3)}
    assert all(r.judged.rule is None for r in got)


def test_filter_has_every_listed_url_and_few_others(spark):
    listed = spark.createDataFrame([(f"a{i}.com/",) for i in range(4000)], "canonical string")
    blocks = urls.bloom_blocks(listed, "canonical", 4000 // urls.URLS_A_BLOCK).collect()
    assert 100 < len(blocks) <= 125 and all(len(b["words"]) == urls.WORDS for b in blocks)
    asked = spark.createDataFrame([(f"a{i}.com/",) for i in range(20_000)], "canonical string")
    held = {b["block"]: b["words"] for b in blocks}
    probe = asked.select("canonical", urls._block(urls.F.col("canonical"), 125).alias("b"), urls.F.array(*urls._bits(urls.F.col("canonical"))).alias("bits"))
    passed = [int(r.canonical[1:-5]) for r in probe.collect() if r.b in held and all(w & bit for w, bit in zip(held[r.b], r.bits))]
    assert set(range(4000)) <= set(passed) and len(passed) < 4000 + 16_000 * 0.01
    assert {r.canonical for r in urls.listed_urls(asked, listed).collect()} == {f"a{i}.com/" for i in range(4000)}


def test_url_plan_has_no_python(spark, sf_dir):
    plan = entry.queries()["op12_url_filter"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


# ---- n-grams and the draw

TEXTS = ["", None, "one", "a b a B A", "x" * 31 + " " + "x" * 32 + " " + "x" * 33 + " " + "x" * 32, "Ärger über-Äpfel 東京 12ab", "...", " lead and trail ", "a", "b\x00c\x7fd\u0080e", "x" * 70 + " " + "x" * 69 + "y"]


def plain_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)


def plain_grams(text, order):
    words = plain_words(text)
    return [" ".join(words[i : i + k]) for k in range(1, order + 1) for i in range(len(words) - k + 1)]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_interned_grams_are_counted_as_plainly(order):
    rng = random.Random(order)
    texts = TEXTS + [" ".join(rng.choice(["ab", "Cd", "eé", "f" * 40, "0"]) for _ in range(rng.randrange(60))) for _ in range(50)]
    for column in (pa.array(texts), pa.array(["skipped", *texts, "also"]).slice(1, len(texts))):
        words = grams.Words(column)
        doc, start, length = words.grams(order)
        table = grams.Interned(words.buffer, start, length, 97)
        found = [table._bytes(i).decode() for i in range(len(start))]
        for d, text in enumerate(texts):
            assert Counter(g for g, at in zip(found, doc) if at == d) == Counter(plain_grams(text, order))
        assert len(table.taken) == len(set(found)) and table.count.sum() == len(found)
        by_slot = {}
        for gram, slot in zip(found, table.slot):
            assert by_slot.setdefault(slot, gram) == gram and table.bucket[slot] == zlib.crc32(gram.encode()) % 97
        assert {by_slot[s]: int(table.count[s]) for s in table.taken} == Counter(found)


def test_short_keys_are_xxh64():
    texts = [bytes(random.Random(n).randrange(1, 256) for _ in range(n)) for n in range(1, 32)]
    padded = np.array([list(t.ljust(32, b"\0")) for t in texts], np.uint8)
    got = grams._hash_short(padded.view("<u8"), np.array([len(t) for t in texts]))
    assert got.tolist() == [xxhash.xxh64_intdigest(t, grams.SEED) for t in texts]


def test_equal_keys_of_other_bytes_get_slots_of_their_own(monkeypatch):
    monkeypatch.setattr(grams, "_hash_short", lambda lanes, lengths: np.full(len(lanes), 7, np.uint64))
    words = grams.Words(pa.array(["a b c a b a"]))
    _, start, length = words.grams(1)
    table = grams.Interned(words.buffer, start, length, 1000)
    assert sorted(table.count[table.taken].tolist()) == [1, 2, 3]


def plain_draw(rows, target, order=1, buckets=10_000, percent=10, least=20, seed=2024):
    grams_of = {i: plain_grams(t, order) for i, (_, t) in enumerate(rows)}
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s = Counter(bucket(g) for gs in grams_of.values() for g in gs)
    t = Counter(bucket(g) for text in target for g in plain_grams(text, order))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out = []
    for i, (doc_id, text) in enumerate(rows):
        weight = sum(gain(bucket(g)) for g in grams_of[i]) // len(grams_of[i]) if grams_of[i] else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(grams_of[i]), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = [i for i in range(len(rows)) if len(plain_words(rows[i][1])) >= least]
    able.sort(key=lambda i: (-out[i][3], out[i][0] is not None, out[i][0] or 0, out[i][2], out[i][1]))
    rank = {i: k + 1 for k, i in enumerate(able[: percent * len(able) // 100])}
    return [(*o, rank.get(i)) for i, o in enumerate(out)]


def _made(seed, count):
    rng = random.Random(seed)
    return [" ".join(rng.choice(["amber", "Brook", "candle", "dune", "東京", "fjord", "x" * 50]) for _ in range(rng.randrange(60))) for _ in range(count)]


@pytest.mark.parametrize("settings", [{}, {"order": 2, "buckets": 50, "percent": 35, "least_words": 3}])
def test_draw_equals_brute_force(spark, settings):
    rows = list(enumerate([*TEXTS, *_made(1, 300)])) + [(None, "w " * 30), (5, "same id " * 20), (5, "same id " * 20)]
    target = [*_made(2, 20), None, ""]
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOC).repartition(4)
    got = resampling.importance_resample(frame, spark.createDataFrame([(t,) for t in target], "text string"), **settings).collect()
    plain = {"least" if k == "least_words" else k: v for k, v in settings.items()}
    order = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted((tuple(r) for r in got), key=order) == sorted(plain_draw(rows, target, **plain), key=order)
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, sum(r["rank"] is not None for r in got) + 1)) != []


def test_long_texts_are_interned_in_several_tables(monkeypatch):
    texts = pa.array(_made(3, 20))
    words = grams.Words(texts)
    whole = Counter()
    monkeypatch.setattr(grams, "GRAMS_AT_ONCE", 17)
    for doc, table in grams.interned(words, 2, 1000):
        assert len(doc) <= 17
        whole.update(zip(doc.tolist(), table.bucket[table.slot].tolist()))
    assert whole == Counter((d, zlib.crc32(g.encode()) % 1000) for d, t in enumerate(texts.to_pylist()) for g in plain_grams(t, 2))


# ---- every operator on odd tables


def test_empty_tables(spark):
    assert whitening.whitened_components(spark.createDataFrame([], f"{VEC}, {CLASH}")).collect() == []
    assert whitening.whitened_components(spark.createDataFrame([(None, None, None)] * 3, VEC)).collect() == []
    assert urls.judge(spark.createDataFrame([], f"page_id long, url string, html string, {CLASH}")).collect() == []
    nulls = urls.judge(spark.createDataFrame([(None, None, None)] * 3, "page_id long, url string, html string")).collect()
    assert [tuple(r.judged) for r in nulls] == [("", "", None, "allow")] * 3
    empty = spark.createDataFrame([], f"{DOC}, {CLASH}")
    assert resampling.importance_resample(empty, empty).collect() == []
    some = spark.createDataFrame([(None, None, None, None, None)] * 3 + [(1, "w " * 30, "en", "s", 1)], DOC)
    assert sorted((r.n_features, r["rank"]) for r in resampling.importance_resample(some, empty, percent=100).collect() if r.n_features) == [(30, 1)]


def test_clashing_columns_and_long_texts(spark):
    rows = [(i, [float(i), float(i * i % 7), 1.0], i % 2, *EXTRA) for i in range(20)] * 2
    got = whitening.whitened_components(spark.createDataFrame(rows, f"{VEC}, {CLASH}")).collect()
    assert len(got) == 80 and {r.n for r in got} == {40}
    pages = [(i, u, "h", *EXTRA) for i, u in enumerate(["http://a.net/x", "http://w.org/fr/1", "http://b.com/" + "y" * 100_000, "http://" + "h" * 50_000, None])]
    out = urls.judge(spark.createDataFrame(pages, f"page_id long, url string, html string, {CLASH}"))
    assert out.columns.count("judged") == 1 and "a.b" in out.columns and out.columns.count("rank") == 1
    assert [r.judged.verdict for r in out.orderBy("page_id").collect()] == ["block", "allow", "allow", "allow", "allow"]
    texts = [(1, "word " * 300_000, "en", "s", 1, *EXTRA), (2, "x" * 400_000, "en", "s", 1, *EXTRA), (2, "a b " * 40, "en", "s", 1, *EXTRA)]
    frame = spark.createDataFrame(texts, f"{DOC}, {CLASH}")
    got = resampling.importance_resample(frame, frame, percent=100).collect()
    assert sorted((r.doc_id, r.n_features, r["rank"] is not None) for r in got) == [(1, 300_000, True), (2, 1, False), (2, 80, True)]


def test_queries_over_the_given_tables(spark, sf_dir):
    got = entry.queries()["op11_embedding_whitening"](spark, sf_dir)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = got.collect()
    given = read(spark, sf_dir, "embeddings").orderBy("vec_id").collect()
    deviation, whitened, values = plain_whitening([r.embedding for r in given], 32)
    assert len(rows) == 32 * len(given) and {r.identity_error < 1e-4 for r in rows} == {True}
    at = {r.vec_id: i for i, r in enumerate(given)}
    for r in rows:
        assert r.deviation == deviation[at[r.vec_id]] and r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
        assert abs(r.whitened) == pytest.approx(abs(whitened[at[r.vec_id], r.component - 1]), abs=1e-7)
    assert entry.queries()["op12_url_filter"](spark, sf_dir).columns == ["page_id", "host", "path", "rule", "verdict"]
    assert entry.queries()["op13_importance_resampling"](spark, sf_dir).columns == ["doc_id", "n_features", "weight", "score", "rank"]
