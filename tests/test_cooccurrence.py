"""Word vectors against a dense singular value decomposition, and topics found by words they do not hold."""

import math
import random
from collections import Counter

import numpy as np

from panelforecast.operators import cooccurrence as co, topics as tp


def corpus():
    rng = random.Random(5)
    fields = [["rain", "crop", "field", "harvest", "drought"], ["troop", "gun", "raid", "militia", "ambush"], ["school", "teacher", "pupil", "class", "book"]]
    texts = [" ".join(rng.choices(fields[i % 3] + ["the", "and"], k=rng.randrange(5, 40))) for i in range(120)]
    return texts + ["", None, "alone", "Rain RAIN rain"]


def dense(texts, window, terms):
    at = {t: i for i, t in enumerate(terms)}
    counts = np.zeros((len(terms), len(terms)))
    for text in texts:
        words = (text or "").lower().split()
        for i, w in enumerate(words):
            for v in words[i + 1 : i + 1 + window]:
                if w in at and v in at:
                    counts[at[w], at[v]] += 1
                    counts[at[v], at[w]] += 1
    own = counts.sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        pmi = np.log(counts * counts.sum() / np.outer(own, own))
    return counts, np.where(counts > 0, np.maximum(pmi, 0), 0)


def test_vectors_equal_a_dense_decomposition(spark):
    texts = corpus()
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    counts = Counter(w for t in texts for w in (t or "").lower().split())
    terms = [t for t, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))]
    for size in (len(terms), 9):
        listed = co.vocabulary(docs, size=size)
        assert [r.term for r in listed.orderBy("id").collect()] == terms[:size]
        plain, pmi = dense(texts, 3, terms[:size])
        got = np.zeros((size, size))
        for r in co.cooccurrences(docs, listed, window=3).collect():
            got[r.a, r.b] = r.n
        np.testing.assert_array_equal(got, plain)
        rows = {r.term: r.vector for r in co.word_vectors(docs, dimensions=4, window=3, size=size).collect()}
        vectors = np.array([rows[t] for t in terms[:size]])
        left, values, _ = np.linalg.svd(pmi)
        want = left[:, :4] * np.sqrt(values[:4])
        np.testing.assert_allclose(np.linalg.norm(vectors, axis=0) ** 2, values[:4], rtol=1e-8)
        for i in range(4):
            gap = min(abs(values[i] - values[j]) for j in range(len(values)) if j != i)
            if gap > 1e-3:  # up to the sign
                assert abs(vectors[:, i] @ want[:, i]) / values[i] > 1 - 1e-8


def test_keyword_absent_from_its_topic_still_finds_it(spark):
    texts = corpus()
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    vectors = co.word_vectors(docs, dimensions=6)
    labelled = [(i % 3, " ".join(w for w in t.split() if w not in ("drought", "ambush", "book"))) for i, t in enumerate(texts[:120])]
    weights = tp.class_tfidf(spark.createDataFrame(labelled, "topic int, text string"))
    keywords = ["Drought", "ambush", "book", "unknown word", "drought"]
    plain = {(r.keyword, r.topic): r.similarity for r in tp.keyword_similarity(weights, keywords).collect()}
    assert all(plain[k, t] == 0 for k in ("Drought", "ambush", "book") for t in range(3))
    found = {(r.keyword, r.topic): r.similarity for r in co.context_similarity(weights, vectors, keywords).collect()}
    assert {k for k, _ in found} == {"Drought", "ambush", "book", "drought"}
    for topic, keyword in enumerate(("Drought", "ambush", "book")):
        assert max(range(3), key=lambda t: found[keyword, t]) == topic and found[keyword, topic] > 0.4
    assert math.isclose(found["Drought", 0], found["drought", 0])
    assert [r.topic for r in tp.relevant_topics(co.context_similarity(weights, vectors, ["drought"]), "drought", 1, 1).collect()] == [0]


def test_corpus_without_words(spark):
    docs = spark.createDataFrame([(None,), ("",), (" ",)], "text string")
    assert co.word_vectors(docs).collect() == []
    one = {r.term: r.vector for r in co.word_vectors(spark.createDataFrame([("single",)], "text string")).collect()}
    assert list(one) == ["single"] and not any(one["single"])


def test_pairs_are_added_up_however_few_a_task_holds(spark, monkeypatch):
    docs = spark.createDataFrame([(t,) for t in corpus()], "text string").repartition(2)
    terms = co.vocabulary(docs)
    want = sorted(map(tuple, co.pair_counts(docs, terms).collect()))
    monkeypatch.setattr(co, "PAIRS_HELD", 3)
    monkeypatch.setattr(co, "TEXTS_A_STEP", 2)
    assert sorted(map(tuple, co.pair_counts(docs, terms).collect())) == want and all(lo <= hi for lo, hi, _ in want)


def test_counts_move_and_are_multiplied_in_strips(spark, monkeypatch):
    texts = corpus()
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    counted = co.term_counts(docs)
    terms = co.vocabulary(docs, counts=counted)
    names = [r.term for r in terms.orderBy("id").collect()]
    plain, pmi = dense(texts, co.WINDOW, names)
    x = np.random.default_rng(3).standard_normal((len(names), 4))
    for bands, strip in ((co.BANDS, co.STRIP), (2, 3)):
        monkeypatch.setattr(co, "BANDS", bands)
        monkeypatch.setattr(co, "STRIP", strip)
        pairs = co.pair_strips(docs, terms)
        # a row a strip, not one a pair
        assert pairs.count() <= bands * -(-len(names) // (bands * strip)) < np.count_nonzero(plain) / 2
        both = co.both_ways(pairs, len(names))
        own = co.word_totals(both, len(names))
        np.testing.assert_array_equal(own, plain.sum(axis=1))
        np.testing.assert_allclose(co._times(both, own, x), pmi @ x, atol=1e-12)
        vectors = [{r.term: r.vector for r in co.word_vectors(docs, dimensions=4, counts=c).collect()} for c in (None, counted)]
        assert vectors[0].keys() == set(names)
        for t in names:
            np.testing.assert_allclose(vectors[0][t], vectors[1][t], atol=1e-9)
