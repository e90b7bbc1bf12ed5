"""Places, tags, topics and monthly series against brute force and pandas."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforecast.operators import joins, places as pl, series as se, tags as tg, topics as tp
from panelforecast.plans import datasets as ds
from panelforecast.sources import tables

LOCATIONS = ["Juba Town", "juba", "A_10", "A_1", "near A_10 and Yei", "", None, "Nowhere", "yei river county", "u", "JUBA"]
DISTRICTS = ["Juba", "A_1", "A_10", "Yei River", "Torit East", "Yei"]


def brute_force(locations, districts, fallback):
    out = []
    for i, place in enumerate(locations):
        text = None if place is None else place.lower()
        hits = [d for d in districts if text is not None and (d.lower() in text or text in d.lower())]
        if not hits:
            hits = list(districts) if fallback == "all" else [pl.NOT_ASSIGNED]
        out += [(i, d) for d in hits]
    return sorted(out)


def frames(spark, locations, districts):
    articles = spark.createDataFrame(list(enumerate(locations)), "doc_id long, location string")
    return articles, spark.createDataFrame([(d,) for d in districts], "district string")


@pytest.mark.parametrize("fallback", ["all", "label"])
@pytest.mark.parametrize("districts", [DISTRICTS, [*DISTRICTS, ""], []])
def test_mapping_equals_brute_force(spark, fallback, districts):
    articles, gazetteer = frames(spark, LOCATIONS, districts)
    got = sorted((r.doc_id, r.district) for r in pl.map_articles(articles, gazetteer, fallback).collect())
    assert got == brute_force(LOCATIONS, districts, fallback)


def test_mapping_equals_brute_force_on_random_names(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abc ") for _ in range(rng.randint(1, 6)))
    districts = sorted({word() for _ in range(40)})
    locations = [word() for _ in range(200)]
    articles, gazetteer = frames(spark, locations, districts)
    got = sorted((r.doc_id, r.district) for r in pl.map_articles(articles, gazetteer, "all").collect())
    assert got == brute_force(locations, districts, "all")
    weights = pl.with_district_weight(articles, gazetteer).collect()
    want = pd.Series([i for i, _ in got]).value_counts().to_dict()
    assert {r.doc_id: r.districts for r in weights} == want


def test_contained_equals_brute_force_at_any_length(spark):
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("ab\u00e9 ") for _ in range(n))
    long = word(400)
    inner = {word(rng.randint(0, 9)) for _ in range(80)} | {long[i : i + n] for i, n in [(0, 64), (3, 65), (50, 127), (100, 128), (90, 300)]}
    outer = {word(rng.randint(0, 40)) for _ in range(80)} | {long, long[3:60], "", "x"}
    frame = lambda texts, name: spark.createDataFrame([(t,) for t in [*sorted(texts), None]], f"{name} string")
    got = sorted((r.inner, r.outer) for r in pl.contained(frame(inner, "inner"), frame(outer, "outer")).collect())
    assert got == sorted((i, o) for i in inner for o in outer if i in o)
    assert pl.contained(frame(set(), "inner"), frame(outer, "outer")).count() == 0
    assert pl.contained(frame(inner, "inner"), frame(set(), "outer")).count() == 0


def test_a_name_is_filed_under_its_rarest_piece(spark, monkeypatch):
    """Names of one common beginning meet only the places that hold the rest of them."""
    names = [f"customer#{i:09d}" for i in range(300)]
    places = [f"{n} market" for n in names] + ["customer# of old"]
    met = []
    join = pl.lookup_join
    monkeypatch.setattr(pl, "lookup_join", lambda *a, **k: met.append(join(*a, **k)) or met[-1])
    frame = lambda texts, name: spark.createDataFrame([(t,) for t in texts], f"{name} string")
    assert pl.contained(frame(names, "inner"), frame(places, "outer")).count() == 300
    assert met[-1].count() == 300


def test_long_gazetteer_goes_in_several_passes(spark):
    mapped = spark.createDataFrame([(1, None), (2, "x"), (3, None)], "doc_id long, district string")
    gazetteer = spark.range(95).select(F.concat(F.lit("d"), "id").alias("district"))
    got = sorted((r.doc_id, r.district) for r in pl._to_every_district(mapped, gazetteer, row_names=30).collect())
    assert got == sorted([(2, "x")] + [(i, f"d{d}") for i in (1, 3) for d in range(95)])


def test_direction_words_go_one_after_the_other(spark):
    raw = [("North Bor South",), ("SoEastuth X",), (" Center\tYei ",), ("east Wau",), ("SoNorthuth Y",), (None,)]
    got = {r.district for r in pl.gazetteer_of(spark.createDataFrame(raw, "district string")).collect()}
    # "SoNorthuth" loses North after South was looked for; "SoEastuth" likewise keeps South
    assert got == {"Bor", "South X", "Yei", "east Wau", "South Y"}


def test_hot_key_is_spread_and_nothing_is_lost(spark):
    some = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id") % 50))
    facts = spark.range(4000).select("id", some.alias("k"))  # a third hot, a third without a key
    lookup = spark.range(50).select(F.concat(F.lit("k"), "id").alias("k"), F.col("id").alias("v")).union(
        spark.createDataFrame([("hot", -1), ("unused", -2)], "k string, v long")
    )
    want = facts.join(lookup, "k", "left")
    got = joins.lookup_join(facts, lookup, "k", "left", spread_by="id", limit_bytes=0)
    assert got.exceptAll(want.select(got.columns)).count() == 0 and got.count() == want.count() == 4000
    assert "_slot" in got._jdf.queryExecution().toString()
    hot = {r.k for r in joins.hot_keys(facts, "k").collect()}
    assert "hot" in hot


def test_small_lookup_is_broadcast(spark):
    facts = spark.range(100).select("id", (F.col("id") % 5).cast("string").alias("k"))
    lookup = spark.createDataFrame([("1", 1)], "k string, v int")
    assert "BroadcastHashJoin" in joins.lookup_join(facts, lookup, "k", spread_by="id")._jdf.queryExecution().toString()


TEXTS = ["a", "b", "a", None, "a", None, "c", "long " * 50]


@pytest.mark.parametrize("limit", [joins.BROADCAST_BYTES, 0])
def test_tag_join_equals_pandas_merge(spark, limit):
    tag = [True, False, False, True, True, True, False, True]
    corpus = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    tagged = spark.createDataFrame(list(zip(TEXTS, tag)), "text string, hunger boolean")
    got = tg.repeat_copies(tg.attach_tags(corpus, tagged, ["hunger"], limit_bytes=limit)).toPandas()
    left = pd.DataFrame({"doc_id": range(len(TEXTS)), "text": TEXTS})
    want = left.merge(pd.DataFrame({"text": TEXTS, "hunger": tag}), how="left", on="text")
    key = ["doc_id", "hunger"]
    assert len(got) == len(want)
    assert sorted(map(tuple, got[key].values.tolist())) == sorted(map(tuple, want[key].values.tolist()))


def test_copies_are_repeated_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(tg, "REPEAT_BLOCK", 10)
    rows = spark.createDataFrame([(1, 1), (2, 10), (3, 11), (4, 35)], "id int, copies long")
    got = {r.id: r["count"] for r in tg.repeat_copies(rows).groupBy("id").count().collect()}
    assert got == {1: 1, 2: 10, 3: 11, 4: 35}


def test_tags_by_id_do_not_multiply(spark):
    corpus = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    tagged = corpus.withColumn("hunger", F.col("doc_id") > 3)
    assert tg.attach_tags_by_id(corpus, tagged, ["hunger"]).count() == len(TEXTS)


def pandas_series(frame, tags):
    out = {}
    for t in tags:
        out[t] = frame.groupby("date")[t].mean().fillna(0).rolling(3).mean().shift(3)
    return pd.DataFrame(out)


def test_monthly_series_equal_pandas(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        month = int(rng.integers(0, 14))
        if month in (4, 9):
            continue
        day = dt.date(2010 + month // 12, month % 12 + 1, int(rng.integers(1, 28)))
        rows.append((i, day, bool(rng.random() < 0.3), None if rng.random() < 0.2 else bool(rng.random() < 0.6)))
    df = spark.createDataFrame(rows, "doc_id long, date date, a boolean, b boolean")
    got = se.monthly_series_features(df, ["a", "b"]).toPandas().set_index("date").sort_index()
    frame = pd.DataFrame(rows, columns=["doc_id", "date", "a", "b"])
    frame["date"] = [d.replace(day=1) for d in frame["date"]]
    frame[["a", "b"]] = frame[["a", "b"]].astype(float)
    want = pandas_series(frame, ["a", "b"])
    assert len(got) == len(want) and got["a"].head(5).isna().all()
    np.testing.assert_allclose(got[["a", "b"]].astype(float), want)


def test_weighted_share_equals_written_out_rows(spark):
    rows = [(dt.date(2010, 1, i + 1), i % 3 == 0, i % 4 + 1) for i in range(20)]
    df = spark.createDataFrame(rows, "date date, a boolean, copies long")
    weighted = se.monthly_topic_share(df, ["a"], weight="copies").first()["a"]
    plain = se.monthly_topic_share(tg.repeat_copies(df), ["a"]).first()["a"]
    assert weighted == pytest.approx(plain)


def expected_selection(similarity, keywords, top_n):
    """Best similarity per topic over the top lists of all keywords, then the ten best."""
    best = {}
    for k in keywords:
        ranked = sorted(((s, t) for kk, t, s in similarity if kk == k), key=lambda p: (-p[0], p[1]))
        for s, t in ranked[:top_n]:
            best[t] = max(best.get(t, -9), s)
    return sorted(best.items(), key=lambda p: (-p[1], p[0]))[:10]


def test_relevant_topics(spark):
    rng = random.Random(1)
    rows = [(k, t, rng.random()) for k in ("a", "b", "c") for t in range(25)]
    similarity = spark.createDataFrame(rows, "keyword string, topic int, similarity double")
    got = [(r.topic, r.similarity) for r in tp.relevant_topics(similarity, ["a", "b"], top_n=7).collect()]
    assert got == expected_selection(rows, ["a", "b"], 7)
    single = [r.topic for r in tp.relevant_topics(similarity, "c", top_n=4).collect()]
    assert single == [t for t, _ in expected_selection(rows, ["c"], 4)]
    by_tag = tp.relevant_topics_by_tag(similarity, {"x": ["a", "b"], "y": ["c", "a"]}, top_n=7)
    assert {r.topic for r in by_tag.where("tag = 'x'").collect()} == {t for t, _ in got}


CORPUS = [("rain and harvest rain", 0), ("harvest failed hunger", 0), ("troops fighting murder", 1), ("fighting goes on", 1), ("", 2), (None, 2)]


def test_keyword_similarity_by_hand(spark):
    docs = spark.createDataFrame(CORPUS, "text string, topic int")
    weights = tp.class_tfidf(docs)
    got = {(r.topic, r.term): r.weight for r in weights.collect()}
    average = (7 + 6) / 2  # words per topic; the topic without words has none to average
    assert got[(0, "rain")] == pytest.approx(2 * np.log(1 + average / 2))
    similarity = {(r.keyword, r.topic): r.similarity for r in tp.keyword_similarity(weights, ["Hunger rain", "absent"]).collect()}
    norm = np.sqrt(sum(w * w for (t, _), w in got.items() if t == 0))
    want = (got[(0, "rain")] + got[(0, "hunger")]) / np.sqrt(2) / norm
    assert similarity[("Hunger rain", 0)] == pytest.approx(want)
    assert similarity[("Hunger rain", 1)] == 0 and similarity[("absent", 0)] == 0


def test_tags_of_unknown_topics_are_false(spark):
    docs = spark.createDataFrame([(1, 5), (2, None), (3, 9)], "doc_id long, topic int")
    chosen = spark.createDataFrame([("a", 5), ("b", 5), ("b", 9)], "tag string, topic int")
    got = {r.doc_id: (r.a, r.b) for r in tg.tag_by_topic(docs, chosen, ["a", "b"]).collect()}
    assert got == {1: (True, True), 2: (False, False), 3: (False, True)}


def test_topic_model_is_repeatable_and_survives_saving(spark, tmp_path):
    words = [["rain", "crop", "field"], ["troop", "gun", "raid"]]
    rows = [(i, " ".join(random.Random(i).choices(words[i % 2], k=12))) for i in range(40)] + [(40, ""), (41, None)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(2).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    model = tp.fit_topics(docs, k=3, features=256)
    topics = {r.doc_id: r.topic for r in tp.assign_topics(model, docs).collect()}
    again = {r.doc_id: r.topic for r in tp.assign_topics(tp.fit_topics(docs, k=3, features=256), docs).collect()}
    assert topics == again and len(topics) == 42
    tables.save_model(model, str(tmp_path / "m"))
    loaded = tables.load_model(str(tmp_path / "m"))
    assert topics == {r.doc_id: r.topic for r in tp.assign_topics(loaded, docs).collect()}


def test_topics_do_not_depend_on_the_partitions(spark):
    words = [["rain", "crop", "field"], ["troop", "gun", "raid"], ["school", "book", "class"]]
    rows = [(i, " ".join(random.Random(i).choices(words[i % 3], k=9))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    vectors = spark.createDataFrame([(i, [float(random.Random(i * 7 + k).random()) for k in range(4)]) for i in range(90)], "doc_id long, embedding array<float>")
    topics, of_vectors = [], []
    for n in (1, 2, 6):
        model = tp.fit_topics(docs.repartition(n), k=4, features=256)
        topics.append({r.doc_id: r.topic for r in tp.assign_topics(model, docs).collect()})
        model = tp.fit_vector_topics(vectors.repartition(n), k=5)
        of_vectors.append({r.doc_id: r.topic for r in tp.assign_vector_topics(model, vectors).collect()})
    assert topics[0] == topics[1] == topics[2] and of_vectors[0] == of_vectors[1] == of_vectors[2]


def test_outliers_are_what_is_far_from_its_centre(spark):
    words = [["rain", "crop", "field"], ["troop", "gun", "raid"]]
    rows = [(i, " ".join(random.Random(i).choices(words[i % 2], k=12))) for i in range(40)] + [(40, ""), (41, None), (42, "zebra rain")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = tp.fit_topics(docs, k=2, features=256)
    centres = model.stages[-1].clusterCenters()
    plain = {r.doc_id: r.topic for r in tp.assign_topics(model, docs).collect()}
    units = {r.doc_id: r._unit.toArray() for r in model.transform(docs.na.fill("", ["text"])).collect()}
    for limit in (0.05, 0.3, 0.9):
        got = {r.doc_id: r.topic for r in tp.assign_topics(model, docs, outlier_distance=limit).collect()}
        for i, u in units.items():
            centre = centres[plain[i]]
            near = u @ centre / np.linalg.norm(centre) if u.any() else 1.0
            if abs(1 - near - limit) > 1e-9:
                assert got[i] == (-1 if u.any() and 1 - near > limit else plain[i])
    assert set(got.values()) <= {-1, 0, 1}


def test_hot_keys_follow_the_size_of_a_task(spark):
    from panelforecast.operators import joins as jn

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        rows = [("half", i) for i in range(5000)] + [("rare", i) for i in range(10)] + [(None, i) for i in range(500)] + [(f"k{i}", i) for i in range(4990)]
        facts = spark.createDataFrame(rows, "key string, id int")
        hot = {r.key: r._slots for r in jn.hot_keys(facts, "key").collect()}
        assert set(hot) == {"half"} and 19 <= hot["half"] <= 22
        lookup = spark.createDataFrame([("half", 1), ("half", 2), ("rare", 3), ("k7", 4)], "key string, v int")
        joined = jn.lookup_join(facts, lookup, "key", "left", spread_by="id", limit_bytes=0)
        assert joined.count() == 5000 * 2 + 10 + 500 + 4990
        assert joined.where("v is not null").groupBy("key").count().count() == 3
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
        spread = jn.spread_join(facts, lookup, "key", "left", "id").where("key = 'half' and v = 1").groupBy(F.spark_partition_id()).count()
        assert spread.count() > 5
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_nearest_centres_in_one_pass_and_in_several(spark):
    vectors = [(i, [float(x) for x in np.random.default_rng(i).normal(size=4)], i % 5) for i in range(20)]
    df = spark.createDataFrame(vectors, "vec_id int, embedding array<float>, label int")
    centres = tp.topic_vectors(df, "label")
    every = tp.vector_similarity(df, centres, "vec_id", "embedding").collect()
    want = {i: sorted([(-r.similarity, r.topic) for r in every if r.vec_id == i])[:2] for i in range(20)}
    for share in (1 << 20, 60):
        got = tp.vector_similarity(df, centres, "vec_id", "embedding", top_n=2, share_bytes=share).collect()
        assert {i: sorted((-r.similarity, r.topic) for r in got if r.vec_id == i) for i in range(20)} == want


@pytest.mark.parametrize("share_bytes", [1 << 20, 60])
def test_vector_similarity_equals_numpy(spark, share_bytes):
    rng = np.random.default_rng(0)
    vectors = [(i, [float(x) for x in rng.normal(size=4)], i % 3) for i in range(12)]
    df = spark.createDataFrame(vectors, "vec_id int, embedding array<float>, label int")
    got = {(r.vec_id, r.topic): r.similarity for r in tp.vector_similarity(df, tp.topic_vectors(df, "label"), "vec_id", "embedding", share_bytes=share_bytes).collect()}
    data = np.array([v for _, v, _ in vectors], dtype=np.float32).astype(float)
    for t in range(3):
        centre = data[[i for i in range(12) if i % 3 == t]].mean(axis=0)
        for i in range(12):
            want = data[i] @ centre / np.linalg.norm(data[i]) / np.linalg.norm(centre)
            assert got[(i, t)] == pytest.approx(want, abs=1e-9)


def test_article_features_with_and_without_fanout(spark):
    rows = [(i, t, topic, dt.date(2010, 1, 1), "x") for i, (t, topic) in enumerate(CORPUS + CORPUS[:1])]
    corpus = spark.createDataFrame(rows, "doc_id long, text string, topic int, date date, location string")
    words = {"hunger": ["hunger"], "conflict": ["fighting"]}
    fan = {r.doc_id: (r.hunger, r.conflict, r.copies) for r in ds.article_features(corpus, words, top_n=1, final_n=1).collect()}
    assert fan[0] == (True, False, 2) and fan[6] == (True, False, 2) and fan[2] == (False, True, 1)
    single = ds.article_features(corpus, words, fanout=False, top_n=1, final_n=1)
    assert single.count() == 7 and single.agg(F.sum("copies")).first()[0] == 7


def test_own_topics_read_the_texts_once(spark):
    words = [["rain", "crop", "field"], ["troop", "gun", "raid"]]
    rows = [(i % 50, " ".join(random.Random(i).choices(words[i % 2], k=12))) for i in range(60)] + [(60, ""), (61, None), (62, "zebra rain")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for limit in (None, 0.3):
        got = tp.own_topics(docs, k=3, features=256, outlier_distance=limit).select("doc_id", "topic")
        plan = got._jdf.queryExecution().toString()
        assert "_tokens" not in plan and "Scan parquet" in plan
        got = sorted(map(tuple, got.collect()))
        want = tp.assign_topics(tp.fit_topics(docs, k=3, features=256), docs, outlier_distance=limit)
        assert got == sorted(map(tuple, want.select("doc_id", "topic").collect())) and len(got) == 63
