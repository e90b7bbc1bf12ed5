"""Boosted trees against the same rule written plainly with numpy, on any partitioning."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforecast.operators import boosting as bo, models as ml
from panelforecast.plans import evaluation as ev
from panelforecast.sources.stages import stage, stage_path
from panelforecast.sources.tables import load_model, save_model


def made(spark, rows=220, seed=3):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(rows):
        a, b = float(rng.normal() * 5), float(rng.integers(0, 6))
        c = float(rng.normal() * 1e-3 + (1e9 if i % 3 else -7))
        y = 0.3 * a + b * (a > 0) + (2.0 if i % 4 == 0 else 0.0) + rng.normal() * 0.1
        gap = lambda v, p: None if rng.random() < p else v
        # a gap of "a" tells something, those of "b" and "c" nothing; "none" is empty, "same" constant
        out.append((i, i % 5, None if i % 4 == 0 else a, gap(b, 0.2), gap(c, 0.1), None, 1.5, None if i % 17 == 0 else float(y)))
    return spark.createDataFrame(out, "id long, epoch int, a double, b double, c double, none double, same double, ipc double"), ["a", "b", "c", "none", "same"]


class Plain:
    """The rule, one node and one cut after the other."""

    def __init__(self, x, y, keys, epochs, fold, all_y, s):
        use = epochs <= fold
        x, y, keys = x[use], y[use], keys[use]
        self.s, self.trees = s, []
        self.base = y.mean()
        scale = 2.0 ** (60 - math.ceil(math.log2(len(all_y) + 1)) - math.ceil(math.log2(4 * (all_y.max() - all_y.min()) + 1)))
        self.cuts = []
        for i in range(x.shape[1]):
            v = np.sort(x[~np.isnan(x[:, i]), i])
            self.cuts.append(sorted({v[math.ceil(j * len(v) / s.bins) - 1] for j in range(1, s.bins)} - {v[-1]}) if len(v) else [])
        guess = np.full(len(y), self.base)
        for t in range(s.maxIter):
            inside = bo.drawn(keys, t, s.seed, s.subsamplingRate)
            tree = self.grow(x[inside], np.rint((guess - y)[inside] * scale) / scale, bo.drawn_columns(x.shape[1], t, s.seed, s.columnRate), 0)
            self.trees.append(tree)
            guess = guess + self.ends(tree, x)

    def leaf(self, g):
        return -self.s.stepSize * g.sum() / (len(g) + 1)

    def grow(self, x, g, columns, level):
        best, gain = None, 1e-6
        if level < self.s.maxDepth:
            for c in columns:
                for left in (False, True):
                    for cut in [*self.cuts[c], math.inf]:
                        low = (x[:, c] <= cut) | (np.isnan(x[:, c]) & left)
                        if not low.any() or low.all():
                            continue
                        score = lambda p: p.sum() ** 2 / (len(p) + 1)
                        more = score(g[low]) + score(g[~low]) - score(g)
                        if more > gain + 1e-12:
                            best, gain = (c, cut, left, low), more
        if best is None:
            return self.leaf(g)
        c, cut, left, low = best
        return c, cut, left, self.grow(x[low], g[low], columns, level + 1), self.grow(x[~low], g[~low], columns, level + 1)

    def ends(self, tree, x):
        out = np.zeros(len(x))
        for i, row in enumerate(x):
            node = tree
            while isinstance(node, tuple):
                c, cut, left, low, high = node
                node = low if (left if np.isnan(row[c]) else row[c] <= cut) else high
            out[i] = node
        return out

    def predict(self, x):
        return self.base + sum((self.ends(t, x) for t in self.trees), np.zeros(len(x)))


def arrays(df, features):
    rows = df.where("ipc is not null").withColumn("_key", F.xxhash64("id")).toPandas()
    return rows[features].to_numpy(float), rows["ipc"].to_numpy(float), rows["_key"].to_numpy(np.int64).view(np.uint64), rows["epoch"].to_numpy(int)


@pytest.mark.parametrize("settings", [{}, {"maxDepth": 3, "stepSize": 0.4, "maxIter": 6, "bins": 8}, {"maxDepth": 2, "stepSize": 0.5, "maxIter": 12, "subsamplingRate": 1.0, "columnRate": 1.0}])
def test_trees_equal_the_plain_rule(spark, settings):
    df, features = made(spark, 90 if not settings else 220)
    s = bo.Settings(**{**ml.TREE_SETTINGS, **settings})
    assert settings or s.maxIter == 100
    x, y, keys, epochs = arrays(df, features)
    forest = bo.fit_forests(df.withColumn("epoch", F.lit(0)).repartition(3), features, "ipc", 1, ["id"], s)[0]
    plain = Plain(x, y, keys, epochs * 0, 0, y, s)
    got = forest.predict(df.select(*features).toPandas().to_numpy(float))
    np.testing.assert_allclose(got, plain.predict(df.select(*features).toPandas().to_numpy(float)), atol=1e-9)
    assert abs(got - df.toPandas()["ipc"]).mean() < abs(y - y.mean()).mean()


def test_folds_are_grown_side_by_side_as_if_alone(spark):
    df, features = made(spark)
    df = df.withColumn("ipc", F.when(F.col("epoch") > 0, F.col("ipc")))  # the first fold has no label
    s = bo.Settings(maxIter=4, maxDepth=3, stepSize=0.3, bins=16)
    forests = bo.fit_forests(df, features, "ipc", 4, ["id"], s)
    x, y, keys, epochs = arrays(df, features)
    whole = df.select(*features).toPandas().to_numpy(float)
    assert forests[0].base is None and np.isnan(forests[0].predict(whole)).all()
    used = epochs < 4
    for fold in (1, 2, 3):
        plain = Plain(x[used], y[used], keys[used], epochs[used], fold, y[used], s)
        np.testing.assert_allclose(forests[fold].predict(whole), plain.predict(whole), atol=1e-9)


def test_cuts_are_exact_quantiles_of_each_fold(spark):
    rng = np.random.default_rng(0)
    values = [rng.normal(size=3000) * 10.0 ** rng.integers(-300, 300, 3000), np.repeat([0.0, -0.0, 5.0], 1000), rng.integers(-3, 4, 3000).astype(float)]
    values[0][:500], values[2][7] = np.nan, np.nan
    epochs = rng.integers(0, 3, 3000)
    epochs[:800] = 2
    rows = [(int(e), *[None if np.isnan(v[i]) else float(v[i]) for v in values], None) for i, e in enumerate(epochs)]
    frame = spark.createDataFrame(rows, "epoch int, x0 double, x1 double, x2 double, x3 double").repartition(5)
    got = bo.quantile_cuts(frame, 4, 3, 50)
    for fold in range(3):
        for i, v in enumerate([*values, np.full(3000, np.nan)]):
            known = np.sort(v[(epochs <= fold) & ~np.isnan(v)])
            want = sorted({known[math.ceil(j * len(known) / 50) - 1] for j in range(1, 50)} - {known[-1]}) if len(known) else []
            assert got[fold][i].tolist() == want


def test_the_same_trees_on_any_partitioning(spark):
    df, features = made(spark)
    fits = [ml.fit_trees(df.repartition(n), features, key=["id"], maxIter=12)[0] for n in (1, 7)]
    for name in ("feature", "threshold", "missing_left", "value"):
        np.testing.assert_array_equal(getattr(fits[0], name), getattr(fits[1], name))


def test_missing_values_learn_their_side(spark):
    rows = [(i, None if i % 2 else float(i), 5.0 if i % 2 else 1.0) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, x double, ipc double")
    model, _ = ml.fit_trees(df, ["x"], key=["id"], maxIter=30, stepSize=0.5)
    np.testing.assert_allclose(model.predict(np.array([[np.nan], [3.0], [1e9]])), [5, 1, 1], atol=0.2)
    kept = load_model(_saved(spark, model), bo.Forest)
    np.testing.assert_array_equal(kept.predict(np.array([[np.nan], [4.0]])), model.predict(np.array([[np.nan], [4.0]])))


def _saved(spark, model):
    path = stage_path(spark, "forest")
    save_model(model, path)
    return path


def test_odd_tables(spark):
    schema = "id long, x double, ipc double, y double, epoch string, key string"
    empty = spark.createDataFrame([], schema)
    model, _ = ml.fit_trees(empty, ["x"], maxIter=2)
    one = spark.createDataFrame([(1, 2.0, 3.0, 1.0, "e", "k")] * 3 + [(2, None, None, None, None, None)], schema)
    assert [r.prediction for r in ml.predict_trees(model, one, ["x"], ["id", "epoch"]).collect()] == [None] * 4
    model, _ = ml.fit_trees(one, ["x", "y"], maxIter=3)
    assert [r.prediction for r in ml.predict_trees(model, one, ["x", "y"], ["key"]).collect()] == [3.0] * 4
    model, _ = ml.fit_trees(one, [], maxIter=3)
    assert ml.predict_trees(model, one, [], ["id"]).columns == ["id", "label", "prediction"]


def test_evaluation_uses_all_rounds_and_folds(spark):
    rng = np.random.default_rng(1)
    rows = [(f"{2001 + m // 12}-{m % 12 + 1:02d}-01", f"d{d}", float(np.sin(m / 3 + d)), None if m % 5 == 0 else float(rng.normal()), float(round(3 + 2 * np.sin(m / 3 + d)))) for m in range(48) for d in range(6)]
    df = spark.createDataFrame(rows, "date string, district string, a double, b double, ipc double").withColumn("date", F.to_date("date"))
    result = ev.model_eval(stage(df, "tree-panel"), ["a", "b"], "XGboost", splits=2, maxIter=21, stepSize=0.2)
    assert [len(m.feature) for m in result.models] == [21, 21]
    assert result.means().first().mean_accuracy > 0.8
    assert result.predictions.count() == 2 * (len(rows) // 3)


def test_columns_counted_together_give_the_same_trees(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, i % 3, *[None if rng.random() < 0.1 else float(rng.integers(0, 40)) for _ in range(3)], float(rng.integers(1, 6))) for i in range(400)]
    df = stage(spark.createDataFrame(rows, "id long, epoch int, a double, b double, c double, y double").repartition(3), "together")
    jobs, found = [], {}
    plain = bo._histograms
    monkeypatch.setattr(bo, "_histograms", lambda *a: jobs.append(1) or plain(*a))
    for most in (2, 0):
        monkeypatch.setattr(bo, "TOGETHER", most)
        jobs.clear()
        found[most] = bo.fit_forests(df, ["a", "b", "c"], "y", 3, ["id"], bo.Settings(maxIter=5, stepSize=0.3)), len(jobs)
    assert found[2][1] == 5 < found[0][1]
    for one, other in zip(found[2][0], found[0][0]):
        for name in ("feature", "threshold", "missing_left", "value"):
            np.testing.assert_array_equal(getattr(one, name), getattr(other, name))
