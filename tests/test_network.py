"""The neural classifier against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforecast.operators import metrics as mt, network as nw
from panelforecast.plans import evaluation as ev
from panelforecast.sources.stages import stage

FEATURES = ["a", "b", "c"]
WEIGHTS = [1.0, 0.3, 2.5]


@pytest.fixture(scope="module")
def points():
    draw = np.random.default_rng(4)
    x = draw.normal(size=(300, 3))
    return x, (x @ np.array([1.0, -2.0, 0.5]) > 0).astype(int) + (x[:, 2] > 1)


def frame(spark, x, y):
    return spark.createDataFrame([(*map(float, r), float(k)) for r, k in zip(x, y)], "a double, b double, c double, label double")


def test_gradient_equals_differences(points):
    x, y = points
    model, weight = nw.Network.start(3, 5, 3, 1), np.array(WEIGHTS)[y]
    loss, gradient = model.gradient(x, y, weight)
    assert loss == pytest.approx(model.loss(x, y, weight))
    for k in range(len(gradient)):
        step = np.zeros(len(gradient))
        step[k] = 1e-6
        slope = (model.moved(step).loss(x, y, weight) - model.moved(-step).loss(x, y, weight)) / 2e-6
        assert gradient[k] == pytest.approx(slope, rel=1e-4, abs=1e-4)


def test_training_equals_numpy_on_any_partitions(spark, points):
    x, y = points
    weight, held = np.array(WEIGHTS), slice(200, None)
    model = nw.Network.start(3, 4, 3, 9)
    slope = spread = 0.0
    curve = []
    for t in range(1, 8):
        loss, g = model.gradient(x[:200], y[:200], weight[y[:200]] / weight[y[:200]].sum())
        curve.append((loss, model.loss(x[held], y[held], weight[y[held]] / weight[y[held]].sum())))
        slope, spread = 0.9 * slope + 0.1 * g, 0.999 * spread + 0.001 * g * g
        model = model.moved(-0.05 * (slope / (1 - 0.9**t)) / (np.sqrt(spread / (1 - 0.999**t)) + 1e-8))
    for parts in (1, 7):
        train, test = frame(spark, x[:200], y[:200]).repartition(parts), frame(spark, x[held], y[held]).repartition(parts)
        fit = nw.train_network(train, test, FEATURES, weights=WEIGHTS, units=4, epochs=6, rate=0.05, seed=9)
        got = [(r.train_loss, r.test_loss) for r in fit.losses.orderBy("epoch").collect()]
        np.testing.assert_allclose(got, curve, rtol=1e-9)
        assert fit.epoch == min(range(7), key=lambda e: curve[e][1])


def test_rows_that_teach_nothing(spark, points):
    x, y = points
    good = frame(spark, x, y)
    odd = spark.createDataFrame([(None, 1.0, 1.0, 0.0), (1.0, float("nan"), 1.0, 0.0), (1.0, 1.0, 1.0, 7.0), (1.0, 1.0, 1.0, 0.5), (1.0, 1.0, 1.0, None)], good.schema)
    fits = [nw.train_network(d, None, FEATURES, weights=WEIGHTS, units=3, epochs=3) for d in (good, good.union(odd))]
    np.testing.assert_allclose(fits[0].model.vector(), fits[1].model.vector(), rtol=1e-9)
    assert fits[0].epoch == 3 and fits[0].losses.where("test_loss is null").count() == 4
    out = nw.predict_network(fits[0].model, odd, FEATURES, ["c"]).collect()
    assert [r.prediction is None for r in out] == [True, True, False, False, False]
    empty = nw.train_network(good.limit(0), good.limit(0), FEATURES, weights=WEIGHTS, units=3, epochs=2)
    assert empty.losses.where("train_loss is null and test_loss is null").count() == 3
    assert nw.predict_network(empty.model, good.limit(0), FEATURES, ["c"]).count() == 0
    for bad in ([-1.0, 1.0], [0.0, 0.0], []):
        with pytest.raises(ValueError):
            nw.train_network(good, None, FEATURES, weights=bad)


def test_weights_count_as_repeated_rows_do(spark, points):
    x, y = points
    df = frame(spark, x, y)
    twice = df.unionAll(df.where("label = 2"))
    fits = [nw.train_network(d, None, FEATURES, weights=w, units=3, epochs=4) for d, w in ((df, [0.5, 0.5, 1.0]), (twice, [1.0, 1.0, 1.0]))]
    np.testing.assert_allclose(fits[0].model.vector(), fits[1].model.vector(), rtol=1e-8)


def test_evaluation_keeps_the_epoch_of_the_lowest_loss(spark):
    draw = np.random.default_rng(2)
    rows = [(f"2010-{1 + i % 12:02d}-01", f"d{i // 12}", float(v), float(w), float(1 + (v > 0) + 2 * (w > 0.5))) for i, (v, w) in enumerate(draw.normal(size=(360, 2)))]
    data = spark.createDataFrame(rows, "date string, district string, v double, w double, ipc double").withColumn("date", F.to_date("date"))
    result = ev.model_eval(data, ["v", "w"], "NN", epochs=40, rate=0.05)
    curve = result.losses.orderBy("epoch").collect()
    assert [r.epoch for r in curve] == list(range(41)) and curve[-1].train_loss < 0.7 * curve[0].train_loss
    test = stage(ev.network_parts(data, ["v", "w"], "ipc"), "network-test").where("role = 'test'")
    loss = mt.weighted_log_loss(F.col("label"), F.col("probability"), [1.0, 1.0, 2.0, 2.0, 2.0])
    again = nw.predict_network(result.final_model, test, ["v", "w"], ["date"]).agg(loss).first()[0]
    assert again == pytest.approx(min(r.test_loss for r in curve))
    assert result.metrics.first().accuracy > 0.6
