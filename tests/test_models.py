"""Metrics, reports and models against numpy, and skill on a panel that has a signal."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforecast.functions import columns as fc
from panelforecast.operators import confidence as cf, metrics as mt, models as ml, regions as rg
from panelforecast.operators.panel import LagSpec, lag_features
from panelforecast.plans import evaluation as ev, reports
from panelforecast.sources.stages import stage


def numpy_f1(true, pred):
    score = 0.0
    for c in set(true) | set(pred):
        tp = np.sum((true == c) & (pred == c))
        total = np.sum(true == c) + np.sum(pred == c)
        score += np.sum(true == c) / len(true) * (2 * tp / total if total else 0.0)
    return score


def test_scores_equal_numpy(spark):
    rng = np.random.default_rng(5)
    true, pred = rng.integers(0, 4, 300), rng.integers(0, 5, 300)
    rows = [(int(i % 2), int(t), int(p)) for i, (t, p) in enumerate(zip(true, pred))] + [(0, None, 1)]
    df = spark.createDataFrame(rows, "fold int, label int, prediction int")
    assert mt.weighted_f1(df).first()[0] == pytest.approx(numpy_f1(true, pred))
    cells = {(r.label, r.prediction): r["rows"] for r in mt.confusion_matrix(df).collect()}
    assert len(cells) == 25 and sum(cells.values()) == 300 and cells[(4, 0)] == 0
    assert cells[(1, 2)] == int(np.sum((true == 1) & (pred == 2)))
    folds = {r.fold: r for r in mt.fold_metrics(df.withColumn("prediction", F.col("prediction").cast("double"))).collect()}
    for f in (0, 1):
        part = np.arange(300) % 2 == f
        assert folds[f].accuracy == pytest.approx(np.mean(true[part] == pred[part]))
        assert folds[f].mae == pytest.approx(np.mean(np.abs(true[part] - pred[part])))
        assert folds[f].weighted_f1 == pytest.approx(numpy_f1(true[part], pred[part]))


def test_rows_without_prediction_are_counted(spark):
    df = spark.createDataFrame([(0, 1.0, None), (0, 2.0, 2.4), (0, None, 1.0)], "fold int, label double, prediction double")
    row = mt.fold_metrics(df, rounded_mae=False).first()
    assert (row.n_scored, row.n_unscored, row.accuracy) == (1, 1, 1.0) and row.mae == pytest.approx(0.4)


def test_rounding(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,)], "x double")
    assert [r[0] for r in df.select(fc.round_half_even(F.col("x"))).collect()] == [0.0, 2.0, 2.0, -0.0]
    assert df.select(fc.round_to(F.lit(0.575), 2)).first()[0] == float(np.round(0.575, 2))
    assert [r[0] for r in spark.createDataFrame([(1.9,), (5.0,)], "y double").select(fc.zero_based_class(F.col("y"))).collect()] == [0, 4]


def test_log_loss_equals_numpy(spark):
    rows = [(0, [0.7, 0.1, 0.1, 0.05, 0.05]), (2, [0.2, 0.2, 0.4, 0.1, 0.1]), (4, [0.1, 0.1, 0.1, 0.1, 0.6])]
    df = spark.createDataFrame(rows, "label int, probability array<double>")
    got = df.agg(mt.weighted_log_loss(F.col("label"), F.col("probability"), ml.CLASS_WEIGHTS)).first()[0]
    assert got == pytest.approx((-np.log(0.7) - 2 * np.log(0.4) - 2 * np.log(0.6)) / 5)


def test_confidence_tables(spark):
    rows = [(1, 1, 0.9), (1, 2, 0.85), (2, 2, 0.3), (0, 0, 1.0), (0, 0, 0.0), (3, 3, 0.31)]
    df = spark.createDataFrame(rows, "true_val int, pred_val int, pred_prob double")
    ranges = {(r.low, r.high): (r["rows"], r.accuracy) for r in cf.accuracy_by_confidence(df).collect()}
    # 0.9 and 0.3 count in both neighbouring ranges; 0 and 1 in none
    assert ranges[(0.9, 1.0)] == (1, 1.0) and ranges[(0.8, 0.9)] == (2, 0.5)
    assert ranges[(0.3, 0.4)] == (2, 1.0) and ranges[(0.0, 0.3)] == (1, 1.0) and ranges[(0.5, 0.6)] == (0, 0.0)
    bins = [r["rows"] for r in cf.confidence_histogram(df).orderBy("bin").collect()]
    assert bins == np.histogram([0.9, 0.85, 0.3, 0.31], bins=[i / 10 for i in range(11)])[0].tolist()


def test_kde_equals_numpy(spark):
    values = np.random.default_rng(2).beta(4, 2, 200)
    df = spark.createDataFrame([(0, 0, float(v)) for v in values], "true_val int, pred_val int, pred_prob double")
    got = cf.confidence_kde(df, points=50).orderBy("point").toPandas()
    h = len(values) ** -0.2 * values.std(ddof=1)
    x = np.linspace(values.min(), values.max(), 50)
    want = np.exp(-0.5 * ((x[:, None] - values) / h) ** 2).sum(axis=1) / (len(values) * h * np.sqrt(2 * np.pi))
    np.testing.assert_allclose(got["x"], x)
    np.testing.assert_allclose(got["density"], want)
    parts = {r.part: r["count"] for r in reports.confidence_report(df, points=50).groupBy("part").count().collect()}
    assert parts == {"histogram": 10, "density": 50, "accuracy": 8}


@pytest.mark.parametrize("spread", [0.2, 1e-3, 3e-6])
def test_density_is_that_of_all_kernels_however_narrow(spark, spread):
    """From bandwidths of many cells to some that need finer cells than the given grid."""
    rng = np.random.default_rng(7)
    values = np.clip(np.concatenate([rng.normal(0.4, spread, 700), rng.normal(0.4 + 9 * spread, spread / 3, 300)]), 1e-9, 1 - 1e-9)
    df = spark.createDataFrame([(0, 0, float(v)) for v in values], "true_val int, pred_val int, pred_prob double").repartition(3)
    got = cf.confidence_kde(df, points=80).orderBy("point").toPandas()
    h = len(values) ** -0.2 * values.std(ddof=1)
    x = np.linspace(values.min(), values.max(), 80)
    want = np.exp(-0.5 * ((x[:, None] - values) / h) ** 2).sum(axis=1) / (len(values) * h * np.sqrt(2 * np.pi))
    np.testing.assert_allclose(got["x"], x)
    np.testing.assert_allclose(got["density"], want, rtol=0, atol=2e-9 / (h * np.sqrt(2 * np.pi)))


def test_density_of_equal_few_or_no_values(spark):
    schema = "true_val int, pred_val int, pred_prob double"
    assert cf.confidence_kde(spark.createDataFrame([], schema)).collect() == []
    for rows in ([(0, 0, 0.5)], [(0, 0, 0.5)] * 4, [(0, 0, 0.5), (1, 0, None), (1, 1, 1.0)]):
        got = cf.confidence_kde(spark.createDataFrame(rows, schema), points=3).collect()
        assert [(r.point, r.x, r.density) for r in sorted(got)] == [(i, 0.5, None) for i in range(3)]


def test_long_tail_is_strictly_below_the_threshold(spark):
    counts = spark.createDataFrame([("a", 500), ("b", 477), ("c", 23), ("d", 22), ("e", 1)], "district string, count long")
    top = rg.top_regions(counts, 4)
    got = {r.district: r["count"] for r in rg.fold_long_tail(top, percent=100 * 23 / 1022).collect()}
    assert got["a"] == 500 and got["c"] == 23 and got["Other regions"] == 22 and "e" not in got
    shares = rg.share_of_total(top).agg(F.sum("share_pct")).first()[0]
    assert shares == pytest.approx(100.0)


def linear_data(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1, 5, 0.2]
    y = 2.0 + x @ [0.5, -0.1, 3.0] + rng.normal(size=n) * 0.3
    rows = [(f"2001-{i % 12 + 1:02d}-01", f"d{i:04d}", *map(float, x[i]), float(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "date string, district string, a double, b double, c double, ipc double")
    return df.withColumn("date", F.to_date("date")), x, y


def test_ols_and_ridge_equal_closed_form(spark):
    df, x, y = linear_data(spark)
    df = df.union(df.limit(1).withColumn("a", F.lit(None).cast("double")))  # incomplete rows are left out
    ones = np.column_stack([np.ones(len(y)), x])
    beta = np.linalg.lstsq(ones, y, rcond=None)[0]
    model = ml.fit_ols(df, ["a", "b", "c"])
    np.testing.assert_allclose([model.intercept, *model.coefficients], beta, rtol=1e-8)
    centred, yc = x - x.mean(axis=0), y - y.mean()
    ridge = np.linalg.solve(centred.T @ centred + 3 * np.eye(3), centred.T @ yc)
    model = ml.fit_ridge(df, ["a", "b", "c"])
    np.testing.assert_allclose(model.coefficients, ridge, rtol=1e-8)


def test_ols_summary_equals_numpy(spark):
    df, x, y = linear_data(spark)
    table, fit = ml.ols_summary(df, ["a", "b", "c"])
    ones = np.column_stack([np.ones(len(y)), x])
    beta = np.linalg.lstsq(ones, y, rcond=None)[0]
    order = sorted(range(len(y)), key=lambda i: (i % 12, f"{i:04d}"))
    e = (y - ones @ beta)[order]
    n, k = ones.shape
    got = fit.first()
    assert got.durbin_watson == pytest.approx(np.sum(np.diff(e) ** 2) / np.sum(e**2))
    assert got.r2 == pytest.approx(1 - e @ e / np.sum((y - y.mean()) ** 2))
    loglik = -n / 2 * (np.log(2 * np.pi) + np.log(e @ e / n) + 1)
    assert got.aic == pytest.approx(-2 * loglik + 2 * k) and got.bic == pytest.approx(-2 * loglik + np.log(n) * k)
    z = (e - e.mean()) / e.std()
    assert got.jarque_bera == pytest.approx(n / 6 * (np.mean(z**3) ** 2 + (np.mean(z**4) - 3) ** 2 / 4))
    se = np.sqrt(np.diag(np.linalg.inv(ones.T @ ones)) * (e @ e) / (n - k))
    assert got.condition_number == pytest.approx(np.linalg.cond(ones))
    assert got.f_prob < 1e-12 and got.jarque_bera_prob == pytest.approx(np.exp(-got.jarque_bera / 2))
    rows = {r.term: r for r in table.collect()}
    assert (rows["b"].high - rows["b"].low) / 2 / rows["b"].std_err == pytest.approx(1.965973, abs=1e-5)  # t, 396 degrees
    assert rows["const"].std_err == pytest.approx(se[0]) and rows["b"].std_err == pytest.approx(se[2])


def test_tails_equal_sums_of_densities():
    from panelforecast.functions.distributions import f_tail, t_quantile

    assert t_quantile(0.95, 10) == pytest.approx(2.2281388, abs=1e-6) and t_quantile(0.95, 1) == pytest.approx(12.7062047, abs=1e-5)
    for d1, d2, at in ((2, 10, 4.0), (3, 7, 0.5), (1, 30, 4.17)):
        x = np.linspace(at, 4000, 4_000_001)
        density = x ** (d1 / 2 - 1) * (1 + d1 * x / d2) ** (-(d1 + d2) / 2)
        whole = np.linspace(1e-9, 1, 2_000_001) ** 4 * 4000  # finer near zero
        all_density = whole ** (d1 / 2 - 1) * (1 + d1 * whole / d2) ** (-(d1 + d2) / 2)
        assert f_tail(at, d1, d2) == pytest.approx(np.trapezoid(density, x) / np.trapezoid(all_density, whole), rel=1e-3)


def test_missing_feature_gives_missing_prediction(spark):
    df, _, _ = linear_data(spark)
    model = ml.fit_ols(df, ["a", "b"])
    holes = df.limit(3).withColumn("a", F.lit(None).cast("double"))
    assert holes.select(ml.linear_prediction(model, ["a", "b"]).alias("p")).where("p is not null").count() == 0


def test_scaling_uses_the_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 3.0), (4.0, 3.0)], "a double, k double")
    got = ml.standard_scale(df, ml.scaling(df, ["a", "k"])).toPandas()
    a = np.array([1.0, 2.0, 4.0])
    np.testing.assert_allclose(got["a"], (a - a.mean()) / a.std())
    assert (got["k"] == 0).all()


def test_intercept_is_skipped_beside_a_constant(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 3.0)], "a double, k double")
    assert "const" not in ml.add_intercept(df, ["a", "k"], skip_if_constant=True).columns
    assert "const" in ml.add_intercept(df, ["a"], skip_if_constant=True).columns


@pytest.fixture(scope="module")
def signal(spark):
    """Monthly panel whose score follows a seasonal covariate; labels every other month."""
    months, districts = 60, 8
    base = spark.range(months * districts).select((F.col("id") % months).alias("m"), F.floor(F.col("id") / months).alias("d"))
    x = F.sin(F.col("m") / 3.0 + F.col("d"))
    noise = (F.xxhash64("m", "d") % 1000) / 4000.0
    level = F.greatest(F.lit(0.0), F.least(F.lit(4.99), 2.5 + 2 * x + noise))
    panel = base.select(
        F.add_months(F.lit("2010-01-01").cast("date"), F.col("m").cast("int")).alias("date"),
        F.concat(F.lit("d"), "d").alias("district"),
        x.alias("x"),
        F.when(F.col("m") % 2 == 0, 1.0 + F.floor(level)).alias("ipc"),
    )
    data = lag_features(panel.withColumn("now", F.col("x")), [LagSpec("ipc", 1, dropna=True), LagSpec("x", 1)])
    return stage(data, "signal"), ["now", "x_lag_1", "ipc_lag_1"]


def majority(df):
    counts = df.where("ipc is not null").groupBy("ipc").count()
    return counts.agg(F.max("count") / F.sum("count")).first()[0]


@pytest.mark.parametrize("model_type", ["OLS", "Ridge"])
def test_linear_evaluation(spark, signal, model_type):
    data, features = signal
    result = ev.model_eval(data, features, model_type)
    rows = result.metrics.collect()
    assert len(rows) == 5 and len(result.models) == 5 and result.final_model is result.models[-1]
    means = result.means().first()
    assert means.mean_accuracy > majority(data) and means.mean_r2 > 0.5
    assert result.confusion().agg(F.sum("rows")).first()[0] == sum(r.n_scored for r in rows)
    assert [r.fold for r in sorted(rows, key=lambda r: r.fold)] == [0, 1, 2, 3, 4]


def test_tree_evaluation(spark, signal):
    data, features = signal
    result = ev.model_eval(data.dropna(subset=["ipc_lag_1"]), features, "XGboost", splits=2, maxIter=15, stepSize=0.2)
    assert result.metrics.count() == 2
    assert result.means().first().mean_accuracy > majority(data)


def test_trees_take_missing_features(spark, signal):
    data, features = signal
    holes = data.withColumn("now", F.when(F.month("date") != 2, F.col("now")))
    model, _ = ml.fit_trees(holes, features, maxIter=2)
    out = ml.predict_trees(model, holes, features, ["date", "district"])
    assert out.count() == holes.count() and out.where("prediction is null").count() == 0


def test_network_evaluation(spark, signal):
    data, features = signal
    result = ev.model_eval(data, features, "NN", iterations=(5, 60))
    losses = {r.max_iter: r.test_loss for r in result.losses.collect()}
    assert losses[60] < losses[5]
    assert result.metrics.first().accuracy > majority(data)
    best = result.predictions.select(F.array_max("probability").alias("p")).agg(F.min("p"), F.max("p")).first()
    assert 0.2 <= best[0] <= best[1] <= 1.0


def test_confusion_counts_every_scored_row(spark):
    rows = [(1.0, 1.0), (2.0, 0.0), (5.0, 6.0), (3.0, -1.0), (7.0, 1.0), (None, 2.0), (2.0, None)]
    df = spark.createDataFrame(rows, "label double, prediction double")
    cells = {(r.label, r.prediction): r["rows"] for r in mt.confusion_matrix(df, (1, 2, 3, 4, 5)).collect()}
    assert sum(cells.values()) == 5 and cells[(2, 0)] == cells[(5, 6)] == cells[(3, -1)] == cells[(7, 1)] == 1
    assert len(cells) == 9 * 9 and cells[(4, 4)] == 0
    assert mt.confusion_matrix(df.limit(0), (0, 1)).count() == 4


def test_network_confusion_counts_from_zero(spark):
    rows = [(0, 0), (0, 1), (4, 4), (2, 2)]
    result = ev.Evaluation(None, spark.createDataFrame(rows, "label int, prediction int"), classes=ev.NETWORK_CLASSES)
    cells = {(r.label, r.prediction): r["rows"] for r in result.confusion().collect()}
    assert len(cells) == 25 and sum(cells.values()) == 4 and cells[(0, 0)] == cells[(0, 1)] == 1


def test_no_fold_is_lost(spark, signal):
    data, _ = signal
    late = data.withColumn("only_late", F.when(F.col("date") >= "2013-01-01", F.col("now"))).select("date", "district", "only_late", "ipc")
    late = late.withColumn("ipc", F.when(F.col("date") >= "2011-06-01", F.col("ipc")))
    for kind, settings in (("OLS", {}), ("Ridge", {}), ("XGboost", {"maxIter": 2})):
        result = ev.model_eval(late, ["only_late"], kind, **settings)
        folds = {r.fold: r for r in result.metrics.collect()}
        assert sorted(folds) == [0, 1, 2, 3, 4] and len(result.models) == 5
        assert folds[0].n_scored == 0 and folds[0].n_unscored > 0
        assert all(folds[f].n_scored > 0 for f in (2, 3, 4))
        assert result.predictions.groupBy("fold").count().count() == 5


def test_class_weights_are_kept_in_proportion(spark):
    assert ml.whole_repeats([1.0, 1.0, 2.0, 2.0, 2.0]) == [1, 1, 2, 2, 2]
    assert ml.whole_repeats([0.5, 1.5, 2.5]) == [1, 3, 5] and ml.whole_repeats([2, 4, 0]) == [1, 2, 0]
    for bad in ([-1, 1], [0, 0], [1, 3.14159265], [1, 1000]):
        with pytest.raises(ValueError):
            ml.whole_repeats(bad)
    df = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "label int, x string")
    got = {r.x: r["count"] for r in ml.repeat_by_class_weight(df, "label", [0.5, 0, 2.5]).groupBy("x").count().collect()}
    assert got == {"a": 1, "c": 5}


def test_loss_curve_goes_on_from_step_to_step(spark, signal):
    data, features = signal
    rows = stage(ev.network_parts(data, features, "ipc"), "curve-rows")
    train, test = rows.where("role = 'train'"), rows.where("role = 'test'")
    choice = ml.select_by_holdout_loss(train, test, features, iterations=(2, 5, 10, 30))
    curve = choice.losses.orderBy("max_iter").collect()
    assert [r.max_iter for r in curve] == [2, 5, 10, 30]
    losses = [r.train_loss for r in curve]
    assert all(b <= a + 1e-9 for a, b in zip(losses, losses[1:])) and losses[-1] < losses[0]
    best = min(curve, key=lambda r: r.test_loss)
    assert choice.best["max_iter"] == best.max_iter
    loss = mt.weighted_log_loss(F.col("label"), F.col("probability"), ml.CLASS_WEIGHTS)
    assert ml.predict_classes(choice.model, test, []).agg(loss).first()[0] == pytest.approx(best.test_loss)


def test_unknown_model(signal):
    with pytest.raises(ValueError):
        ev.model_eval(*signal, "SVM")
