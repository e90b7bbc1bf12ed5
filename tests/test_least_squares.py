"""Least squares of any rank against numpy's pseudo-inverse, and all folds from one pass against a fit per fold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforecast.operators import folds as fd, models as ml
from panelforecast.operators.least_squares import LinearFit
from panelforecast.operators.panel import interpolate_linear, row_position
from panelforecast.plans import evaluation as ev
from panelforecast.sources.stages import stage, stage_path
from panelforecast.sources.tables import load_model, save_model


def frame(spark, x, y):
    names = [f"x{i}" for i in range(x.shape[1])]
    rows = [(f"2001-{i % 12 + 1:02d}-01", f"d{i:04d}", *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))]
    schema = "date string, district string, " + ", ".join(f"{c} double" for c in names) + ", ipc double"
    return spark.createDataFrame(rows, schema).withColumn("date", F.to_date("date")), names


def designs():
    rng = np.random.default_rng(4)
    a, c = rng.normal(size=200) * 3 + 5, rng.normal(size=200) * 0.01
    big = rng.normal(size=200) * 1e4 + 1e5
    return {
        "full rank": np.column_stack([a, c, a * c]),
        "doubled": np.column_stack([a, 2 * a, c]),
        "constant": np.column_stack([a, np.full(200, 7.1), c]),
        "sum": np.column_stack([a, c, a + c]),
        "twice collinear": np.column_stack([a, -a, 3 * a, c, 5 * c]),
        "other units": np.column_stack([a, big, 1e-4 * big]),
        "all constant": np.full((200, 2), 3.0),
        "a column of zeros": np.column_stack([a, 0 * a]),
    }


@pytest.mark.parametrize("name", list(designs()))
def test_fit_of_any_rank_equals_the_pseudo_inverse(spark, name):
    x = designs()[name]
    rng = np.random.default_rng(9)
    y = 2.0 + x @ rng.normal(size=x.shape[1]) / np.maximum(x.std(axis=0).max(), 1) + rng.normal(size=len(x))
    df, names = frame(spark, x, y)
    design = np.column_stack([np.ones(len(x)), x])
    back = np.linalg.pinv(design, rcond=1e-11)
    beta, rank = back @ y, np.linalg.matrix_rank(design, tol=1e-9 * np.linalg.norm(design, 2))
    errors = y - design @ beta
    model = ml.fit_ols(df, names)
    np.testing.assert_allclose([model.intercept, *model.coefficients], beta, rtol=1e-7, atol=1e-9)
    assert (model.rank, model.df_resid, model.df_model, model.rows) == (rank, 200 - rank, rank - 1, 200)
    assert model.squared_errors == pytest.approx(errors @ errors, rel=1e-8)
    se = np.sqrt(np.diag(back @ back.T) * (errors @ errors) / (200 - rank))
    table = {r.term: r for r in ml.ols_coefficients(model, names, spark).collect()}
    np.testing.assert_allclose([table[c].std_err for c in ("const", *names)], se, rtol=1e-6, atol=1e-12)
    assert np.isinf(model.condition) == (rank < design.shape[1])


def test_summary_of_collinear_columns(spark):
    x = designs()["doubled"]
    y = 1 + x[:, 0] + np.random.default_rng(1).normal(size=200)
    df, names = frame(spark, x, y)
    table, fit = ml.ols_summary(df, names)
    alone, plain = ml.ols_summary(df, ["x0", "x2"])
    got, want = fit.first(), plain.first()
    assert (got.df_resid, got.df_model) == (197, 2) == (want.df_resid, want.df_model)
    for c in ("r2", "r2_adj", "f_statistic", "aic", "bic", "durbin_watson", "f_prob", "omnibus"):
        assert got[c] == pytest.approx(want[c], rel=1e-6, abs=1e-12)
    slopes = {r.term: r for r in table.collect()}
    whole = {r.term: r for r in alone.collect()}
    assert slopes["x0"].coef + 2 * slopes["x1"].coef == pytest.approx(whole["x0"].coef) and slopes["x1"].coef == pytest.approx(2 * slopes["x0"].coef)
    assert slopes["x0"].t == pytest.approx(whole["x0"].t) and slopes["x0"].p < 1e-10


def test_fits_of_few_or_no_rows(spark):
    df, names = frame(spark, np.array([[1.0, 2.0], [2.0, 5.0]]), np.array([1.0, 3.0]))
    exact = ml.fit_ols(df, names)
    assert (exact.rank, exact.df_resid) == (2, 0) and exact.r2 == pytest.approx(1.0)
    guess = df.select(ml.linear_prediction(exact, names).alias("p"), "ipc").collect()
    assert all(r.p == pytest.approx(r.ipc) for r in guess)
    assert {r.std_err for r in ml.ols_coefficients(exact, names, spark).collect()} == {None}
    none = ml.fit_ols(df.limit(0), names)
    assert none.rows == 0 and none.r2 is None and df.select(ml.linear_prediction(none, names).alias("p")).first().p is None
    table, fit = ml.ols_summary(df.limit(0), names)
    assert fit.first().n_obs == 0 and table.count() == 3
    assert ml.ols_summary(df, names)[1].first().omnibus is None


def test_ridge_with_collinear_columns_is_unique(spark):
    x = designs()["doubled"]
    y = x[:, 0] + np.random.default_rng(2).normal(size=200)
    df, names = frame(spark, x, y)
    centred = x - x.mean(axis=0)
    want = np.linalg.solve(centred.T @ centred + 3 * np.eye(3), centred.T @ (y - y.mean()))
    model = ml.fit_ridge(df, names)
    np.testing.assert_allclose(model.coefficients, want, rtol=1e-8)
    assert model.intercept == pytest.approx(y.mean() - x.mean(axis=0) @ want)


def test_fit_is_saved_and_loaded(spark):
    df, names = frame(spark, designs()["full rank"], np.random.default_rng(3).normal(size=200))
    model, path = ml.fit_ols(df, names), stage_path(spark, "fit")
    save_model(model, path)
    again = load_model(path, LinearFit)
    assert again.coefficients == model.coefficients and again.r2 == model.r2 and again.df_resid == model.df_resid
    np.testing.assert_array_equal(again.covariance, model.covariance)


def test_normality_scores_equal_published_ones(spark):
    def scores(values):
        df = spark.createDataFrame([(float(v),) for v in values], "e double")
        n, skew, kurt = F.lit(float(len(values))), F.skewness("e"), F.kurtosis("e") + 3
        return df.agg(ml.skew_score(n, skew), ml.kurtosis_score(n, kurt)).first()

    # from the documentation of a statistics package
    assert scores([2, 8, 0, 4, 1, 9, 9, 0])[0] == pytest.approx(0.44626385374196975)
    assert scores([1, 2, 3, 4, 5, 6, 7, 8000])[0] == pytest.approx(3.571773510360407)
    assert scores(range(20))[1] == pytest.approx(-1.7058104152122062)


@pytest.fixture(scope="module")
def gappy(spark):
    """A panel with gaps everywhere, a column that is empty at first, one that is constant at first, and a collinear one."""
    rng = np.random.default_rng(12)
    rows = []
    for d in range(9):
        for m in range(40):
            a, b = rng.normal(), rng.normal() * 50 + 1000
            late = float(rng.normal()) if m > 17 else None
            flat = 2.0 if m < 12 else float(rng.normal())
            gap = lambda v, p: None if rng.random() < p else float(v)
            rows.append((f"{2001 + m // 12}-{m % 12 + 1:02d}-01", f"d{d}", gap(a, 0.3), gap(b, 0.1), late, flat, gap(3 + a + b / 100, 0.6 if d else 1.0)))
    frame = spark.createDataFrame(rows, "date string, district string, a double, b double, late double, flat double, ipc double")
    frame = frame.withColumns({"date": F.to_date("date"), "twice": 2 * F.col("b")})
    return stage(frame.where(~((F.col("district") == "d3") & (F.month("date") % 4 == 1))), "gappy"), ["a", "b", "late", "flat", "twice"]


def by_fold(data, features, splits=5):
    """Each fold's filled training rows and its test rows, the plain way."""
    rows = stage(row_position(data, ["date", "district"]), "plain-positions")
    for fold, start in enumerate(fd.block_starts(rows.count(), splits)):
        train = interpolate_linear(rows.where(F.col("position") < start), [*features, "ipc"], ["district"])
        yield fold, start, rows.where(F.col("position") < start), train


@pytest.mark.parametrize("splits", [5, 2])
def test_versions_are_the_rows_that_every_fold_would_fill(spark, gappy, splits):
    data, features = gappy
    columns = [*features, "ipc"]
    rows, starts = ev._positioned(data, features, "ipc", splits)
    versions = stage(fd.interpolated_versions(rows, columns, splits), "versions")
    assert versions.count() < rows.count() * 1.6
    key = lambda r: tuple((x is not None, round(x, 9) if x is not None else 0) for x in r)
    for fold, start, _, train in by_fold(data, features, splits):
        got = versions.where(f"since <= {fold} and {fold} < until").select(*columns).collect()
        assert sorted(map(key, got)) == sorted(map(key, train.select(*columns).collect()))


@pytest.mark.parametrize("kind, alpha", [("OLS", 0.0), ("Ridge", 3.0)])
def test_all_folds_from_one_pass_equal_a_fit_per_fold(spark, gappy, kind, alpha):
    data, features = gappy
    result = ev.model_eval(data, features, kind)
    metrics = {r.fold: r for r in result.metrics.collect()}
    guesses = {(r.fold, r.date, r.district): r.prediction for r in result.predictions.collect()}
    for fold, start, raw, train in by_fold(data, features):
        varies = raw.agg(*[(F.min(c) < F.max(c)).alias(c) for c in features]).first()
        used = [c for c in features if varies[c]]
        rows = train.dropna(subset=[*used, "ipc"]).toPandas()
        x, y = rows[used].to_numpy(), rows["ipc"].to_numpy()
        centred = x - x.mean(axis=0)
        if alpha:
            b = np.linalg.solve(centred.T @ centred + alpha * np.eye(len(used)), centred.T @ (y - y.mean()))
            line = np.array([y.mean() - x.mean(axis=0) @ b, *b])
        else:
            line = np.linalg.pinv(np.column_stack([np.ones(len(x)), x]), rcond=1e-11) @ y
        assert result.features[fold] == used
        np.testing.assert_allclose([result.models[fold].intercept, *result.models[fold].coefficients], line, rtol=1e-6, atol=1e-8)
        error = y - line[0] - x @ line[1:]
        assert metrics[fold].n_train == len(rows) and metrics[fold].r2 == pytest.approx(1 - error @ error / ((y - y.mean()) ** 2).sum())
    plain = row_position(data, ["date", "district"]).toPandas().sort_values("position")
    for r in plain[plain.position >= start].itertuples():
        want = line[0] + sum(getattr(r, c) * b for c, b in zip(used, line[1:]))
        got = guesses[4, r.date, r.district]
        assert (got is None) == bool(np.isnan(want)) and (got is None or got == pytest.approx(want, rel=1e-6))


def test_positions_are_scanned_once_for_all_fits(spark, gappy, monkeypatch):
    """The fits ask the cluster for two aggregates over the positions, not for one per fold."""
    data, features = gappy
    calls = []
    collect = type(data).collect
    monkeypatch.setattr(type(data), "collect", lambda self: calls.append(self) or collect(self))
    ev.model_eval(data, features, "Ridge")
    assert len(calls) == 2
