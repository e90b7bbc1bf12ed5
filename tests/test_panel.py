"""Panel operators against pandas, on panels with random gaps."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelforecast.operators import folds as fo
from panelforecast.operators import panel as pa

SCHEMA = "date date, district string, x double, y double, ipc double"


def random_panel(seed, months=14, districts=3, gap=0.1, missing=0.1):
    rng = np.random.default_rng(seed)
    rows = []
    for m in range(months):
        for d in range(districts):
            if rng.random() < gap:
                continue
            x, y = (None if rng.random() < missing else float(v) for v in rng.normal(size=2))
            label = None if m % 3 or rng.random() < missing / 3 else float(rng.integers(1, 6))
            rows.append((dt.date(2001 + m // 12, m % 12 + 1, 1), f"d{d}", x, y, label))
    return rows or [(dt.date(2001, 1, 1), "d0", 1.0, 1.0, 1.0)]


def to_pandas(rows):
    names = ["date", "district", "x", "y", "ipc"]
    return pd.DataFrame(rows, columns=names).set_index(["date", "district"]).astype(float)


def pandas_lag(frame, spec):
    """One feature worked out on the wide date x district table."""
    wide = frame[spec.column].unstack()
    if spec.rolling:
        wide = wide.rolling(spec.rolling).mean()
    if spec.difference:
        wide = wide.diff()
    if spec.dropna:
        wide = wide.dropna(how="any")
    return wide.shift(spec.lag).stack().reindex(frame.index)


SPECS = [
    pa.LagSpec("x", 3, rolling=3),
    pa.LagSpec("y", 1, rolling=2, difference=True),
    pa.LagSpec("x", 2),
    pa.LagSpec("ipc", 1, dropna=True),
    pa.LagSpec("ipc", 2, dropna=True),
    pa.LagSpec("y", 4, rolling=2, dropna=True),
]


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(seed=st.integers(0, 10_000), gap=st.sampled_from([0.0, 0.05, 0.2]))
def test_lag_features_equal_pandas(spark, seed, gap):
    rows = random_panel(seed, gap=gap)
    out = pa.lag_features(spark.createDataFrame(rows, SCHEMA), SPECS).toPandas()
    out = out.set_index(["date", "district"]).astype(float)
    frame = to_pandas(rows)
    assert len(out) == len(frame)
    for spec in SPECS:
        want = pandas_lag(frame, spec)
        np.testing.assert_allclose(out[spec.name].reindex(frame.index), want, atol=1e-9, err_msg=spec.name)


def test_a_district_without_labels_leaves_the_label_lag_empty(spark):
    rows = [(dt.date(2001, m, 1), d, 1.0, 1.0, 2.0 if d == "a" else None) for m in range(1, 7) for d in "ab"]
    out = pa.lag_features(spark.createDataFrame(rows, SCHEMA), [pa.LagSpec("ipc", 1, dropna=True)])
    assert out.where("ipc_lag_1 is not null").count() == 0 and out.count() == 12


def test_duplicate_key_is_an_error(spark):
    rows = [(dt.date(2001, m, 1), "a", 1.0, 1.0, 1.0) for m in (1, 2, 2, 3)]
    panel = spark.createDataFrame(rows, SCHEMA)
    with pytest.raises(PySparkException, match="duplicate"):
        pa.lag_features(panel, [pa.LagSpec("x", 1)]).collect()
    with pytest.raises(ValueError, match="duplicate"):
        pa.assert_unique_key(panel)


def test_dates_must_be_dates(spark):
    panel = spark.createDataFrame([("2001-01-01", "a", 1.0)], "date string, district string, x double")
    with pytest.raises(TypeError):
        pa.lag_features(panel, [pa.LagSpec("x", 1)])


def test_empty_panel(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert pa.lag_features(empty, SPECS).count() == 0
    assert pa.densify(empty).count() == 0
    assert pa.trim_to_first_label(empty, "ipc").count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_densify_equals_the_wide_table(spark, seed):
    rows = random_panel(seed, gap=0.3)
    out = pa.densify(spark.createDataFrame(rows, SCHEMA)).toPandas()
    wide = to_pandas(rows)["x"].unstack()
    assert len(out) == wide.size and int(out["present"].sum()) == len(rows)
    got = out.set_index(["date", "district"])["x"].unstack().reindex(index=wide.index, columns=wide.columns)
    np.testing.assert_allclose(got.astype(float), wide)


@pytest.mark.parametrize("seed", [4, 5, 6])
def test_interpolation_equals_pandas(spark, seed):
    rows = random_panel(seed, gap=0.1, missing=0.5)
    out = pa.interpolate_linear(spark.createDataFrame(rows, SCHEMA), ["x", "y"]).toPandas()
    out = out.set_index(["date", "district"]).sort_index()
    frame = to_pandas(rows).sort_index()
    for c in ("x", "y"):
        want = frame.groupby("district")[c].transform(lambda g: g.interpolate())
        np.testing.assert_allclose(out[c].astype(float), want, atol=1e-9)


def test_trim_is_row_granular(spark):
    rows = [
        (dt.date(2001, 1, 1), "a", 1.0, 1.0, None),
        (dt.date(2001, 2, 1), "a", 1.0, 1.0, None),
        (dt.date(2001, 2, 1), "b", 1.0, 1.0, 3.0),
        (dt.date(2001, 2, 1), "c", 1.0, 1.0, None),
        (dt.date(2001, 3, 1), "a", 1.0, 1.0, None),
    ]
    panel = spark.createDataFrame(rows, SCHEMA)
    kept = {(r.date, r.district) for r in pa.trim_to_first_label(panel, "ipc").collect()}
    assert kept == {(r[0], r[1]) for r in rows[2:]}
    unlabelled = panel.withColumn("ipc", F.lit(None).cast("double"))
    assert pa.trim_to_first_label(unlabelled, "ipc").count() == 5


def test_positions_when_one_date_holds_most_rows(spark):
    rows = [(dt.date(2001, 1, 1), f"d{i:05d}") for i in range(3000)] + [(dt.date(2001, m, 1), "d") for m in range(2, 10)]
    panel = spark.createDataFrame(rows, "date date, district string").repartition(7)
    got = {(r.date, r.district): r.position for r in pa.row_position(panel).collect()}
    assert got == {key: i for i, key in enumerate(sorted(rows))}


@pytest.mark.parametrize("n", [6, 17, 60])
def test_folds_follow_the_arithmetic(spark, n):
    rows = spark.range(n).select(F.col("id").alias("position"))
    got = {(r.fold, r.role, r.position) for r in fo.time_series_folds(rows).collect()}
    block = n // 6
    want = set()
    for fold in range(5):
        start = n - (5 - fold) * block
        want |= {(fold, "train", i) for i in range(start)} | {(fold, "test", i) for i in range(start, start + block)}
    assert got == want


def test_holdout_does_not_depend_on_partitioning(spark):
    rows = spark.range(5000).select(F.col("id").alias("k"))
    one = fo.holdout_split(rows.coalesce(1), ["k"])
    many = fo.holdout_split(rows.repartition(9), ["k"])
    assert one.exceptAll(many).count() == 0
    assert 0.17 < one.where("role = 'test'").count() / 5000 < 0.23


def test_column_coverage(spark):
    rows = [(0, "train", 1.0, None, 0.0), (0, "train", 2.0, None, 0.0), (0, "test", 1.0, 5.0, 1.0)]
    folds = spark.createDataFrame(rows, "fold int, role string, a double, b double, c double")
    got = {r.column: (r["values"], r.varies) for r in fo.column_coverage(folds, ["a", "b", "c"]).collect()}
    assert got == {"a": (2, True), "b": (0, False), "c": (2, False)}
    assert {r.column for r in fo.live_columns_per_fold(folds, ["a", "b", "c"]).collect()} == {"a", "c"}


def test_densify_refuses_duplicate_keys(spark):
    rows = [("2001-01-01", "a", 1.0), ("2001-01-01", "a", 2.0), ("2001-02-01", "b", 1.0)]
    df = spark.createDataFrame(rows, "date string, district string, x double").withColumn("date", F.to_date("date"))
    with pytest.raises(Exception, match="duplicate"):
        pa.densify(df).collect()
