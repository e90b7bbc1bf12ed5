"""Model steps and whole datasets over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforecast.functions import columns as fc
from panelforecast.operators import metrics as mt
from panelforecast.operators import models as ml
from panelforecast.operators import network as nw
from panelforecast.operators.least_squares import LinearFit
from panelforecast.operators.panel import LagSpec, lag_features
from panelforecast.plans import datasets as ds
from panelforecast.plans import evaluation as ev
from panelforecast.queries.adapters import ARTICLES, FINE_PANEL, NEWS, PANEL, TAG_WORDS, load, with_cte
from panelforecast.queries.registry import r6, registry
from panelforecast.queries.panel_queries import COMPLETE, _kept_lag, _rolled
from panelforecast.queries.text_queries import MATCHED, SERIES, TAGGED, TOP_N
from panelforecast.sources.stages import stage, stage_path
from panelforecast.sources.tables import load_model, save_model

QUERIES, ORACLES, query = registry()



# the labelled rows of the supplier panel, with two features, so that fits have a closed form
PAIR = """SELECT date, district, ipc, count_violence AS x1, ndvi_anom / 10.0E0 AS x2 FROM ({panel}) AS p
          WHERE ipc IS NOT NULL""".replace("{panel}", FINE_PANEL)


def _pair(spark, sf):
    return stage(load(spark, sf, PAIR), "pair")


def _two_feature_fit(penalty: float) -> str:
    return f""", m AS (SELECT avg(x1) AS m1, avg(x2) AS m2, avg(ipc) AS my FROM d),
      c AS (SELECT sum((x1 - m1) * (x1 - m1)) + {penalty} AS s11, sum((x2 - m2) * (x2 - m2)) + {penalty} AS s22,
                   sum((x1 - m1) * (x2 - m2)) AS s12, sum((x1 - m1) * (ipc - my)) AS s1y, sum((x2 - m2) * (ipc - my)) AS s2y FROM d, m),
      b AS (SELECT (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM c)
      SELECT date, district, round(my + b1 * (x1 - m1) + b2 * (x2 - m2), 6) AS prediction FROM d, m, b"""


def _fitted(rows, model):
    guess = ml.linear_prediction(model, ["x1", "x2"])
    return rows.select("date", "district", r6(guess).alias("prediction"))


@query("ols_fit", with_cte(_two_feature_fit(0.0), d=PAIR))
def ols_fit(spark, sf):
    rows = _pair(spark, sf)
    return _fitted(rows, ml.fit_ols(rows, ["x1", "x2"]))


@query("ridge_fit", with_cte(_two_feature_fit(ml.RIDGE_ALPHA), d=PAIR))
def ridge_fit(spark, sf):
    rows = _pair(spark, sf)
    return _fitted(rows, ml.fit_ridge(rows, ["x1", "x2"]))


# omnibus test: normal scores of skewness and kurtosis
OMNIBUS = """
  o1 AS (SELECT *, sk * sqrt((x + 1) * (x + 3) / (6 * (x - 2))) AS y,
                3 * (x * x + 27 * x - 70) * (x + 1) * (x + 3) / ((x - 2) * (x + 5) * (x + 7) * (x + 9)) AS b2,
                (ku - 3 * (x - 1) / (x + 1)) / sqrt(24 * x * (x - 2) * (x - 3) / ((x + 1) * (x + 1) * (x + 3) * (x + 5))) AS z,
                6 * (x * x - 5 * x + 2) / ((x + 7) * (x + 9)) * sqrt(6 * (x + 3) * (x + 5) / (x * (x - 2) * (x - 3))) AS g
         FROM (SELECT *, CAST(n AS DOUBLE) AS x FROM s) AS u),
  o2 AS (SELECT *, sqrt(2 * (b2 - 1)) - 1 AS w2, 6 + 8 / g * (2 / g + sqrt(1 + 4 / (g * g))) AS a FROM o1),
  o3 AS (SELECT asinh(y / sqrt(2 / (w2 - 1))) / sqrt(ln(w2) / 2) AS zs,
                (1 - 2 / (9 * a) - sign((1 - 2 / a) / (1 + z * sqrt(2 / (a - 4)))) * pow(abs((1 - 2 / a) / (1 + z * sqrt(2 / (a - 4)))), 1.0E0 / 3))
                / sqrt(2 / (9 * a)) AS zk FROM o2),
  o AS (SELECT zs * zs + zk * zk AS omnibus FROM o3)"""

FIT_STATISTICS = _two_feature_fit(0.0).rsplit("SELECT date", 1)[0].rstrip() + """,
  r AS (SELECT ipc AS y, ipc - (my + b1 * (x1 - m1) + b2 * (x2 - m2)) AS e, row_number() OVER (ORDER BY date, district) AS i FROM d, m, b),
  s AS (SELECT count(*) AS n, sum(e * e) AS ssr, var_pop(y) AS v, avg(e * e * e) / pow(avg(e * e), 1.5E0) AS sk,
               avg(e * e * e * e) / pow(avg(e * e), 2) AS ku FROM r),
  w AS (SELECT sum(pow(e - p, 2)) AS steps FROM (SELECT e, lag(e) OVER (ORDER BY i) AS p FROM r) AS x),
  f AS (SELECT *, 1 - ssr / (v * n) AS r2, -n / 2.0E0 * (ln(2 * pi()) + ln(ssr / n) + 1) AS ll FROM s),""" + OMNIBUS + """,
  stats AS (
  SELECT n AS n_obs, round(r2, 6) AS r2, round(1 - (1 - r2) * (n - 1) / (n - 3), 6) AS r2_adj,
         round(r2 / 2 / ((1 - r2) / (n - 3)), 6) AS f_statistic, round(ll, 6) AS log_likelihood, round(-2 * ll + 6, 6) AS aic,
         round(-2 * ll + 3 * ln(n), 6) AS bic, round(sk, 6) AS skew, round(ku, 6) AS kurtosis,
         round(n / 6.0E0 * (sk * sk + pow(ku - 3, 2) / 4), 6) AS jarque_bera, round(steps / ssr, 6) AS durbin_watson,
         round(exp(-n / 12.0E0 * (sk * sk + pow(ku - 3, 2) / 4)), 6) AS jarque_bera_prob,
         round(omnibus, 6) AS omnibus, round(exp(-omnibus / 2), 6) AS omnibus_prob
  FROM f, w, o)"""


@query("ols_fit_statistics", with_cte(FIT_STATISTICS + " SELECT * FROM stats", d=PAIR))
def ols_fit_statistics(spark, sf):
    _, fit = ml.ols_summary(_pair(spark, sf), ["x1", "x2"])
    return fit.select("n_obs", *[r6(c).alias(c) for c in fit.columns if c not in ("n_obs", "df_resid", "df_model", "condition_number", "f_prob")])


@query(
    "standard_scale",
    with_cte(
        """, m AS (SELECT avg(x1) AS a1, stddev_pop(x1) AS s1, avg(x2) AS a2, stddev_pop(x2) AS s2 FROM d)
           SELECT date, district, round((x1 - a1) / s1, 6) AS x1, round((x2 - a2) / s2, 6) AS x2, CAST(0 AS DOUBLE) AS const FROM d, m""",
        d=PAIR,
    ),
)
def standard_scale(spark, sf):
    rows = _pair(spark, sf).withColumn("const", F.lit(1.0))
    out = ml.standard_scale(rows, ml.scaling(rows, ["x1", "x2", "const"]))
    return out.select("date", "district", r6("x1").alias("x1"), r6("x2").alias("x2"), "const")


SMALL = ["count_violence", "ndvi_anom", "food_price_idx"]


def _labelled_panel(spark, sf):
    """The supplier panel with lagged features, the shape every model is evaluated on; it grows with the facts."""
    specs = [LagSpec(c, 3, rolling=6) for c in SMALL] + [LagSpec("ipc", 4)]
    panel = stage(load(spark, sf, FINE_PANEL).select("date", "district", *SMALL, "ipc"), "panel")
    return stage(lag_features(panel, specs), "model-panel"), [s.name for s in specs]


# two features and labels from the first one on, so that every step has a closed form
PAIRS = """SELECT date, district, count_violence AS x1, ndvi_anom / 10.0E0 AS x2, ipc FROM ({panel}) AS p
           WHERE date >= DATE '1995-06-01'""".replace("{panel}", FINE_PANEL)


def _evaluated(penalty: float, rounded: bool) -> str:
    """SQL of an evaluation: positions, folds, interpolation per fold and place, closed form per fold."""
    error = "abs(round_even(guess, 0) - ipc)" if rounded else "abs(guess - ipc)"
    return f""", pos AS (SELECT *, row_number() OVER (ORDER BY date, district) - 1 AS i, count(*) OVER () AS n FROM d),
      folds AS (SELECT date, district, x1, x2, ipc, CAST(g.f AS INTEGER) AS fold, i < n - (5 - g.f) * (n // 6) AS train
                FROM pos, range(5) AS g(f) WHERE i < n - (4 - g.f) * (n // 6)),
      rows AS (SELECT *, row_number() OVER w AS r, CASE WHEN ipc IS NOT NULL THEN row_number() OVER w END AS k FROM folds WHERE train
               WINDOW w AS (PARTITION BY fold, district ORDER BY date)),
      near AS (SELECT *, last_value(ipc IGNORE NULLS) OVER b AS y0, last_value(k IGNORE NULLS) OVER b AS k0,
                      first_value(ipc IGNORE NULLS) OVER a AS y1, first_value(k IGNORE NULLS) OVER a AS k1 FROM rows
               WINDOW b AS (PARTITION BY fold, district ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                      a AS (PARTITION BY fold, district ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
      filled AS (SELECT fold, x1, x2, CASE WHEN ipc IS NOT NULL THEN ipc WHEN k1 IS NULL THEN y0
                                          ELSE y0 + (y1 - y0) / (k1 - k0) * (r - k0) END AS y FROM near),
      known AS (SELECT *, avg(x1) OVER w AS m1, avg(x2) OVER w AS m2, avg(y) OVER w AS my FROM filled WHERE y IS NOT NULL
                WINDOW w AS (PARTITION BY fold)),
      c AS (SELECT fold, count(*) AS n_train, min(m1) AS m1, min(m2) AS m2, min(my) AS my,
                   sum((x1 - m1) * (x1 - m1)) + {penalty} AS s11, sum((x2 - m2) * (x2 - m2)) + {penalty} AS s22, sum((x1 - m1) * (x2 - m2)) AS s12,
                   sum((x1 - m1) * (y - my)) AS s1y, sum((x2 - m2) * (y - my)) AS s2y FROM known GROUP BY fold),
      b AS (SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM c),
      fit AS (SELECT b.fold, min(n_train) AS n_train, 1 - sum(pow(y - b.my - b1 * (x1 - b.m1) - b2 * (x2 - b.m2), 2)) / sum(pow(y - b.my, 2)) AS r2
              FROM known JOIN b ON known.fold = b.fold GROUP BY b.fold),
      test AS (SELECT folds.fold, ipc, my + b1 * (x1 - m1) + b2 * (x2 - m2) AS guess FROM folds JOIN b ON folds.fold = b.fold
               WHERE NOT train AND ipc IS NOT NULL),
      basic AS (SELECT fold, avg({error}) AS mae, avg(CAST(round_even(guess, 0) = round_even(ipc, 0) AS DOUBLE)) AS accuracy,
                       count(guess) AS n_scored, count(*) - count(guess) AS n_unscored FROM test GROUP BY fold),
      sides AS (SELECT fold, CAST(ipc AS INTEGER) AS class, 1 AS s, 0 AS p, 0 AS h FROM test UNION ALL
                SELECT fold, CAST(round_even(guess, 0) AS INTEGER), 0, 1, CASE WHEN round_even(guess, 0) = ipc THEN 1 ELSE 0 END FROM test),
      classes AS (SELECT fold, class, sum(s) AS s, 2.0E0 * sum(h) / (sum(s) + sum(p)) AS f1 FROM sides GROUP BY 1, 2),
      scores AS (SELECT fold, sum(f1 * s) / sum(s) AS weighted_f1 FROM classes GROUP BY 1),
      metrics AS (SELECT fold, mae, accuracy, n_scored, n_unscored, weighted_f1, r2, n_train
                  FROM fit JOIN basic USING (fold) JOIN scores USING (fold))"""


METRICS = """ SELECT fold, round(mae, 6) AS mae, round(accuracy, 6) AS accuracy, n_scored, n_unscored, round(weighted_f1, 6) AS weighted_f1,
  round(r2, 6) AS r2, n_train FROM metrics"""


def _pairs_evaluated(spark, sf, kind):
    return ev.model_eval(stage(load(spark, sf, PAIRS), "pairs"), ["x1", "x2"], kind)


def _metrics(result):
    return result.metrics.select("fold", "n_scored", "n_unscored", "n_train", *[r6(c).alias(c) for c in ("mae", "accuracy", "weighted_f1", "r2")])


@query("evaluate_ols", with_cte(_evaluated(0.0, False) + METRICS, d=PAIRS))
def evaluate_ols(spark, sf):
    return _metrics(_pairs_evaluated(spark, sf, "OLS"))


@query("evaluate_ridge", with_cte(_evaluated(ml.RIDGE_ALPHA, True) + METRICS, d=PAIRS))
def evaluate_ridge(spark, sf):
    return _metrics(_pairs_evaluated(spark, sf, "Ridge"))


@query(
    "fold_means",
    with_cte(
        _evaluated(0.0, False)
        + """ SELECT round(avg(mae), 6) AS mean_mae, round(avg(r2), 6) AS mean_r2, round(avg(accuracy), 6) AS mean_accuracy,
                     round(avg(weighted_f1), 6) AS mean_weighted_f1 FROM metrics""",
        d=PAIRS,
    ),
)
def fold_means(spark, sf):
    means = _pairs_evaluated(spark, sf, "OLS").means()
    return means.select(*[r6(c).alias(c) for c in means.columns])


@query("zero_based_label", with_cte(" SELECT date, district, CAST(ipc AS INTEGER) - 1 AS label FROM d WHERE ipc IS NOT NULL", d=FINE_PANEL))
def zero_based_label(spark, sf):
    rows = load(spark, sf, FINE_PANEL).where("ipc is not null")
    return rows.select("date", "district", fc.zero_based_class(F.col("ipc")).cast("int").alias("label"))


@query("model_save_load", with_cte(_two_feature_fit(0.0), d=PAIR))
def model_save_load(spark, sf):
    """Predictions of a model that was saved and loaded again."""
    rows, path = _pair(spark, sf), stage_path(spark, "model")
    save_model(ml.fit_ols(rows, ["x1", "x2"]), path)
    return _fitted(rows, load_model(path, LinearFit))


LINE = """,
  e AS (SELECT count(*) AS n, sum(pow(ipc - (my + b1 * (x1 - m1) + b2 * (x2 - m2)), 2)) / (count(*) - 3) AS v FROM d, m, b),
  q AS (SELECT b1, b2, my - b1 * m1 - b2 * m2 AS b0, sqrt(v * s22 / (s11 * s22 - s12 * s12)) AS e1, sqrt(v * s11 / (s11 * s22 - s12 * s12)) AS e2,
               sqrt(v * (1.0E0 / n + (m1 * m1 * s22 - 2 * m1 * m2 * s12 + m2 * m2 * s11) / (s11 * s22 - s12 * s12))) AS e0 FROM m, c, b, e),
  line AS (SELECT 'x1' AS term, b1 AS coef, e1 AS std_err FROM q UNION ALL SELECT 'x2', b2, e2 FROM q UNION ALL SELECT 'const', b0, e0 FROM q)"""
COEFFICIENTS = _two_feature_fit(0.0).rsplit("SELECT date", 1)[0].rstrip() + LINE + """
  SELECT term, round(coef, 6) AS coef, round(std_err, 6) AS std_err, round(coef / std_err, 6) AS t FROM line"""


@query("ols_coefficients", with_cte(COEFFICIENTS, d=PAIR))
def ols_coefficients(spark, sf):
    table, _ = ml.ols_summary(_pair(spark, sf), ["x1", "x2"])
    return table.select("term", *[r6(c).alias(c) for c in ("coef", "std_err", "t")])


# t tails by the finite sum for whole degrees of freedom, the t bound by its expansion in 1 / df, the F tail for two
# degrees in closed form, the condition number by the roots of the 3 x 3 products' characteristic polynomial
SUMMARY = FIT_STATISTICS + LINE + """,
  k AS (SELECT n - 3 AS k, (n - 3) % 2 AS odd, 1.959963984540054E0 AS z FROM e),
  bound AS (SELECT z + (pow(z, 3) + z) / 4 / k + (5 * pow(z, 5) + 16 * pow(z, 3) + 3 * z) / 96 / pow(k, 2)
                   + (3 * pow(z, 7) + 19 * pow(z, 5) + 17 * pow(z, 3) - 15 * z) / 384 / pow(k, 3)
                   + (79 * pow(z, 9) + 776 * pow(z, 7) + 1482 * pow(z, 5) - 1920 * pow(z, 3) - 945 * z) / 92160 / pow(k, 4) AS reach FROM k),
  angle AS (SELECT *, coef / std_err AS t, atan(abs(coef / std_err) / sqrt(k)) AS a FROM line, k, bound),
  terms AS (SELECT term, sum(CASE WHEN odd = 1 THEN exp(lgamma(j + 1.0E0) - lgamma(j + 1.5E0) + 2 * j * ln(cos(a))) * sqrt(pi()) / 2
                                  ELSE exp(lgamma(j + 0.5E0) - lgamma(j + 1.0E0) + 2 * j * ln(cos(a))) / sqrt(pi()) END) AS total
            FROM angle, (SELECT unnest(range(0, (SELECT (k - odd) // 2 FROM k))) AS j) AS u GROUP BY term),
  tails AS (SELECT angle.*, 1 - CASE WHEN odd = 1 THEN 2 / pi() * (a + sin(a) * cos(a) * total) ELSE sin(a) * total END AS p
            FROM angle JOIN terms USING (term)),
  h AS (SELECT CAST(n AS DOUBLE) AS x, s11, s22, s12, m1, m2, s11 * s22 - s12 * s12 AS det2 FROM c, m, e),
  h1 AS (SELECT x + s11 + s22 + x * (m1 * m1 + m2 * m2) AS tr, x * det2 AS det,
                x * s11 + x * s22 + det2 + x * (m1 * m1 * s22 + m2 * m2 * s11 - 2 * m1 * m2 * s12) AS e2 FROM h),
  h2 AS (SELECT *, sqrt((tr * tr - 3 * e2) / 9) AS rad FROM h1),
  h3 AS (SELECT *, tr / 3 + 2 * rad * cos(acos(least(1.0E0, (2 * pow(tr, 3) - 9 * tr * e2 + 27 * det) / 54 / pow(rad, 3))) / 3) AS big FROM h2),
  h4 AS (SELECT big, det / big AS prod, (e2 - det / big) / big AS total FROM h3),
  h5 AS (SELECT sqrt(big / (prod / ((total + sqrt(total * total - 4 * prod)) / 2))) AS cond FROM h4),
  one AS (SELECT stats.*, n_obs - 3 AS df_resid, 2 AS df_model, round(cond, 6) AS condition_number,
                 round(pow(1 + 2 * (f.r2 / 2 / ((1 - f.r2) / (n - 3))) / (n - 3), -(n - 3) / 2.0E0), 6) AS f_prob FROM stats, h5, f),
  named AS (UNPIVOT (SELECT COLUMNS(*)::DOUBLE FROM one) ON COLUMNS(*) INTO NAME term VALUE coef)
  SELECT term, round(coef, 6) AS coef, round(std_err, 6) AS std_err, round(t, 6) AS t, round(p, 6) AS p,
         round(coef - reach * std_err, 6) AS low, round(coef + reach * std_err, 6) AS high FROM tails
  UNION ALL SELECT term, coef, NULL, NULL, NULL, NULL, NULL FROM named"""


@query("ols_summary", with_cte(SUMMARY, d=PAIR))
def ols_summary(spark, sf):
    coefficients, fit = ml.ols_summary(_pair(spark, sf), ["x1", "x2"])
    named = fit.select(F.inline(F.array(*[F.struct(F.lit(c).alias("term"), F.col(c).cast("double").alias("coef")) for c in fit.columns])))
    both = coefficients.unionByName(named, allowMissingColumns=True)
    return both.select("term", *[r6(c).alias(c) for c in both.columns if c != "term"])


@query(
    "ols_collinear",
    with_cte(
        """, m AS (SELECT avg(x1) AS m1, avg(ipc) AS my, count(*) AS n FROM d),
             c AS (SELECT sum((x1 - m1) * (x1 - m1)) AS s11, sum((x1 - m1) * (ipc - my)) AS s1y, sum((ipc - my) * (ipc - my)) AS syy FROM d, m),
             f AS (SELECT *, s1y / s11 AS b, sqrt((syy - s1y * s1y / s11) / (n - 2) / s11) AS se, (syy - s1y * s1y / s11) / (n - 2) AS v FROM m, c)
           SELECT 'x1' AS term, round(b / 5, 6) AS coef, round(se / 5, 6) AS std_err, n - 2 AS df_resid FROM f
           UNION ALL SELECT 'twice', round(2 * b / 5, 6), round(2 * se / 5, 6), n - 2 FROM f
           UNION ALL SELECT 'const', round(my - b * m1, 6), round(sqrt(v * (1.0E0 / n + m1 * m1 / s11)), 6), n - 2 FROM f""",
        d=PAIR,
    ),
)
def ols_collinear(spark, sf):
    """A feature and its double: one slope, shared as the shortest solution shares it, and one degree of freedom more."""
    rows = _pair(spark, sf).withColumn("twice", 2 * F.col("x1"))
    model = ml.fit_ols(rows, ["x1", "twice"])
    table = ml.ols_coefficients(model, ["x1", "twice"], spark)
    return table.select("term", r6("coef").alias("coef"), r6("std_err").alias("std_err"), F.lit(model.df_resid).cast("long").alias("df_resid"))


@query("evaluate_trees")
def evaluate_trees(spark, sf):
    """Five time folds of 100 boosting rounds each."""
    data, features = _labelled_panel(spark, sf)
    return ev.model_eval(data, features, "XGboost").metrics


@query("gbt_fit")
def gbt_fit(spark, sf):
    data, features = _labelled_panel(spark, sf)
    model, columns = ml.fit_trees(data, features)
    return ml.predict_trees(model, data, features, ["date", "district"])


@query("mlp_fit")
def mlp_fit(spark, sf):
    data, features = _labelled_panel(spark, sf)
    rows = stage(ev.network_parts(data, features, "ipc"), "network-rows", "role")
    fit = nw.train_network(rows.where("role = 'train'"), None, features, weights=ml.CLASS_WEIGHTS, units=ml.HIDDEN_UNITS)
    return nw.predict_network(fit.model, rows, features, ["date", "district", "role"])


@query("select_by_holdout_loss")
def select_by_holdout_loss(spark, sf):
    data, features = _labelled_panel(spark, sf)
    return ev.model_eval(data, features, "NN").losses


@query("evaluate_network")
def evaluate_network(spark, sf):
    data, features = _labelled_panel(spark, sf)
    return ev.model_eval(data, features, "NN").metrics


def _lagged_sql(specs, extra: str) -> str:
    """Dense-grid SQL of a dataset's lag features, joined to the monthly series ``series``."""
    columns = list(dict.fromkeys(s.column for s in specs if not s.dropna))
    rolled = ", ".join(f"{_rolled(c, 6)} AS {c}_r" for c in columns)
    late = ", ".join(f"lag({s.column}_r, 3) OVER w AS {s.name}" for s in specs if not s.dropna and not s.difference)
    diffs = [s.column for s in specs if s.difference]
    moved = ", ".join(f"{c}_r - lag({c}_r) OVER (PARTITION BY district ORDER BY date) AS {c}_d" for c in diffs)
    late_d = ", ".join(f"lag({c}_d, 3) OVER w AS {c}_lag_3" for c in diffs)
    kept = [s.lag for s in specs if s.dropna]
    return (
        COMPLETE
        + "".join(_kept_lag(k) for k in kept)
        + f""", dates AS (SELECT DISTINCT date FROM panel), places AS (SELECT DISTINCT district FROM panel),
        grid AS (SELECT dates.date AS date, places.district AS district, {', '.join(f'panel.{c}' for c in columns)}, panel.ipc,
                        panel.district IS NOT NULL AS present
                 FROM dates CROSS JOIN places LEFT JOIN panel ON panel.date = dates.date AND panel.district = places.district),
        rolled AS (SELECT date, district, ipc, present, {rolled} FROM grid),
        moved AS (SELECT *, {moved} FROM rolled),
        late AS (SELECT date, district, ipc, present, {late}, {late_d} FROM moved
                 WINDOW w AS (PARTITION BY district ORDER BY date)),
        first AS (SELECT min(date) AS d FROM panel WHERE ipc IS NOT NULL),
        cut AS (SELECT min(district) AS s FROM panel, first WHERE ipc IS NOT NULL AND date = d),
        joined AS (SELECT late.*, {', '.join(f'kept{k}.v AS ipc_lag_{k}' for k in kept)} FROM late
                   {' '.join(f'LEFT JOIN kept{k} ON late.date = kept{k}.date AND late.district = kept{k}.district' for k in kept)},
                   first, cut
                   WHERE present AND (d IS NULL OR late.date > d OR (late.date = d AND late.district >= s)))"""
        + extra
    )


def _dataset_select(lags, tags, where: str = "") -> str:
    values = ", ".join(f"round({s.name}, 6) AS {s.name}" for s in lags)
    shares = ", ".join(f"coalesce(round(series.{t}, 6), 0) AS {t}" for t in tags)
    return f""" SELECT joined.date, district, CAST(1 AS DOUBLE) AS const, {values}, {shares}, ipc
                FROM joined LEFT JOIN series ON joined.date = series.date {where}"""


def _rounded(data):
    numbers = [c for c in data.columns if c not in ("date", "district", "const", "ipc")]
    return data.withColumns({c: r6(c) for c in numbers})


@query(
    "dataset_standard",
    with_cte(
        _lagged_sql(ds.STANDARD_LAGS, SERIES + _dataset_select(ds.STANDARD_LAGS, ds.STANDARD_TAGS)),
        panel=PANEL,
        articles=ARTICLES,
    ),
)
def dataset_standard(spark, sf):
    return _rounded(ds.prepare_dataset(stage(load(spark, sf, PANEL), "panel"), load(spark, sf, ARTICLES), "Standard"))


COPIES = """, joined_text AS (SELECT news.doc_id, news.date, news.location, {tags}, count(*) AS copies
    FROM news JOIN tagged ON news.text IS NOT DISTINCT FROM tagged.text GROUP BY ALL)""".replace(
    "{tags}", ", ".join(f"tagged.{t} AS {t}" for t in TAG_WORDS)
)


@query(
    "article_features",
    with_cte(
        TAGGED + COPIES + f" SELECT doc_id, date, location, {', '.join(TAG_WORDS)}, copies FROM joined_text",
        news=NEWS,
    ),
)
def article_features(spark, sf):
    out = ds.article_features(load(spark, sf, NEWS), TAG_WORDS, top_n=TOP_N, final_n=TOP_N)
    return out.select("doc_id", "date", "location", *TAG_WORDS, "copies")


IMPROVED_SERIES = (
    TAGGED
    + COPIES
    + """, gazetteer AS (SELECT DISTINCT trim(district) AS district FROM panel), articles AS (SELECT * FROM joined_text)"""
    + MATCHED.replace("SELECT a.doc_id, a.date, g.district", "SELECT DISTINCT a.doc_id, g.district")
    + """, weights_by_article AS (SELECT articles.*, copies * coalesce(n, (SELECT count(*) FROM gazetteer)) AS w FROM articles
           LEFT JOIN (SELECT doc_id, count(*) AS n FROM pairs GROUP BY 1) AS c ON articles.doc_id = c.doc_id),
      m AS (SELECT CAST(date_trunc('month', date) AS DATE) AS date, """
    + ", ".join(f"sum(CASE WHEN {t} THEN 1.0E0 ELSE 0.0E0 END * w) / sum(w) AS {t}" for t in TAG_WORDS)
    + " FROM weights_by_article GROUP BY 1), series AS (SELECT date, "
    + ", ".join(f"CASE WHEN count({t}) OVER s = 3 THEN avg({t}) OVER s END AS {t}" for t in TAG_WORDS)
    + " FROM m WINDOW s AS (ORDER BY date ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING))"
)


@query(
    "dataset_improved",
    with_cte(
        _lagged_sql(
            ds.IMPROVED_LAGS,
            IMPROVED_SERIES + _dataset_select(ds.IMPROVED_LAGS, ds.IMPROVED_TAGS, "WHERE ipc_lag_1 IS NOT NULL"),
        ),
        panel=PANEL,
        news=NEWS,
    ),
)
def dataset_improved(spark, sf):
    articles = ds.article_features(load(spark, sf, NEWS), TAG_WORDS, top_n=TOP_N, final_n=TOP_N)
    return _rounded(ds.prepare_dataset(stage(load(spark, sf, PANEL), "panel"), articles, "Improved"))
