"""Metrics and confidence reports over a prediction table derived from the orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforecast.functions import columns as fc
from panelforecast.operators import confidence as cf
from panelforecast.operators import metrics as mt
from panelforecast.operators.models import CLASS_WEIGHTS
from panelforecast.plans.reports import confidence_report as build_report
from panelforecast.queries.adapters import PREDICTIONS, load, with_cte
from panelforecast.queries.registry import r6, registry

QUERIES, ORACLES, query = registry()



def _predictions(spark, sf):
    return load(spark, sf, PREDICTIONS).withColumn("probability", F.array("p0", "p1", "p2", "p3", "p4"))


def _scored(spark, sf):
    """Labelled rows with just the columns of a confidence table."""
    rows = mt.scored_rows(_predictions(spark, sf))
    return rows.select(F.col("label").alias("true_val"), F.col("prediction").alias("pred_val"), "pred_prob")


SCORED = ", s AS (SELECT * FROM p WHERE label IS NOT NULL)"
INSIDE = SCORED + ", i AS (SELECT * FROM s WHERE pred_prob > 0 AND pred_prob < 1)"


@query(
    "round_predictions",
    with_cte(" SELECT doc_id, round_even(raw, 0) AS rounded FROM p", p=PREDICTIONS),
)
def round_predictions(spark, sf):
    return _predictions(spark, sf).select("doc_id", fc.round_half_even(F.col("raw")).alias("rounded"))


@query(
    "confusion_matrix",
    with_cte(
        SCORED
        + """ SELECT CAST(t.c AS INTEGER) AS label, CAST(g.c AS INTEGER) AS prediction,
                     (SELECT count(*) FROM s WHERE s.label = t.c AND s.prediction = g.c) AS "rows"
              FROM range(5) AS t(c) CROSS JOIN range(5) AS g(c)""",
        p=PREDICTIONS,
    ),
)
def confusion_matrix(spark, sf):
    return mt.confusion_matrix(_predictions(spark, sf))


@query(
    "accuracy",
    with_cte(SCORED + " SELECT round(avg(CAST(label = prediction AS DOUBLE)), 6) AS accuracy FROM s", p=PREDICTIONS),
)
def accuracy(spark, sf):
    rows = mt.scored_rows(_predictions(spark, sf))
    return rows.agg(r6(mt.accuracy(F.col("label"), F.col("prediction"))).alias("accuracy"))


F1 = """, classes AS (SELECT label AS c FROM s UNION SELECT prediction FROM s),
  f AS (SELECT c, (SELECT count(*) FROM s WHERE label = c) AS support, (SELECT count(*) FROM s WHERE prediction = c) AS predicted,
               (SELECT count(*) FROM s WHERE prediction = c AND label = c) AS hits FROM classes)"""


@query(
    "weighted_f1",
    with_cte(
        SCORED + F1 + " SELECT round(sum(2.0E0 * hits / (support + predicted) * support) / sum(support), 6) AS weighted_f1 FROM f",
        p=PREDICTIONS,
    ),
)
def weighted_f1(spark, sf):
    return mt.weighted_f1(_predictions(spark, sf)).select(r6("weighted_f1").alias("weighted_f1"))


@query(
    "mae",
    with_cte(
        SCORED
        + """ SELECT round(avg(abs(raw - label)), 6) AS mae, round(avg(abs(round_even(raw, 0) - label)), 6) AS mae_rounded FROM s""",
        p=PREDICTIONS,
    ),
)
def mae(spark, sf):
    rows = mt.scored_rows(_predictions(spark, sf))
    label, raw = F.col("label"), F.col("raw")
    return rows.agg(r6(mt.mae(label, raw)).alias("mae"), r6(mt.mae(label, raw, rounded=True)).alias("mae_rounded"))


@query(
    "r2_score",
    with_cte(
        SCORED
        + """ SELECT round(1 - sum((label - raw) * (label - raw)) / sum((label - m) * (label - m)), 6) AS r2
              FROM s, (SELECT avg(label) AS m FROM s) AS x""",
        p=PREDICTIONS,
    ),
)
def r2_score(spark, sf):
    return mt.r2_score(_predictions(spark, sf), "label", "raw").select(r6("r2").alias("r2"))


@query(
    "fold_metrics",
    with_cte(
        """, k AS (SELECT CAST(doc_id % 5 AS INTEGER) AS fold, label, raw, round_even(raw, 0) AS c FROM p WHERE label IS NOT NULL),
        side AS (SELECT fold, label AS c FROM k UNION SELECT fold, c FROM k),
        f AS (SELECT side.fold, side.c, count(CASE WHEN k.label = side.c THEN 1 END) AS support,
                     count(CASE WHEN k.c = side.c THEN 1 END) AS predicted,
                     count(CASE WHEN k.c = side.c AND k.label = side.c THEN 1 END) AS hits
              FROM side JOIN k ON side.fold = k.fold GROUP BY 1, 2),
        w AS (SELECT fold, sum(2.0E0 * hits / (support + predicted) * support) / sum(support) AS f1 FROM f GROUP BY 1)
        SELECT k.fold, round(avg(abs(c - label)), 6) AS mae, round(avg(CAST(label = c AS DOUBLE)), 6) AS accuracy,
               count(*) AS n_scored, CAST(0 AS BIGINT) AS n_unscored, round(max(f1), 6) AS weighted_f1
        FROM k JOIN w ON k.fold = w.fold GROUP BY k.fold""",
        p=PREDICTIONS,
    ),
)
def fold_metrics(spark, sf):
    rows = _predictions(spark, sf).select((F.col("doc_id") % 5).cast("int").alias("fold"), "label", F.col("raw").alias("prediction"))
    out = mt.fold_metrics(rows)
    return out.withColumns({c: r6(c) for c in ("mae", "accuracy", "weighted_f1")})


CLASS_WEIGHT = "list_extract([1.0E0, 1.0E0, 2.0E0, 2.0E0, 2.0E0], label + 1)"


@query(
    "weighted_log_loss",
    with_cte(
        SCORED
        + f""" SELECT round(sum({CLASS_WEIGHT} * -ln(list_extract([p0, p1, p2, p3, p4], label + 1))) / sum({CLASS_WEIGHT}), 6) AS log_loss
               FROM s""",
        p=PREDICTIONS,
    ),
)
def weighted_log_loss(spark, sf):
    rows = mt.scored_rows(_predictions(spark, sf))
    return rows.agg(r6(mt.weighted_log_loss(F.col("label"), F.col("probability"), CLASS_WEIGHTS)).alias("log_loss"))


@query(
    "confidence_table",
    with_cte(
        """ SELECT doc_id, label AS true_val, CAST(list_position(a, list_max(a)) - 1 AS INTEGER) AS pred_val,
                   round(list_max(a), 6) AS pred_prob FROM (SELECT *, [p0, p1, p2, p3, p4] AS a FROM p) AS x""",
        p=PREDICTIONS,
    ),
)
def confidence_table(spark, sf):
    out = cf.confidence_table(_predictions(spark, sf), ["doc_id"])
    return out.withColumn("pred_prob", r6("pred_prob"))


BINS = INSIDE + """, h AS (SELECT CAST(b.c AS INTEGER) AS bin, b.c / 10.0E0 AS low, (b.c + 1) / 10.0E0 AS high,
    (SELECT count(*) FROM i WHERE pred_prob >= b.c / 10.0E0 AND (pred_prob < (b.c + 1) / 10.0E0 OR b.c = 9)) AS "rows"
    FROM range(10) AS b(c))"""


@query("confidence_histogram", with_cte(BINS + " SELECT * FROM h", p=PREDICTIONS))
def confidence_histogram(spark, sf):
    return cf.confidence_histogram(_scored(spark, sf))


KDE = """, st AS (SELECT count(*) AS n, min(pred_prob) AS low, max(pred_prob) AS high,
                 pow(count(*), -0.2E0) * stddev_samp(pred_prob) AS h FROM i),
  xs AS (SELECT CAST(c AS INTEGER) AS point, low + (high - low) * c / 199.0E0 AS x FROM range(200) AS r(c), st),
  k AS (SELECT point, min(x) AS x, sum(exp(-0.5E0 * pow((x - pred_prob) / h, 2)) / (h * sqrt(2 * pi()) * n)) AS density
        FROM xs, st, i GROUP BY point)"""


@query(
    "confidence_kde",
    with_cte(INSIDE + KDE + " SELECT point, round(x, 6) AS x, round(density, 6) AS density FROM k", p=PREDICTIONS),
)
def confidence_kde(spark, sf):
    return cf.confidence_kde(_scored(spark, sf)).select("point", r6("x").alias("x"), r6("density").alias("density"))


RANGES = INSIDE + """, g AS (SELECT low, high, count(label) AS "rows", round(coalesce(avg(CAST(label = prediction AS DOUBLE)), 0), 6) AS accuracy
    FROM (VALUES (0.9E0, 1.0E0), (0.8E0, 0.9E0), (0.7E0, 0.8E0), (0.6E0, 0.7E0), (0.5E0, 0.6E0), (0.4E0, 0.5E0), (0.3E0, 0.4E0),
                 (0.0E0, 0.3E0)) AS v(low, high) LEFT JOIN i ON pred_prob BETWEEN low AND high GROUP BY 1, 2)"""


@query("accuracy_by_confidence", with_cte(RANGES + " SELECT * FROM g", p=PREDICTIONS))
def accuracy_by_confidence(spark, sf):
    return cf.accuracy_by_confidence(_scored(spark, sf)).withColumn("accuracy", r6("accuracy"))


@query(
    "explain_predictions",
    with_cte(
        SCORED
        + """ SELECT doc_id, round_even(a[1] * 100, 0) / 100 AS prob_1,
                     round_even(a[5] * 100, 0) / 100 AS prob_5,
                     CAST(list_position(a, list_max(a)) AS INTEGER) AS predicted_score,
                     round_even(100 * list_max(a) * 100, 0) / 100 AS confidence_pct, CAST(label + 1 AS INTEGER) AS true_score
              FROM (SELECT *, [p0, p1, p2, p3, p4] AS a FROM s) AS x""",
        p=PREDICTIONS,
    ),
)
def explain_predictions(spark, sf):
    out = cf.explain_predictions(mt.scored_rows(_predictions(spark, sf)), ["doc_id"])
    return out.select(
        "doc_id",
        F.get("probabilities", F.lit(0)).alias("prob_1"),
        F.get("probabilities", F.lit(4)).alias("prob_5"),
        "predicted_score",
        "confidence_pct",
        "true_score",
    )


@query(
    "confidence_report",
    with_cte(
        RANGES
        + BINS[len(INSIDE) :]
        + KDE
        + """ SELECT 'histogram' AS part, round(low, 6) AS low, round(high, 6) AS high, CAST("rows" AS DOUBLE) AS value FROM h
              UNION ALL SELECT 'density', round(x, 6), round(x, 6), round(density, 6) FROM k
              UNION ALL SELECT 'accuracy', low, high, accuracy FROM g""",
        p=PREDICTIONS,
    ),
)
def confidence_report(spark, sf):
    out = build_report(_scored(spark, sf))
    return out.select("part", r6("low").alias("low"), r6("high").alias("high"), r6("value").alias("value"))
