"""Panel, window and fold operators over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforecast.functions import columns as fc
from panelforecast.operators import folds as fo
from panelforecast.operators import panel as pa
from panelforecast.queries.adapters import FINE_PANEL, PANEL, RAW_NAMES, load, table, with_cte
from panelforecast.queries.registry import r6, registry
from panelforecast.sources.stages import materialize, stage, stage_path
from panelforecast.sources.tables import read_delimited, read_table, write_table

QUERIES, ORACLES, query = registry()



def _fine(spark, sf, *columns):
    """The supplier panel, for operators that read their input once."""
    panel = load(spark, sf, FINE_PANEL)
    return panel.select(*columns) if columns else panel


def _stored(spark, sf, *columns, sql=FINE_PANEL):
    """A panel as a stored table, for operators that read it more than once: the facts are aggregated once."""
    panel = load(spark, sf, sql)
    return stage(panel.select(*columns) if columns else panel, "panel")


@query(
    "scan_table",
    "SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS order_date, o_totalprice FROM orders",
)
def scan_table(spark, sf):
    rows = read_table(spark, f"{sf}/orders.parquet", ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"])
    return rows.select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("order_date"), "o_totalprice")


@query("write_read_roundtrip", "SELECT doc_id, lang, source, text, n_chars FROM documents")
def write_read_roundtrip(spark, sf):
    source = table(spark, sf, "documents").select("doc_id", "lang", "source", "text", "n_chars")
    path = stage_path(spark, "roundtrip")
    write_table(source, path, "csv")
    return read_delimited(spark, path, source.schema, multi_line=True)


@query(
    "materialized_stage",
    with_cte(" SELECT date, district, count_violence, round(food_price_idx, 6) AS food_price_idx, ipc FROM panel", panel=FINE_PANEL),
)
def materialized_stage(spark, sf):
    path = stage_path(spark, "panel")
    materialize(spark, path, lambda: _fine(spark, sf))
    # the second call must find the table, not build it
    again = materialize(spark, path, lambda: _fine(spark, sf).limit(0))
    return again.select("date", "district", "count_violence", r6("food_price_idx").alias("food_price_idx"), "ipc")


@query(
    "parse_year_month",
    "SELECT l_orderkey, l_linenumber, CAST(date_trunc('month', l_shipdate) AS DATE) AS date FROM lineitem",
)
def parse_year_month(spark, sf):
    keyed = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.date_format("l_shipdate", "yyyy_MM").alias("k"))
    return keyed.select("l_orderkey", "l_linenumber", fc.parse_month_key(F.col("k")).alias("date"))


@query("month_trunc", "SELECT event_id, CAST(date_trunc('month', ts) AS DATE) AS month FROM events")
def month_trunc(spark, sf):
    return table(spark, sf, "events").select("event_id", fc.month_of(F.col("ts")).alias("month"))


@query(
    "key_uniqueness",
    """SELECT CAST(o_orderdate AS DATE) AS date, o_custkey, count(*) AS copies FROM orders
       GROUP BY 1, 2 HAVING count(*) > 1""",
)
def key_uniqueness(spark, sf):
    rows = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date"), "o_custkey")
    return pa.duplicate_keys(rows, ["date", "o_custkey"])


@query(
    "gazetteer_normalise",
    with_cte(
        """SELECT DISTINCT trim(replace(replace(replace(replace(replace(district, 'Center', ''), 'South', ''), 'North', ''),
                                'East', ''), 'West', '')) AS district FROM raw_names""",
        raw_names=RAW_NAMES,
    ),
)
def gazetteer_normalise(spark, sf):
    from panelforecast.operators.places import gazetteer_of

    return gazetteer_of(load(spark, sf, RAW_NAMES))


@query(
    "trim_to_first_label",
    with_cte(
        """, first AS (SELECT min(date) AS d FROM panel WHERE ipc IS NOT NULL),
              cut AS (SELECT min(district) AS s FROM panel, first WHERE ipc IS NOT NULL AND date = d)
           SELECT date, district, ipc FROM panel, first, cut
           WHERE d IS NULL OR date > d OR (date = d AND district >= s)""",
        panel=FINE_PANEL,
    ),
)
def trim_to_first_label(spark, sf):
    return pa.trim_to_first_label(_stored(spark, sf, "date", "district", "ipc"), "ipc")


# every present date for every district
GRID = """, dates AS (SELECT DISTINCT date FROM panel), places AS (SELECT DISTINCT district FROM panel),
grid AS (SELECT d.date, p.district, panel.count_violence, panel.ndvi_anom, panel.food_price_idx, panel.ipc,
                panel.district IS NOT NULL AS present
         FROM dates d CROSS JOIN places p LEFT JOIN panel ON panel.date = d.date AND panel.district = p.district)"""


@query(
    "panel_densify",
    with_cte(
        GRID + " SELECT date, district, round(food_price_idx, 6) AS food_price_idx, ipc, present FROM grid", panel=FINE_PANEL
    ),
)
def panel_densify(spark, sf):
    dense = pa.densify(_stored(spark, sf, "date", "district", "food_price_idx", "ipc"))
    return dense.select("date", "district", r6("food_price_idx").alias("food_price_idx"), "ipc", "present")


def _rolled(column: str, size: int) -> str:
    frame = f"(PARTITION BY district ORDER BY date ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({column}) OVER {frame} = {size} THEN avg({column}) OVER {frame} END"


@query(
    "panel_rolling_mean",
    with_cte(
        GRID
        + f""", r AS (SELECT date, district, present, {_rolled('food_price_idx', 6)} AS v FROM grid)
        SELECT date, district, round(v, 6) AS food_price_roll FROM r WHERE present""",
        panel=FINE_PANEL,
    ),
)
def panel_rolling_mean(spark, sf):
    out = pa.rolling_mean(_stored(spark, sf, "date", "district", "food_price_idx"), "food_price_idx", 6, "v")
    return out.select("date", "district", r6("v").alias("food_price_roll"))


@query(
    "panel_diff",
    with_cte(
        GRID
        + """, r AS (SELECT date, district, present,
                            ndvi_anom - lag(ndvi_anom) OVER (PARTITION BY district ORDER BY date) AS v FROM grid)
        SELECT date, district, round(v, 6) AS ndvi_diff FROM r WHERE present""",
        panel=FINE_PANEL,
    ),
)
def panel_diff(spark, sf):
    out = pa.difference(_stored(spark, sf, "date", "district", "ndvi_anom"), "ndvi_anom", "v")
    return out.select("date", "district", r6("v").alias("ndvi_diff"))


COMPLETE = """, complete AS (SELECT date, row_number() OVER (ORDER BY date) AS position FROM
    (SELECT date FROM panel GROUP BY date HAVING count(ipc) = (SELECT count(DISTINCT district) FROM panel)) AS x)"""


@query(
    "complete_dates",
    with_cte(COMPLETE + " SELECT date, CAST(position AS BIGINT) AS position FROM complete", panel=FINE_PANEL),
)
def complete_dates(spark, sf):
    out = pa.complete_dates(_stored(spark, sf, "date", "district", "ipc"), "ipc")
    return out.select("date", F.col("position").cast("long").alias("position"))


def _kept_lag(lag: int) -> str:
    return f""", kept{lag} AS (SELECT panel.date, district, lag(ipc, {lag}) OVER (PARTITION BY district ORDER BY panel.date) AS v
                              FROM panel JOIN complete ON panel.date = complete.date)"""


@query(
    "panel_lag",
    with_cte(
        COMPLETE
        + _kept_lag(2)
        + """ SELECT panel.date, panel.district, v AS ipc_lag_2
              FROM panel LEFT JOIN kept2 ON panel.date = kept2.date AND panel.district = kept2.district""",
        panel=FINE_PANEL,
    ),
)
def panel_lag(spark, sf):
    out = pa.lag_features(_stored(spark, sf, "date", "district", "ipc"), [pa.LagSpec("ipc", 2, dropna=True)])
    return out.select("date", "district", "ipc_lag_2")


LAG_SPECS = [
    pa.LagSpec("count_violence", 3, rolling=6),
    pa.LagSpec("ndvi_anom", 3),
    pa.LagSpec("food_price_idx", 3, rolling=6, difference=True),
    pa.LagSpec("ipc", 1, dropna=True),
]

LAGGED_SQL = (
    GRID
    + COMPLETE
    + _kept_lag(1)
    + f""", rolled AS (SELECT *, {_rolled('count_violence', 6)} AS cv, {_rolled('food_price_idx', 6)} AS fp FROM grid),
      moved AS (SELECT *, fp - lag(fp) OVER (PARTITION BY district ORDER BY date) AS fd FROM rolled),
      late AS (SELECT date, district, present, lag(cv, 3) OVER w AS cv3, lag(ndvi_anom, 3) OVER w AS nd3, lag(fd, 3) OVER w AS fd3
               FROM moved WINDOW w AS (PARTITION BY district ORDER BY date))
      SELECT late.date, late.district, round(cv3, 6) AS count_violence_lag_3, round(nd3, 6) AS ndvi_anom_lag_3,
             round(fd3, 6) AS food_price_idx_lag_3, v AS ipc_lag_1
      FROM late LEFT JOIN kept1 ON late.date = kept1.date AND late.district = kept1.district WHERE present"""
)


@query("lag_features", with_cte(LAGGED_SQL, panel=FINE_PANEL))
def lag_features(spark, sf):
    out = pa.lag_features(_stored(spark, sf), LAG_SPECS)
    return out.select(
        "date",
        "district",
        r6("count_violence_lag_3").alias("count_violence_lag_3"),
        r6("ndvi_anom_lag_3").alias("ndvi_anom_lag_3"),
        r6("food_price_idx_lag_3").alias("food_price_idx_lag_3"),
        "ipc_lag_1",
    )


@query(
    "drop_null_lag",
    with_cte(
        COMPLETE
        + _kept_lag(1)
        + """ SELECT panel.date, panel.district, ipc, v AS ipc_lag_1
              FROM panel JOIN kept1 ON panel.date = kept1.date AND panel.district = kept1.district WHERE v IS NOT NULL""",
        panel=PANEL,
    ),
)
def drop_null_lag(spark, sf):
    panel = _stored(spark, sf, "date", "district", "ipc", sql=PANEL)
    return pa.drop_null_lag(pa.lag_features(panel, [pa.LagSpec("ipc", 1, dropna=True)]))


@query(
    "interpolate_linear",
    with_cte(
        """, n AS (SELECT *, row_number() OVER (PARTITION BY district ORDER BY date) AS r FROM panel),
        k AS (SELECT date, district, ipc, r,
                     last_value(CASE WHEN ipc IS NOT NULL THEN r END IGNORE NULLS) OVER b AS r0,
                     last_value(ipc IGNORE NULLS) OVER b AS x0,
                     first_value(CASE WHEN ipc IS NOT NULL THEN r END IGNORE NULLS) OVER a AS r1,
                     first_value(ipc IGNORE NULLS) OVER a AS x1
              FROM n WINDOW b AS (PARTITION BY district ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                            a AS (PARTITION BY district ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
        SELECT date, district, round(CASE WHEN ipc IS NOT NULL THEN ipc WHEN x1 IS NULL THEN x0
                                          ELSE x0 + (x1 - x0) / (r1 - r0) * (r - r0) END, 6) AS ipc FROM k""",
        panel=FINE_PANEL,
    ),
)
def interpolate_linear(spark, sf):
    out = pa.interpolate_linear(_fine(spark, sf, "date", "district", "ipc"), ["ipc"])
    return out.select("date", "district", r6("ipc").alias("ipc"))


POSITIONS = ", p AS (SELECT date, district, ipc, ndvi_anom, row_number() OVER (ORDER BY date, district) - 1 AS position FROM panel)"


@query(
    "row_position",
    with_cte(POSITIONS + " SELECT date, district, CAST(position AS BIGINT) AS position FROM p", panel=FINE_PANEL),
)
def row_position(spark, sf):
    return pa.row_position(_fine(spark, sf, "date", "district"))


FOLDS = (
    POSITIONS
    + """, s AS (SELECT count(*) AS n, count(*) // 6 AS t FROM p),
    f AS (SELECT CAST(i AS INTEGER) AS fold, n - (5 - i) * t AS low, n - (4 - i) * t AS high FROM s, range(5) AS r(i)),
    folds AS (SELECT date, district, ipc, position, fold, CASE WHEN position < low THEN 'train' ELSE 'test' END AS role
              FROM p JOIN f ON position < high)"""
)


@query(
    "time_series_folds",
    with_cte(FOLDS + " SELECT date, district, CAST(position AS BIGINT) AS position, fold, role FROM folds", panel=FINE_PANEL),
)
def time_series_folds(spark, sf):
    return fo.time_series_folds(pa.row_position(_fine(spark, sf, "date", "district")))


@query(
    "live_columns_per_fold",
    with_cte(
        GRID
        + """, q AS (SELECT *, row_number() OVER (ORDER BY date, district) - 1 AS position FROM panel),
        s AS (SELECT count(*) AS n, count(*) // 6 AS t FROM q),
        f AS (SELECT CAST(i AS INTEGER) AS fold, n - (5 - i) * t AS low FROM s, range(5) AS r(i)),
        c AS (SELECT fold, count(ndvi_anom) AS a, count(ipc) AS b, count(nothing) AS z
              FROM (SELECT *, CAST(NULL AS DOUBLE) AS nothing FROM q) AS q JOIN f ON position < low GROUP BY fold)
        SELECT fold, 'ndvi_anom' AS "column", a AS "values" FROM c WHERE a > 0
        UNION ALL SELECT fold, 'ipc', b FROM c WHERE b > 0 UNION ALL SELECT fold, 'nothing', z FROM c WHERE z > 0""",
        panel=FINE_PANEL,
    ),
)
def live_columns_per_fold(spark, sf):
    rows = _fine(spark, sf).select("date", "district", "ndvi_anom", "ipc", F.lit(None).cast("double").alias("nothing"))
    return fo.live_columns_per_fold(fo.time_series_folds(pa.row_position(rows)), ["ndvi_anom", "ipc", "nothing"])


@query(
    "holdout_split",
    with_cte(
        """ SELECT date, district,
               CASE WHEN CAST(('0x' || substr(md5(concat(CAST(date AS STRING), '|', district, '|69')), 1, 8)) AS BIGINT)
                         / 4294967296.0E0 < 0.2E0 THEN 'test' ELSE 'train' END AS role FROM panel""",
        panel=FINE_PANEL,
    ),
)
def holdout_split(spark, sf):
    return fo.holdout_split(_fine(spark, sf, "date", "district"), ["date", "district"])
