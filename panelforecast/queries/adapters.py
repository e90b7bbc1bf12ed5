"""The given tables in the shape of the inputs: panels, articles, news, predictions.

The SQL runs in Spark and in DuckDB alike; ``{orders}`` and the like stand for tables.
Facts are aggregated before they are joined, so that a customer with a third of all
orders is a few dozen rows by the time anything is shuffled for the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

# month x nation; prices and balances are indexed to a base of 977 and 97
PANEL = """
SELECT date, district, count_violence, ndvi_anom, food_price_idx, ruggedness_mean, pop, cropland_pct,
       sum_fatalities, et_anom, rain_anom,
       CASE WHEN month(date) IN (2, 6, 10) AND date >= DATE '1995-06-01' THEN 1.0E0 + (n % 5) END AS ipc
FROM (SELECT date, n_name AS district, CAST(sum(n) AS BIGINT) AS n,
             sum(urgent) AS count_violence,
             sum(c_acctbal * n) / sum(n) / 97.0E0 AS ndvi_anom,
             sum(price) / sum(n) / 977.0E0 AS food_price_idx,
             max(1.0E0 * (n_nationkey % 7)) AS ruggedness_mean,
             1.0E0 * sum(n) AS pop,
             sum(low) / sum(n) AS cropland_pct,
             sum(finished) AS sum_fatalities,
             min(cheapest) / 977.0E0 AS et_anom,
             max(c_acctbal) / 97.0E0 AS rain_anom
      FROM (SELECT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, count(*) AS n,
                   sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0E0 ELSE 0.0E0 END) AS urgent,
                   sum(CASE WHEN o_orderpriority = '5-LOW' THEN 1.0E0 ELSE 0.0E0 END) AS low,
                   sum(CASE WHEN o_orderstatus = 'F' THEN 1.0E0 ELSE 0.0E0 END) AS finished,
                   sum(o_totalprice) AS price, min(o_totalprice) AS cheapest
            FROM {orders} GROUP BY 1, 2) AS o
      JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
      GROUP BY 1, 2) AS a
"""

# month x supplier: the number of places grows with the data
FINE_PANEL = """
SELECT date, district, count_violence, ndvi_anom, food_price_idx,
       CASE WHEN month(date) IN (2, 6, 10) AND date >= DATE '1995-06-01' THEN 1.0E0 + (n % 5) END AS ipc
FROM (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
             concat('District ', CAST(l_suppkey AS STRING)) AS district, count(*) AS n,
             sum(CASE WHEN l_returnflag = 'R' THEN 1.0E0 ELSE 0.0E0 END) AS count_violence,
             avg(l_quantity) AS ndvi_anom,
             avg(l_extendedprice) / 977.0E0 AS food_price_idx
      FROM {lineitem} GROUP BY 1, 2) AS a
"""

RAW_NAMES = """
SELECT concat(n_name, CASE n_nationkey % 5 WHEN 0 THEN ' North' WHEN 1 THEN ' South' WHEN 2 THEN 'East '
                           WHEN 3 THEN ' Center West' ELSE '' END) AS district
FROM {nation}
"""

ARTICLES = """
SELECT o_orderkey AS doc_id, CAST(o_orderdate AS DATE) AS date,
       CASE o_orderkey % 4 WHEN 0 THEN 'Remote' WHEN 1 THEN 'nation'
            ELSE concat('NATION_', CAST(o_custkey % 25 AS STRING), ' town') END AS location,
       o_orderpriority = '1-URGENT' AS hunger, o_orderpriority = '2-HIGH' AS refugees,
       o_orderstatus = 'F' AS conflict, o_orderstatus = 'P' AS humanitarian
FROM {orders}
"""

NEWS = """
SELECT doc_id, DATE '1992-06-01' + CAST(doc_id * 7 % 2200 AS INT) AS date,
       CASE doc_id % 4 WHEN 0 THEN 'Remote' WHEN 1 THEN 'nation'
            ELSE concat('NATION_', CAST(doc_id % 25 AS STRING), ' town') END AS location,
       source AS topic, text
FROM {documents}
"""

PREDICTIONS = """
SELECT doc_id, label, prediction, raw, pred_prob,
       p0 / total AS p0, p1 / total AS p1, p2 / total AS p2, p3 / total AS p3, p4 / total AS p4
FROM (SELECT doc_id, CASE WHEN unlabelled THEN NULL ELSE class END AS label,
             CASE WHEN doc_id % 5 = 0 THEN (class + 1) % 5 ELSE class END AS prediction,
             class + 1.0E0 * (doc_id % 9 - 4) / 4.0E0 AS raw,
             1.0E0 * (doc_id * 37 % 101) / 100.0E0 AS pred_prob,
             p0, p1, p2, p3, p4, p0 + p1 + p2 + p3 + p4 AS total
      FROM (SELECT o_orderkey AS doc_id, o_orderstatus = 'P' AS unlabelled,
                   CASE WHEN o_orderpriority < '4' THEN CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 ELSE 3 END AS class,
                   1.0E0 + o_orderkey * 3 % 11 AS p0, 1.0E0 + o_orderkey * 5 % 13 AS p1,
                   1.0E0 + o_orderkey * 7 % 17 AS p2, 1.0E0 + o_orderkey * 11 % 19 AS p3,
                   1.0E0 + o_orderkey * 13 % 23 AS p4
            FROM {orders}) AS b) AS c
"""

# Words of the generated prose that stand for the keywords of each tag.
TAG_WORDS = {
    "hunger": ["orre", "thatin rewh"],
    "refugees": ["ononst", "inoran"],
    "humanitarian": ["orantion"],
    "conflict": ["hehely", "nd", "ou"],
    "Governance": ["with"],
    "Diplomacy": ["from"],
    "Crisis": ["this"],
    "Security": ["are"],
    "Society": ["un"],
    "Health": ["des"],
    "Development": ["und"],
    "Education": ["der"],
    "Survival": ["el"],
    "International": ["les"],
    "Opposition": ["von"],
    "Welfare": ["den"],
    "Media": ["ing"],
    "Leadership": ["tion"],
}


def load(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql.format(**{t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}))


def plain(sql: str) -> str:
    """The adapter for DuckDB, where the tables are views."""
    return sql.format(**{t: t for t in TABLES}).strip()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_cte(body: str, **ctes: str) -> str:
    """WITH clause of named adapters (or other SELECTs) in front of ``body``."""
    return "WITH " + ",\n".join(f"{name} AS ({plain(sql)})" for name, sql in ctes.items()) + "\n" + body
