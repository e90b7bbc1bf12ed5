"""Place mapping, tags, topics and monthly shares over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforecast.operators import cooccurrence as co
from panelforecast.operators import density as dn
from panelforecast.operators import places as pl
from panelforecast.operators import regions as rg
from panelforecast.operators import series as se
from panelforecast.operators import tags as tg
from panelforecast.operators import topics as tp
from panelforecast.plans.reports import articles_per_region
from panelforecast.queries.adapters import (
    ARTICLES,
    NEWS,
    PANEL,
    RAW_NAMES,
    TAG_WORDS,
    load,
    table,
    with_cte,
)
from panelforecast.queries.registry import r6, registry

QUERIES, ORACLES, query = registry()
ARTICLE_TAGS = ["hunger", "refugees", "conflict", "humanitarian"]
TOP_N = 5



def _places(spark, sf):
    return load(spark, sf, RAW_NAMES)


GAZETTEER = """SELECT DISTINCT trim(replace(replace(replace(replace(replace(district, 'Center', ''), 'South', ''),
               'North', ''), 'East', ''), 'West', '')) AS district FROM ({raw})""".replace("{raw}", RAW_NAMES)

MATCHED = """, pairs AS (SELECT a.doc_id, a.date, g.district FROM articles a JOIN gazetteer g
                   ON contains(lower(a.location), lower(g.district)) OR contains(lower(g.district), lower(a.location)))"""

ALL_FALLBACK = (
    MATCHED
    + """, mapped AS (SELECT doc_id, date, district FROM pairs UNION ALL
                      SELECT doc_id, date, district FROM articles, gazetteer WHERE doc_id NOT IN (SELECT doc_id FROM pairs))"""
)
LABEL_FALLBACK = (
    MATCHED
    + """, mapped AS (SELECT doc_id, date, district FROM pairs UNION ALL
                      SELECT doc_id, date, 'Not assigned' FROM articles WHERE doc_id NOT IN (SELECT doc_id FROM pairs))"""
)


@query(
    "map_articles_all_fallback",
    with_cte(ALL_FALLBACK + " SELECT doc_id, date, district FROM mapped", articles=ARTICLES, gazetteer=GAZETTEER),
)
def map_articles_all_fallback(spark, sf):
    articles = load(spark, sf, ARTICLES).select("doc_id", "date", "location")
    return pl.map_articles(articles, pl.gazetteer_of(_places(spark, sf)), "all").drop("location")


@query(
    "map_articles_label_fallback",
    with_cte(LABEL_FALLBACK + " SELECT doc_id, date, district FROM mapped", articles=ARTICLES, gazetteer=GAZETTEER),
)
def map_articles_label_fallback(spark, sf):
    return _mapped(spark, sf)


# every customer is a place name; locations hold one, lie in some, or match none
SHOPS = """SELECT o_orderkey AS doc_id, CASE o_orderkey % 4 WHEN 0 THEN 'Remote' WHEN 1 THEN concat(c_name, ' market')
             WHEN 2 THEN substring(c_name, 1, length(c_name) - 1) ELSE concat('near ', lower(c_name)) END AS location
           FROM {orders} JOIN {customer} ON o_custkey = c_custkey"""
CUSTOMERS = "SELECT DISTINCT c_name AS district FROM {customer}"


@query(
    "map_articles_long_gazetteer",
    with_cte(
        """, spots AS (SELECT DISTINCT location FROM articles),
           pairs AS (SELECT s.location, g.district FROM spots s JOIN gazetteer g
                     ON contains(lower(s.location), lower(g.district)) OR contains(lower(g.district), lower(s.location)))
           SELECT doc_id, coalesce(district, 'Not assigned') AS district
           FROM articles LEFT JOIN pairs ON articles.location = pairs.location""",
        articles=SHOPS,
        gazetteer=CUSTOMERS,
    ),
)
def map_articles_long_gazetteer(spark, sf):
    """Locations against a gazetteer that grows with the data: every customer's name."""
    return pl.map_articles(load(spark, sf, SHOPS), load(spark, sf, CUSTOMERS), "label").drop("location")


def _counted(spark, sf):
    articles = load(spark, sf, ARTICLES).select("doc_id", "location")
    return pl.count_by_district(articles, pl.gazetteer_of(_places(spark, sf)))


def _mapped(spark, sf):
    articles = load(spark, sf, ARTICLES).select("doc_id", "date", "location")
    return pl.map_articles(articles, pl.gazetteer_of(_places(spark, sf)), "label").drop("location")


@query(
    "article_district_weight",
    with_cte(
        ALL_FALLBACK + " SELECT doc_id, count(*) AS districts FROM mapped GROUP BY doc_id",
        articles=ARTICLES,
        gazetteer=GAZETTEER,
    ),
)
def article_district_weight(spark, sf):
    articles = load(spark, sf, ARTICLES).select("doc_id", "location")
    return pl.with_district_weight(articles, pl.gazetteer_of(_places(spark, sf))).drop("location")


@query(
    "tag_join_fanout",
    """SELECT a.doc_id, b.source AS tag_source, count(*) AS copies
       FROM documents a JOIN documents b ON a.text IS NOT DISTINCT FROM b.text GROUP BY 1, 2""",
)
def tag_join_fanout(spark, sf):
    docs = table(spark, sf, "documents")
    tagged = docs.select("text", F.col("source").alias("tag_source"))
    return tg.attach_tags(docs.select("doc_id", "text"), tagged, ["tag_source"]).drop("text")


@query(
    "monthly_topic_share",
    with_cte(
        """ SELECT CAST(date_trunc('month', date) AS DATE) AS month, round(avg(CAST(hunger AS DOUBLE)), 6) AS hunger,
            round(avg(CAST(refugees AS DOUBLE)), 6) AS refugees, round(avg(CAST(conflict AS DOUBLE)), 6) AS conflict,
            round(avg(CAST(humanitarian AS DOUBLE)), 6) AS humanitarian FROM articles GROUP BY 1""",
        articles=ARTICLES,
    ),
)
def monthly_topic_share(spark, sf):
    out = se.monthly_topic_share(load(spark, sf, ARTICLES), ARTICLE_TAGS, out="month")
    return out.select("month", *[r6(t).alias(t) for t in ARTICLE_TAGS])


SERIES = """, m AS (SELECT CAST(date_trunc('month', date) AS DATE) AS date, avg(CAST(hunger AS DOUBLE)) AS hunger,
    avg(CAST(refugees AS DOUBLE)) AS refugees, avg(CAST(conflict AS DOUBLE)) AS conflict,
    avg(CAST(humanitarian AS DOUBLE)) AS humanitarian FROM articles GROUP BY 1),
  series AS (SELECT date, """ + ", ".join(
    f"CASE WHEN count({t}) OVER w = 3 THEN avg({t}) OVER w END AS {t}" for t in ARTICLE_TAGS
) + " FROM m WINDOW w AS (ORDER BY date ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING))"


@query(
    "monthly_series_features",
    with_cte(
        SERIES + " SELECT date, " + ", ".join(f"round({t}, 6) AS {t}" for t in ARTICLE_TAGS) + " FROM series",
        articles=ARTICLES,
    ),
)
def monthly_series_features(spark, sf):
    out = se.monthly_series_features(load(spark, sf, ARTICLES), ARTICLE_TAGS)
    return out.select("date", *[r6(t).alias(t) for t in ARTICLE_TAGS])


@query(
    "panel_join_monthly",
    with_cte(
        SERIES
        + " SELECT panel.date, district, "
        + ", ".join(f"coalesce(round({t}, 6), 0) AS {t}" for t in ARTICLE_TAGS)
        + " FROM panel LEFT JOIN series ON panel.date = series.date",
        articles=ARTICLES,
        panel=PANEL,
    ),
)
def panel_join_monthly(spark, sf):
    series = se.monthly_series_features(load(spark, sf, ARTICLES), ARTICLE_TAGS)
    out = se.join_monthly(load(spark, sf, PANEL).select("date", "district"), series, ARTICLE_TAGS)
    return out.select("date", "district", *[r6(t).alias(t) for t in ARTICLE_TAGS])


@query(
    "topic_share_by_class",
    with_cte(
        SERIES.split("series AS")[0].rstrip().rstrip(",")
        + " SELECT ipc, "
        + ", ".join(f"round(avg({t}), 6) AS {t}" for t in ARTICLE_TAGS)
        + " FROM panel LEFT JOIN m ON panel.date = m.date WHERE ipc IS NOT NULL GROUP BY ipc",
        articles=ARTICLES,
        panel=PANEL,
    ),
)
def topic_share_by_class(spark, sf):
    monthly = se.monthly_topic_share(load(spark, sf, ARTICLES), ARTICLE_TAGS)
    out = rg.topic_share_by_class(load(spark, sf, PANEL).select("date", "ipc"), monthly, ARTICLE_TAGS)
    return out.select("ipc", *[r6(t).alias(t) for t in ARTICLE_TAGS])


COUNTS = LABEL_FALLBACK + ', counts AS (SELECT district, count(*) AS "count" FROM mapped GROUP BY 1)'
TOP = COUNTS + ', top AS (SELECT * FROM counts ORDER BY "count" DESC, district LIMIT 10)'
FOLDED = (
    TOP
    + """, folded AS (SELECT CASE WHEN "count" < (SELECT sum("count" / 100 * 2.3E0) FROM top) THEN 'Other regions' ELSE district END AS district,
                   CAST(sum("count") AS BIGINT) AS "count" FROM top GROUP BY 1)"""
)


@query(
    "articles_per_region_counts",
    with_cte(COUNTS + " SELECT * FROM counts", articles=ARTICLES, gazetteer=GAZETTEER),
)
def articles_per_region_counts(spark, sf):
    return _counted(spark, sf)


@query("top_regions", with_cte(TOP + " SELECT * FROM top", articles=ARTICLES, gazetteer=GAZETTEER))
def top_regions(spark, sf):
    return rg.top_regions(_counted(spark, sf))


@query(
    "fold_long_tail",
    """WITH top AS (SELECT concat(o_orderstatus, '/', o_orderpriority) AS district, count(*) AS "count"
                    FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
       SELECT CASE WHEN "count" < (SELECT sum("count" / 100 * 9.0E0) FROM top) THEN 'Other regions' ELSE district END AS district,
              CAST(sum("count") AS BIGINT) AS "count" FROM top GROUP BY 1""",
)
def fold_long_tail(spark, sf):
    orders = table(spark, sf, "orders").select(F.concat_ws("/", "o_orderstatus", "o_orderpriority").alias("district"))
    return rg.fold_long_tail(rg.top_regions(rg.count_per_region(orders)), percent=9.0)


@query(
    "region_share_pct",
    with_cte(
        COUNTS + ' SELECT district, "count", round(100.0E0 * "count" / (SELECT sum("count") FROM counts), 6) AS share_pct FROM counts',
        articles=ARTICLES,
        gazetteer=GAZETTEER,
    ),
)
def region_share_pct(spark, sf):
    shares = rg.share_of_total(_counted(spark, sf))
    return shares.withColumn("share_pct", r6("share_pct"))


@query(
    "articles_by_region_report",
    with_cte(
        FOLDED
        + ' SELECT district, "count", round(100.0E0 * "count" / (SELECT sum("count") FROM folded), 6) AS share_pct FROM folded',
        articles=ARTICLES,
        gazetteer=GAZETTEER,
    ),
)
def articles_by_region_report(spark, sf):
    out = articles_per_region(load(spark, sf, ARTICLES), _places(spark, sf))
    return out.withColumn("share_pct", r6("share_pct"))


@query("topic_assign")
def topic_assign(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return tp.own_topics(docs).select("doc_id", "topic")


@query("topic_assign_outliers")
def topic_assign_outliers(spark, sf):
    """Topics, -1 where a text is far from its centre."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return tp.own_topics(docs, outlier_distance=0.5).select("doc_id", "topic")


@query("topic_assign_vectors")
def topic_assign_vectors(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return tp.assign_vector_topics(tp.fit_vector_topics(vectors), vectors).select("vec_id", "topic")


@query("topic_density")
def topic_density(spark, sf):
    """Topics of the texts by density, as many as there are; -1 for texts that lie apart."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return dn.density_topics(dn.text_vectors(docs), "doc_id", "vector")


@query("topic_density_vectors")
def topic_density_vectors(spark, sf):
    """The same for vectors that come with the rows."""
    return dn.density_topics(table(spark, sf, "embeddings").select("vec_id", "embedding"))


WEIGHTS = r""", words AS (SELECT topic, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM news),
  counts AS (SELECT topic, term, count(*) AS tf FROM words GROUP BY 1, 2),
  totals AS (SELECT term, sum(tf) AS total FROM counts GROUP BY 1),
  average AS (SELECT avg(n) AS a FROM (SELECT sum(tf) AS n FROM counts GROUP BY topic) AS x),
  weights AS (SELECT topic, counts.term, tf, CAST(total AS BIGINT) AS total, tf * ln(1 + a / total) AS weight
              FROM counts JOIN totals ON counts.term = totals.term, average)""".replace("{{", "{").replace("}}", "}")


@query(
    "ctfidf_terms",
    with_cte(WEIGHTS + " SELECT topic, term, tf, total, round(weight, 6) AS weight FROM weights", news=NEWS),
)
def ctfidf_terms(spark, sf):
    return tp.class_tfidf(load(spark, sf, NEWS)).withColumn("weight", r6("weight"))


def _keyword_values() -> str:
    rows = [
        f"('{tag}', '{k}', '{w}', {len(k.split())})" for tag, ks in TAG_WORDS.items() for k in ks for w in sorted(set(k.split()))
    ]
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS v(tag, keyword, term, words)"


SIMILARITY = (
    WEIGHTS
    + f""", keys AS ({_keyword_values()}),
  norms AS (SELECT topic, sqrt(sum(weight * weight)) AS norm FROM weights GROUP BY 1),
  dots AS (SELECT keyword, topic, sum(weight) AS dot FROM weights JOIN keys ON weights.term = keys.term GROUP BY 1, 2),
  similarity AS (SELECT k.keyword, norms.topic, coalesce(dot, 0) / sqrt(k.words) / norm AS similarity
                 FROM (SELECT DISTINCT keyword, words FROM keys) AS k CROSS JOIN norms
                 LEFT JOIN dots ON dots.keyword = k.keyword AND dots.topic = norms.topic)"""
)
NEAR = (
    SIMILARITY
    + f""", near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY similarity DESC, topic) AS "rank"
                     FROM similarity) AS x WHERE "rank" <= {TOP_N}),
  best AS (SELECT tag, topic, max(similarity) AS similarity
           FROM near JOIN (SELECT DISTINCT tag, keyword FROM keys) AS t ON t.keyword = near.keyword GROUP BY 1, 2),
  chosen AS (SELECT tag, topic, similarity FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY similarity DESC, topic) AS r
                     FROM best) AS x WHERE r <= {TOP_N})"""
)
ALL_WORDS = [k for ks in TAG_WORDS.values() for k in ks]


def _similarity(spark, sf):
    return tp.keyword_similarity(tp.class_tfidf(load(spark, sf, NEWS)), ALL_WORDS)


@query(
    "keyword_topic_similarity",
    with_cte(SIMILARITY + " SELECT keyword, topic, round(similarity, 6) AS similarity FROM similarity", news=NEWS),
)
def keyword_topic_similarity(spark, sf):
    return _similarity(spark, sf).withColumn("similarity", r6("similarity"))


@query("context_topic_similarity")
def context_topic_similarity(spark, sf):
    """Topics near a keyword in the space of word vectors learned from the news, whether or not they hold it."""
    news = load(spark, sf, NEWS)
    weights = tp.class_tfidf(news)
    counts = weights.groupBy("term").agg(F.sum("tf").alias("n"))
    return co.context_similarity(weights, co.word_vectors(news, counts=counts), ALL_WORDS)


@query(
    "vector_topic_similarity",
    """WITH parts AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
       means AS (SELECT label AS topic, pos, avg(x) AS c FROM parts GROUP BY 1, 2)
       SELECT vec_id, topic, round(sum(x * c) / sqrt(sum(x * x)) / sqrt(sum(c * c)), 6) AS similarity
       FROM parts JOIN means ON parts.pos = means.pos GROUP BY 1, 2""",
)
def vector_topic_similarity(spark, sf):
    vectors = table(spark, sf, "embeddings")
    centres = tp.topic_vectors(vectors, "label")
    return tp.vector_similarity(vectors, centres, "vec_id", "embedding").withColumn("similarity", r6("similarity"))


@query(
    "vector_topics_nearest",
    """WITH parts AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
       means AS (SELECT label AS topic, pos, avg(x) AS c FROM parts GROUP BY 1, 2),
       near AS (SELECT vec_id, topic, sum(x * c) / sqrt(sum(x * x)) / sqrt(sum(c * c)) AS similarity
                FROM parts JOIN means ON parts.pos = means.pos GROUP BY 1, 2),
       ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, topic) AS k FROM near)
       SELECT vec_id, topic, round(similarity, 6) AS similarity FROM ranked WHERE k <= 3""",
)
def vector_topics_nearest(spark, sf):
    vectors = table(spark, sf, "embeddings")
    near = tp.vector_similarity(vectors, tp.topic_vectors(vectors, "label"), "vec_id", "embedding", top_n=3)
    return near.withColumn("similarity", r6("similarity"))


@query(
    "topics_per_keyword",
    with_cte(
        NEAR + ' SELECT keyword, topic, round(similarity, 6) AS similarity, CAST("rank" AS INTEGER) AS "rank" FROM near',
        news=NEWS,
    ),
)
def topics_per_keyword(spark, sf):
    return tp.topics_per_keyword(_similarity(spark, sf), TOP_N).withColumn("similarity", r6("similarity"))


@query(
    "relevant_topics",
    with_cte(
        NEAR + " SELECT topic, round(similarity, 6) AS similarity FROM chosen WHERE tag = 'conflict'",
        news=NEWS,
    ),
)
def relevant_topics(spark, sf):
    out = tp.relevant_topics(_similarity(spark, sf), TAG_WORDS["conflict"], TOP_N, TOP_N)
    return out.withColumn("similarity", r6("similarity"))


TAGGED = (
    NEAR
    + ", tagged AS (SELECT doc_id, date, location, text, "
    + ", ".join(f"topic IN (SELECT topic FROM chosen WHERE tag = '{t}') AS {t}" for t in TAG_WORDS)
    + " FROM news)"
)


@query("topic_tags", with_cte(TAGGED + f" SELECT doc_id, {', '.join(TAG_WORDS)} FROM tagged", news=NEWS))
def topic_tags(spark, sf):
    from panelforecast.plans.datasets import tag_corpus

    return tag_corpus(load(spark, sf, NEWS), TAG_WORDS, TOP_N, TOP_N).select("doc_id", *TAG_WORDS)
