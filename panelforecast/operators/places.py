"""Mapping article locations to districts by substring match in either direction.

The match is an equality join on pieces of the texts. A text that may lie inside others is
filed under one piece of its own, the rarest among the texts it may lie in; those look up
their pieces, and the whole text is verified where a piece is met. Pieces are as long as the
largest power of two that fits (at most 64), so a text has a piece for every start and few
lengths, however many lengths the gazetteer's names have, and a met piece is over half of a
text of usual length.
Neither many locations nor a long gazetteer turns into a nested loop.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from panelforecast.functions.columns import strip_direction_words
from panelforecast.operators.joins import lookup_join
from panelforecast.sources.stages import stage

NOT_ASSIGNED = "Not assigned"
ROW_NAMES = 100_000
# A power of two; it bounds the bytes of a long text's pieces by its length.
LONGEST_PIECE = 64


def gazetteer_of(panel: DataFrame, entity: str = "district") -> DataFrame:
    """Distinct district names without direction words."""
    names = panel.select(strip_direction_words(F.col(entity)).alias("district"))
    return names.where(F.col("district").isNotNull()).distinct()


def _piece_size(text: str) -> Column:
    """The largest power of two up to ``LONGEST_PIECE`` that is no longer than the text, 0 for the empty text."""
    size = F.least(F.length(text), F.lit(LONGEST_PIECE))
    return F.when(size > 0, F.pow(F.lit(2), F.length(F.bin(size)) - 1).cast("int")).otherwise(0)


def _pieces(text: Column | str, size: Column) -> Column:
    """Every distinct part of ``text`` of that size; size 0 gives the empty text, contained in everything."""
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, size)))


def contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """Pairs (inner, outer) of the distinct texts of two one-column tables where ``outer`` holds ``inner``.

    Every inner text is filed under its rarest piece, by the number of outer texts with it,
    ties to the smaller piece. A text of which some piece is in no outer text is in none itself
    and goes before anything is compared. Missing texts match nothing. A piece of the outer
    texts moves only if an inner text has it, and hot ones are spread.
    """
    own = inner.withColumn("piece", F.explode(_pieces("inner", _piece_size("inner"))))
    # no more sizes than a text's length has bits
    sizes = inner.where("inner is not null").agg(F.collect_set(_piece_size("inner"))).scalar()
    sized = outer.withColumn("_size", F.explode(sizes)).where(F.col("_size") <= F.length("outer"))
    parts = sized.select("outer", F.explode(_pieces("outer", F.col("_size"))).alias("piece"))
    known = lookup_join(parts, own.select("piece").distinct(), "piece", "left_semi", spread_by="outer")
    known = stage(known.select("outer", "piece"), "pieces")
    frequency = known.groupBy("piece").agg(F.count(F.lit(1)).alias("_n"))
    counted = lookup_join(own, frequency, "piece", "left", spread_by="inner")
    rarest = F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("piece")))
    filed = counted.groupBy("inner").agg(rarest.alias("_r")).where("_r.n > 0").select("inner", F.col("_r.piece").alias("piece"))
    met = lookup_join(known, filed, "piece", "inner", spread_by="outer")
    return met.where(F.contains("outer", "inner")).select("inner", "outer")


def match_locations(locations: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Pairs (place, district) for distinct lower-case places that contain a district
    name or are contained in one. An empty text is contained in everything."""
    names = gazetteer.select("district", F.lower("district").alias("name")).where("name is not null")
    distinct = stage(names.select("name").distinct(), "names")
    places = locations.select("place").where("place is not null")
    holds = contained(distinct.toDF("inner"), places.toDF("outer")).toDF("name", "place")
    # an equal pair is among the first ones
    held = contained(places.toDF("inner"), distinct.toDF("outer")).where("inner != outer").toDF("place", "name")
    pairs = stage(holds.unionByName(held), "place-names")
    return lookup_join(pairs, names, "name", "inner", spread_by="place").select("place", "district")


def _distinct_places(articles: DataFrame, location: str) -> DataFrame:
    """Staged, because matching needs them several times and the articles are large."""
    places = articles.select(F.lower(location).alias("place")).where("place is not null").distinct()
    return stage(places, "places")


def district_count_by_place(
    articles: DataFrame, gazetteer: DataFrame, location: str, out: str = "districts"
) -> DataFrame:
    places = _distinct_places(articles, location)
    return match_locations(places, gazetteer).groupBy("place").agg(F.count(F.lit(1)).alias(out))


def count_by_district(
    articles: DataFrame, gazetteer: DataFrame, location: str = "location", weight: str | None = None, label: str = NOT_ASSIGNED
) -> DataFrame:
    """``(district, count)`` as of ``map_articles(fallback="label")``: articles are counted per
    place first, and only the places meet the districts."""
    rows = F.sum(weight) if weight else F.count(F.lit(1))
    per_place = stage(articles.groupBy(F.lower(location).alias("place")).agg(rows.alias("_n")), "articles-per-place")
    pairs = match_locations(per_place.select("place").where("place is not null"), stage(gazetteer.select("district"), "gazetteer"))
    mapped = lookup_join(per_place, pairs, "place", "left", spread_by="place")
    return mapped.groupBy(F.coalesce("district", F.lit(label)).alias("district")).agg(F.sum("_n").alias("count"))


def map_articles(
    articles: DataFrame,
    gazetteer: DataFrame,
    fallback: str = "all",
    location: str = "location",
    key: str = "doc_id",
    label: str = NOT_ASSIGNED,
) -> DataFrame:
    """One row per article and matched district.

    Without a match (or without a location) an article goes to every district
    (``fallback="all"``) or to one row with ``label`` (``fallback="label"``).
    """
    if fallback not in ("all", "label"):
        raise ValueError(f"fallback must be 'all' or 'label', not {fallback!r}")
    gazetteer = stage(gazetteer.select("district"), "gazetteer")
    pairs = match_locations(_distinct_places(articles, location), gazetteer)
    placed = articles.drop("district").withColumn("place", F.lower(location))
    mapped = lookup_join(placed, pairs, "place", "left", spread_by=key).drop("place")
    if fallback == "label":
        return mapped.fillna(label, subset=["district"])
    return _to_every_district(mapped, gazetteer)


def _to_every_district(mapped: DataFrame, gazetteer: DataFrame, row_names: int = ROW_NAMES) -> DataFrame:
    """Give each row without a district all of them.

    The names are attached as one array and exploded where the article already is, so
    the articles do not move. Names too many for one row go in several passes, each
    with its share of them.
    """
    columns = [c for c in mapped.columns if c != "district"]
    passes = gazetteer.count() // row_names + 1
    share = F.pmod(F.xxhash64("district"), F.lit(passes))

    def names(i: int) -> Column:
        return gazetteer.where(share == i).agg(F.collect_list("district")).scalar()

    if passes == 1:
        goes_to = F.when(F.col("district").isNull(), names(0)).otherwise(F.array("district"))
        return mapped.select(*columns, F.explode(goes_to).alias("district"))
    unmatched = mapped.where("district is null")
    spread = [unmatched.select(*columns, F.explode(names(i)).alias("district")) for i in range(passes)]
    return reduce(DataFrame.unionByName, spread, mapped.where("district is not null").select(*columns, "district"))


def with_district_weight(
    articles: DataFrame, gazetteer: DataFrame, location: str = "location", key: str = "doc_id", out: str = "districts"
) -> DataFrame:
    """How many rows ``map_articles(fallback="all")`` makes of each article, without making them."""
    gazetteer = stage(gazetteer.select("district"), "gazetteer")
    counts = district_count_by_place(articles, gazetteer, location, out)
    everywhere = gazetteer.agg(F.count(F.lit(1))).scalar()
    placed = articles.withColumn("place", F.lower(location))
    joined = lookup_join(placed, counts, "place", "left", spread_by=key).drop("place")
    return joined.withColumn(out, F.coalesce(out, everywhere))
