"""Joining facts to a derived lookup table, whatever size the lookup turns out to have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType

from panelforecast.sources.stages import stage

BROADCAST_BYTES = 64 * 1024 * 1024
# A key is hot if it has more rows than this many average tasks.
HOT_TASKS = 2
# Items the sketch follows for every key that can be hot; its limits are Spark's.
TRACKED_PER_KEY = 40
MOST_HOT, MOST_TRACKED = 25_000, 1_000_000


def _row_bytes(df: DataFrame) -> Column:
    width = F.lit(16)
    for field in df.schema:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (StringType, BinaryType)):
            width = width + F.coalesce(F.octet_length(column), F.lit(0)) + 16
        elif isinstance(field.dataType, ArrayType):
            width = width + F.coalesce(F.length(column.cast("string")), F.lit(0)) + 16
        else:
            width = width + 8
    return width


def measured_bytes(df: DataFrame) -> int:
    """In-memory size of a staged table, by one aggregate over it."""
    return df.agg(F.coalesce(F.sum(_row_bytes(df).cast("long")), F.lit(0))).first()[0]


def _tasks(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def hot_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys with more rows than ``HOT_TASKS`` average tasks, and how many tasks' worth each has (``_slots``).

    There cannot be more than a ``HOT_TASKS``-th of the tasks of them, whatever the data.
    The sketch merges on the map side and has a fixed size, so finding the heavy keys
    moves no rows. A key it misses is merely not spread.
    """
    tasks = _tasks(df)
    most = min(MOST_HOT, tasks // HOT_TASKS + 1)
    sketch = df.where(F.col(key).isNotNull()).agg(
        F.expr(f"approx_top_k(`{key}`, {most}, {min(MOST_TRACKED, TRACKED_PER_KEY * most + 1000)})").alias("top"),
        F.count(F.lit(1)).alias("total"),
    )
    heavy = sketch.select("total", F.explode("top").alias("entry"))
    share = F.col("total") / F.lit(tasks)
    return heavy.where(F.col("entry.count") > share * HOT_TASKS).select(
        F.col("entry.item").alias(key), F.ceil(F.col("entry.count") / share).cast("int").alias("_slots")
    )


def spread_join(facts: DataFrame, lookup: DataFrame, key: str, how: str, spread_by: str) -> DataFrame:
    """Shuffled join in which the rows of a hot key go to as many tasks as they would fill,
    and rows without a key to all.

    The spread is a hash of a column of the row, never a random number: a
    recomputed task must send each row to the same place.
    """
    hot = F.broadcast(stage(hot_keys(facts, key), "hot-keys"))
    # rows without a key match nothing, yet an outer join would send them all to one task:
    # they get a key of their own slot that no lookup row has
    slots = F.when(F.col(key).isNull(), _tasks(facts)).otherwise(F.coalesce("_slots", F.lit(1)))
    left = facts.join(hot, key, "left").withColumn("_slot", F.pmod(F.xxhash64(spread_by), slots).cast("int")).drop("_slots")
    copies = F.sequence(F.lit(0), F.coalesce("_slots", F.lit(1)) - 1)
    right = lookup.join(hot, key, "left").withColumn("_slot", F.explode(copies)).drop("_slots")
    return left.join(right, [key, "_slot"], how).drop("_slot")


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    key: str,
    how: str = "left",
    *,
    spread_by: str,
    limit_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join facts to a lookup derived by aggregation.

    The lookup is staged and measured. Within the limit it is broadcast and the
    facts do not move; beyond it both sides are shuffled with hot keys spread.
    """
    lookup = stage(lookup, "lookup")
    if measured_bytes(lookup) <= limit_bytes:
        return facts.join(F.broadcast(lookup), key, how)
    return spread_join(facts, lookup, key, how, spread_by)
