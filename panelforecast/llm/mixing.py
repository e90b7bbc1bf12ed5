"""Mixing sources to target weights by a Pfair schedule of their blocks."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK_ROWS = 16
ROWS_A_BUCKET = 1_000
BROADCAST_SLOTS = 1 << 20


def schedule(shares: dict[int, int], blocks: dict[int, int] | None = None) -> list[tuple[int, int, int]]:
    """``(source, k, slot)`` of one period, by earliest deadline first.

    With ``blocks``, how many blocks each source has, it ends as soon as these have their slots.

    A source with the share a of a period of Q slots has its k-th block (from 0)
    released at slot floor(k Q / a) and due by slot ceil((k + 1) Q / a). In every slot the
    released block with the earliest deadline goes, of equal ones the source with the
    smaller number. The shares add up to Q, so on one line every deadline is met: after t
    slots each source has had more than t a / Q - 1 and fewer than t a / Q + 1 blocks.
    """
    period = sum(shares.values())
    done = dict.fromkeys(shares, 0)
    coming = [(0, s) for s in shares]
    heapq.heapify(coming)
    ready: list[tuple[int, int]] = []
    out = []
    left = sum(min(a, blocks[s]) for s, a in shares.items()) if blocks is not None else period
    for slot in range(period):
        if not left:
            break
        while coming and coming[0][0] <= slot:
            s = heapq.heappop(coming)[1]
            heapq.heappush(ready, (-(-(done[s] + 1) * period // shares[s]), s))
        source = heapq.heappop(ready)[1]
        out.append((source, done[source], slot))
        left -= blocks is None or done[source] < blocks[source]
        done[source] += 1
        if done[source] < shares[source]:
            heapq.heappush(coming, (done[source] * period // shares[source], source))
    return out


def flattened(rows: Column) -> Column:
    """The default weight of a source: the root of its row count, rounded down, the usual flattening of large sources."""
    return F.floor(F.sqrt(rows)).cast("long")


def _shares(weights: list[tuple], period: int | None = None) -> list[tuple[int, object, int]]:
    """``(number, source, share)`` in the order of the sources: the weights without their common divisor.

    They add up to the shortest period that holds the weights exactly; with ``period`` to
    the longest repeat of it that is no longer. Where not even one fits, nothing is rounded.
    """
    ranked = sorted(weights, key=lambda w: (w[0] is not None, w[0] or ""))
    common = math.gcd(*(w for _, w in ranked)) or 1
    exact = sum(w for _, w in ranked) // common
    if period is not None and exact > period:
        raise ValueError(f"{len(ranked)} sources with these weights need a period of {exact} slots, more than {period}")
    repeat = period // exact if period is not None and exact else 1
    return [(i, s, w // common * repeat) for i, (s, w) in enumerate(ranked)]


def _numbered(rows: DataFrame) -> DataFrame:
    """``source_row``: the place of a row among its source's, by key, then id.

    Buckets are ranges of the key's first digits, so numbers within a bucket and the sizes
    of the buckets before it give the place. Their number follows the table's size.
    """
    buckets = 1 << (rows.count() // ROWS_A_BUCKET).bit_length()
    digits = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("bucket", F.floor(digits * F.lit(buckets) / F.lit(1 << 32)).cast("int"))
    sizes = rows.groupBy("number", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("number").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("number", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("number", "bucket").orderBy("key", "id")
    rows = rows.withColumn("r", F.row_number().over(within) - 1)
    return rows.join(sizes, ["number", "bucket"]).withColumn("source_row", F.col("r") + F.col("start")).drop("bucket", "r", "start")


def pfair_mix(
    docs: DataFrame,
    weights: DataFrame | dict | None = None,
    id_column: str = "doc_id",
    source_column: str = "source",
    period: int | None = None,
    block_rows: int = BLOCK_ROWS,
    whole_rows: bool = False,
) -> DataFrame:
    """``(id, source, source_row, block, slot)``: the place of every row in the mixture.

    A source's rows are shuffled by the MD5 of their id and cut into blocks of
    ``block_rows``; its k-th block takes the slot that the schedule gives it. The schedule
    repeats after the sum of the weights (without their common divisor), so at most one period
    is ever worked out, no further than there are blocks, and blocks beyond it follow by
    arithmetic, whatever their number.
    While a source lasts, it is less than one block off the weight asked for at every slot;
    slots of a source that has ended stay empty, which leaves the others' proportions as
    they are. No row is dropped or repeated: reading by slot, then ``source_row``, gives the
    mixture.

    ``weights`` (source to positive whole number, a dict or a table ``(source, weight)``,
    the largest of several) default to ``flattened``; a source without a weight gets 1.
    The sources and one period pass through the driver. With ``period`` weights that no
    period of so many slots holds exactly raise ``ValueError``. A null source is a source of
    its own. Rows with equal ids come next to each other. With ``whole_rows`` the rows
    themselves come along as the struct ``row``. Rows are numbered within buckets of a
    source, so that the largest source is never sorted in one task. Empty input gives no rows.
    """
    spark = docs.sparkSession
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if whole_rows else []
    rows = docs.select(F.col(id_column).alias("id"), F.col(source_column).cast("string").alias("source"), *row)
    rows = rows.withColumn("key", F.md5(F.coalesce(F.col("id").cast("string"), F.lit(""))))
    counted = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    counted = counted.withColumn("weight", flattened(F.col("n")))
    if isinstance(weights, DataFrame):
        given = weights.groupBy(F.col("source").cast("string").alias("name")).agg(F.max("weight").alias("given"))
        counted = counted.join(given, counted["source"].eqNullSafe(given["name"]), "left").select("source", "n", F.col("given").alias("weight"))
    found = counted.collect()
    asked = [(r.source, r.weight) for r in found]
    if isinstance(weights, dict):
        asked = [(s, weights.get(s)) for s, _ in asked]
    shares = _shares([(s, max(1, int(w or 1))) for s, w in asked], period)
    slots = sum(a for *_, a in shares)
    blocks = {r.source: -(-r.n // block_rows) for r in found}
    planned = np.array(schedule({i: a for i, _, a in shares}, {i: blocks[s] for i, s, _ in shares}), np.int64).reshape(-1, 3)
    plan = spark.createDataFrame(pa.table({c: planned[:, i] for i, c in enumerate(("number", "k", "at"))}))
    share = spark.createDataFrame(shares, "number long, name string, share long")
    if len(planned) <= BROADCAST_SLOTS:  # there are no more sources than slots worked out
        plan, share = F.broadcast(plan), F.broadcast(share)
    numbered = _numbered(rows.join(share, rows["source"].eqNullSafe(share["name"])).drop("name"))
    placed = numbered.withColumn("block", F.floor(F.col("source_row") / block_rows)).withColumn("k", F.pmod("block", "share"))
    return placed.join(plan, ["number", "k"]).select(
        F.col("id").alias(id_column),
        F.col("source").alias(source_column),
        "source_row",
        "block",
        (F.floor(F.col("block") / F.col("share")) * slots + F.col("at")).alias("slot"),
        *(["row"] if whole_rows else []),
    )
