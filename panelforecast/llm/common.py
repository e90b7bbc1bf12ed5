"""Small helpers shared by the document operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from panelforecast.operators.joins import lookup_join
from panelforecast.sources.stages import lean_shuffles, stage

SLICE_BYTES = 2 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of about ``limit`` bytes of text; a longer text is a run of its own.

    What a task holds as Python objects is then bounded by one run and one text, not by a batch.
    """
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    run = np.cumsum(sizes.astype(np.int64)) // limit
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
    for start, stop in zip(cuts, cuts[1:]):
        yield batch.slice(start, stop - start)


def held_out(id_column: str, parts: int, part: int) -> Column:
    """True for ids whose CRC-32, as text, leaves the remainder ``part``; a null id is learned from by no one."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % parts == part, F.lit(True))


def fitting_rows(rows: DataFrame, bound: int) -> list:
    """At most ``bound`` rows, the first by the column ``h``, a 64-bit hash: the same choice on any cluster.

    Rows are counted first. Only those below the hash that leaves half as many again as
    asked for are ordered, so that what the tasks send is bounded too, whatever their number.
    """
    share = min(1.0, 1.5 * bound / max(1, rows.count()))
    if share < 1.0:
        rows = rows.where(F.col("h") < F.lit(int(-(1 << 63) + share * (1 << 64))))
    return rows.orderBy(*rows.columns).limit(bound).collect()


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the ranges ``[start, start + length)``, one after another."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit values, so that near values get unrelated ones."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def lean_stage(df: DataFrame, name: str) -> DataFrame:
    """A stage table whose shuffle files go as soon as it is written: nothing reads them again."""
    with lean_shuffles(df.sparkSession):
        return stage(df, name)


def in_written_order(docs: DataFrame, out: str) -> DataFrame:
    """The rows with their position, from 0, in the order in which their files were written.

    Parts are ordered by their number, and rows as they lie in them: the order that a sorted
    table had when Spark wrote it, which reading does not keep. Rows that come from no file
    are written first, as they come.
    """
    file, row = "_file of the row", "_row in the file"
    try:
        rows = docs.withColumns({file: F.col("_metadata.file_path"), row: F.col("_metadata.row_index")})
    except AnalysisException:
        return in_written_order(stage(docs, "as-given"), out)
    name = F.element_at(F.split(F.col(f"`{file}`"), "/"), -1)
    part = F.coalesce(F.try_to_number(F.regexp_extract(name, r"^part-(\d+)", 1), F.lit("9999999999")), F.lit(0))
    files = rows.groupBy(f"`{file}`").agg((F.max(f"`{row}`") + 1).alias("rows")).withColumn("part", part)
    before = Window.orderBy("part", f"`{file}`").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    starts = files.select(f"`{file}`", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias(out))
    placed = lookup_join(rows, starts, file, "inner", spread_by=row)
    return placed.withColumn(out, F.col(out) + F.col(f"`{row}`")).drop(file, row)
