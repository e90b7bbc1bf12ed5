"""Train/test splits and what has to be known about each training part."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelforecast.functions.columns import hash_uniform


def time_series_folds(rows: DataFrame, splits: int = 5, position: str = "position") -> DataFrame:
    """Expanding-window folds by row position, in long form: one row per (row, fold it is used in).

    With t = n div (splits + 1), fold i tests the t rows from n - (splits - i) t on and
    trains on everything before. Which folds use a row follows from its position alone,
    so the copies are made in place, without a join.
    """
    size = rows.agg(F.count(F.lit(1))).scalar()
    block = F.floor(size / F.lit(splits + 1)).cast("long")
    start = size - block * splits
    ahead = F.col(position) - start
    # fold this row is tested in; -1 for the rows before the first test block
    tested = F.when(ahead < 0, F.lit(-1)).otherwise(F.floor(ahead / block).cast("int"))
    fold = F.explode(F.sequence(F.greatest(tested, F.lit(0)), F.lit(splits - 1)))
    return (
        rows.withColumn("_tested", tested)
        .withColumn("fold", fold)
        .withColumn("role", F.when(F.col("_tested") == F.col("fold"), "test").otherwise("train"))
        .drop("_tested")
    )


def holdout_split(df: DataFrame, keys: Sequence[str], test_size: float = 0.2, seed: int = 69) -> DataFrame:
    """Random split by key hash: the same rows whatever the partitioning."""
    key = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    return df.withColumn("role", F.when(hash_uniform(key, seed) < test_size, "test").otherwise("train"))


def column_coverage(folds: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per fold and column: training values present, and whether they vary. One pass for all folds."""
    train = folds.where(F.col("role") == "train")
    stats = [
        F.struct(
            F.lit(c).alias("column"),
            F.count(c).alias("values"),
            F.coalesce(F.min(c) < F.max(c), F.lit(False)).alias("varies"),
        )
        for c in columns
    ]
    wide = train.groupBy("fold").agg(F.array(*stats).alias("stats"))
    return wide.select("fold", F.explode("stats").alias("s")).select("fold", "s.column", "s.values", "s.varies")


def live_columns_per_fold(folds: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns with at least one training value, per fold."""
    return column_coverage(folds, columns).where("values > 0").select("fold", "column", "values")


def block_starts(size: int, splits: int) -> list[int]:
    """The position each fold's test block starts at; everything before it is the fold's training part."""
    return [size - (splits - f) * (size // (splits + 1)) for f in range(splits)]


def first_fold(starts: Sequence[int], position: str = "position") -> Column:
    """The first fold that trains on a row: as many as there are test blocks that start at or before it."""
    return sum(((F.col(position) >= s).cast("int") for s in starts), F.lit(0))


def interpolated_versions(rows: DataFrame, columns: Sequence[str], splits: int, group: str = "district", position: str = "position") -> DataFrame:
    """Training rows with their gaps filled as each fold fills them, without a copy for each fold.

    ``rows`` have their ``epoch``, the first fold that trains on them. Within a group a gap
    lies on the line between its known neighbours; after the last known value that a fold
    sees it repeats that one; before the first it stays null. So a row changes only when a
    later fold gets to see the value after a gap: most rows have one version for all folds, a
    row before a group's last known value of a fold one more. A version is valid for the
    folds from ``since`` to before ``until``.
    """
    inside = rows.where(F.col("epoch") < splits)
    forward = Window.partitionBy(group).orderBy(position)
    behind = forward.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy(group).orderBy(F.col(position).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = inside.withColumn("_at", F.row_number().over(forward))
    values = {c: F.col(f"`{c}`") for c in columns}

    def known(c: str) -> Column:
        return F.when(values[c].isNotNull(), F.struct(F.col("_at").alias("at"), values[c].cast("double").alias("x"), "epoch"))

    before, after = {c: f"_before {c}" for c in columns}, {c: f"_after {c}" for c in columns}
    found = found.withColumns({before[c]: F.last(known(c), ignorenulls=True).over(behind) for c in columns})
    found = found.withColumns({after[c]: F.last(known(c), ignorenulls=True).over(ahead) for c in columns})

    def later(c: str) -> Column:
        gap = values[c].isNull() & F.col(f"`{before[c]}`").isNotNull()
        return F.when(gap & (F.col(f"`{after[c]}`.epoch") > F.col("epoch")), F.col(f"`{after[c]}`.epoch"))

    changes = F.array_sort(F.array_distinct(F.array_compact(F.array("epoch", *[later(c) for c in columns]))))
    found = found.withColumn("_changes", changes).select("*", F.posexplode("_changes").alias("_nth", "since"))

    def filled(c: str) -> Column:
        prev, nxt = F.col(f"`{before[c]}`"), F.col(f"`{after[c]}`")
        line = prev["x"] + (nxt["x"] - prev["x"]) / (nxt["at"] - prev["at"]) * (F.col("_at") - prev["at"])
        seen = nxt.isNotNull() & (nxt["epoch"] <= F.col("since"))
        return F.when(values[c].isNotNull(), values[c].cast("double")).when(seen, line).otherwise(prev["x"])

    until = F.coalesce(F.get("_changes", F.col("_nth") + 1), F.lit(splits))
    return found.select(*[filled(c).alias(c) for c in columns], "since", until.alias("until"))
