"""Gap-aware features of a (date, entity) panel.

Offsets count *present dates*: a month in which no entity has a row does not exist,
and a date at which only this entity has no row is a gap. Each date gets its
position on the time axis, and windows run over ranges of positions, so a gap is
seen without building the dense date x entity grid.

Dates must be of type DATE. That bounds the time axis by the calendar (a few
million days at the very most, some hundred months in practice), which is why the
axis may be broadcast and numbered in one task, and why one entity's window holds
at most one row per calendar day however many rows the panel has.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DateType

from panelforecast.sources.stages import stage


@dataclass(frozen=True)
class LagSpec:
    """One lagged feature: rolling mean, then difference, then complete dates, then lag."""

    column: str
    lag: int
    rolling: int | None = None
    difference: bool = False
    dropna: bool = False

    @property
    def name(self) -> str:
        return f"{self.column}_lag_{self.lag}"


def _require_date(df: DataFrame, date: str) -> None:
    if not isinstance(df.schema[date].dataType, DateType):
        raise TypeError(f"{date} must be a DATE column, found {df.schema[date].dataType.simpleString()}")


def time_axis(panel: DataFrame, date: str = "date", *measures: Column) -> DataFrame:
    """Present dates with their position (1, 2, ...) and optional per-date aggregates."""
    _require_date(panel, date)
    per_date = panel.where(F.col(date).isNotNull()).groupBy(date).agg(F.count(F.lit(1)).alias("_rows"), *measures)
    return per_date.withColumn("_pos", F.row_number().over(Window.orderBy(date)))


def _entity_count(panel: DataFrame, entity: str) -> Column:
    return panel.select(entity).where(F.col(entity).isNotNull()).distinct().agg(F.count(F.lit(1))).scalar()


def duplicate_keys(panel: DataFrame, keys: Sequence[str] = ("date", "district")) -> DataFrame:
    """Key combinations that occur more than once, with their count."""
    return panel.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def assert_unique_key(panel: DataFrame, keys: Sequence[str] = ("date", "district")) -> DataFrame:
    clash = duplicate_keys(panel, keys).limit(1).collect()
    if clash:
        raise ValueError(f"duplicate key {clash[0].asDict()}")
    return panel


def _windowed(entity: str) -> Window:
    return Window.partitionBy(entity).orderBy("_pos")


def _once_per_date(w, value: Column, kind: str = "double") -> Column:
    """The value, or an error if an entity has two rows for one date."""
    copies = F.count(F.lit(1)).over(w.rangeBetween(0, 0))
    clash = F.raise_error(F.lit("duplicate (date, entity) key in the panel")).cast(kind)
    return F.when(copies > 1, clash).otherwise(value)


def _mean_at(w, column: str, size: int, back: int) -> Column:
    """Mean of ``size`` positions ending ``back`` positions ago; null unless all are present."""
    frame = w.rangeBetween(-(back + size - 1), -back)
    return F.when(F.count(column).over(frame) == size, F.avg(column).over(frame))


def _value_at(w, spec: LagSpec, back: int) -> Column:
    size = spec.rolling or 1
    value = _mean_at(w, spec.column, size, back)
    return value - _mean_at(w, spec.column, size, back + 1) if spec.difference else value


def rolling_mean(panel: DataFrame, column: str, size: int, out: str, date="date", entity="district") -> DataFrame:
    """Mean over the last ``size`` present dates, null unless every one has a value."""
    placed = _place(panel, date)
    w = _windowed(entity)
    return placed.withColumn(out, _once_per_date(w, _mean_at(w, column, size, 0))).drop("_pos")


def difference(panel: DataFrame, column: str, out: str, date="date", entity="district") -> DataFrame:
    """Change since the previous present date."""
    placed = _place(panel, date)
    w = _windowed(entity)
    change = F.col(column) - _mean_at(w, column, 1, 1)
    return placed.withColumn(out, _once_per_date(w, change)).drop("_pos")


def _place(panel: DataFrame, date: str) -> DataFrame:
    return panel.join(F.broadcast(time_axis(panel, date).select(date, "_pos")), date)


def complete_dates(panel: DataFrame, column: str, date="date", entity="district") -> DataFrame:
    """Dates at which every entity of the panel has a value, with their position among these."""
    axis = time_axis(panel, date, F.count(column).alias("_filled"))
    return axis.where(F.col("_filled") == _entity_count(panel, entity)).select(
        date, F.row_number().over(Window.orderBy(date)).alias("position")
    )


def lag_features(
    panel: DataFrame, specs: Sequence[LagSpec], date: str = "date", entity: str = "district"
) -> DataFrame:
    """Add one column per spec; later specs of the same name win.

    Lagged rolling means and differences are frames shifted back by the lag, so all
    specs without ``dropna`` share one window over one shuffle by entity. Specs with
    ``dropna`` look at complete dates only: there every entity has a value, hence the
    k-th earlier complete date is the k-th earlier value kept for the entity.
    """
    specs = list({s.name: s for s in specs}.values())
    plain = [s for s in specs if not s.dropna]
    direct = [s for s in specs if s.dropna and not s.rolling and not s.difference]
    shaped = [s for s in specs if s.dropna and (s.rolling or s.difference)]
    w = _windowed(entity)

    counted = sorted({s.column for s in direct})
    axis = time_axis(panel, date, *[F.count(c).alias(f"_n_{c}") for c in counted])
    entities = _entity_count(panel, entity)
    axis = axis.select(
        date, "_pos", *[(F.col(f"_n_{c}") == entities).alias(f"_full_{c}") for c in counted]
    )
    out = panel.drop(*[s.name for s in specs]).join(F.broadcast(axis), date)

    shapes = {f"_shape_{i}": s for i, s in enumerate(shaped)}
    out = out.withColumns(
        {s.name: _once_per_date(w, _value_at(w, s, s.lag)) for s in plain}
        | {name: _value_at(w, s, 0) for name, s in shapes.items()}
        | {f"_kept_{c}": F.when(F.col(f"_full_{c}"), F.col(c)) for c in counted}
    )
    if shapes:
        full = out.groupBy(date).agg(*[(F.count(n) == entities).alias(f"_full{n}") for n in shapes])
        out = out.join(F.broadcast(full), date)
        out = out.withColumns({f"_kept{n}": F.when(F.col(f"_full{n}"), F.col(n)) for n in shapes})

    def kept_lag(kept: str, flag: str, lag: int) -> Column:
        earlier = F.lag(kept, lag).over(w) if lag == 0 else F.expr(
            f"lag(`{kept}`, {lag}) ignore nulls over (partition by `{entity}` order by `_pos`)"
        )
        return _once_per_date(w, F.when(F.col(flag), earlier))

    lagged = {s.name: kept_lag(f"_kept_{s.column}", f"_full_{s.column}", s.lag) for s in direct}
    lagged |= {s.name: kept_lag(f"_kept{n}", f"_full{n}", s.lag) for n, s in shapes.items()}
    return out.withColumns(lagged).select(*[c for c in panel.columns if c not in lagged], *[s.name for s in specs])


def densify(panel: DataFrame, date: str = "date", entity: str = "district") -> DataFrame:
    """Every present date for every entity, gaps filled with nulls; ``present`` marks real rows.

    Each row is followed by the filler rows up to the entity's next row (and the first
    one preceded by those before it): one shuffle by entity, no date x entity product.
    Two rows of an entity for one date are an error.
    """
    axis = time_axis(panel, date).select(date, "_pos")
    last = axis.agg(F.max("_pos")).scalar()
    w = _windowed(entity)
    values = [c for c in panel.columns if c not in (date, entity)]
    placed = panel.join(F.broadcast(axis), date).withColumns(
        {
            "_from": F.when(F.row_number().over(w) == 1, F.lit(1)).otherwise(F.col("_pos")),
            "_to": _once_per_date(w, F.coalesce(F.lead("_pos").over(w) - 1, last), "int"),
        }
    )
    grid = placed.withColumn("_slot", F.explode(F.sequence("_from", "_to")))
    real = F.col("_slot") == F.col("_pos")
    filled = grid.select(
        F.col("_slot").alias("_pos"),
        entity,
        real.alias("present"),
        *[F.when(real, F.col(c)).alias(c) for c in values],
    )
    return filled.join(F.broadcast(axis), "_pos").select(date, entity, *values, "present")


def trim_to_first_label(
    panel: DataFrame, label: str, date: str = "date", entity: str = "district", source: DataFrame | None = None
) -> DataFrame:
    """Drop the rows that precede, in (date, entity) order, the first labelled one; keep all if none is.

    ``source`` may name the table ``panel`` was derived from, to look the bound up there.
    """
    here = F.struct(date, entity)
    first = (source or panel).agg(F.min(F.when(F.col(label).isNotNull(), here)).alias("first")).scalar()
    return panel.where(first.isNull() | (here >= first))


def latest_lag_column(df: DataFrame, label: str = "ipc") -> str:
    """The lag of the label that rows are dropped by: the third, else the first, else the longest there is."""
    lags = [int(c.rpartition("_")[2]) for c in df.columns if c.startswith(f"{label}_lag_") and c.rpartition("_")[2].isdigit()]
    return f"{label}_lag_{3 if 3 in lags else 1 if 1 in lags or not lags else max(lags)}"


def drop_null_lag(df: DataFrame, column: str | None = None) -> DataFrame:
    return df.dropna(subset=[column or latest_lag_column(df)])


def interpolate_linear(
    df: DataFrame, columns: Sequence[str], groups: Sequence[str] = ("district",), order: str = "date"
) -> DataFrame:
    """Straight line between known values by row position within each group.

    Leading gaps stay null; trailing gaps repeat the last value. The look ahead is a
    running window in descending order, which costs a second sort but stays linear.
    """
    forward = Window.partitionBy(*groups).orderBy(order)
    behind = forward.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy(*groups).orderBy(F.col(order).desc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )

    def known(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct(F.col("_row").alias("at"), F.col(c).cast("double").alias("x")))

    out = df.withColumn("_row", F.row_number().over(forward))
    out = out.withColumns({f"_prev_{c}": F.last(known(c), ignorenulls=True).over(behind) for c in columns})
    out = out.withColumns({f"_next_{c}": F.last(known(c), ignorenulls=True).over(ahead) for c in columns})

    def filled(c: str) -> Column:
        prev, nxt = F.col(f"_prev_{c}"), F.col(f"_next_{c}")
        step = (nxt["x"] - prev["x"]) / (nxt["at"] - prev["at"])
        line = prev["x"] + step * (F.col("_row") - prev["at"])
        return F.when(F.col(c).isNotNull(), F.col(c).cast("double")).when(nxt.isNull(), prev["x"]).otherwise(line)

    helpers = ["_row", *[f"_prev_{c}" for c in columns], *[f"_next_{c}" for c in columns]]
    return out.withColumns({c: filled(c) for c in columns}).drop(*helpers)


def row_position(df: DataFrame, order: Sequence[str] = ("date", "district"), out: str = "position") -> DataFrame:
    """Zero-based position in the total order of ``order``, however a date's rows are spread.

    Rows are range partitioned, so even a date with most of the rows is cut into
    many tasks. Their place within the task is written with them; the start of each
    task then follows from the row counts, one per task.
    """
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_task", F.spark_partition_id())
        .withColumn("_seq", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    )
    placed = stage(placed, "ordered-rows")
    starts = placed.groupBy("_task").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), "_task").withColumn(out, F.col("_start") + F.col("_seq")).drop(
        "_task", "_seq", "_start"
    )
