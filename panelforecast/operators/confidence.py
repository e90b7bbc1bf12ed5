"""How sure a classifier is, and how right it is when it is sure."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelforecast.functions.columns import round_to
from panelforecast.sources.stages import stage

# Cells of [0, 1] whose values are summed up by their powers for the density, and the highest power.
GRID = 4096
POWERS = 12

# Closed confidence ranges (low, high); neighbours share an end.
CONFIDENCE_RANGES = [(0.9, 1.0), (0.8, 0.9), (0.7, 0.8), (0.6, 0.7), (0.5, 0.6), (0.4, 0.5), (0.3, 0.4), (0.0, 0.3)]


def confidence_table(
    predictions: DataFrame, keys: Sequence[str] = (), label: str = "label", probability: str = "probability"
) -> DataFrame:
    """True class, most probable class (the first of equals) and its probability."""
    best = F.array_max(probability)
    return predictions.select(
        *keys,
        F.col(label).alias("true_val"),
        (F.array_position(F.col(probability), best) - 1).cast("int").alias("pred_val"),
        best.alias("pred_prob"),
    )


def between_zero_and_one(df: DataFrame, prob: str = "pred_prob") -> DataFrame:
    """Strictly inside (0, 1)."""
    return df.where((F.col(prob) > 0) & (F.col(prob) < 1))


def confidence_histogram(df: DataFrame, prob: str = "pred_prob", bins: int = 10) -> DataFrame:
    """Counts in equal bins of [0, 1], the last closed, empty ones included."""
    inside = between_zero_and_one(df, prob)
    edge = lambda i: F.lit(i / bins)
    cells = [
        F.struct(
            F.lit(i).alias("bin"),
            edge(i).alias("low"),
            edge(i + 1).alias("high"),
            F.count_if((F.col(prob) >= edge(i)) & ((F.col(prob) < edge(i + 1)) | F.lit(i == bins - 1))).alias("rows"),
        )
        for i in range(bins)
    ]
    return inside.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def confidence_cells(
    df: DataFrame,
    prob: str = "pred_prob",
    grid: int = GRID,
    bins: int = 10,
    ranges: Sequence[tuple[float, float]] = CONFIDENCE_RANGES,
) -> DataFrame:
    """Counts and moments of the probabilities per cell of a fine grid, histogram bin, set of
    ranges and whether the class was right: a table of bounded size, whatever the rows.

    ``bin`` counts from 0; bit i of ``ranges`` says that range i holds the value. ``m1`` to
    ``m12`` are the sums of the powers of the distance from the cell's centre, in cells.
    """
    p = F.col("p")
    inside = between_zero_and_one(df, prob).select(
        F.col(prob).cast("double").alias("p"), (F.col("true_val") == F.col("pred_val")).alias("right")
    )
    number = sum((F.when(p >= F.lit(i / bins), 1).otherwise(0) for i in range(1, bins)), F.lit(0))
    held = sum((F.when(p.between(low, high), 1 << i).otherwise(0) for i, (low, high) in enumerate(ranges)), F.lit(0))
    keyed = inside.select("p", "right", F.floor(p * grid).cast("int").alias("cell"), number.alias("bin"), held.alias("ranges"))
    return _with_powers(keyed, grid).groupBy("cell", "bin", "ranges", "right").agg(*_moments())


def _with_powers(keyed: DataFrame, grid: int) -> DataFrame:
    return keyed.withColumn("off", F.col("p") * grid - F.col("cell") - F.lit(0.5))


def _moments() -> list[Column]:
    powers = [F.sum(F.pow("off", F.lit(float(k)))).alias(f"m{k}") for k in range(1, POWERS + 1)]
    return [
        F.count(F.lit(1)).alias("rows"), F.avg("p").alias("mean"), F.var_pop("p").alias("var"), F.min("p").alias("low"), F.max("p").alias("high"), *powers,
    ]


def histogram_of(cells: DataFrame, bins: int = 10) -> DataFrame:
    """``confidence_histogram`` from the cells."""
    parts = [
        F.struct(
            F.lit(i).alias("bin"), F.lit(i / bins).alias("low"), F.lit((i + 1) / bins).alias("high"),
            F.coalesce(F.sum(F.when(F.col("bin") == i, F.col("rows"))), F.lit(0)).alias("rows"),
        )
        for i in range(bins)
    ]
    return cells.agg(F.array(*parts).alias("parts")).select(F.inline("parts"))


def accuracy_of(cells: DataFrame, ranges: Sequence[tuple[float, float]] = CONFIDENCE_RANGES) -> DataFrame:
    """``accuracy_by_confidence`` from the cells."""

    def part(i: int, low: float, high: float) -> Column:
        mine = F.col("ranges").bitwiseAND(1 << i) != 0
        known = F.sum(F.when(mine & F.col("right").isNotNull(), F.col("rows")))
        return F.struct(
            F.lit(float(low)).alias("low"),
            F.lit(float(high)).alias("high"),
            F.coalesce(F.sum(F.when(mine, F.col("rows"))), F.lit(0)).alias("rows"),
            F.coalesce(F.sum(F.when(mine & F.col("right"), F.col("rows"))) / known, F.when(known.isNotNull(), 0.0), F.lit(0.0)).alias("accuracy"),
        )

    parts = [part(i, low, high) for i, (low, high) in enumerate(ranges)]
    return cells.agg(F.array(*parts).alias("parts")).select(F.inline("parts"))


def _hermite(order: int) -> list[list[float]]:
    """Coefficients of the Hermite polynomials He_0 to He_order, lowest power first."""
    out = [[1.0], [0.0, 1.0]]
    for k in range(1, order):
        up, down = [0.0, *out[k]], [k * c for c in out[k - 1]]
        out.append([a - b for a, b in zip(up, down + [0.0] * (len(up) - len(down)))])
    return out


def density_of(cells: DataFrame, points: int = 200, grid: int = GRID, finer: Callable[[int], DataFrame] | None = None) -> DataFrame:
    """``confidence_kde`` from the cells.

    The kernel of a value v at a point x is expanded about the centre c of v's cell: with
    u = (x - c) / h and s = (v - c) / h it is exp(-u^2 / 2) times the sum of He_k(u) s^k / k!, so
    that a cell counts by its sums of powers. By Cramer's bound what is left out after the
    12th power is at most 1.09 times the sum over k > 12 of |s|^k / sqrt(k!) of the kernel's height: below
    2e-9 of it for |s| up to 1/2, which holds where a cell is no wider than the bandwidth. Where
    it is wider, ``finer`` is asked for cells of a grid that is fine enough.
    """
    shape = cells.agg(
        F.sum("rows").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.try_divide(F.sum(F.col("mean") * F.col("rows")), F.sum("rows")).alias("mean"),
    ).first()
    rows = shape["rows"] or 0
    spread = cells.agg(F.sum(F.col("rows") * (F.col("var") + F.pow(F.col("mean") - F.lit(shape["mean"]).cast("double"), F.lit(2.0))))).first()[0] if rows > 1 else 0.0
    width = rows**-0.2 * math.sqrt(spread / (rows - 1)) if spread else 0.0
    steps = cells.sparkSession.range(points if rows else 0).select(F.col("id").cast("int").alias("point"))
    low, high = shape["low"] or 0.0, shape["high"] or 0.0
    x = F.lit(low) + F.lit(high - low) * F.col("point") / F.lit(float(max(1, points - 1)))
    if not width:  # no row, or all values equal: there is no density
        return steps.select("point", x.alias("x"), F.lit(None).cast("double").alias("density"))
    if grid * width < 1 and finer is not None:
        grid = 1 << math.ceil(math.log2(1 / width))
        cells = finer(grid)
    scale = 1.0 / (grid * width)
    sums = cells.groupBy("cell").agg(F.sum("rows").cast("double").alias("m0"), *[F.sum(f"m{k}").alias(f"m{k}") for k in range(1, POWERS + 1)])
    hermite = _hermite(POWERS)
    powers = [
        sum((F.col(f"m{k}") * F.lit(scale**k / math.factorial(k) * c[j]) for k, c in enumerate(hermite) if j < len(c) and c[j]), F.lit(0.0)).alias(f"b{j}")
        for j in range(POWERS + 1)
    ]
    centre = (F.col("cell") + F.lit(0.5)) / F.lit(float(grid))
    placed = sums.select(centre.alias("c"), *powers, F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    placed = placed.withColumn("u", (x - F.col("c")) / F.lit(width))
    value = F.col(f"b{POWERS}")
    for j in range(POWERS - 1, -1, -1):
        value = value * F.col("u") + F.col(f"b{j}")
    bump = F.exp(-0.5 * F.col("u") * F.col("u")) * value
    return placed.groupBy("point").agg(F.min(x).alias("x"), (F.sum(bump) / F.lit(rows * width * math.sqrt(2 * math.pi))).alias("density"))


def finer_cells(df: DataFrame, prob: str = "pred_prob") -> Callable[[int], DataFrame]:
    """For ``density_of``: one more pass over the rows, into the cells of a finer grid."""

    def cells(grid: int) -> DataFrame:
        inside = between_zero_and_one(df, prob).select(F.col(prob).cast("double").alias("p"))
        return _with_powers(inside.withColumn("cell", F.floor(F.col("p") * grid)), grid).groupBy("cell").agg(*_moments())

    return cells


def confidence_kde(df: DataFrame, prob: str = "pred_prob", points: int = 200, grid: int = GRID) -> DataFrame:
    """Gaussian density with Scott's bandwidth at even points from the least to the greatest value.

    Equal to the sum of all kernels but for an error below 2e-9 of one kernel's height (see
    ``density_of``). What meets the points are cells, not rows. The density is null without a
    row and where all values are equal.
    """
    return density_of(stage(confidence_cells(df, prob, grid), "confidence-cells"), points, grid, finer_cells(df, prob))


def accuracy_by_confidence(
    df: DataFrame, ranges: Sequence[tuple[float, float]] = CONFIDENCE_RANGES, prob: str = "pred_prob"
) -> DataFrame:
    """Accuracy within each closed range, 0 where it is empty; a shared end counts in both ranges."""
    inside = between_zero_and_one(df, prob)
    right = (F.col("true_val") == F.col("pred_val")).cast("double")

    def cell(low: float, high: float) -> Column:
        hit = F.col(prob).between(low, high)
        return F.struct(
            F.lit(float(low)).alias("low"),
            F.lit(float(high)).alias("high"),
            F.count_if(hit).alias("rows"),
            F.coalesce(F.avg(F.when(hit, right)), F.lit(0.0)).alias("accuracy"),
        )

    return inside.agg(F.array(*[cell(lo, hi) for lo, hi in ranges]).alias("cells")).select(F.inline("cells"))


def explain_predictions(
    predictions: DataFrame, keys: Sequence[str], label: str = "label", probability: str = "probability", digits: int = 2
) -> DataFrame:
    """Rounded class probabilities next to predicted and true score (1-based) and confidence in percent."""
    best = F.array_max(probability)
    return predictions.select(
        *keys,
        F.transform(probability, lambda p: round_to(p, digits)).alias("probabilities"),
        F.array_position(F.col(probability), best).cast("int").alias("predicted_score"),
        round_to(100 * best, digits).alias("confidence_pct"),
        (F.col(label) + 1).cast("int").alias("true_score"),
    )
