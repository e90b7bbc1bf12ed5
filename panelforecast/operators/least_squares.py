"""Least squares of any rank from sums of products, which one aggregate gives."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Of the centred and scaled features' products: a direction with less than this share of the
# largest eigenvalue is taken as collinear. Sums in doubles do not resolve much less.
COLLINEAR = 1e-12
# A column whose variance is below this share of its squared mean is constant but for rounding.
CONSTANT = 1e-27


@dataclass
class Moments:
    """Count, means and centred products of some columns; the label is the last one."""

    rows: int
    means: np.ndarray
    products: np.ndarray

    @staticmethod
    def of_sums(rows: int, sums: np.ndarray, products: np.ndarray, shift: np.ndarray) -> Moments:
        """From sums and products of values that ``shift`` was taken from; best near the means."""
        rows = int(rows)
        off = sums / rows if rows else sums * 0.0
        return Moments(rows, shift + off, products - rows * np.outer(off, off))


def product_sums(columns: Sequence[Column], where: Column | None = None) -> list[Column]:
    """Aggregates for ``read_sums``: the count, the sums, and the products of all pairs, rows with a null left out."""
    whole = F.lit(True)
    for c in columns:
        whole = whole & c.isNotNull()
    if where is not None:
        whole = whole & F.coalesce(where, F.lit(False))
    sums = [F.sum(F.when(whole, 1.0).otherwise(0.0)), *[F.sum(F.when(whole, c)) for c in columns]]
    pairs = [F.sum(F.when(whole, columns[i] * columns[j])) for i in range(len(columns)) for j in range(i + 1)]
    return [F.coalesce(s, F.lit(0.0)) for s in (*sums, *pairs)]


def read_sums(values: Sequence[float], width: int) -> tuple[float, np.ndarray, np.ndarray]:
    """``(rows, sums, products)`` of the values of ``product_sums``."""
    numbers = np.array(values, dtype=float)
    products = np.zeros((width, width))
    products[np.tril_indices(width)] = numbers[1 + width :]
    return numbers[0], numbers[1 : 1 + width], products + np.tril(products, -1).T


def moments(rows: DataFrame, features: Sequence[str], label: str) -> Moments:
    """Of the complete rows, in two aggregates: means, then products of the values less the means."""
    values = [F.col(f"`{c}`").cast("double") for c in (*features, label)]
    shift = np.array([m or 0.0 for m in rows.dropna(subset=[*features, label]).agg(F.array(*[F.avg(v) for v in values])).first()[0]])
    found = rows.agg(F.array(*product_sums([v - F.lit(float(m)) for v, m in zip(values, shift)]))).first()[0]
    return Moments.of_sums(*read_sums(found, len(values)), shift)


@dataclass
class LinearFit:
    """A line with its intercept, and what its summary needs.

    ``covariance`` times the error variance is the covariance of the intercept (first) and
    the coefficients; it is the pseudo-inverse of the design's products.
    """

    coefficients: tuple[float, ...]
    intercept: float | None
    rows: int
    rank: int = 0
    squared_errors: float = 0.0
    squares: float = 0.0
    covariance: np.ndarray = field(default_factory=lambda: np.zeros((1, 1)))
    condition: float = 1.0

    @property
    def df_resid(self) -> int:
        return self.rows - self.rank

    @property
    def df_model(self) -> int:
        return max(0, self.rank - 1)

    @property
    def r2(self) -> float | None:
        if not self.rows:
            return None
        return 1.0 - self.squared_errors / self.squares if self.squares > 0 else 0.0

    def to_table(self, spark: SparkSession) -> DataFrame:
        numbers = (self.rows, self.rank, self.squared_errors, self.squares, self.condition)
        row = (list(self.coefficients), self.intercept, *numbers, self.covariance.tolist())
        schema = "coefficients array<double>, intercept double, rows long, rank int, squared_errors double, squares double, condition double, covariance array<array<double>>"
        return spark.createDataFrame([row], schema)

    @staticmethod
    def from_table(table: DataFrame) -> LinearFit:
        r = table.first()
        return LinearFit(tuple(r.coefficients), r.intercept, r["rows"], r["rank"], r.squared_errors, r.squares, np.array(r.covariance), r.condition)


def solve(m: Moments, alpha: float = 0.0) -> LinearFit:
    """Least squares with the penalty ``alpha |b|^2`` on the sum of squares, the intercept free.

    Without a penalty collinear columns have no single solution; the one with the least
    ``intercept^2 + |b|^2`` is taken, the one that the design's pseudo-inverse gives. The rank
    is read from the eigenvalues of the centred products at unit scale, so that it does
    not depend on the columns' units. The label's own product is the last one of ``m``.
    """
    width = len(m.means) - 1
    if not m.rows:
        return LinearFit((0.0,) * width, None, 0)
    x, y = m.means[:-1], m.means[-1]
    own, cross = m.products[:-1, :-1], m.products[:-1, -1]
    squares = max(0.0, float(m.products[-1, -1]))
    spread = np.diagonal(own).clip(min=0)
    varies = spread > CONSTANT * m.rows * np.maximum(x * x, np.finfo(float).tiny)
    scale = np.where(varies, np.sqrt(np.where(varies, spread, 1.0)), 1.0)
    unit = np.where(np.outer(varies, varies), own / np.outer(scale, scale), 0.0)
    if alpha > 0:
        b = np.linalg.solve(unit + np.diag(alpha / scale**2), np.where(varies, cross, 0.0) / scale) / scale
        rank = 1 + int(varies.sum())
        inverse, null = np.zeros((width, width)), np.zeros((width + 1, 0))
    else:
        values, turn = np.linalg.eigh(unit)
        kept = values > COLLINEAR * max(values.max(initial=0.0), np.finfo(float).tiny)
        back = turn[:, kept] / scale[:, None]
        inverse = back / values[kept] @ back.T
        b, rank = inverse @ cross, 1 + int(kept.sum())
        # directions that no row tells apart, at the columns' own scale and with the intercept
        lost = turn[:, ~kept] / scale[:, None]
        null = np.vstack([-x @ lost, lost])
        null = np.linalg.svd(null / np.maximum(np.linalg.norm(null, axis=0), np.finfo(float).tiny), full_matrices=False)[0] if null.shape[1] else null
    line = np.concatenate([[y - x @ b], b])
    spans = np.vstack([np.concatenate([[1.0 / m.rows + x @ inverse @ x], -inverse @ x]), np.column_stack([-inverse @ x, inverse])])
    keep = np.eye(width + 1) - null @ null.T
    line, spans = keep @ line, keep @ spans @ keep
    errors = squares - 2 * line[1:] @ cross + line[1:] @ own @ line[1:]
    design = own + m.rows * np.outer(x, x)
    design = np.vstack([np.concatenate([[m.rows], m.rows * x]), np.column_stack([m.rows * x, design])])
    extremes = np.linalg.eigvalsh(design)[[0, -1]]
    condition = float(np.sqrt(extremes[1] / extremes[0])) if rank == width + 1 and extremes[0] > 0 else float("inf")
    return LinearFit(tuple(line[1:].tolist()), float(line[0]), m.rows, rank, max(0.0, float(errors)), squares, spans, condition)
