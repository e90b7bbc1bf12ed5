"""Whitening of embeddings on their leading principal components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from panelforecast.llm.spectrum import leading_eigenpairs

# Entries become whole numbers by this step and offset.
STEPS, OFFSET = 64, 1_000_000
COMPONENTS = 32
_MOST = 2.0**62
_LOW = 31


@dataclass
class Whitening:
    """What the fit list gives; a few numbers a dimension, and ``dim`` squared while it is fitted."""

    dim: int
    rows: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace

    @property
    def map(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def usable(column: Column, dim: int | None = None) -> Column:
    """True for vectors without null or non-finite entries, of ``dim`` entries where given; never null."""
    finite = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    length = F.size(column) == dim if dim is not None else F.size(column) > 0
    return F.coalesce(finite & length, F.lit(False))


def _whole(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    """The batch's vectors as whole numbers, one row each; beyond 2^62 they stay there."""
    entries = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    steps = np.floor(STEPS * np.clip(entries, -_MOST / STEPS, _MOST / STEPS))
    return np.clip(steps, -_MOST, _MOST - 2 * OFFSET).astype(np.int64) + OFFSET


def _scaled_deviations(x: np.ndarray, rows: int, sums: list[int]) -> np.ndarray:
    """``rows * x - sums``, exact: 64-bit numbers where they hold it, else Python's."""
    base = [s // rows for s in sums]
    rest = [s - rows * b for s, b in zip(sums, base)]
    if max(map(abs, base), default=0) < 2**61 and len(x):
        off = x.astype(object) - np.array(base, dtype=object) if np.abs(x).max() >= 2**61 else x - np.array(base, np.int64)
        if rows * (int(np.abs(off).max()) + 1) < 2**62:
            return rows * off.astype(np.int64) - np.array(rest, np.int64)
    return rows * x.astype(object) - np.array(sums, dtype=object)


def _centred(x: np.ndarray, rows: int, sums: list[int]) -> np.ndarray:
    return (_scaled_deviations(x, rows, sums) / rows).astype(float)


def _squared_length(scaled: np.ndarray) -> list[int | None]:
    """The sum of squares of every row, exact; None where a long does not hold it."""
    if scaled.dtype != object and scaled.size and (int(np.abs(scaled).max()) ** 2) * scaled.shape[1] < 2**63:
        return (scaled * scaled).sum(axis=1).tolist()
    exact = [sum(int(c) ** 2 for c in row) for row in scaled]
    return [v if v < 2**63 else None for v in exact]


def _sums(vectors: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Rows, and the exact sum of every dimension: tasks send two halves of 64 bits a dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, high, low = 0, np.zeros(dim, np.int64), np.zeros(dim, np.int64)
        for batch in batches:
            x = _whole(batch, dim)
            rows += len(x)
            high += (x >> _LOW).sum(axis=0)
            low += (x & ((1 << _LOW) - 1)).sum(axis=0)
        columns = [pa.array(np.arange(dim), pa.int32()), pa.array(high), pa.array(low), pa.array(np.full(dim, rows, np.int64))]
        yield pa.RecordBatch.from_arrays(columns, ["i", "high", "low", "rows"])

    exact = [F.sum(F.col(c).cast("decimal(20,0)")).cast("decimal(38,0)").alias(c) for c in ("high", "low", "rows")]
    found = vectors.mapInArrow(run, "i int, high long, low long, rows long").groupBy("i").agg(*exact).orderBy("i").collect()
    return int(found[0]["rows"]), [(int(r["high"]) << _LOW) + int(r["low"]) for r in found]


def _summed_products(vectors: DataFrame, dim: int, row_of: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """The sum of the rows ``[1, r]' [1, r]`` over all vectors' ``r = row_of(x)``.

    A task sends one matrix of ``width + 1`` squared; the tasks that add them up hold one
    line of it for each number that they are dealt.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width + 1))
        for batch in batches:
            rows = row_of(_whole(batch, dim))
            rows = np.concatenate([np.ones((len(rows), 1)), rows], axis=1)
            total += rows.T @ rows
        if total[0, 0]:
            yield _lines(dict(enumerate(total)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: dict[int, np.ndarray] = {}
        for batch in batches:
            values = batch.column("line").flatten().to_numpy(zero_copy_only=False).reshape(-1, width + 1)
            for i, line in zip(batch.column("i").to_pylist(), values):
                lines[i] = lines[i] + line if i in lines else line.copy()
        if lines:
            yield _lines(lines)

    schema = "i int, line array<double>"
    parts = vectors.mapInArrow(partial, schema).repartition("i").mapInArrow(add, schema)
    return np.array([r["line"] for r in sorted(parts.collect(), key=lambda r: r["i"])])


def _lines(lines: dict[int, np.ndarray]) -> pa.RecordBatch:
    values = pa.array([line.tolist() for line in lines.values()], pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays([pa.array(list(lines), pa.int32()), values], ["i", "line"])


def _arrow_vectors(vectors: DataFrame, vector_column: str, dim: int | None, *others: Column) -> DataFrame:
    given = F.col(vector_column).cast("array<double>")
    return vectors.select(*others, given.alias("vector")).where(usable(F.col("vector"), dim))


def fit(vectors: DataFrame, vector_column: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all usable vectors, None without one.

    Vectors that are null, empty or hold null or non-finite entries are dropped. The
    dimension is the most frequent length, the longer of equally frequent ones; a vector of
    another length has too few or too many entries and is dropped as well. Entries become
    ``floor(64 c) + 1,000,000``, within 2^62.

    Three passes: exact sums, the covariance of the centred vectors, and the covariance of
    the whitened ones, which tells the largest departure from the identity. What reaches
    the driver is bounded by the dimension (its square in doubles: 32 KB at 64, 8 MB at
    1,024). Components whose variance is not told from zero do not exist, so that a fit
    can have fewer than asked for, none when all vectors are equal.
    """
    given = _arrow_vectors(vectors, vector_column, None)
    sizes = given.groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("rows"))
    first = sizes.orderBy(F.desc("rows"), F.desc("dim")).first()
    if first is None:
        return None
    dim = int(first["dim"])
    given = _arrow_vectors(vectors, vector_column, dim)
    rows, sums = _sums(given, dim)
    moments = _summed_products(given, dim, lambda x: _centred(x, rows, sums), dim)
    covariance = moments[1:, 1:] / rows
    values, directions = leading_eigenpairs(covariance, components)
    model = Whitening(dim, rows, sums, values, directions, float(np.trace(covariance)), 0.0)
    if len(values):
        turn = model.map
        moments = _summed_products(given, dim, lambda x: _centred(x, rows, sums) @ turn, len(values)) / rows
        spread = moments[1:, 1:] - np.outer(moments[0, 1:], moments[0, 1:])  # the rows are centred; their rounding is not
        model.identity_error = float(np.abs(spread - np.eye(len(values))).max())
    return model


def whiten(vectors: DataFrame, model: Whitening, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``(id, deviation, whitened)``, one row per usable vector of the model's dimension.

    ``deviation`` is the exact sum over dimensions of ``(n x - S)^2``, null where it needs
    more than 64 bits. ``whitened`` holds one double a component. Null ids and repeated
    rows stay as they are; other columns are not carried along.
    """
    dim, rows, sums, turn = model.dim, model.rows, model.sums, model.map
    id_type = vectors.select(F.col(id_column)).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scaled = _scaled_deviations(_whole(batch, dim), rows, sums)
            out = (scaled / rows).astype(float) @ turn
            offsets = np.arange(0, out.size + 1, max(1, out.shape[1]), dtype=np.int32) if out.shape[1] else np.zeros(len(out) + 1, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(_squared_length(scaled), pa.int64()), lists], ["id", "deviation", "whitened"])

    given = _arrow_vectors(vectors, vector_column, dim, F.col(id_column).alias("id"))
    out = given.mapInArrow(run, f"id {id_type}, deviation long, whitened array<double>")
    return out.select(F.col("id").alias(id_column), "deviation", "whitened")


def whitened_components(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``(id, component, n, deviation, whitened, explained, identity_error)``: a row per usable vector and component.

    Fitted on and applied to all usable vectors (see ``fit``); components count from 1
    by falling variance. Empty where there is no usable vector or no variance.
    """
    schema = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(vectors, vector_column, components)
    if model is None or not len(model.values):
        return vectors.select(F.col(id_column), *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in schema.split(", ")]).where(F.lit(False))
    shares = F.array(*[F.lit(float(s)) for s in model.explained])
    rows = whiten(vectors, model, id_column, vector_column)
    return rows.select(id_column, "deviation", F.posexplode("whitened").alias("at", "value")).select(
        id_column,
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.rows).cast("long").alias("n"),
        "deviation",
        F.col("value").alias("whitened"),
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )
