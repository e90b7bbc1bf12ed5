"""Leading eigenpairs of a symmetric matrix by spectrum slicing: inertia counts, then Rayleigh quotient iteration."""

from __future__ import annotations

import numpy as np

#: Narrowest slice, as a share of the largest eigenvalue's bound; eigenvalues that share one are solved together.
NARROWEST = 1e-12
#: Neighbours nearer than this share of the bound are made orthogonal to each other.
CLOSE = 1e-3
_PIVOT = (1 + np.sqrt(17)) / 8


def count_below(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues lie below ``shift``: the negative eigenvalues of D in L D L' of ``matrix - shift I``.

    L D L' is a congruence, which keeps the inertia (Sylvester). D has blocks of one and
    two rows, chosen by partial pivoting (Bunch and Kaufman), so no shift is unstable.
    """
    a = np.array(matrix, dtype=float)
    size = len(a)
    a[np.diag_indices(size)] -= shift
    negative = at = 0
    while at < size:
        own, below = abs(a[at, at]), np.abs(a[at + 1 :, at])
        width, swap = 1, at
        if len(below) and below.max() > 0:
            other = at + 1 + int(below.argmax())
            most = below[other - at - 1]
            if own < _PIVOT * most:
                row = np.abs(a[other, at:])
                row[other - at] = 0
                if own * row.max() < _PIVOT * most * most:
                    width, swap = (1, other) if abs(a[other, other]) >= _PIVOT * row.max() else (2, other)
        elif own == 0:
            at += 1  # a zero pivot of a zero column: an eigenvalue at the shift itself
            continue
        to = at + width - 1
        if swap != to:
            a[[to, swap]] = a[[swap, to]]
            a[:, [to, swap]] = a[:, [swap, to]]
        block, column = a[at : at + width, at : at + width], a[at + width :, at : at + width]
        if width == 1:
            negative += int(block[0, 0] < 0)
            a[at + 1 :, at + 1 :] -= np.outer(column[:, 0] / block[0, 0], column[:, 0])
        else:
            negative += int((np.linalg.eigvalsh(block) < 0).sum())
            a[at + 2 :, at + 2 :] -= column @ np.linalg.solve(block, column.T)
        at += width
    return negative


def _slices(matrix: np.ndarray, wanted: int, low: float, high: float, narrow: float) -> list[tuple[float, float, int, int]]:
    """``(low, high, above, upto)``: slices that hold the eigenvalues numbered ``above + 1`` to ``upto`` from the top.

    A slice is halved until it holds one eigenvalue or is as narrow as ``narrow``.
    """
    found, open_ = [], [(low, high, 0, len(matrix))]
    while open_:
        low, high, above, upto = open_.pop()
        if above >= min(wanted, upto):
            continue
        if upto - above == 1 or high - low <= narrow:
            found.append((low, high, above, upto))
            continue
        middle = (low + high) / 2
        cut = len(matrix) - count_below(matrix, middle)
        open_ += [(low, middle, cut, upto), (middle, high, above, cut)]
    return sorted(found, key=lambda s: s[2])


def _solve(matrix: np.ndarray, shift: float, rhs: np.ndarray, nudge: float) -> np.ndarray:
    shifted = matrix - shift * np.eye(len(matrix))
    try:
        out = np.linalg.solve(shifted, rhs)
    except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
        out = np.linalg.solve(shifted - nudge * np.eye(len(matrix)), rhs)
    return out


def _one(matrix: np.ndarray, low: float, high: float, number: int, nudge: float) -> tuple[float, np.ndarray]:
    """The only eigenpair of a slice; the counts on both sides of its value certify its number."""
    rng = np.random.default_rng(number)
    while True:
        vector = rng.standard_normal(len(matrix))
        value, rest = (low + high) / 2, np.inf
        for step in range(40):
            vector = _solve(matrix, value, vector / np.linalg.norm(vector), nudge)
            vector /= np.linalg.norm(vector)
            if step >= 2:  # inverse iteration turns towards the slice, then the quotient takes over
                done = rest <= nudge  # one more step after that one: to the last bits
                value = float(vector @ matrix @ vector)
                rest = float(np.linalg.norm(matrix @ vector - value * vector))
                if done or not low <= value <= high:
                    break
        if low - nudge <= value <= high + nudge and rest <= 64 * nudge:
            reach = rest + 4 * nudge
            above = len(matrix) - count_below(matrix, value + reach)
            if above <= number - 1 < number <= len(matrix) - count_below(matrix, value - reach):
                return value, vector
        if high - low <= 16 * nudge:
            raise ArithmeticError(f"eigenvalue {number} could not be certified")
        middle = (low + high) / 2  # the iteration left the slice: halve it and start again
        if len(matrix) - count_below(matrix, middle) >= number:
            low = middle
        else:
            high = middle


def _several(matrix: np.ndarray, low: float, high: float, count: int, nudge: float) -> tuple[np.ndarray, np.ndarray]:
    """All eigenpairs of a slice that cannot be told apart: block inverse iteration."""
    block = np.random.default_rng(count).standard_normal((len(matrix), count))
    for _ in range(4):
        block = np.linalg.qr(_solve(matrix, (low + high) / 2 + nudge, block, nudge))[0]
    return _ritz(matrix, block)


def _ritz(matrix: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    basis = np.linalg.qr(basis)[0]
    values, turn = np.linalg.eigh(basis.T @ matrix @ basis)
    return values[::-1], (basis @ turn)[:, ::-1]


def leading_eigenpairs(matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``wanted`` largest eigenvalues of a positive semi-definite matrix and their unit vectors, in columns.

    Values fall. Those that rounding cannot tell from zero are left out, so fewer may
    come back, none for a zero matrix. Of a vector the largest entry is positive. Vectors
    of equal eigenvalues are any orthonormal basis of their space.
    """
    matrix = (matrix + matrix.T) / 2
    bound = float(np.abs(matrix).sum(axis=1).max(initial=0.0))
    if bound == 0:
        return np.zeros(0), np.zeros((len(matrix), 0))
    nudge = len(matrix) * np.finfo(float).eps * bound / 4
    values, vectors = [], []
    for low, high, above, upto in _slices(matrix, wanted, -bound * 1e-3, bound * 1.001, bound * NARROWEST):
        if upto - above == 1:
            value, vector = _one(matrix, low, high, upto, nudge)
            values.append(value)
            vectors.append(vector)
        else:
            several, block = _several(matrix, low, high, upto - above, nudge)
            values += several.tolist()
            vectors += list(block.T)
    values, vectors = np.array(values), np.array(vectors).T
    starts = [0, *(np.flatnonzero(values[:-1] - values[1:] > CLOSE * bound) + 1).tolist(), len(values)]
    for start, stop in zip(starts, starts[1:]):
        if stop - start > 1:
            values[start:stop], vectors[:, start:stop] = _ritz(matrix, vectors[:, start:stop])
    keep = int((values[:wanted] > len(matrix) * np.finfo(float).eps * bound).sum())
    values, vectors = values[:keep], vectors[:, :keep]
    return values, vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(keep)])
