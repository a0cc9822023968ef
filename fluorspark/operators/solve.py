"""Small dense solves in the task that holds a tile's sums: matrices of a tile's cycles, never of its clusters."""

from __future__ import annotations

import numpy as np

from fluorspark.model import CHANNELS, Params
from fluorspark.operators.sufficient import unpacked_width


def unpacked(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """J, K, call sums, signal sums and weight sum of a flat vector."""
    m = unpacked_width(sums)
    j, k, s, i, w = np.split(sums, np.cumsum([m * m, m * m, m, m]))
    return j.reshape(m, m), k.reshape(m, m), s, i, float(w[0])


#: How a tile's mixing is solved for: by Cholesky factors, by singular values, by singular values with a negative A cut to 0, or over A >= 0.
SOLVERS = ("cholesky", "svd", "clipped", "nonnegative")


def system(sums: np.ndarray, start: np.ndarray, ridge: float = 1e5, delta: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Both sides of the ridge regression of A and N towards the starting A and towards no noise."""
    j, k, s, i, w = unpacked(sums)
    left = np.block([[j, s[:, None]], [s[None, :], np.array([[w]])]])
    right = np.vstack([k, i[None, :]])
    right[:-1] += ridge * start.T
    left += (ridge + delta) * np.eye(len(left))
    return left, right


def mixing(sums: np.ndarray, start: np.ndarray, ridge: float = 1e5, delta: float = 1.0, solver: str = "cholesky") -> Params:
    """A and N by ridge regression; ``solver`` is one of ``SOLVERS``. N may be negative with each of them."""
    left, right = system(sums, start, ridge, delta)
    if solver in ("svd", "clipped"):
        found = least_squares(left, right)
        if solver == "clipped":
            found[:-1] = np.maximum(found[:-1], 0.0)
    else:
        np.linalg.cholesky(left)  # raises if the system is not positive definite
        found = np.linalg.solve(left, right)
        if solver == "nonnegative":
            border, corner = left[:-1, -1], left[-1, -1]
            # N is free: it is put in terms of A, and A is what is left
            a = nonnegative_system(left[:-1, :-1] - np.outer(border, border) / corner, right[:-1] - np.outer(border, right[-1]) / corner, found[:-1] > 0)
            found = np.vstack([a, (right[-1] - border @ a) / corner])
    return Params(found[:-1].T.copy(), found[-1].copy())


def nonnegative_system(left: np.ndarray, right: np.ndarray, free: np.ndarray | None = None) -> np.ndarray:
    """x >= 0 of least x'Lx / 2 - x'r for each column r of ``right`` and a positive definite L, by exchanging all variables that break a condition between the
    free and the bound ones; where that does not lessen their number, only the last of them, which ends. ``free`` is a first guess."""
    out = np.zeros_like(right)
    scale = 1e-12 * max(1.0, float(np.abs(right).max(initial=0.0)))
    for c in range(right.shape[1]):
        on = free[:, c].copy() if free is not None else np.zeros(len(left), dtype=bool)
        best, chances = len(left) + 1, 3
        while True:
            x = np.zeros(len(left))
            if on.any():
                x[on] = np.linalg.solve(left[np.ix_(on, on)], right[on, c])
            gain = right[:, c] - left @ x
            bad = np.where(on, x < 0, gain > scale)
            n = int(bad.sum())
            if n == 0:
                break
            if n < best:
                best, chances = n, 3
            elif chances:
                chances -= 1
            else:
                bad[: np.flatnonzero(bad)[-1]] = False
            on ^= bad
        out[:, c] = x
    return out


def off_optimum(left: np.ndarray, right: np.ndarray, found: Params) -> tuple[int, float]:
    """How many entries of A are negative, and how far A and N are from the least squares over A >= 0: the largest gradient of an entry that is not 0, or gain of one that is, over the right side."""
    x = np.vstack([found.a.T, found.n])
    gain = right - left @ x
    gain[:-1] = np.where(x[:-1] == 0, np.maximum(gain[:-1], 0.0), gain[:-1])
    return int((found.a < 0).sum()), float(np.abs(gain).max() / max(float(np.abs(right).max()), 1e-300))


def normalised(a: np.ndarray) -> tuple[np.ndarray, float]:
    """A with a determinant of about 1, and the factor that brightness takes over."""
    a = a + 3e-8 * np.eye(len(a))
    factor = 1e-5 + np.exp(np.linalg.slogdet(a)[1] / len(a))
    return a / factor, float(factor)


def precision(v: np.ndarray) -> np.ndarray:
    """The block-tridiagonal precision matrix whose inverse agrees with V on the band: cliques less separators of the chain of cycles."""
    cycles = len(v) // CHANNELS
    v = (v + v.T) / 2
    if cycles == 1:
        return _inverse(v)
    out = np.zeros_like(v)
    for c in range(cycles - 1):
        at = slice(c * CHANNELS, (c + 2) * CHANNELS)
        out[at, at] += _inverse(v[at, at])
    for c in range(1, cycles - 1):
        at = slice(c * CHANNELS, (c + 1) * CHANNELS)
        out[at, at] -= _inverse(v[at, at])
    return out


def _inverse(v: np.ndarray) -> np.ndarray:
    try:
        np.linalg.cholesky(v)
    except np.linalg.LinAlgError:
        v = v + 1e-5 * max(1.0, float(np.trace(v))) * np.eye(len(v))
    return np.linalg.inv(v)


def least_squares(left: np.ndarray, right: np.ndarray, rcond: float = 3e-8) -> np.ndarray:
    return np.linalg.lstsq(left, right, rcond=rcond)[0]


def clipped_squares(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least squares with negative values set to 0."""
    return np.maximum(least_squares(left, right), 0.0)


def nonnegative_squares(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least squares over x >= 0 by an active set: free variables are solved for, the worst bound one is freed."""
    x, free = np.zeros(left.shape[1]), np.zeros(left.shape[1], dtype=bool)
    limit = 1e-10 * max(1.0, float(np.abs(left.T @ right).max(initial=0.0)))
    while not free.all():
        gain = np.where(free, -np.inf, left.T @ (right - left @ x))
        if gain.max() <= limit:
            break
        free[gain.argmax()] = True
        while True:
            trial = np.zeros_like(x)
            trial[free] = np.linalg.lstsq(left[:, free], right, rcond=None)[0]
            bad = free & (trial <= 0)
            if not bad.any():
                x = trial
                break
            step = np.min(x[bad] / (x[bad] - trial[bad]))
            x = x + step * (trial - x)
            free &= x > 1e-14
            x[~free] = 0.0
    return x
