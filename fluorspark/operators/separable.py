"""The separable model: signal = brightness * M S P + N, where S is a cluster's sequence (4 x C, one base a cycle), M a 4 x 4 mix of
channels, P a C x C phasing of cycles and N a 4 x C offset.

M and N are linear least squares for fixed P, and P is for fixed M and N. Both sides are contractions of the sums that the full model has as
well (J, K, S, I, w), so the rows are read once: ``fit`` adds up a tile's sums in tasks, and the task that gets
them alternates until the error stops falling. No step raises the error. The scale that M and P share is settled by |det M| = 1.

Matrices in tables are flat, row by row: ``mix`` by (channel, base), ``phase`` by (called cycle, signal's cycle), ``noise`` and signals by (cycle, channel).

Defined results: ambiguous bases stand for no signal; systems that are singular (a cycle or a base that is never called) have their solution of least norm; a
tile whose sums are not finite has no row; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fluorspark.model import CHANNELS, crosstalk
from fluorspark.operators import kernels
from fluorspark.operators.parameters import ParameterFiles, shared_cut
from fluorspark.operators.solve import least_squares
from fluorspark.operators.sufficient import batch_sums, matrix_of, one_hot, partial_sums

FITTED = "tile int, mix array<double>, phase array<double>, noise array<double>, variance array<double>, error double, start_error double, rounds int, rises int"
SUMMED = ["signal", "calls", "brightness", "weight"]


@dataclass
class Separable:
    """M (channel x base), P (called cycle x signal's cycle) and N (cycle x channel)."""

    mix: np.ndarray
    phase: np.ndarray
    noise: np.ndarray

    @classmethod
    def initial(cls, cycles: int) -> Separable:
        return cls(crosstalk(), np.eye(cycles), np.zeros((cycles, CHANNELS)))


class Sums:
    """A tile's sums as tensors: ``j`` (c, b, d, e), ``k`` (c, b, d, channel), ``s`` (c, b), ``i`` (d, channel), ``w`` and ``energy`` (d), the weighted squares of the signal."""

    def __init__(self, flat: np.ndarray) -> None:
        # 2 m^2 + 2 m + 1 numbers of batch_sums and m / 4 squares
        m = int(round((np.sqrt(5.0625 + 8 * (len(flat) - 1)) - 2.25) / 4))
        c = m // CHANNELS
        j, k, s, i, w, self.energy = np.split(flat, np.cumsum([m * m, m * m, m, m, 1]))
        self.cycles, self.w = c, float(w[0])
        self.j, self.k = j.reshape(c, CHANNELS, c, CHANNELS), k.reshape(c, CHANNELS, c, CHANNELS)
        self.s, self.i = s.reshape(c, CHANNELS), i.reshape(c, CHANNELS)

    @staticmethod
    def of(signal: np.ndarray, calls: np.ndarray, brightness: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The flat vector of a batch; vectors of batches are added."""
        squares = (weight @ (signal * signal)).reshape(-1, CHANNELS).sum(axis=1)
        return np.concatenate([batch_sums(signal, calls, brightness, weight), squares])

    def mix_side(self, phase: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The system of M and N for fixed P, cycles weighted by ``v``: (4 + C) x (4 + C) and (4 + C) x 4."""
        weighted = phase * v
        border = self.s.T @ weighted
        left = np.block([[np.einsum("cbde,cd->be", self.j, weighted @ phase.T), border], [border.T, self.w * np.diag(v)]])
        return left, np.vstack([np.einsum("cbdk,cd->bk", self.k, weighted), self.i * v[:, None]])

    def phase_side(self, mix: np.ndarray, noise: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The system of P for fixed M and N, C x C both; a cycle's weight cancels."""
        return np.einsum("cbde,be->cd", self.j, mix.T @ mix), np.einsum("cbdk,kb->cd", self.k, mix) - self.s @ mix.T @ noise.T

    def errors(self, x: Separable) -> np.ndarray:
        """The weighted squared error of each cycle."""
        left, right = self.phase_side(x.mix, x.noise)
        fitted = np.einsum("cd,ce,ed->d", x.phase, left, x.phase) - 2 * (x.phase * right).sum(axis=0)
        return self.energy + fitted + self.w * (x.noise**2).sum(axis=1) - 2 * (x.noise * self.i).sum(axis=1)

    def step(self, x: Separable, v: np.ndarray) -> Separable:
        """M and N for the P of ``x``, then P for them."""
        found = least_squares(*self.mix_side(x.phase, v), rcond=1e-12)
        mix, noise = found[:CHANNELS].T, found[CHANNELS:]
        return Separable(mix, least_squares(*self.phase_side(mix, noise), rcond=1e-12), noise)


def scaled(x: Separable) -> Separable:
    """The same model with |det M| = 1, or as it is where M is singular."""
    sign, log = np.linalg.slogdet(x.mix)
    factor = float(np.exp(log / CHANNELS)) if sign else 1.0
    return Separable(x.mix / factor, x.phase * factor, x.noise)


def solved(sums: Sums, rounds: int = 200, tolerance: float = 1e-10, by_variance: bool = False) -> tuple[Separable, np.ndarray, list[float]]:
    """The model, the variance of each cycle (a channel's), and the errors after each round, the start's first.

    Rounds end when the error falls by less than ``tolerance`` of itself. ``by_variance`` then weighs cycles by their
    inverse variance and goes on from there; the errors are those of the last weights.
    """
    x, v = Separable.initial(sums.cycles), np.ones(sums.cycles)
    for weighing in range(1 + by_variance):
        if weighing:
            variance = sums.errors(x)
            v = np.where(variance > 0, variance.mean() / np.where(variance > 0, variance, 1.0), 1.0)
        path = [float(v @ sums.errors(x))]
        for _ in range(rounds):
            x = sums.step(x, v)
            path.append(float(v @ sums.errors(x)))
            if path[-2] - path[-1] <= tolerance * abs(path[-2]):
                break
    return scaled(x), sums.errors(x) / (max(sums.w, 1e-300) * CHANNELS), path


def sums_of(rows: DataFrame) -> DataFrame:
    """``tile`` and the flat sums of rows with tile, signal, calls, brightness and weight."""
    return partial_sums(rows, SUMMED, lambda tile, c: Sums.of(matrix_of(c[0]), matrix_of(c[1], np.int8), c[2].to_numpy(), c[3].to_numpy()))


def fit(rows: DataFrame, rounds: int = 200, tolerance: float = 1e-10, by_variance: bool = False) -> tuple[DataFrame, ParameterFiles]:
    """Fits every tile of ``rows`` (tile, signal, calls, brightness, weight): its parameters as a table, ``FITTED``, and as files for tasks.

    ``error`` and ``start_error`` are those of the last weights, ``rises`` counts rounds whose error rose by more than rounding.
    """
    files = ParameterFiles(rows.sparkSession, Separable)
    files.last = "separable"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for k, tile in enumerate(batch.column("tile").to_pylist()):
                flat = batch.column("v")[k].values.to_numpy()
                if np.isfinite(flat).all():
                    x, variance, path = solved(Sums(flat), rounds, tolerance, by_variance)
                    files.put(files.last, tile, x)
                    rises = sum(b > a + 1e-9 * abs(path[0]) for a, b in zip(path, path[1:], strict=False))
                    done.append((tile, x.mix.ravel(), x.phase.ravel(), x.noise.ravel(), variance, path[-1], path[0], len(path) - 1, rises))
            kinds = [pa.int32(), *[pa.list_(pa.float64())] * 4, pa.float64(), pa.float64(), pa.int32(), pa.int32()]
            names = [f.split()[0] for f in FITTED.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in done], kind) for c, kind in enumerate(kinds)], names=names)

    return shared_cut(sums_of(rows).mapInArrow(run, FITTED)), files


def residual_sums(rows: DataFrame, files: ParameterFiles) -> DataFrame:
    """``tile`` and the sums over its rows of weight * brightness * residual by (signal's cycle, channel, called cycle, base), then weight * residual by (cycle, channel):
    another reading of the rows, whose contractions with M and P are the fit's normal equations."""

    def kernel(tile: int, c: list[pa.Array]) -> np.ndarray:
        signal, calls, lam, w = matrix_of(c[0]), matrix_of(c[1], np.int8), c[2].to_numpy(), c[3].to_numpy()
        x = files.get(files.last, tile)
        if x is None:
            return np.full(signal.shape[1] ** 2 + signal.shape[1], np.nan)
        rest = (signal - kernels.separable_expected(calls, lam, x.mix, x.phase, x.noise.ravel())) * w[:, None]
        return np.concatenate([(rest.T @ (one_hot(calls) * lam[:, None])).ravel(), rest.sum(axis=0)])

    return partial_sums(rows, SUMMED, kernel)


def normal_equations(rows: DataFrame, files: ParameterFiles) -> DataFrame:
    """tile, equation (``M``, ``P`` or ``N``), i, j and off: what is left of each normal equation of the unweighted fit, over the largest term that it is made of."""
    out = "tile int, equation string, i int, j int, off double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, tile in enumerate(batch.column("tile").to_pylist()):
                x, flat = files.get(files.last, tile), batch.column("v")[k].values.to_numpy()
                if x is None:
                    continue
                c = len(x.phase)
                g = flat[: -c * CHANNELS].reshape(c, CHANNELS, c, CHANNELS)
                size = Sums(batch.column("own")[k].values.to_numpy())
                terms = {
                    "M": (np.einsum("dkcb,cd->kb", g, x.phase), np.einsum("cbdk,cd->kb", np.abs(size.k), np.abs(x.phase))),
                    "P": (np.einsum("dkcb,kb->cd", g, x.mix), np.einsum("cbdk,kb->cd", np.abs(size.k), np.abs(x.mix))),
                    "N": (flat[-c * CHANNELS :].reshape(c, CHANNELS), np.sqrt(size.w * size.energy)[:, None]),
                }
                for name, (value, scale) in terms.items():
                    off = value / max(float(np.max(scale, initial=0.0)), 1e-300)
                    i, j = np.indices(off.shape)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(off.size, tile), pa.int32()), pa.array([name] * off.size), pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(off.ravel())], names=["tile", "equation", "i", "j", "off"])

    return residual_sums(rows, files).join(sums_of(rows).withColumnRenamed("v", "own"), "tile").mapInArrow(run, out)


def sides(rows: DataFrame, mix: np.ndarray, phase: np.ndarray, noise: np.ndarray) -> DataFrame:
    """tile, side, i, j, v: the left and right sides of both systems, of M and N at ``phase`` and of P at ``mix`` and ``noise``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, tile in enumerate(batch.column("tile").to_pylist()):
                own = Sums(batch.column("v")[k].values.to_numpy())
                found = (*own.mix_side(phase, np.ones(own.cycles)), *own.phase_side(mix, noise))
                for name, v in zip(("M left", "M right", "P left", "P right"), found, strict=True):
                    i, j = np.indices(v.shape)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(v.size, tile), pa.int32()), pa.array([name] * v.size), pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(v.ravel())], names=["tile", "side", "i", "j", "v"])

    return sums_of(rows).mapInArrow(run, "tile int, side string, i int, j int, v double")


def unmixed(rows: DataFrame, files: ParameterFiles | None = None, fixed: Separable | None = None) -> DataFrame:
    """``cluster_idx``, ``tile`` and ``processed``, M^-1 (I - N) P^-1 by the tile's fitted parameters or by ``fixed``; null where a tile has none or they are singular."""

    def of(tile: int, signal: np.ndarray) -> list | np.ndarray:
        x = fixed or files.get(files.last, tile)
        try:
            return list(kernels.separable_processed(signal, x.mix, x.phase, x.noise.ravel())) if x else [None] * len(signal)
        except np.linalg.LinAlgError:
            return [None] * len(signal)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tiles = batch.column("tile").to_numpy()
            for tile in np.unique(tiles):
                own = batch.take(pa.array(np.flatnonzero(tiles == tile)))
                p = pa.array(of(int(tile), matrix_of(own.column("signal"))), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([own.column("cluster_idx"), own.column("tile"), p], names=["cluster_idx", "tile", "processed"])

    return rows.select("cluster_idx", "tile", "signal").mapInArrow(run, f"cluster_idx {dict(rows.dtypes)['cluster_idx']}, tile {dict(rows.dtypes)['tile']}, processed array<double>")
