"""The separable model and the choice of solver, on simulated clusters and against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluorspark.model import Options, Params, crosstalk
from fluorspark.operators import kernels, separable, solve
from fluorspark.operators.sufficient import batch_sums, one_hot
from fluorspark.plans import entry

C = 6


def simulated(n=3000, noise=0.5, seed=3):
    rng = np.random.default_rng(seed)
    phase = 0.85 * np.eye(C) + 0.1 * np.eye(C, k=1) + 0.05 * np.eye(C, k=-1)
    calls = rng.integers(0, 4, (n, C)).astype(np.int8)
    calls[:40, 2] = 4
    lam, offset = rng.uniform(50, 150, n), rng.uniform(-5, 5, (C, 4))
    signal = kernels.separable_expected(calls, lam, crosstalk(), phase, offset.ravel()) + rng.normal(0, noise, (n, 4 * C))
    return signal, calls, lam, rng.uniform(0.5, 1, n), separable.scaled(separable.Separable(crosstalk(), phase, offset))


def table(spark, signal, calls, lam, w, tiles):
    rows = [(k, int(tiles[k]), s.tolist(), c.tolist(), float(x), float(y)) for k, (s, c, x, y) in enumerate(zip(signal, calls, lam, w, strict=True))]
    return spark.createDataFrame(rows, "cluster_idx long, tile int, signal array<double>, calls array<tinyint>, brightness double, weight double").repartition(3)


def test_errors_and_sides_equal_the_rows():
    signal, calls, lam, w, truth = simulated(200)
    sums = separable.Sums(separable.Sums.of(signal, calls, lam, w))
    x = separable.Separable(truth.mix + 0.1, truth.phase - 0.02, truth.noise + 1)
    rest = signal - kernels.separable_expected(calls, lam, x.mix, x.phase, x.noise.ravel())
    assert np.allclose(sums.errors(x), (w[:, None] * rest**2).reshape(-1, C, 4).sum(axis=(0, 2)))
    s = one_hot(calls).reshape(-1, C, 4).transpose(0, 2, 1) * lam[:, None, None]
    v = np.arange(1.0, C + 1)
    design = np.concatenate([s @ x.phase, np.broadcast_to(np.eye(C), (200, C, C))], axis=1)  # each cluster's S^P
    left, right = sums.mix_side(x.phase, v)
    assert np.allclose(left, np.einsum("n,nic,c,njc->ij", w, design, v, design))
    assert np.allclose(right, np.einsum("n,nic,c,nck->ik", w, design, v, signal.reshape(-1, C, 4)))
    ms = np.einsum("kb,nbc->nkc", x.mix, s)
    left, right = sums.phase_side(x.mix, x.noise)
    assert np.allclose(left, np.einsum("n,nkc,nkd->cd", w, ms, ms))
    assert np.allclose(right, np.einsum("n,nkc,ndk->cd", w, ms, signal.reshape(-1, C, 4) - x.noise))


@pytest.mark.parametrize("by_variance", [False, True])
def test_recovers_what_was_simulated(by_variance):
    signal, calls, lam, w, truth = simulated()
    found, variance, path = separable.solved(separable.Sums(separable.Sums.of(signal, calls, lam, w)), by_variance=by_variance)
    assert np.allclose(found.mix, truth.mix, atol=0.01) and np.allclose(found.phase, truth.phase, atol=0.01) and np.allclose(found.noise, truth.noise, atol=0.3)
    assert np.allclose(variance, 0.25, atol=0.03)
    assert all(b <= a * (1 + 1e-9) for a, b in zip(path, path[1:], strict=False)) and len(path) > 2


def test_fit_by_tile_equals_one_tile_and_unmixes(spark):
    signal, calls, lam, w, _ = simulated(600, 0.01)
    tiles = np.arange(600) % 2
    rows = table(spark, signal, calls, lam, w, tiles)
    fitted, files = separable.fit(rows)
    got = {x.tile: x for x in fitted.collect()}
    for tile in (0, 1):
        own = tiles == tile
        want, _, path = separable.solved(separable.Sums(separable.Sums.of(signal[own], calls[own], lam[own], w[own])))
        assert np.allclose(got[tile].mix, want.mix.ravel()) and np.allclose(got[tile].phase, want.phase.ravel()) and np.allclose(got[tile].noise, want.noise.ravel(), atol=1e-6)
        assert got[tile].rises == 0 and got[tile].start_error == pytest.approx(path[0])
    p = separable.unmixed(rows, files).orderBy("cluster_idx").collect()
    scale = np.array([abs(np.linalg.det(crosstalk())) ** 0.25])
    assert np.allclose([x.processed for x in p[40:]], (lam[:, None] * one_hot(calls))[40:], atol=1.0 * scale[0] + 1.0)
    off = separable.normal_equations(rows, files)
    assert off.count() == 2 * (16 + C * C + 4 * C) and off.agg(F.max(F.abs("off"))).first()[0] < 1e-4


def test_odd_tiles(spark):
    signal, calls, lam, w, _ = simulated(60)
    calls[:] = np.where(np.arange(C) == 3, 4, calls)  # a cycle that is never called
    tiles = np.arange(60) // 30
    signal[tiles == 1, 0] = np.nan
    rows = table(spark, signal, calls, lam, w, tiles)
    fitted, files = separable.fit(rows)
    assert [(x.tile, np.isfinite(x.phase).all(), x.rises) for x in fitted.collect()] == [(0, True, 0)]
    assert {x.tile for x in separable.unmixed(rows, files).where("processed IS NOT NULL").collect()} <= {0}
    empty = separable.fit(rows.limit(0))
    assert empty[0].count() == 0 and separable.normal_equations(rows.limit(0), empty[1]).count() == 0


def test_nonnegative_system_meets_its_conditions():
    rng = np.random.default_rng(5)
    for _ in range(30):
        a, b = rng.normal(size=(20, 9)), rng.normal(size=(20, 4))
        x = solve.nonnegative_system(a.T @ a, a.T @ b)
        gain = a.T @ (b - a @ x)
        assert (x >= 0).all() and np.abs(gain[x > 0]).max() < 1e-9 and gain[x == 0].max(initial=0) < 1e-9
        assert np.allclose(x, np.stack([solve.nonnegative_squares(a, y) for y in b.T], axis=1), atol=1e-8)


def test_solvers_of_a_tile():
    signal, calls, lam, w, _ = simulated(400, 30.0)
    sums, start = batch_sums(signal, calls, lam, w), Params.initial(C).a
    system = solve.system(sums, start, 1.0)
    found = {s: solve.mixing(sums, start, 1.0, solver=s) for s in solve.SOLVERS}
    assert np.allclose(found["cholesky"].a, found["svd"].a) and (found["cholesky"].a < 0).any()
    assert np.allclose(found["clipped"].a, np.maximum(found["svd"].a, 0))
    negatives, off = solve.off_optimum(*system, found["nonnegative"])
    assert negatives == 0 and off < 1e-9
    cost = lambda p: np.trace((x := np.vstack([p.a.T, p.n])).T @ system[0] @ x / 2 - x.T @ system[1])
    assert cost(found["cholesky"]) <= cost(found["nonnegative"]) <= cost(found["clipped"])


@pytest.mark.parametrize("solver", ["svd", "nonnegative"])
def test_runs_with_a_solver(spark, solver):
    signal, calls, lam, w, _ = simulated(300, 1.0)
    rows = table(spark, signal, calls, lam, w, np.zeros(300)).select("cluster_idx", "tile", F.transform("signal", lambda v: F.round(v).cast("smallint")).alias("signal"))
    want = {x.cluster_idx: x.bases for x in entry.run(rows, Options(iterations=2)).collect()}
    got = {x.cluster_idx: x.bases for x in entry.run(rows, Options(iterations=2, solver=solver)).collect()}
    assert len(got) == 300 and sum(want[k] == got[k] for k in got) >= 295
