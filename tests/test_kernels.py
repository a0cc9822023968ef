from __future__ import annotations

import itertools

import numpy as np
import pytest

from fluorspark.model import Params, crosstalk
from fluorspark.operators import kernels, solve
from fluorspark.operators.sufficient import batch_sums, by_base_pairs, one_hot


def chain(rng, cycles):
    v = rng.normal(size=(4 * cycles, 12 * cycles))
    return solve.precision(v @ v.T / (12 * cycles))


@pytest.mark.parametrize("cycles", [1, 2, 3, 4])
def test_best_path_is_the_brute_force_optimum(cycles):
    rng = np.random.default_rng(cycles)
    omega, p, lam = chain(rng, cycles), rng.normal(size=(5, 4 * cycles)) * 2, rng.uniform(0.5, 3, 5)
    calls, score = kernels.best_path(p, lam, omega)
    every = np.array(list(itertools.product(range(4), repeat=cycles)))
    for k in range(5):
        rest = p[k] - lam[k] * one_hot(every)
        forms = np.einsum("ni,ij,nj->n", rest, omega, rest)
        assert np.isclose(forms.min(), score[k])
        assert (every[forms.argmin()] == calls[k]).all()
    assert np.allclose(kernels.path_score(p, lam, omega, calls), score)


def test_quality_of_zero_brightness_is_the_same_everywhere():
    omega, p = np.eye(8), np.random.default_rng(1).normal(size=(3, 8))
    quality = kernels.posterior_quality(p, np.zeros(3), omega, 8.0, np.zeros((3, 2), dtype=np.int8))
    assert kernels.quality_text(quality) == ['""'] * 3


def test_posterior_against_all_paths():
    rng = np.random.default_rng(3)
    omega, p, lam = chain(rng, 3), rng.normal(size=(4, 12)) * 3, rng.uniform(1, 3, 4)
    calls, _ = kernels.best_path(p, lam, omega)
    got = kernels.posterior_quality(p, lam, omega, 12.0, calls)
    every = np.array(list(itertools.product(range(4), repeat=3)))
    for k in range(4):
        rest = p[k] - lam[k] * one_hot(every)
        forms = np.einsum("ni,ij,nj->n", rest, omega, rest)
        for c in range(3):
            best = np.array([forms[every[:, c] == b].min() for b in range(4)])
            w = ((1 + best) / (1 + best[calls[k, c]])) ** (-(1 + 12.0) / 2)
            assert np.isclose(got[k, c], -10 * np.log10(1 - (1 - 10**-3.8) / w.sum()))


def test_precision_agrees_on_the_band():
    rng = np.random.default_rng(5)
    v = rng.normal(size=(24, 60))
    v = v @ v.T / 60
    omega = solve.precision(v)
    band = np.abs(np.arange(24)[:, None] // 4 - np.arange(24)[None, :] // 4) <= 1
    assert np.allclose(omega[~band], 0)
    assert np.allclose(np.linalg.inv(omega)[band], v[band])
    np.linalg.cholesky(omega)


def test_sums_give_back_the_model():
    rng = np.random.default_rng(6)
    start = Params.initial(3)
    calls, lam = rng.integers(0, 4, (4000, 3)).astype(np.int8), rng.uniform(1, 5, 4000) * 100
    noise = rng.normal(size=12) * 5
    signal = kernels.expected(calls, lam, start.a, noise) + rng.normal(size=(4000, 12))
    found = solve.mixing(batch_sums(signal, calls, lam, np.ones(4000)), start.a, ridge=1e-3, delta=0.0)
    assert np.abs(found.a - start.a).max() < 0.02
    assert np.abs(found.n - noise).max() < 1.0


def test_batch_sums_equal_the_long_form(spark):
    """J, K and the band by batches and by the plain definition, with ambiguous bases."""
    from fluorspark.operators import sufficient as suff

    rng = np.random.default_rng(16)
    rows = [(int(k % 2), [int(v) for v in rng.integers(-50, 900, 12)], [int(b) for b in rng.integers(0, 5, 3)], float(rng.uniform(1, 9)), float(rng.uniform(0.1, 1))) for k in range(40)]
    df = spark.createDataFrame(rows, "tile int, signal array<smallint>, calls array<tinyint>, brightness double, weight double")
    held = lambda d: {(r["tile"], r["i"], r["j"]): round(r["v"], 6) for r in d.collect() if abs(r["v"]) > 1e-9}
    assert held(suff.batch_long(df, "gram")) == held(suff.gram(df, ["tile"]))
    assert held(suff.batch_long(df, "cross")) == held(suff.cross(df, ["tile"]))
    own = df.selectExpr("*", "transform(signal, v -> double(v)) AS processed")
    assert held(suff.batch_band(own)) == held(suff.band_covariance(own, ["tile"]))


def test_ranks_and_medians_of_hot_groups(spark):
    from fluorspark.operators import statistics as stats

    rng = np.random.default_rng(18)
    rows = [("a", float(v)) for v in rng.integers(0, 40, 300)] + [("b", 1.0)] * 200 + [("c", 2.0), ("c", 5.0), ("d", 3.0), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {(r["g"], r["rank"]): (r["v"], r["n"]) for r in stats.ranked(df.where("v IS NOT NULL"), ["g"], "v").collect()}
    for g in "abcd":
        values = sorted(v for k, v in rows if k == g and v is not None)
        assert [got[g, k + 1] for k in range(len(values))] == [(v, len(values)) for v in values]
    assert {r["g"]: r["median"] for r in stats.median(df, ["g"], "v").collect()} == {g: float(np.median([v for k, v in rows if k == g and v is not None])) for g in "abcd"}


def test_sequence_with_ambiguous_bases_is_scored():
    rng = np.random.default_rng(20)
    omega, p, lam = chain(rng, 3), rng.normal(size=(2, 12)), rng.uniform(1, 3, 2)
    calls = np.array([[0, 4, 2], [4, 4, 1]], dtype=np.int8)
    rest = p - lam[:, None] * one_hot(calls)
    assert np.allclose(kernels.path_score(p, lam, omega, calls), np.einsum("ni,ij,nj->n", rest, omega, rest))


def test_nonnegative_squares():
    rng = np.random.default_rng(7)
    for _ in range(20):
        a, b = rng.normal(size=(12, 5)), rng.normal(size=12)
        x = solve.nonnegative_squares(a, b)
        gain = a.T @ (b - a @ x)
        assert (x >= 0).all() and (gain <= 1e-8).all() and np.allclose(gain[x > 0], 0, atol=1e-8)


def test_normalised_determinant():
    a, factor = solve.normalised(np.kron(np.eye(2), crosstalk()))
    assert np.isclose(abs(np.linalg.det(a)), 1, atol=1e-3) and factor > 0


def test_first_sums_of_five_clusters():
    """Sums of a small worked example: weights, brightness and three cycles."""
    # The example's inputs and sums.
    calls = np.array([3, 2, 3, 3, 3, 1, 3, 1, 3, 0, 1, 3, 3, 0, 2], dtype=np.int8).reshape(5, 3)
    w = np.array([0.33081400, 0.29916646, 0.79687810, 0.04376649, 0.04898477])
    lam = np.array([2.852168, 11.890647, 10.675880, 5.542096, 3.245923])
    j, k, s, i, total = solve.unpacked(batch_sums(np.ones((5, 12)), calls, lam, w))
    assert round(total, 2) == 1.52
    pairs = by_base_pairs(j)
    assert np.allclose(pairs[0], [1.34, 0, 0, 0, 0.52, 0, 0, 0, 0], atol=0.006) and np.allclose(pairs[15], [136.33, 42.30, 93.51, 42.30, 42.30, 0, 93.51, 0, 94.86], atol=0.006)
    assert by_base_pairs(k).shape == (16, 9)
    assert np.allclose(s.reshape(3, 4).T, [[0.24, 0.16, 0.00], [0.00, 8.75, 3.56], [0.00, 0.94, 0.16], [13.17, 3.56, 9.69]], atol=0.006)


def test_separable_round_trip():
    rng = np.random.default_rng(14)
    calls, lam, n = rng.integers(0, 4, (6, 3)).astype(np.int8), rng.uniform(1, 2, 6), rng.normal(size=12)
    phase = np.eye(3) + 0.1 * rng.random((3, 3))
    signal = kernels.separable_expected(calls, lam, crosstalk(), phase, n)
    assert np.allclose(kernels.separable_processed(signal, crosstalk(), phase, n), lam[:, None] * one_hot(calls))


def test_single_cycle_call():
    p, lam = np.array([[10.0, 0.1, 0.0, 0.2], [0.0, 0.0, 5.0, 4.9], [1.0, 2.0, 3.0, 4.0], [1e4, 0.0, 0.0, 0.0]]), np.array([10.0, 5.0, 0.0, 1.0])
    call, quality = kernels.single_cycle_call(p, lam, np.eye(4), np.zeros(4))
    assert call.tolist() == [0, 2, 0, 0] and quality[2] == 0.0
    like = np.exp(-0.5 * np.array([((p[0] - 10 * np.eye(4)[b]) ** 2).sum() for b in range(4)]))
    assert np.isclose(quality[0], -10 * np.log10(1 - (1e-5 + like[0]) / (4e-5 + like.sum())))
    assert quality[1] < 5 and np.isclose(quality[3], -10 * np.log10(0.75))
