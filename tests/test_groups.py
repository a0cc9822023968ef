"""Fits of many groups at once, and sums in dense slices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from fluorspark.operators import statistics as stats
from fluorspark.operators import sufficient as suff

# A sample of a hundred brightness values, and the mixture of three components that 20 rounds fit to it.
SAMPLE = (
    555.353809, 419.564836, 450.809844, 506.616249, 371.848397, 706.041743, 499.771478, 518.205954, 439.831391, 520.698218, 753.356296, 634.271222, 648.977558, 426.391545, 435.153296, 626.732370, 682.769467,
    372.357013, 291.009191, 743.990353, 504.417073, 458.590261, 498.829058, 625.966339, 458.646545, 755.981885, 444.928290, 671.684696, 511.331531, 611.902597, 460.118735, 647.189709, 554.216660, 686.963086,
    569.606866, 563.419112, 737.653389, 403.080434, 443.322036, 705.570561, 585.026202, 527.917187, 510.285342, 786.916684, 704.429015, 810.036549, 606.572596, 623.419361, 859.987869, 396.441948, 635.692142,
    467.207053, 455.246160, 502.105741, 387.227887, 669.400516, 876.899870, 415.545602, 498.551550, 597.935299, 554.070947, 531.724291, 474.741011, 485.607134, 716.949414, 796.529972, 669.240221, 782.202950,
    632.050738, 604.872450, 709.481322, 316.291477, 493.978862, 397.919084, 750.448521, 765.381530, 527.989506, 466.661803, 776.561412, 459.935279, 532.403051, 809.891371, 493.566193, 422.406857, 539.929369,
    442.825910, 647.185790, 614.505724, 554.314087, 791.001484, 682.230378, 540.590458, 405.754796, 540.967678, 731.316672, 539.827951, 716.837993, 774.198977, 468.462159, 407.249870,
)
START = ((0.3333, 707.4036, 44.4608), (0.3333, 574.0212, 44.4608), (0.3333, 440.6387, 44.4608))
START_LIKE, LAST_LIKE = -640.380928, -624.673092
FITTED = ((0.3324, 725.4120, 70.5150), (0.2691, 555.4223, 75.4486), (0.3984, 460.2699, 66.0481))


def brute(v, k, rounds):
    v = np.asarray(v, float)
    share, sd = np.full(k, 1 / k), np.full(k, max(1e-9, v.std() / k))
    mean = v.mean() + (2 - 4 * np.arange(1, k + 1) / (k + 1)) * v.std()
    like = None
    for _ in range(rounds):
        log = np.log(share) - np.log(sd) - 0.5 * np.log(2 * np.pi) - 0.5 * ((v[:, None] - mean) / sd) ** 2
        top = log.max(axis=1, keepdims=True)
        w = np.exp(log - top)
        like = float((top[:, 0] + np.log(w.sum(axis=1))).sum())
        w /= w.sum(axis=1, keepdims=True)
        share, mean = w.mean(axis=0), (w * v[:, None]).sum(axis=0) / w.sum(axis=0)
        sd = np.maximum(1e-9, np.sqrt(np.maximum(0, (w * v[:, None] ** 2).sum(axis=0) / w.sum(axis=0) - mean**2)))
    return share, mean, sd, like


def test_mixture_of_the_sample(spark):
    df = spark.createDataFrame([(v,) for v in SAMPLE], "v double")
    first = stats.mixture_starts(df.withColumn("g", F.lit(1)), ["g"], "v", 3).first()
    assert np.allclose(np.array([first["share"], first["mean"], first["sd"]]).T, START, atol=6e-5)
    assert abs(stats.mixture_fit(df, "v", 3, 1)[1] - START_LIKE) < 1e-6
    parts, like = stats.mixture_fit(df, "v", 3, 20)
    assert np.allclose(parts, FITTED, atol=6e-5) and abs(like - LAST_LIKE) < 1e-6


def test_a_thousand_groups_in_as_many_jobs_as_one(spark, monkeypatch):
    rng = np.random.default_rng(3)
    values = {g: np.r_[rng.normal(0, 1, 12), rng.normal(6 + g % 5, 1, 12)] for g in range(1000)}
    values[1000], values[1001] = np.array([2.5]), np.array([4.0] * 5)
    df = spark.createDataFrame([(g, float(x)) for g, v in values.items() for x in v] + [(7, None), (2000, None)], "g int, v double")
    cuts, one_round = [0], stats._mixture_round
    monkeypatch.setattr(stats, "_mixture_round", lambda *a: (cuts.__setitem__(0, cuts[0] + 1), one_round(*a))[1])
    one = stats.mixture_fits(df.where("g = 3"), ["g"], "v", 2, 4)
    alone, cuts[0] = cuts[0], 0
    got = {r["g"]: r for r in stats.mixture_fits(df, ["g"], "v", 2, 4).collect()}
    assert cuts[0] == alone and set(got) == set(values) and one.first()["mean"] == got[3]["mean"]
    for g in (*range(0, 1000, 97), 1000):
        share, mean, sd, like = brute(values[g], 2, 4)
        assert np.allclose(got[g]["share"], share) and np.allclose(got[g]["mean"], mean) and np.allclose(got[g]["sd"], sd, atol=1e-6), g
    assert got[1001]["mean"][0] == 4.0
    monkeypatch.setattr(stats, "MOST_GROUPS", 5)
    many = {r["g"]: r for r in stats.mixture_fits(df, ["g"], "v", 2, 4).collect()}
    assert all(np.allclose(many[g]["mean"], got[g]["mean"]) for g in values)


def test_groups_stop_one_by_one(spark):
    rng = np.random.default_rng(4)
    rows = [("far", float(x)) for x in np.r_[rng.normal(0, 1, 200), rng.normal(50, 1, 200)]] + [("near", float(x)) for x in np.r_[rng.normal(0, 1, 200), rng.normal(2, 1, 200)]]
    got = {r["g"]: r for r in stats.mixture_fits(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", 2, 40, tolerance=1e-3).collect()}
    assert got["far"]["rounds"] < got["near"]["rounds"] <= 40
    for g, r in got.items():
        share, mean, _, like = brute([v for n, v in rows if n == g], 2, r["rounds"])
        assert np.allclose(r["mean"], mean, atol=1e-6) and np.allclose(r["share"], share, atol=1e-6) and abs(r["like"] - like) < 1e-6
    empty = stats.mixture_fits(spark.createDataFrame([], "g string, v double"), ["g"], "v", 2, 3, tolerance=0.1)
    assert empty.count() == 0


def test_sums_in_slices(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(t, [int(v) for v in rng.integers(-50, 50, 12)]) for t in range(40) for _ in range(9)]
    df = spark.createDataFrame(rows, "tile int, signal array<smallint>").repartition(6)
    want = {}
    for t, v in rows:
        want[t] = want.get(t, 0) + np.outer(v, v).ravel()

    def kernel(tile, c):
        x = suff.matrix_of(c[0])
        return (x.T @ x).ravel()

    for cut, held in ((4096, 8 << 20), (50, 300), (1, 1)):
        monkeypatch.setattr(suff, "SLICE", cut)
        monkeypatch.setattr(suff, "HELD_NUMBERS", held)
        got = {r["tile"]: np.array(r["v"]) for r in suff.partial_sums(df, ["signal"], kernel).collect()}
        assert set(got) == set(want) and all((got[t] == want[t]).all() for t in want)


def test_sums_travel_at_eight_bytes_a_number(spark):
    """Sums are sent as arrays, never as a row for each number."""
    n = 40_000
    df = spark.range(0, 256, 1, 4).select((F.col("id") % 64).cast("int").alias("tile"), F.array(F.lit(1)).alias("signal"))
    sums = suff.partial_sums(df, ["signal"], lambda tile, c: np.random.default_rng(tile).normal(size=n))
    plan = sums._jdf.queryExecution().toString()
    assert plan.count("Exchange hashpartitioning") >= 2 and "explode" not in plan.lower()
    slices = -(-n // suff.SLICE)
    assert (n * 8 + slices * 64) / (n * 8) < 1.2
