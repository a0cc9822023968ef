from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluorspark.functions import calibration
from fluorspark.functions import nucleotides as nuc
from fluorspark.functions import signal as sig
from fluorspark.model import Options
from fluorspark.operators import statistics as stats
from fluorspark.operators import sufficient as suff
from fluorspark.operators.fit import fit, training_mark
from fluorspark.plans import blocks
from fluorspark.sources import cif, sinks, text


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_bases(spark):
    assert one(spark, nuc.parse(F.lit("ACGTaatgXc")), nuc.reverse_complement(F.lit("ACGTaatgXc"))) == ("ACGTAATGNC", "GNCATTACGT")
    assert one(spark, nuc.chars(nuc.codes(F.lit("acgtn"))), nuc.has_ambiguous(F.lit("ACG"))) == ("ACGTN", False)
    assert one(spark, nuc.parse(F.lit(None).cast("string")))[0] is None and one(spark, nuc.codes(F.lit("")))[0] == []


@pytest.mark.parametrize(("p", "char", "q"), [(-0.1, "!", 0), (0.0, "!", 0), (0.5, "$", 3), (0.8, "(", 7), (0.9, "+", 10), (0.955333, "/", 14), (0.99, "5", 20), (0.993, "7", 22), (0.9994, "A", 32), (0.99995, "L", 43), (0.999996, "W", 54), (1.0, "~", 93), (1.1, "!", 0)])
def test_qualities(spark, p, char, q):
    value = nuc.quality_from_prob(F.lit(p))
    assert one(spark, nuc.phred_char(value), nuc.quality_int(value)) == (char, q)
    assert one(spark, nuc.quality_of_char(F.lit(char)))[0] == q


def test_signal(spark):
    df = spark.createDataFrame([([1, 5, 5, 0, 0, 0, 0, 0],), ([],), (None,)], "signal array<smallint>")
    assert [tuple(x) for x in df.select(sig.initial_calls(F.col("signal")), sig.dark_cycles(F.col("signal"))).collect()[:2]] == [([1, 0], 1), ([], 0)]
    x, y = sig.synthetic_xy(F.col("id"))
    assert [tuple(v) for v in spark.range(4).select(x, y).collect()] == [(1, 1), (2, 1), (2, 2), (3, 1)]
    assert one(spark, sig.decode(F.array(F.lit(40.0), F.lit(-0.0005), F.lit(-40.0))))[0] == [32767, -1, -32768]


def test_blocks(spark):
    assert blocks.parse("R4I2C3R1") == [[(0, 4), (6, 3)], [(9, 1)]]
    for bad in ("", "C3", "R", "R0", "X3", "R-1"):
        with pytest.raises(ValueError):
            blocks.parse(bad)
    df = spark.createDataFrame([(1, list(range(12)))], "cluster_idx long, signal array<smallint>")
    assert [tuple(v) for v in blocks.split(df, "R1I1C1R2").orderBy("block").collect()] == [(1, 0, [0, 1, 2, 3, 8, 9, 10, 11]), (1, 1, [])]


def test_calibration(spark):
    t = calibration.Table()
    got = one(spark, calibration.calibrate(F.array(F.lit(10.0), F.lit(20.0), F.lit(30.0)), F.array(F.lit(0), F.lit(4), F.lit(2)), F.lit(1.0)))[0]
    assert np.allclose(got, [t.intercept + t.slope * 10, 0, t.intercept + t.slope * 30])
    both = one(spark, calibration.adjusted(F.lit(1.0), F.lit(1), F.lit(3), F.lit(2)))[0]
    assert math.isclose(both, t.intercept + t.slope + t.prior[7] + t.next[11] + t.triplet[39])
    assert calibration.Table() == text.parse_calibration(text.calibration_text(t).splitlines())


def test_matrix_text():
    m = np.arange(6.0).reshape(2, 3)
    assert (text.parse_matrix(text.matrix_text(m).splitlines()) == m).all()
    with pytest.raises(ValueError):
        text.parse_matrix(["2 2", "1 2"])
    with pytest.raises(ValueError):
        text.parse_matrix(["2 1", "1"])


def test_files_and_ranges():
    assert text.select_files(["b_int.txt", "A_1_int.txt", "a.cif"], "a+", "txt") == ["A_1_int.txt"]
    assert text.parse_range("L2T8") == ((2, 2), (8, 8)) and text.parse_range("l1-2t5-9") == ((1, 2), (5, 9))


def test_output_names(spark):
    def name(of, tag, kind, block=None, sample=None):
        return spark.range(1).select(sinks.output_name(F.lit(of), tag, kind, None if block is None else F.lit(block), sample)).first()[0]

    assert name("s_1_2.cif", "fastq.gz", "cif") == "s_1_2.fastq.gz" and name("s_1_2.cif", "A", "cif", 0) == "s_1_21.A"
    assert name("s_1_0002_int.txt", "seq", "txt") == "s_1_0002_seq.txt" and name("s_1_0002_int.txt.gz", "seq", "txt", 1) == "s_1_00022_seq.txt"
    assert name("s_1_2.cif", "fastq", "cif", None, "S") == "S.fastq" and name("s_1_2.cif", "fastq", "cif", 1, "S") == "S_2.fastq" and name("plain", "seq", "txt") == "seq"


def test_text_round_trip(spark, tmp_path):
    (tmp_path / "a_int.txt").write_text("1\t2\t3\t4\t1.4 2.5 -2.5 40000\t0 0 0 1\n1\t2\t5\t6\t1 2 3 4\t5 6 7 8\n")
    rows = text.read_intensities(spark, str(tmp_path / "a_int.txt")).orderBy("cluster_idx")
    assert [x["signal"] for x in rows.collect()] == [[1, 3, -3, 32767, 0, 0, 0, 1], [1, 2, 3, 4, 5, 6, 7, 8]]
    line = rows.select(text.intensity_line(rows)).first()[0]
    assert line == "1\t2\t3\t4\t1.0 3.0 -3.0 32767.0\t0.0 0.0 0.0 1.0"
    assert text.read_intensities(spark, str(tmp_path / "a_int.txt"), 1).count() == 2
    assert text.read_intensities(spark, str(tmp_path / "a_int.txt"), 3).count() == 0


def test_spikes(spark, tmp_path):
    path = tmp_path / "spikes"
    path.write_text("1\tACGTA\n7\tTTTTT\n")
    assert [(x["cluster_idx"], x["truth"]) for x in text.read_spikes(spark, str(path), 4).orderBy("line").collect()] == [(0, "ACGT"), (6, "TTTT")]
    path.write_text("1\tACGTA\n0\tTTTTT\n")
    with pytest.raises(ValueError):
        text.read_spikes(spark, str(path), 4)


@pytest.mark.parametrize("width", [1, 2, 4])
def test_cif_round_trip(spark, tmp_path, width):
    rng = np.random.default_rng(width)
    values = rng.integers(-100, 100, (9, 12))
    df = spark.createDataFrame([(1, 2, k, [int(v) for v in row]) for k, row in enumerate(values)], "lane int, tile int, cluster_idx long, signal array<smallint>")
    made = cif.write(df, str(tmp_path), width=width).collect()
    assert [(x["file"], x["clusters"]) for x in made] == [("s_1_2.cif", 9)]
    spark.dataSource.register(cif.CifSource)
    read = spark.read.format("intensity").option("path", f"{tmp_path}/s_1_2.cif").load().orderBy("cluster_idx")
    assert [x["signal"] for x in read.collect()] == values.tolist()
    part = spark.read.format("intensity").option("path", f"{tmp_path}/s_1_2.cif").option("cycles", "2").load().orderBy("cluster_idx")
    assert [x["signal"] for x in part.collect()] == values[:, :8].tolist()
    with pytest.raises(ValueError):
        cif.header(b"CIX" + bytes(10))


def test_stitched(spark):
    df = spark.createDataFrame([(1, 0, 2, [5]), (1, 0, 1, [4]), (1, 1, 1, [6])], "tile int, cluster_idx long, first_cycle int, signal array<smallint>")
    assert [tuple(x) for x in cif.stitched(df, ["tile"]).orderBy("cluster_idx").collect()] == [(1, 0, [4, 5]), (1, 1, [6])]


def test_robust_weights_without_spread(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, 1.0)], "tile int, lse double")
    assert {x["weight"] for x in suff.robust_weights(df, ["tile"]).collect()} == {1.0}


def test_thinning_keeps_spikes(spark):
    df = spark.createDataFrame([(k, [0] * 16, k == 5) for k in range(6)], "cluster_idx long, signal array<smallint>, spiked boolean")
    assert [x["cluster_idx"] for x in training_mark(df, Options(thin=2), "spiked").where("used").collect()] == [5]


def test_mixture(spark):
    rng = np.random.default_rng(0)
    sample = np.r_[rng.normal(0, 1, 600), rng.normal(8, 1, 400)]
    parts, like = stats.mixture_fit(spark.createDataFrame([(float(v),) for v in sample], "v double").cache(), "v", 2, 15)
    assert sorted(round(m) for _, m, _ in parts) == [0, 8] and abs(sum(p for p, _, _ in parts) - 1) < 1e-9 and like < 0


def simulated(spark, n, cycles, seed=1):
    """A tile whose truth is known: default crosstalk, a little phasing, noise in all channels."""
    from fluorspark.model import Params
    from fluorspark.operators import kernels

    rng = np.random.default_rng(seed)
    calls, lam = rng.integers(0, 4, (n, cycles)).astype(np.int8), rng.logistic(1500, 120, n).clip(200)
    a = Params.initial(cycles).a + 0.08 * np.kron(np.eye(cycles, k=-1), np.eye(4))
    signal = np.round(kernels.expected(calls, lam, a, np.full(4 * cycles, 20.0)) + rng.normal(0, 60, (n, 4 * cycles))).clip(-32768, 32767)
    rows = [(k, 1 + k % 2, [int(v) for v in s]) for k, s in enumerate(signal)]
    return spark.createDataFrame(rows, "cluster_idx long, tile int, signal array<smallint>"), calls


def test_fit_recovers_bases(spark):
    df, truth = simulated(spark, 600, 5)
    state, params = fit(df, Options(iterations=3))
    got = {x["cluster_idx"]: x["calls"] for x in state.collect()}
    wrong = np.mean([list(truth[k]) != got[k] for k in range(600)])
    assert wrong < 0.02 and set(params) == {1, 2}
    assert state.where("length(quality) = 5").count() == 600


def test_fit_does_not_depend_on_partitions(spark):
    df, _ = simulated(spark, 200, 3, seed=2)
    one_, _ = fit(df.coalesce(1), Options(iterations=2))
    many, _ = fit(df.repartition(7), Options(iterations=2))
    key = lambda d: sorted((x["cluster_idx"], tuple(x["calls"]), x["quality"]) for x in d.collect())
    assert key(one_) == key(many)


def test_failed_tile_gets_null_calls(spark):
    df = spark.createDataFrame([(k, 1, [0] * 8) for k in range(3)], "cluster_idx long, tile int, signal array<smallint>")
    state, params = fit(df, Options(iterations=1, zero_thin=1))
    assert params[1] is None and {x["quality"] for x in state.collect()} == {"!!"}


def test_sequence_sink(spark, tmp_path):
    df = spark.createDataFrame([("s_1_1.cif", 1, 1, 0, 0, 4, 5, [0, 3], "II")], "name string, lane int, tile int, block int, cluster_idx long, x long, y long, calls array<tinyint>, quality string")
    sinks.write_sequences(df, sinks.Outputs(str(tmp_path / "o"), "cif"), form="fastq.gz")
    assert [x["value"] for x in spark.read.text(str(tmp_path / "o/s_1_1.fastq.gz")).collect()] == ["@Sample:1:1:4:5/1", "AT", "+", "II"]
