from __future__ import annotations

import numpy as np
import pytest

from fluorspark.plans import cli
from fluorspark.sources import cif, text
from fluorspark.streaming import cycles


def tile(n=40, c=4, seed=3):
    from fluorspark.model import Params
    from fluorspark.operators import kernels

    rng = np.random.default_rng(seed)
    calls = rng.integers(0, 4, (n, c)).astype(np.int8)
    return calls, np.round(kernels.expected(calls, rng.uniform(800, 1500, n), Params.initial(c).a, np.zeros(4 * c)))


def test_command_line_on_binary_files(spark, tmp_path):
    calls, signal = tile()
    (tmp_path / "s_1_2.cif").write_bytes(cif.encoded(signal))
    (tmp_path / "truth").write_text("1\t" + "".join("ACGT"[b] for b in calls[0]) + "\n")
    args = cli.parser().parse_args(["-i", str(tmp_path), "-o", str(tmp_path / "out"), "-n", "2", "-K", str(tmp_path / "truth"), "-w", "-f", "fastq.gz", "s_1+"])
    cli.run(spark, args)
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "out/s_1_2.fastq.gz")).collect()]
    assert len(lines) == 160 and lines[0] == "@Sample:1:2:1:1/1"
    assert np.mean(["".join("ACGT"[b] for b in calls[k]) == lines[4 * k + 1] for k in range(40)]) > 0.9
    counts = [r["value"].split("\t") for r in spark.read.text(str(tmp_path / "out/s_1_2.qspike")).collect()]
    assert len(counts) == 94 and sum(int(c[2]) for c in counts) == 4


def test_command_line_on_text_in_blocks(spark, tmp_path):
    _, signal = tile(12, 5)
    rows = ["\t".join(["1", "3", str(k), "7", *(" ".join(map(str, s[4 * c : 4 * c + 4])) for c in range(5))]) for k, s in enumerate(signal)]
    (tmp_path / "a_int.txt").write_text("\n".join(rows) + "\n")
    args = cli.parser().parse_args(["-d", "txt", "-b", "R2I1R2", "-n", "1", "-f", "fasta", "-i", str(tmp_path), "-o", str(tmp_path / "out"), "a_int.txt"])
    assert cli.run(spark, args).count() == 24
    lines = [{r["value"] for r in spark.read.text(str(tmp_path / f"out/a{k}_seq.txt")).collect()} for k in (1, 2)]
    assert ">Sample:1:3:0:7/1" in lines[0] and ">Sample:1:3:0:7/2" in lines[1]
    with pytest.raises(ValueError):
        cli.run(spark, cli.parser().parse_args(["-i", str(tmp_path), "none+"]))
    with pytest.raises(ValueError):
        cli.options_of(spark, cli.parser().parse_args(["-A", "x", "a"]))


def test_truth_by_tile_and_block(spark, tmp_path):
    truth = {}
    (tmp_path / "truth").mkdir()
    for tile_, seed in ((2, 3), (3, 8)):
        truth[tile_], signal = tile(30, 5, seed)
        (tmp_path / f"s_1_{tile_}.cif").write_bytes(cif.encoded(signal))
    letters = lambda calls: "".join("ACGT"[b] for b in calls)
    for tile_, calls in truth.items():
        for block, at in enumerate((slice(0, 2), slice(3, 5))):
            # the same clusters in both tiles; the last truth of a cluster counts
            (tmp_path / f"truth/s_1_{tile_}{block + 1}.spike").write_text("1\tNN\n" + "".join(f"{k + 1}\t{letters(calls[k][at])}\n" for k in range(10)))
    run = lambda out, *more: cli.run(spark, cli.parser().parse_args(["-i", str(tmp_path), "-o", str(tmp_path / out), "-n", "2", "-K", str(tmp_path / "truth"), *more, "s_1+"]))
    calls = run("out", "-b", "R2I1R2").collect()
    counts = [[int(v) for v in r["value"].split("\t")] for r in spark.read.text(str(tmp_path / "out/*.qspike")).collect()]
    want = [(a, b) for r in calls if r["cluster_idx"] < 10 for a, b in zip(r["bases"], letters(truth[r["tile"]][r["cluster_idx"]][slice(0, 2) if r["block"] == 0 else slice(3, 5)]), strict=True)]
    assert sum(c[2] for c in counts) == len(want) == 80 and sum(c[1] for c in counts) == sum(a != b for a, b in want)
    with pytest.raises(ValueError):
        text.spike_place("s_1_2_spike.txt", 2)
    assert text.spike_place("s_1_0002_spike2.txt", 2) == (1, 2, 1) and text.spike_place("s_1_2.spike") == (1, 2, 0) and text.spike_place("truth") is None


def test_run_folder(spark, tmp_path):
    _, signal = tile(6, 3)
    for c in range(3):
        folder = tmp_path / f"Data/Intensities/L002/C{c + 1}.1"
        folder.mkdir(parents=True)
        (folder / "s_2_8.cif").write_bytes(cif.encoded(signal[:, 4 * c : 4 * c + 4], first=c + 1))
    rows = cli.read_folder(spark, str(tmp_path), ["L2T8-9"]).orderBy("cluster_idx").collect()
    assert [r["signal"] for r in rows] == signal.astype(int).tolist() and {r["tile"] for r in rows} == {8}


def letters(calls):
    return "".join("ACGTN"[b] for b in calls)


def test_truth_stands_for_calls_in_the_fit(spark):
    """Spike-ins are never thinned, keep their bases in all iterations but the last, and are called in the last."""
    from pyspark.sql import functions as F

    from fluorspark.model import Options
    from fluorspark.operators.fit import fit

    calls, signal = tile(60, 4)
    wrong = (calls[0] + 1) % 4
    rows = [(k, 1, [int(v) for v in s], [int(b) for b in (wrong if k == 1 else calls[k])] if k in (1, 3, 5) else None) for k, s in enumerate(signal)]
    rows[5][3][0] = 4  # an ambiguous base in the truth
    df = spark.createDataFrame(rows, "cluster_idx long, tile int, signal array<smallint>, truth array<tinyint>")
    state, _ = fit(df, Options(iterations=1, thin=2), truth="truth")
    got = {r["cluster_idx"]: r for r in state.collect()}
    assert {k for k, r in got.items() if r["used"]} == {k for k in range(60) if k % 2 == 0} | {1, 3, 5}
    assert np.mean([list(got[k]["calls"]) == calls[k].tolist() for k in range(60)]) > 0.9
    # with an iteration to come, the truth is still there
    import fluorspark.operators.fit as module

    held, cut = [], module.shared_cut
    module.shared_cut = lambda d: (made := cut(d), held.append(made))[0]
    try:
        fit(df, Options(iterations=2), truth="truth")
    finally:
        module.shared_cut = cut
    states = [d for d in held if "calls" in d.columns]
    first, second, last = ({r["cluster_idx"]: list(r["calls"]) for r in d.where(F.col("truth").isNotNull()).collect()} for d in states)
    assert first == second == {k: rows[k][3] for k in (1, 3, 5)} and last[3] == calls[3].tolist()


def test_spikes_of_one_tile_recalibrate_its_qualities(spark, tmp_path):
    truth = {}
    (tmp_path / "truth").mkdir()
    for tile_, seed in ((2, 3), (3, 8)):
        truth[tile_], signal = tile(30, 4, seed)
        (tmp_path / f"s_1_{tile_}.cif").write_bytes(cif.encoded(signal))
    (tmp_path / "truth/s_1_2.spike").write_text("".join(f"{k + 1}\t{letters(truth[2][k])}\n" for k in range(12)) + "99\tACGT\n")
    run = lambda out, *more: cli.run(spark, cli.parser().parse_args(["-i", str(tmp_path), "-o", str(tmp_path / out), "-n", "2", "-K", str(tmp_path / "truth"), *more, "s_1+"]))
    plain = {(r["tile"], r["cluster_idx"]): r for r in run("a").collect()}
    counts = [(2, *map(int, r["value"].split("\t"))) for r in spark.read.text(str(tmp_path / "a/s_1_2.qspike")).collect()]
    # only the tile with truth is counted, on qualities as the model gives them
    want = {}
    for k in range(12):
        for a, b, q in zip(plain[2, k]["bases"], letters(truth[2][k]), plain[2, k]["quality"], strict=True):
            diff, obs = want.get(ord(q) - 33, (0, 0))
            want[ord(q) - 33] = (diff + (a != b), obs + 1)
    assert not (tmp_path / "a/s_1_3.qspike").exists() and len(counts) == 94 and {q: (d, n) for _, q, d, n in counts if n} == want
    actual = {q: int(np.floor(-10 * np.log10((d + 10 ** (-q / 10)) / (n + 1)) + 0.5)) for _, q, d, n in counts}
    new = {(r["tile"], r["cluster_idx"]): r for r in run("b", "-k").collect()}
    assert all(new[k]["quality"] == ("".join(chr(33 + min(93, max(0, actual[ord(q) - 33]))) for q in r["quality"]) if k[0] == 2 else r["quality"]) for k, r in plain.items())
    assert any(new[2, k]["quality"] != plain[2, k]["quality"] for k in range(30)) and not list((tmp_path / "b").glob("*.qspike"))


def run_folder(root, lane, tile_, cycles, **more):
    for c, signal in cycles.items():
        folder = root / f"Data/Intensities/L{lane:03d}/C{c}.1"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"s_{lane}_{tile_}.cif").write_bytes(cif.encoded(signal, first=c, **more))


def test_run_folder_with_gaps_and_positions(spark, tmp_path):
    import bz2
    import gzip

    _, signal = tile(6, 4)
    at = lambda c: signal[:, 4 * c - 4 : 4 * c]
    run_folder(tmp_path, 2, 8, {1: at(1), 3: at(3), 4: at(4)})
    run_folder(tmp_path, 2, 9, {c: at(c) for c in (1, 2, 3, 4)})
    for c, pack in ((1, gzip), (2, bz2)):
        path = tmp_path / f"Data/Intensities/L002/C{c}.1/s_2_9.cif"
        path.with_suffix(".cif.gz" if pack is gzip else ".cif.bz2").write_bytes(pack.compress(path.read_bytes()))
        path.unlink()
    (tmp_path / "Data/Intensities/s_2_0008_pos.txt").write_text("".join(f"{k}.25 {k * 2}.0\n" for k in range(6)))
    rows = cli.read_folder(spark, str(tmp_path), ["L2T8-10"]).orderBy("tile", "cluster_idx").collect()
    gap = signal.astype(int).copy()
    gap[:, 4:8] = 0
    assert [r["signal"] for r in rows] == gap.tolist() + signal.astype(int).tolist()
    assert [(r["x"], r["y"]) for r in rows[:6]] == [(1000 + int(np.floor(10 * (k + 0.25) + 0.5)), 1000 + 20 * k) for k in range(6)] and (rows[6]["x"], rows[6]["y"]) == (1, 1)
    (tmp_path / "Data/Intensities/s_2_0008_pos.txt").write_text("1 2\n")
    with pytest.raises(Exception, match="numbers of clusters and coordinates differ"):
        cli.read_folder(spark, str(tmp_path), ["L2T8"]).collect()
    run_folder(tmp_path, 3, 1, {1: at(1), 2: at(2)[:4]})
    with pytest.raises(Exception, match="number of clusters"):
        cli.read_folder(spark, str(tmp_path), ["L3T1"]).collect()
    run_folder(tmp_path, 3, 2, {1: at(1), 2: at(2)})
    (tmp_path / "Data/Intensities/L003/C2.1/s_3_2.cif").write_bytes(cif.encoded(at(2), first=1))
    with pytest.raises(Exception, match="given twice"):
        cli.read_folder(spark, str(tmp_path), ["L3T2"]).collect()


def test_files_that_cannot_be_opened_are_skipped(spark, tmp_path):
    _, signal = tile(5, 3)
    (tmp_path / "s_1_2.cif").write_bytes(cif.encoded(signal))
    (tmp_path / "s_1_3.cif").write_bytes(b"nothing")
    (tmp_path / "s_1_4.cif").write_bytes(b"XYZ" + cif.encoded(signal)[3:])
    args = cli.parser().parse_args(["-i", str(tmp_path), "-d", "CIF", "s_1+"])
    assert {r["tile"] for r in cli.read(spark, args).collect()} == {2}
    line = "\t".join(["1", "3", "4", "7", "1 2 3 4", "5 6 7 8"])
    (tmp_path / "a_int.txt").write_text(line + "\n")
    (tmp_path / "a_int.txt.gz").write_bytes(b"\x1f\x8b no gzip")
    args = cli.parser().parse_args(["-i", str(tmp_path), "-d", "Txt", "a_int+"])
    assert [tuple(r) for r in cli.read(spark, args).collect()] == [(1, 3, 0, 4, 7, [1, 2, 3, 4, 5, 6, 7, 8], None, "a_int.txt")]


def test_working_outputs_and_simulation(spark, tmp_path):
    calls, signal = tile(40, 3)
    (tmp_path / "s_1_2.cif").write_bytes(cif.encoded(signal))
    run = lambda out, *more: cli.run(spark, cli.parser().parse_args(["-i", str(tmp_path), "-o", str(tmp_path / out), "-n", "0x2", *more, "s_1_2.cif"]))
    out = run("w", "-w", "processed", "-s", "a header\n\nof lines").collect()
    lines = lambda name: [r["value"] for r in spark.read.text(str(tmp_path / "w" / name)).collect()]
    a, n = text.parse_matrix(lines("s_1_2.A")), text.parse_matrix(lines("s_1_2.N"))
    held = spark.read.parquet(str(tmp_path / "w/final")).first()
    assert a.shape == (12, 12) and n.shape == (4, 3) and np.allclose(a.ravel(), held["a"], atol=1e-6) and np.allclose(n.T.ravel(), held["n"], atol=1e-6) and held["effdf"] > 0
    spark.dataSource.register(cif.CifSource)
    pif = {r["cluster_idx"]: r["signal"] for r in spark.read.format("intensity").option("path", str(tmp_path / "w/s_1_2.pif")).load().collect()}
    want = np.linalg.solve(a, (signal - np.array(held["n"])).T).T
    assert np.abs(np.array([pif[k] for k in range(40)]) - want).max() < 0.51 + 1e-3 * np.abs(want).max()
    runfile = lines("s_1_2.runfile")
    head = [x for x in runfile if x.startswith("#")]
    assert head[:3] == ["# 5", "# a header", "# of lines"] and len(runfile) == len(head) + 13
    light = np.array([r["brightness"] for r in out if r["brightness"] != 0])
    fields = runfile[len(head)].split()
    assert fields[:2] == ["3", "L"] and np.allclose([float(x) for x in fields[2:]], [light.mean(), light.std(ddof=1) * 3**0.5 / np.pi], atol=1e-5)
    v = np.array([[float(x) for x in row.split()] for row in runfile[len(head) + 1 :]])
    assert np.allclose(v, v.T, atol=1e-4) and (np.diag(v) > 0).all()
    assert spark.read.text(str(tmp_path / "w/Sample.tab"), wholetext=True).count() == 1
    run("m", "-w", "matrices")
    assert (tmp_path / "m/s_1_2.A").exists() and not (tmp_path / "m/final").exists() and not (tmp_path / "m/s_1_2.pif").exists()
    run("c", "-c", "-f", "fasta")
    run("c", "-c", "-f", "fasta")
    assert spark.read.text(str(tmp_path / "c/Sample.fasta")).count() == 160


def test_whole_numbers_as_in_c():
    assert [cli.uint(x) for x in ("12", "0x1F", "010", "0", "-3", "+7")] == [12, 31, 8, 0, 0, 7]
    with pytest.raises(Exception):
        cli.uint("twelve")
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["--version"])


def test_the_fit_is_the_same_for_many_tiles(spark):
    """A tile's calls do not depend on the other tiles."""
    from pyspark.sql import functions as F

    from fluorspark.model import Options
    from fluorspark.operators.fit import fit

    _, signal = tile(30, 3)
    one = spark.createDataFrame([(k, [int(v) for v in s]) for k, s in enumerate(signal)], "cluster_idx long, signal array<smallint>")
    want = None
    for n in (1, 10, 300):
        many = one.withColumn("tile", F.explode(F.sequence(F.lit(1), F.lit(n))))
        state, files = fit(many.select("cluster_idx", "tile", "signal"), Options(iterations=2))
        got = state.select("cluster_idx", F.transform("calls", lambda b: b.cast("int")).alias("c"), "quality").groupBy("cluster_idx", "c", "quality").count().collect()
        assert len(got) == 30 and {r["count"] for r in got} == {n} and len(set(files)) == n
        want = want or {(r["cluster_idx"], tuple(r["c"]), r["quality"]) for r in got}
        assert want == {(r["cluster_idx"], tuple(r["c"]), r["quality"]) for r in got}


def test_stream_of_cycles(spark, tmp_path):
    _, signal = tile(5, 3)
    schema = "tile int, cluster_idx long, cycle int, signal array<smallint>"
    for c in (2, 0, 1):
        rows = [(1, k, c, [int(v) for v in s[4 * c : 4 * c + 4]]) for k, s in enumerate(signal) if not (k == 4 and c == 1)]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    query = cycles.call_to(stream, 3, str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(120)
    done = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["cluster_idx"] for r in done.select("cluster_idx").distinct().collect()) == [0, 1, 2, 3] and {len(r["bases"]) for r in done.collect()} == {3}


def simulated(n=200, c=8, seed=5, noise=25.0):
    rng = np.random.default_rng(seed)
    calls, signal = tile(n, c, seed)
    return calls, np.round(signal + rng.normal(0, noise, signal.shape))


def run_of(spark, source, out, *more):
    """The calls of a run by cluster and block."""
    rows = cli.run(spark, cli.parser().parse_args(["-i", str(source), "-o", str(out), "-n", "2", *more])).collect()
    return {(r["cluster_idx"], r["block"]): r for r in rows}


def test_cycles_without_files_are_called_n(spark, tmp_path):
    calls, signal = simulated()
    at = lambda c: signal[:, 4 * c - 4 : 4 * c]
    there = [1, 3, 4, 6, 8]
    run_folder(tmp_path / "gap", 1, 1, {c: at(c) for c in there})
    run_folder(tmp_path / "less", 1, 1, {k + 1: at(c) for k, c in enumerate(there)})
    got = run_of(spark, tmp_path / "gap", tmp_path / "a", "-r", "-q", "-w", "processed", "-s", "x", "L1T1")
    less = run_of(spark, tmp_path / "less", tmp_path / "b", "-r", "-q", "L1T1")
    for k, r in got.items():
        bases, quality = (list(less[k][c]) for c in ("bases", "quality"))
        for c in (2, 5, 7):
            bases.insert(c - 1, "N")
            quality.insert(c - 1, "!")
        assert (r["bases"], r["quality"]) == ("".join(bases), "".join(quality))
    assert np.mean([[b == "ACGT"[calls[k[0], c - 1]] for c, b in enumerate(r["bases"], 1) if c in there] for k, r in got.items()]) > 0.99
    # outputs have all cycles: those without data are neutral
    a, n = (text.parse_matrix((tmp_path / f"a/s_1_1.{x}").read_text().splitlines()) for x in "AN")
    assert a.shape == (32, 32) and n.shape == (4, 8) and (n[:, 1] == 0).all() and (a[4:8, :4] == 0).all()
    pif = np.array([r["signal"] for r in cif.load(spark, cif.CifSource, path=str(tmp_path / "a/s_1_1.pif")).orderBy("cluster_idx").collect()])
    assert pif.shape == (200, 32) and (pif[:, 4:8] == 0).all() and (pif[:, :4] != 0).any()
    # calibration takes no neighbour that is not there
    tabled = run_of(spark, tmp_path / "gap", tmp_path / "c", "-r", "L1T1")
    assert all(r["bases"] == got[k]["bases"] and all(r["quality"][c - 1] == "!" for c in (2, 5, 7)) for k, r in tabled.items())


def test_cycles_that_are_dark_in_a_tile(spark, tmp_path):
    _, signal = simulated(60, 5)
    dark = signal.copy()
    dark[:, 8:12] = 0
    dark[0, :4] = 0  # one cluster alone is no reason
    (tmp_path / "s_1_1.cif").write_bytes(cif.encoded(dark))
    (tmp_path / "s_1_2.cif").write_bytes(cif.encoded(np.zeros((7, 20))))
    rows = cli.run(spark, cli.parser().parse_args(["-i", str(tmp_path), "-o", str(tmp_path / "o"), "-n", "1", "--mask-nodata", "-b", "R1I1C2R1", "s_1+"])).collect()
    assert all(r["bases"] == "N" * len(r["bases"]) and set(r["quality"]) == {"!"} for r in rows if r["tile"] == 2)
    first = [r for r in rows if r["tile"] == 1 and r["block"] == 0]
    assert len(first) == 60 and all(r["bases"][1] == "N" and "N" not in r["bases"][0] + r["bases"][2] for r in first)
    assert len([r for r in rows if r["tile"] == 2]) == 14


def test_fixed_parameters_over_valid_cycles(spark, tmp_path):
    from fluorspark.model import Params

    _, signal = simulated(50, 4)
    at = lambda c: signal[:, 4 * c - 4 : 4 * c]
    run_folder(tmp_path / "gap", 1, 1, {c: at(c) for c in (1, 2, 4)})
    run_folder(tmp_path / "less", 1, 1, {k + 1: at(c) for k, c in enumerate((1, 2, 4))})
    for n, name in ((4, "4"), (3, "3")):
        (tmp_path / f"A{name}").write_text(text.matrix_text(Params.initial(n).a))
        (tmp_path / f"N{name}").write_text(text.matrix_text(np.zeros((4, n))))
    fixed = lambda n: ("-A", str(tmp_path / f"A{n}"), "-N", str(tmp_path / f"N{n}"), "-q", "-r", "L1T1")
    got, less = run_of(spark, tmp_path / "gap", tmp_path / "a", *fixed(4)), run_of(spark, tmp_path / "less", tmp_path / "b", *fixed(3))
    assert all(r["bases"] == less[k]["bases"][:2] + "N" + less[k]["bases"][2] and r["quality"] == less[k]["quality"][:2] + "!" + less[k]["quality"][2] for k, r in got.items())


def test_blocks_of_one_cycle(spark, tmp_path):
    from fluorspark.operators import kernels, solve

    calls, signal = simulated(80, 5)
    (tmp_path / "s_1_1.cif").write_bytes(cif.encoded(signal))
    got = run_of(spark, tmp_path, tmp_path / "o", "-b", "R1I3R1", "-m", "1e-5", "-q", "-w", "values", "s_1_1.cif")
    assert np.mean([r["bases"] == "ACGT"[calls[k, 4 * b]] for (k, b), r in got.items()]) > 0.99
    held = {r["block"]: r for r in spark.read.parquet(str(tmp_path / "o/final")).collect()}
    for b in (0, 1):
        own, lam = signal[:, 16 * b : 16 * b + 4], np.array([got[k, b]["brightness"] for k in range(80)])
        p = kernels.processed(own, np.reshape(held[b]["a"], (4, 4)), np.array(held[b]["n"]))
        call, quality = kernels.single_cycle_call(p, lam, np.reshape(held[b]["omega"], (4, 4)), np.zeros(4), 1e-5)
        assert ["ACGT"[x] for x in call] == [got[k, b]["bases"] for k in range(80)] and kernels.quality_text(quality[:, None]) == [got[k, b]["quality"] for k in range(80)]
    assert solve.precision(np.eye(4)).shape == (4, 4)


def test_a_run_that_is_repeated_replaces_its_files(spark, tmp_path):
    _, signal = simulated(30, 3)
    (tmp_path / "s_1_2.cif").write_bytes(cif.encoded(signal))
    content = lambda: {p.name: p.read_bytes() for p in (tmp_path / "o").iterdir() if p.is_file() and not p.name.endswith(".crc")}
    run_of(spark, tmp_path, tmp_path / "o", "-w", "processed", "-s", "x", "s_1_2.cif")
    once = content()
    run_of(spark, tmp_path, tmp_path / "o", "-w", "processed", "-s", "x", "s_1_2.cif")
    assert content() == once and {"s_1_2.fastq", "s_1_2.A", "s_1_2.N", "s_1_2.pif", "s_1_2.runfile", "Sample.tab"} == set(once)
    assert spark.read.parquet(str(tmp_path / "o/final")).count() == 1 and not [p for p in (tmp_path / "o").iterdir() if p.name.startswith("_")]
