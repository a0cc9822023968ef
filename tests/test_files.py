"""Sources with push-down and sinks that commit."""

from __future__ import annotations

import bz2
import gzip
import json
import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThanOrEqual

from fluorspark.plans import blocks, cli
from fluorspark.sources import cif, named


@pytest.fixture
def pushed(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


@pytest.fixture
def counted(monkeypatch):
    """The bytes that readers in this process take from files."""
    from contextlib import contextmanager

    total, opened = [0], cif._opened

    @contextmanager
    def counting(path):
        with opened(path) as read:
            yield lambda n, at: (total.__setitem__(0, total[0] + n), read(n, at))[1]

    monkeypatch.setattr(cif, "_opened", counting)
    return total


def values(n, cycles, seed=1):
    return np.random.default_rng(seed).integers(-1000, 1000, (n, 4 * cycles))


def rows_of(reader):
    return [r for part in reader.partitions() for batch in reader.read(part) for r in batch.to_pylist()]


def test_a_file_gives_only_what_is_wanted(tmp_path, counted):
    wide = values(1000, 50)
    (tmp_path / "s_1_2.cif").write_bytes(cif.encoded(wide))
    (tmp_path / "s_1_3.cif").write_bytes(cif.encoded(wide))
    reader = cif._PushedFileReader({"path": f"{tmp_path}/s_1_2.cif,{tmp_path}/s_1_3.cif", "cycles": "[3, 4, 40]"})
    left = list(reader.pushFilters([EqualTo(("tile",), 2), In(("lane",), (1, 5)), GreaterThan(("cluster_idx",), 99), LessThanOrEqual(("cluster_idx",), 199), IsNotNull(("lane",))]))
    assert [type(f).__name__ for f in left] == ["IsNotNull"]
    rows = rows_of(reader)
    columns = np.r_[8:16, 156:160]
    assert [r["signal"] for r in rows] == wide[100:200, columns].tolist() and {r["tile"] for r in rows} == {2} and [r["cluster_idx"] for r in rows] == list(range(100, 200))
    assert counted[0] == 2 * 13 + 100 * 12 * 2


def test_shares_of_a_tile(tmp_path, monkeypatch):
    monkeypatch.setattr(cif, "BYTES_A_TASK", 700)
    monkeypatch.setattr(cif, "ROWS_A_BATCH", 7)
    wide = values(101, 3)
    (tmp_path / "s_1_2.cif").write_bytes(cif.encoded(wide))
    reader = cif._FileReader({"path": f"{tmp_path}/s_1_2.cif"})
    assert len(reader.partitions()) == 4
    rows = rows_of(reader)
    assert [r["signal"] for r in rows] == wide.tolist() and [r["cluster_idx"] for r in rows] == list(range(101))


def test_a_task_gets_one_tile_of_a_run_folder(tmp_path, counted):
    wide = values(40, 6)
    tiles = []
    for tile in (1, 2):
        paths = []
        for c in (1, 2, 4, 6):
            path = tmp_path / f"{tile}_{c}.cif"
            path.write_bytes(cif.encoded(wide[:, 4 * c - 4 : 4 * c], first=c))
            paths.append(str(path))
        tiles.append([3, tile, paths, 4 * 333])
    reader = cif._PushedFolderReader({"tiles": json.dumps(tiles), "cycles": "[2, 3, 4]", "from": "10", "to": "20"})
    assert list(reader.pushFilters([EqualTo(("tile",), 2)])) == []
    (part,) = reader.partitions()
    assert counted[0] == 0  # the driver opens nothing
    for held in (pickle.dumps(part), pickle.dumps(reader)):
        assert b"1_1.cif" not in held.replace(b"/2_", b"")
    rows = [r for b in pickle.loads(pickle.dumps(reader)).read(part) for r in b.to_pylist()]
    want = wide[10:20, 4:16].copy()
    want[:, 4:8] = 0
    assert [r["signal"] for r in rows] == want.tolist() and {tuple(r["valid"]) for r in rows} == {(True, False, True)}
    assert counted[0] == 4 * 13 + 2 * (13 + 10 * 4 * 2)


def test_filters_reach_the_source(spark, tmp_path, pushed):
    wide = values(30, 4)
    for tile in (1, 2, 3):
        (tmp_path / f"s_2_{tile}.cif").write_bytes(cif.encoded(wide + tile))
    paths = ",".join(str(tmp_path / f"s_2_{t}.cif") for t in (1, 2, 3))
    rows = cif.load(spark, cif.CifSource, [1, 4], path=paths).where("tile >= 2 AND tile < 3 AND cluster_idx BETWEEN 5 AND 9 AND signal[0] % 2 = 0")
    physical = rows._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "% 2" in physical and ">=" not in physical and "<" not in physical
    want = [(2, k, (wide[k] + 2)[np.r_[0:4, 12:16]].tolist()) for k in range(5, 10) if (wide[k, 0] + 2) % 2 == 0]
    assert sorted((r["tile"], r["cluster_idx"], r["signal"]) for r in rows.collect()) == want


def test_wanted_cycles_of_a_block_string():
    assert blocks.wanted("I1R2I3C1R2") == ([2, 3, 7, 8, 9], "R2C1R2")


def test_a_run_reads_the_cycles_of_its_blocks_alone(spark, tmp_path):
    wide = values(20, 9)
    (tmp_path / "s_1_1.cif").write_bytes(cif.encoded(wide))
    args = cli.parser().parse_args(["-i", str(tmp_path), "-b", "I1R2I3C1R2", "s_1_1.cif"])
    cycles, text = blocks.wanted(args.blocks)
    rows = blocks.split(cli.read(spark, args, cycles), text).orderBy("block", "cluster_idx").collect()
    assert [r["signal"] for r in rows] == [*wide[:, np.r_[4:12, 24:28]].tolist(), *wide[:, 28:36].tolist()]


@pytest.mark.parametrize(("rows_a_part", "packed"), [(65536, ""), (3, ""), (4, "gz"), (5, "bz2")])
def test_text_files(spark, tmp_path, monkeypatch, rows_a_part, packed):
    monkeypatch.setattr(named, "ROWS_A_PART", rows_a_part)
    rows = spark.range(100).select(F.concat(F.lit("f"), F.col("id") % 3, F.lit(".txt")).alias("file"), (100 - F.col("id")).alias("at"), F.concat(F.lit("line é "), "id").alias("value"))
    unpack = {"": lambda b: b, "gz": gzip.decompress, "bz2": bz2.decompress}[packed]
    want = {f"f{k}.txt": "".join(f"line é {i}\n" for i in range(99, -1, -1) if i % 3 == k) for k in range(3)}
    got = lambda: {p.name: unpack(p.read_bytes()).decode() for p in tmp_path.iterdir()}
    named.write_text(rows, str(tmp_path), ["at"], packed)
    assert got() == want
    named.write_text(rows, str(tmp_path), ["at"], packed)
    assert got() == want
    named.write_text(rows, str(tmp_path), ["at"], packed, append=True)
    assert got() == {k: v + v for k, v in want.items()}
    named.write_text(rows.where("id < 0"), str(tmp_path), ["at"], packed)
    assert len(got()) == 3


@pytest.mark.parametrize("width", [1, 2, 4])
def test_intensity_files_from_parts(spark, tmp_path, monkeypatch, width):
    monkeypatch.setattr(named, "ROWS_A_PART", 7)
    made = {t: np.clip(values(50 + t, 3, t), -120, 120) for t in (1, 2)}
    df = spark.createDataFrame([(1, t, k, [int(x) for x in v]) for t, m in made.items() for k, v in enumerate(m)], "lane int, tile int, cluster_idx long, signal array<smallint>")
    cif.write(df.repartition(5), str(tmp_path), width=width)
    for t, m in made.items():
        assert (tmp_path / f"s_1_{t}.cif").read_bytes() == cif.encoded(m.astype(float), width)
    assert len(list(tmp_path.iterdir())) == 2


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    rows = spark.range(40).select(F.concat(F.lit("f"), F.col("id") % 4).alias("file"), F.col("id").alias("at"), F.lit("x").alias("value"))
    (tmp_path / "f1").write_text("before")
    broken = rows.withColumn("value", F.when(F.col("at") == 33, F.raise_error(F.lit("broken")).cast("string")).otherwise(F.col("value")))
    with pytest.raises(Exception, match="broken"):
        named.write_text(broken, str(tmp_path), ["at"])
    assert [p.name for p in tmp_path.iterdir()] == ["f1"] and (tmp_path / "f1").read_text() == "before"
    # a file whose parts are lost fails in the sink's own task, after others were put together
    spark.dataSource.register(named.NamedFiles)
    (tmp_path / "part").write_text("part\n")
    bad = spark.createDataFrame([("a", [(str(tmp_path / "part"), 1)]), ("b", [(str(tmp_path / "gone"), 1)])], named.NamedFiles({}).schema()).coalesce(1)
    with pytest.raises(Exception):
        bad.write.format("named_files").options(path=str(tmp_path / "o"), run="r", kind="text").mode("append").save()
    assert not list((tmp_path / "o").glob("*"))
