"""Clusters from a stream of cycles: restarts, late and missing cycles, repeats, and state that does not grow."""

from __future__ import annotations

import datetime as dt

import pytest

from fluorspark.model import Options
from fluorspark.streaming import assembly

SCHEMA = "lane int, tile int, cluster_idx long, cycle int, signal array<smallint>, at timestamp"
NAME = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def store(spark):
    spark.conf.set(NAME, assembly.PROVIDER)
    yield
    spark.conf.unset(NAME)


def cycle(k, c, seconds, base=None):
    b = (k + c) % 4 if base is None else base
    return (1, 1, k, c, [100 * (x == b) for x in range(4)], dt.datetime(2020, 1, 1) + dt.timedelta(seconds=seconds))


def put(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))


def run(spark, tmp_path, options=None):
    q = assembly.call_to(stream(spark, tmp_path / "in"), 3, 10_000, str(tmp_path / "out"), str(tmp_path / "state"), options=options)
    q.awaitTermination(180)
    return q


def calls(spark, tmp_path):
    return {r["cluster_idx"]: r["bases"] for r in spark.read.parquet(str(tmp_path / "out" / "calls")).collect()}


def of(k, gone=()):
    return "".join("N" if c in gone else "ACGT"[(k + c) % 4] for c in range(3))


def test_restart_late_and_missing_cycles(spark, store, tmp_path):
    put(spark, tmp_path / "in", [cycle(k, 0, 0) for k in range(6)] + [(1, 1, 1, 7, [1, 2, 3, 4], dt.datetime(2020, 1, 1)), (1, 1, 2, 1, None, dt.datetime(2020, 1, 1)), (None, 1, 2, 1, [1, 2, 3, 4], dt.datetime(2020, 1, 1))])
    put(spark, tmp_path / "in", [cycle(k, 2, 2) for k in range(4)] + [cycle(0, 0, 2, 3)])
    run(spark, tmp_path)
    assert calls(spark, tmp_path) == {}
    # the query starts again from its checkpoint: cluster 0 has a repeat, which does not count
    put(spark, tmp_path / "in", [cycle(k, 1, 4) for k in range(3)])
    run(spark, tmp_path)
    assert calls(spark, tmp_path) == {k: of(k) for k in range(3)}
    # cluster 3 lacks a cycle when its time is over, clusters 4 and 5 two; what comes for them later is late
    put(spark, tmp_path / "in", [cycle(9, 0, 40)])
    run(spark, tmp_path)
    want = {0: of(0), 1: of(1), 2: of(2), 3: of(3, {1}), 4: of(4, {1, 2}), 5: of(5, {1, 2})}
    assert calls(spark, tmp_path) == want
    put(spark, tmp_path / "in", [cycle(3, 1, 5), cycle(9, 1, 41), cycle(9, 2, 41)])
    run(spark, tmp_path)
    assert calls(spark, tmp_path) == want | {9: of(9)}


def test_state_does_not_grow(spark, store, tmp_path):
    for k in range(6):
        put(spark, tmp_path / "in", [cycle(10 * k + j, c, 30 * k) for j in range(10) for c in range(2 + j % 2)])
    q = run(spark, tmp_path)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    # clusters of two batches at the most, each with a state and a timer in two indexes
    assert len(calls(spark, tmp_path)) >= 50 and max(held) <= 2 * 10 * 3 and held[-1] <= 10 * 3


def test_each_batch_is_fitted(spark, store, tmp_path):
    put(spark, tmp_path / "in", [cycle(k, c, 0) for k in range(40) for c in range(3) if not (k == 7 and c == 1)])
    put(spark, tmp_path / "in", [cycle(100, 0, 60)])
    run(spark, tmp_path, Options(iterations=1))
    got = {r["cluster_idx"]: (r["bases"], r["quality"]) for r in spark.read.parquet(str(tmp_path / "out" / "calls")).collect()}
    assert {k: b for k, (b, _) in got.items() if k < 100} == {k: of(k, {1} if k == 7 else ()) for k in range(40)}
    assert got[7][1][1] == "!" and all(len(q) == 3 for _, q in got.values())


def test_needs_a_store_with_timers(spark, tmp_path):
    put(spark, tmp_path / "in", [cycle(0, 0, 0)])
    with pytest.raises(ValueError, match="providerClass"):
        assembly.assembled(stream(spark, tmp_path / "in"), 3, 1000)
