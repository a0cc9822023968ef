"""Every query with SQL equals DuckDB on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from fluorspark import queries as base
from fluorspark.model import Options
from fluorspark.plans import entry as plan

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(frame, columns):
    return sorted(str(tuple(x)) for x in frame[columns].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(base.ORACLES))
def test_matches_sql(spark, duck, tmp_path, name):
    base.QUERIES[name](spark, SF).write.parquet(str(tmp_path / "out"))
    got = duck.sql(f"SELECT * FROM '{tmp_path}/out/*.parquet'").df()
    want = duck.sql(base.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


@pytest.mark.parametrize("name", sorted(set(base.QUERIES) - set(base.ORACLES)))
def test_others_run(spark, name):
    assert base.QUERIES[name](spark, SF).count() > 0


def test_fit_runs_the_default_iterations(spark):
    want = plan.run(base.clusters(spark, SF), Options())
    assert sorted(map(tuple, base.QUERIES["fit_tile"](spark, SF).select("tile", "cluster_idx", "bases", "quality").collect())) == sorted(map(tuple, want.select("tile", "cluster_idx", "bases", "quality").collect()))


def test_whole_mixture_equals_brute_force(spark, duck):
    v = np.log(duck.sql("SELECT value FROM events").df()["value"].to_numpy(float) + 1)
    share, sd = np.full(3, 1 / 3), np.full(3, v.std() / 3)
    mean = v.mean() + (2 - np.arange(1, 4)) * v.std()
    for _ in range(100):
        log = np.log(share) - np.log(sd) - 0.5 * ((v[:, None] - mean) / sd) ** 2
        w = np.exp(log - log.max(axis=1, keepdims=True))
        w /= w.sum(axis=1, keepdims=True)
        share, mean = w.mean(axis=0), (w * v[:, None]).sum(axis=0) / w.sum(axis=0)
        sd = np.sqrt((w * v[:, None] ** 2).sum(axis=0) / w.sum(axis=0) - mean**2)
    got = base.QUERIES["mixnormal_em_whole"](spark, SF).orderBy("component").collect()
    assert np.allclose([r[1:] for r in got], np.c_[share, mean, sd], atol=1e-3)


def test_every_cluster_has_a_best_path(spark):
    assert base.QUERIES["viterbi_independent_whole"](spark, SF).count() == base.clusters(spark, SF).count()


def test_entry(spark):
    assert entry.entry(spark).count() == 500
    assert set(entry.oracle_sql()) <= set(entry.queries())
