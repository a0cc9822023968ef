"""Shared helpers: the shared work folder, table reading and batch sizing."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    Where the session names none a fresh folder serves on one machine; a cluster must name its own.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return named or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder: computed once, safe against lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: as ``cut``, for large rows, which compressed columns hold in less space."""
    folder = work_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def release(spark: SparkSession) -> None:
    """Lets go of shuffle files whose results are cut: Spark removes them when its driver collects garbage, which a driver with little to do puts off."""
    gc.collect()
    spark._jvm.System.gc()


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder path for ``name`` inside the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long_ids(df: DataFrame, name: str = "doc_id") -> DataFrame:
    """``df`` with whole-number ids as longs; ids of other types are an error."""
    kind = dict(df.dtypes)[name]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{name} must be a whole number, not {kind}")
    return df.withColumn(name, F.col(name).cast("long"))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of few rows, so that few texts at a time become Python objects; Spark bounds a batch's bytes itself.

    After the last one Arrow gives back what it holds unused: a worker that waits for its next task shares its executor's memory with others.
    """
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
    pa.default_memory_pool().release_unused()


def fields(df: DataFrame, *names: str) -> str:
    """The schema text of some columns of ``df``."""
    types = dict(df.dtypes)
    return ", ".join(f"`{n}` {types[n]}" for n in names)


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns c0, c1, ... and their names by the old ones, so that no own column can clash with them."""
    names = {c: f"c{k}" for k, c in enumerate(df.columns)}
    return df.select(*(F.col(f"`{old}`").alias(new) for old, new in names.items())), names


def restored(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*(F.col(new).alias(old) for old, new in names.items()))


def texts_of(batch: pa.RecordBatch, name: str = "_text") -> list[str | None]:
    return batch.column(name).to_pylist()


def with_new(batch: pa.RecordBatch, keep: tuple[str, ...], new: dict, repeat: list[int] | None = None) -> pa.RecordBatch:
    """The columns ``keep`` of an Arrow batch, each row ``repeat`` times, and new ones; nulls and types stay as they are."""
    kept = [batch.column(n) for n in keep]
    if repeat is not None:
        rows = pa.array(np.repeat(np.arange(batch.num_rows), repeat))
        kept = [c.take(rows) for c in kept]
    return pa.RecordBatch.from_arrays([*kept, *(x if isinstance(x, pa.Array) else pa.array(x) for x in new.values())], names=[*keep, *new])
