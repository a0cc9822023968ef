"""Sufficient statistics of the mixing model: in batches, whose rows do not grow with the squared number of cycles, and in long form, as their plain definition.

Rows carry ``signal``, ``calls`` (base codes), ``brightness`` and ``weight``. Positions count
cycle * 4 + channel from 0. Ambiguous bases contribute to nothing but the signal sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluorspark.model import CHANNELS

#: Numbers of a slice of a tile's sums, and numbers that a task holds before it sends them.
SLICE, HELD_NUMBERS = 4096, 8 << 20


def robust_weights(df: DataFrame, by: list[str], error: str = "lse") -> DataFrame:
    """Adds ``weight``: 1 / (1 + half the squared standardised distance of a row's error from its group's mean); 1 where all errors agree."""
    moments = df.groupBy(*by).agg(F.avg(error).alias("_mean"), F.var_samp(error).alias("_var"))
    far = F.pow(F.col(error) - F.col("_mean"), 2) / F.col("_var")
    return df.join(moments, by).withColumn("weight", F.when(F.coalesce(F.col("_var"), F.lit(0.0)) > 0, 1 / (1 + 0.5 * far)).otherwise(1.0)).drop("_mean", "_var")


def signal_long(df: DataFrame, by: list[str]) -> DataFrame:
    return df.select(*by, "weight", "brightness", F.posexplode("signal").alias("pos", "v"))


def called_long(df: DataFrame, by: list[str]) -> DataFrame:
    """A row for each call that is a base: ``at`` is its position."""
    rows = df.select(*by, "weight", "brightness", F.posexplode("calls").alias("cycle", "base"))
    return rows.where(F.col("base") < CHANNELS).select(*by, "weight", "brightness", (F.col("cycle") * CHANNELS + F.col("base")).alias("at"))


def signal_sums(df: DataFrame, by: list[str]) -> DataFrame:
    """Weighted signal of every position."""
    return signal_long(df, by).groupBy(*by, "pos").agg(F.sum(F.col("weight") * F.col("v")).alias("ibar"))


def call_sums(df: DataFrame, by: list[str]) -> DataFrame:
    """Weighted brightness of every called position."""
    return called_long(df, by).groupBy(*by, F.col("at").alias("pos")).agg(F.sum(F.col("weight") * F.col("brightness")).alias("sbar"))


def _calls_array(df: DataFrame) -> DataFrame:
    at = F.transform("calls", lambda b, c: F.when(b < CHANNELS, c * CHANNELS + b))
    return df.withColumn("_at", F.array_compact(at))


def gram(df: DataFrame, by: list[str]) -> DataFrame:
    """J: weighted squared brightness of every pair of called positions (both orders)."""
    pairs = _calls_array(df).select(*by, (F.col("weight") * F.col("brightness") * F.col("brightness")).alias("w"), "_at", F.explode("_at").alias("i"))
    return pairs.select(*by, "w", "i", F.explode("_at").alias("j")).groupBy(*by, "i", "j").agg(F.sum("w").alias("v"))


def cross(df: DataFrame, by: list[str]) -> DataFrame:
    """K: weighted brightness times signal for every called position i and signal position j."""
    pairs = _calls_array(df).select(*by, (F.col("weight") * F.col("brightness")).alias("w"), "signal", F.explode("_at").alias("i"))
    return pairs.select(*by, "w", "i", F.posexplode("signal").alias("j", "x")).groupBy(*by, "i", "j").agg(F.sum(F.col("w") * F.col("x")).alias("v"))


def band_covariance(df: DataFrame, by: list[str], processed: str = "processed") -> DataFrame:
    """V: weighted covariance of residuals (processed less brightness at the call), cycles at most one apart."""
    rest = F.transform(processed, lambda p, k: p - F.when(F.get("calls", F.floor(k / CHANNELS).cast("int")).cast("int") == k % CHANNELS, F.col("brightness")).otherwise(0.0))
    rows = df.select(*by, "weight", rest.alias("r"))
    left = rows.select(*by, "weight", "r", F.posexplode("r").alias("i", "x"))
    first = F.greatest(F.lit(0), (F.floor(F.col("i") / CHANNELS) - 1) * CHANNELS).cast("int")
    near = left.select(*by, "weight", "i", "x", first.alias("f"), F.posexplode(F.slice("r", first + 1, F.when(F.col("i") < CHANNELS, 2 * CHANNELS).otherwise(3 * CHANNELS))).alias("d", "y"))
    return near.groupBy(*by, "i", (F.col("f") + F.col("d")).alias("j")).agg((F.sum(F.col("weight") * F.col("x") * F.col("y")) / F.sum("weight")).alias("v"))


def one_hot(calls: np.ndarray) -> np.ndarray:
    """n x 4C of a matrix of codes (n x C)."""
    return (calls[:, :, None] == np.arange(CHANNELS)).reshape(len(calls), -1).astype(np.float64)


def batch_sums(signal: np.ndarray, calls: np.ndarray, brightness: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """J, K, sums of calls and of signal and the weights' sum as one flat vector."""
    s = one_hot(calls)
    wl = weight * brightness
    return np.concatenate([((s * (wl * brightness)[:, None]).T @ s).ravel(), ((s * wl[:, None]).T @ signal).ravel(), wl @ s, weight @ signal, [weight.sum()]])


def unpacked_width(sums: np.ndarray) -> int:
    """The number of positions, 4C, of a vector of ``batch_sums``."""
    return int(round((np.sqrt(1 + 2 * (len(sums) - 1)) - 1) / 2))


def by_base_pairs(matrix: np.ndarray) -> np.ndarray:
    """J or K (4C x 4C) with a row for each pair of bases (or base and channel) and a column for each pair of cycles: the form of the separable model."""
    c = len(matrix) // CHANNELS
    return matrix.reshape(c, CHANNELS, c, CHANNELS).transpose(1, 3, 0, 2).reshape(CHANNELS * CHANNELS, c * c)


def matrix_of(column: pa.Array, kind: type = np.float64) -> np.ndarray:
    """Arrow lists of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def band_sums(rest: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted products of residuals of one cycle and of neighbouring cycles (all that a chain's precision needs), and the weights' sum, as one flat vector."""
    r = rest.reshape(len(rest), -1, CHANNELS)
    w = r * weight[:, None, None]
    return np.concatenate([np.einsum("nci,ncj->cij", w, r).ravel(), np.einsum("nci,ncj->cij", w[:, :-1], r[:, 1:]).ravel(), [weight.sum()]])


def band_matrix(sums: np.ndarray) -> np.ndarray:
    """The covariance of ``band_sums``, zero off the band."""
    size = CHANNELS * CHANNELS
    cycles = (len(sums) - 1 + size) // (2 * size)
    v = sums[:-1].reshape(-1, CHANNELS, CHANNELS) / sums[-1]
    out = np.zeros((cycles, CHANNELS, cycles, CHANNELS))
    for c in range(cycles):
        out[c, :, c, :] = v[c]
        if c:
            out[c - 1, :, c, :], out[c, :, c - 1, :] = v[cycles + c - 1], v[cycles + c - 1].T
    return out.reshape(cycles * CHANNELS, -1)


def partial_sums(df: DataFrame, columns: list[str], kernel) -> DataFrame:
    """``tile`` and ``v``, the sum of ``kernel(tile, arrays)``, a flat vector.

    Each task adds up its rows and sends its sums in dense slices of ``SLICE`` numbers; the task that gets a slice of a tile adds up what
    comes, slice by slice and in the order of the tasks, so that sums do not depend on timing; a tile's few slices are then put side by side.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sent, held = TaskContext.get().partitionId(), 0, {}

        def flushed() -> Iterator[pa.RecordBatch]:
            for tile, total in held.items():
                cuts = range(0, len(total), SLICE)
                n = len(cuts)
                yield pa.RecordBatch.from_arrays([pa.array([tile] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array([(part << 20) + sent] * n, pa.int64()), pa.array([total[k : k + SLICE] for k in cuts], pa.list_(pa.float64()))], names=["tile", "slice", "part", "v"])
            held.clear()

        for batch in batches:
            tiles = batch.column("tile").to_numpy()
            for tile in np.unique(tiles):
                own = batch.take(pa.array(np.flatnonzero(tiles == tile)))
                new = kernel(int(tile), [own.column(c) for c in columns])
                held[int(tile)] = held[int(tile)] + new if int(tile) in held else new
            if sum(map(len, held.values())) > HELD_NUMBERS:
                yield from flushed()
                sent += 1
        yield from flushed()

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            done = []
            for k, key in enumerate(zip(batch.column("tile").to_pylist(), batch.column("slice").to_pylist(), strict=True)):
                own = batch.column("v")[k].values.to_numpy()
                if key == now:
                    total = total + own
                else:
                    if now is not None:
                        done.append((*now, total))
                    now, total = key, own
            yield _slices(done)
        if now is not None:
            yield _slices([(*now, total)])

    parts = df.select("tile", *columns).mapInArrow(run, "tile int, slice int, part long, v array<double>")
    sums = parts.repartition("tile", "slice").sortWithinPartitions("tile", "slice", "part").drop("part").mapInArrow(added, "tile int, slice int, v array<double>")
    return sums.groupBy("tile").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("slice", "v"))), lambda s: s["v"])).alias("v"))


def _slices(rows: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.float64()))], names=["tile", "slice", "v"])


def _state_sums(df: DataFrame, kernel) -> DataFrame:
    """``partial_sums`` of signal, calls, brightness and weight as numpy arrays; all rows are one tile where there is no ``tile``."""
    rows = df if "tile" in df.columns else df.withColumn("tile", F.lit(0))
    return partial_sums(rows, ["signal", "calls", "brightness", "weight"], lambda tile, c: kernel(matrix_of(c[0]), matrix_of(c[1], np.int8), c[2].to_numpy(), c[3].to_numpy()))


def batch_long(df: DataFrame, which: str) -> DataFrame:
    """J (``gram``) or K (``cross``) of every tile as rows tile, i, j, v from ``batch_sums``; entries that are zero are left out."""
    sums = _state_sums(df, batch_sums)
    width = F.round((F.sqrt(F.lit(1.0) + 2 * (F.size("v") - 1)) - 1) / 2).cast("int")
    held = sums.select("tile", width.alias("m"), "v")
    first = F.lit(1) if which == "gram" else F.col("m") * F.col("m") + 1
    each = held.select("tile", "m", F.posexplode(F.slice("v", first, F.col("m") * F.col("m"))).alias("pos", "v")).where("v != 0")
    return each.select("tile", F.floor(F.col("pos") / F.col("m")).cast("int").alias("i"), (F.col("pos") % F.col("m")).alias("j"), "v")


def batch_band(df: DataFrame, processed: str = "signal") -> DataFrame:
    """The weighted covariance of residuals, cycles at most one apart, of every tile as rows tile, i, j, v from ``band_sums``."""
    rows = df.drop("signal").withColumnRenamed(processed, "signal") if processed != "signal" else df
    sums = _state_sums(rows, lambda signal, calls, lam, w: band_sums(signal - lam[:, None] * one_hot(calls), w))
    size = CHANNELS * CHANNELS
    cycles = F.floor((F.size("v") - 1 + size) / (2 * size)).cast("int")
    held = sums.select("tile", cycles.alias("c"), F.element_at("v", -1).alias("w"), F.slice("v", F.lit(1), F.size("v") - 1).alias("v"))
    each = held.select("tile", "c", "w", F.posexplode("v").alias("pos", "x"))
    beside = F.col("pos") >= F.col("c") * size
    at = F.floor(F.when(beside, F.col("pos") - F.col("c") * size).otherwise(F.col("pos")) / size).cast("int")
    i = at * CHANNELS + F.floor(F.col("pos") % size / CHANNELS).cast("int")
    j = (at + beside.cast("int")) * CHANNELS + F.col("pos") % CHANNELS
    pair = each.select("tile", i.alias("i"), j.alias("j"), (F.col("x") / F.col("w")).alias("v"), beside.alias("beside"))
    return pair.drop("beside").unionByName(pair.where("beside").select("tile", F.col("j").alias("i"), F.col("i").alias("j"), "v"))
