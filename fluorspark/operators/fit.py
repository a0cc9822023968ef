"""The model fit: alternating robust weighted sums over all clusters with a small solve for each tile.

All tiles of a table are fitted side by side, and nothing of a tile passes through the driver. Per iteration two aggregates
bring a tile's sums to the task that solves for its parameters and writes them to the shared folder, and one
map calls the clusters, its tasks reading the parameters of the tiles they meet. Clusters are never
moved, and their state is cut in the shared folder, so the plan does not grow with the iterations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluorspark.functions import signal as sig
from fluorspark.model import AMBIGUOUS, CHANNELS, MIN_PHRED, Options, Params
from fluorspark.operators import kernels, solve
from fluorspark.operators.masks import mask_of
from fluorspark.operators.parameters import ParameterFiles, shared_cut
from fluorspark.operators.sufficient import band_matrix, band_sums, batch_sums, matrix_of, one_hot, partial_sums, robust_weights, unpacked_width

STATE = "cluster_idx long, tile int, signal array<smallint>, truth array<tinyint>, calls array<tinyint>, brightness double, lse double, lss double, used boolean, quality string, valid array<boolean>"
SUMMED = ["signal", "calls", "brightness", "weight"]


def training_mark(clusters: DataFrame, options: Options, spiked: str | None = None) -> DataFrame:
    """Adds ``used``: every ``thin``-th cluster that is not too dark; spiked clusters always."""
    keep = (F.col("cluster_idx") % options.thin == 0) & (sig.dark_cycles(F.col("signal")) < options.zero_thin)
    return clusters.withColumn("used", keep | F.coalesce(F.col(spiked), F.lit(False)) if spiked else keep)


def _rows(batch: pa.RecordBatch, new: dict) -> pa.RecordBatch:
    values = {c: batch.column(c) for c in batch.schema.names} | new
    names = [f.split()[0] for f in STATE.split(", ")]
    return pa.RecordBatch.from_arrays([values[c] for c in names], names=names)


def _lists(values: np.ndarray) -> pa.Array:
    return pa.array(list(values.astype(np.int8)), pa.list_(pa.int8()))


def mapped(state: DataFrame, kernel) -> DataFrame:
    """Applies ``kernel(tile, columns) -> new columns`` to the state, a batch and tile at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tiles = batch.column("tile").to_numpy()
            for tile in np.unique(tiles):
                own = batch.take(pa.array(np.flatnonzero(tiles == tile)))
                yield _rows(own, kernel(int(tile), own))

    return state.mapInArrow(run, STATE)


def _truth(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are spiked, and their bases."""
    column = rows.column("truth")
    at = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    return at, matrix_of(column.take(pa.array(at)), np.int8) if len(at) else np.zeros((0, 0), dtype=np.int8)


def _solved(sums: DataFrame, use) -> None:
    """Runs ``use(tile, vector, row)`` in the task of each tile's sums; a solve that fails leaves the tile without parameters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for k, tile in enumerate(batch.column("tile").to_pylist()):
                try:
                    use(tile, batch.column("v")[k].values.to_numpy(), {c: batch.column(c)[k].as_py() for c in batch.schema.names if c != "v"})
                    done.append(True)
                except np.linalg.LinAlgError:
                    done.append(False)
            yield pa.RecordBatch.from_arrays([batch.column("tile"), pa.array(done)], names=["tile", "done"])

    # attempts at one solve read the same shuffled sums, added up in one order: they write the same file
    shared_cut(sums.mapInArrow(run, "tile int, done boolean"))


def fit(clusters: DataFrame, options: Options = Options(), spiked: str | None = None, mix: np.ndarray | None = None, truth: str | None = None) -> tuple[DataFrame, ParameterFiles]:
    """Fits every tile of ``clusters`` (cluster_idx, tile, signal) and calls its bases.

    Returns the state of all clusters, with ``quality`` as text, and the tiles' parameters. A tile
    whose solve fails has none; its clusters are called A with the least quality. The
    signals of a tile have one length. ``truth`` names a column of base codes, null for most clusters: where it is known
    it stands for the calls in all iterations but the last, and such clusters are never thinned; ``spiked`` names a column
    of clusters that are not thinned either.

    Where ``clusters`` has a column ``valid`` (booleans, one for each cycle, the same for all clusters of a tile; null if all cycles are valid) the
    others take no part in sums, precision, paths and qualities: a tile is fitted as if it had its valid cycles alone, and the
    rest is called N with the least quality. ``signal`` of the state holds valid cycles only.
    """
    files = ParameterFiles(clusters.sparkSession)
    known = F.col(truth).cast("array<tinyint>") if truth else F.lit(None).cast("array<tinyint>")
    masked = "valid" in clusters.columns
    valid = F.col("valid") if masked else F.lit(None).cast("array<boolean>")
    signal, known = (sig.kept(F.col("signal"), valid, CHANNELS), sig.kept(known, valid)) if masked else (F.col("signal"), known)
    rows = clusters.select("cluster_idx", "tile", signal.alias("signal"), valid.alias("valid"), known.alias("truth"), (F.col(spiked) if spiked else F.lit(False)).alias("_spiked"))
    marked = training_mark(rows.withColumn("_spiked", F.col("_spiked") | F.col("truth").isNotNull()), options, "_spiked")
    none = {"calls": "array<tinyint>", "brightness": "double", "lse": "double", "lss": "double", "quality": "string"}
    state = marked.select("cluster_idx", "tile", "signal", "valid", "truth", "used", *(F.lit(None).cast(t).alias(c) for c, t in none.items()))

    state = state.select(*(f.split()[0] for f in STATE.split(", ")))
    none_valid = state.where(F.size("signal") == 0)
    masks = None
    if masked:
        state = state.where(F.size("signal") > 0)
        masks = state.groupBy("tile").agg(F.first("valid").alias("valid")) if options.fixed else None

    def first(cycles: int, valid: np.ndarray | None) -> Params:
        return options.fixed.kept(valid) if options.fixed else Params.initial(cycles, mix)

    def start(tile: int, rows: pa.RecordBatch) -> dict:
        signal = matrix_of(rows.column("signal"))
        param, n = first(signal.shape[1] // CHANNELS, mask_of(rows)), len(signal)
        p = kernels.processed(signal, param.a, param.n)
        calls = kernels.strongest(p)
        at, bases = _truth(rows)
        if len(at):
            calls[at] = bases
        lam = kernels.brightness(signal, calls, param.a, param.n)
        return {"calls": _lists(calls), "brightness": pa.array(lam), "lse": pa.array(kernels.error(p, calls, lam)), "lss": pa.array(np.full(n, float(signal.shape[1]))), "quality": pa.array([None] * n, pa.string())}

    state = shared_cut(mapped(state, start))
    for step in range(options.iterations):
        used = robust_weights(state.where("used"), ["tile"])
        sums = partial_sums(used, SUMMED, lambda tile, c: batch_sums(matrix_of(c[0]), matrix_of(c[1], np.int8), c[2].to_numpy(), c[3].to_numpy()))

        def mixed(tile: int, v: np.ndarray, row: dict, step: int = step) -> None:
            begin = first(unpacked_width(v) // CHANNELS, row.get("valid"))
            found = begin if options.fixed else solve.mixing(v, begin.a, options.ridge, options.delta, options.solver)
            a, scale = solve.normalised(found.a)
            files.put(f"{step}-mixing", tile, Params(found.a if options.fixed else a, found.n, scale=scale))

        _solved(sums if masks is None else sums.join(masks, "tile", "left"), mixed)

        def spread(tile: int, c: list[pa.Array], step: int = step) -> np.ndarray:
            found = files.get(f"{step}-mixing", tile)
            signal, calls, w = matrix_of(c[0]), matrix_of(c[1], np.int8), c[3].to_numpy()
            if found is None:
                return band_sums(np.zeros_like(signal), np.zeros(len(signal)))
            return band_sums(kernels.processed(signal, found.a, found.n) - (c[2].to_numpy() * found.scale)[:, None] * one_hot(calls), w)

        freedom = state.where("used").groupBy("tile").agg(F.median("lss").alias("freedom"))

        def precise(tile: int, v: np.ndarray, row: dict, step: int = step) -> None:
            found = files.get(f"{step}-mixing", tile)
            if found is not None:
                files.put(str(step), tile, Params(found.a, found.n, solve.precision(band_matrix(v)), found.scale, row["freedom"]))

        _solved(partial_sums(used, SUMMED, spread).join(freedom, "tile"), precise)

        def call(tile: int, rows: pa.RecordBatch, step: int = step, last: bool = step + 1 == options.iterations, g: float = options.generalised_error, mu: float = options.mu) -> dict:
            signal, n = matrix_of(rows.column("signal")), rows.num_rows
            cycles, param = signal.shape[1] // CHANNELS, files.get(str(step), tile)
            if param is None:
                return {"calls": _lists(np.zeros((n, cycles))), "brightness": pa.array(np.zeros(n)), "lse": pa.array(np.zeros(n)), "lss": pa.array(np.zeros(n)), "quality": pa.array(["!" * cycles] * n)}
            p = kernels.processed(signal, param.a, param.n)
            lam = kernels.brightness(signal, matrix_of(rows.column("calls"), np.int8), param.a, param.n)
            text = pa.array([None] * n, pa.string())
            if cycles == 1:
                best, quality = kernels.single_cycle_call(p, lam, param.omega, np.zeros(CHANNELS), mu)
                calls, quality = best[:, None], quality[:, None]
                lss = kernels.path_score(p, lam, param.omega, calls)
            else:
                calls, lss = kernels.best_path(p, lam, param.omega)
                quality = kernels.posterior_quality(p, lam, param.omega, param.freedom, calls, g) if last else None
            if last:
                text = pa.array(kernels.quality_text(quality))
            else:
                at, bases = _truth(rows)
                if len(at):
                    calls[at], lss[at] = bases, kernels.path_score(p[at], lam[at], param.omega, bases)
                lam = kernels.brightness(signal, calls, param.a, param.n)
            return {"calls": _lists(calls), "brightness": pa.array(lam), "lse": pa.array(kernels.error(p, calls, lam)), "lss": pa.array(lss), "quality": text}

        state, files.last = shared_cut(mapped(state, call)), str(step)
    if masked:
        lost = none_valid.withColumn("calls", F.array().cast("array<tinyint>")).withColumn("quality", F.lit(""))
        state = state.unionByName(lost.fillna(0.0, ["brightness", "lse", "lss"]).withColumn("used", F.lit(False)))
        letters = F.filter(F.split("quality", ""), lambda c: c != "")
        state = state.withColumn("calls", sig.spread(F.col("calls"), F.col("valid"), F.lit(AMBIGUOUS).cast("tinyint")))
        state = state.withColumn("quality", F.array_join(sig.spread(letters, F.col("valid"), F.lit(chr(MIN_PHRED))), ""))
    return state, files
