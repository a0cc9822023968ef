"""Runs from clusters to called sequences: with fitted or with fixed parameters."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluorspark.functions import calibration
from fluorspark.functions import nucleotides as nuc
from fluorspark.functions import signal as sig
from fluorspark.model import MIN_PHRED, Options, crosstalk
from fluorspark.operators import joins, masks
from fluorspark.operators.fit import fit
from fluorspark.operators.parameters import BlockFiles, shared_cut
from fluorspark.plans import blocks


def quick_calls(clusters: DataFrame) -> DataFrame:
    """Calls by the strongest channel after un-mixing with the default crosstalk: no fit, and no Python."""
    import numpy as np

    inverse = np.linalg.inv(crosstalk()).tolist()
    rows = clusters.withColumn("processed", sig.unmix(F.col("signal"), inverse))
    rows = rows.withColumn("calls", sig.initial_calls(F.col("processed")))
    return rows.withColumn("brightness", sig.brightness_ols(F.col("processed"), F.col("calls")))


def run(clusters: DataFrame, options: Options = Options(), table: calibration.Table = calibration.Table(), mix=None, truth: DataFrame | None = None) -> DataFrame:
    """Called bases and qualities of every cluster and block of ``clusters`` (cluster_idx, tile, signal); ``mix``: an initial crosstalk."""
    return fitted(clusters, options, table, mix, truth)[0]


def fitted(clusters: DataFrame, options: Options = Options(), table: calibration.Table = calibration.Table(), mix=None, truth: DataFrame | None = None) -> tuple[DataFrame, list[BlockFiles]]:
    """``run`` and the parameters of each block. Cycles that ``valid`` of a tile leaves out, or with ``mask_nodata`` those that are dark in all clusters of a tile, are called N.

    ``truth`` (tile, block, cluster_idx, truth as text, line) holds spike-ins: their bases are known in the fit, and
    qualities are left as the model gives them, for the counts to be taken.
    """
    if options.mask_nodata:
        clusters = masks.with_masks(clusters, shared_cut(masks.lit_cycles(clusters)))
    parts = blocks.split(clusters, options.blocks) if options.blocks else clusters.withColumn("block", F.lit(0))
    if truth is not None:
        own = joins.last_wins(truth, ["tile", "block", "cluster_idx"]).withColumn("truth", nuc.codes(F.col("truth")))
        parts = parts.join(own, ["tile", "block", "cluster_idx"], "left")
    n = len(blocks.parse(options.blocks)) if options.blocks else 1
    # all blocks are fitted side by side: a block of a tile is a tile of its own
    keyed = parts.withColumn("tile", F.col("tile") * n + F.col("block")) if n > 1 else parts
    state, files = fit(keyed, replace(options, blocks=""), mix=mix, truth=None if truth is None else "truth")
    found = [BlockFiles(files, n, k) for k in range(n)]
    out = state.drop("truth").withColumn("block", F.pmod("tile", F.lit(n)).cast("int")).withColumn("tile", F.floor(F.col("tile") / n).cast("int"))
    if options.calibrate and truth is None:
        values = F.transform(F.filter(F.split("quality", ""), lambda c: c != ""), lambda c: (F.ascii(c) - MIN_PHRED).cast("double"))
        new = calibration.calibrate(values, F.col("calls"), F.col("brightness"), table)
        out = out.withColumn("quality", F.array_join(F.transform(new, nuc.phred_char), ""))
    return out.withColumn("bases", nuc.chars(F.col("calls"))), found
