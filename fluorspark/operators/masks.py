"""Cycles without data: which of a tile's cycles were measured, as an array of booleans that is null where all were."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluorspark.functions import signal as sig
from fluorspark.model import CHANNELS
from fluorspark.operators.sufficient import batch_sums, matrix_of, partial_sums

#: Tiles whose masks are sent to every task; with more the clusters are joined by tile.
MOST_TILES = 100_000


def mask_of(rows: pa.RecordBatch) -> np.ndarray | None:
    """The mask of a batch of one tile's rows."""
    first = rows.column("valid")[0]
    return np.array(first.as_py(), dtype=bool) if first.is_valid else None


def lit_cycles(clusters: DataFrame) -> DataFrame:
    """``tile`` and ``valid``: the cycles in which any cluster of a tile has a channel that is not zero; null if all are. Signals of a tile may differ in length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            tiles, lengths = batch.column("tile").to_numpy(), batch.column("signal").value_lengths().to_numpy()
            for tile, length in sorted(set(zip(tiles.tolist(), lengths.tolist(), strict=True))):
                rows = batch.column("signal").take(pa.array(np.flatnonzero((tiles == tile) & (lengths == length))))
                lit = (matrix_of(rows).reshape(len(rows), -1, CHANNELS) != 0).any(axis=(0, 2)) if length else np.zeros(0, bool)
                old = held.get(tile, np.zeros(0, bool))
                new = np.zeros(max(len(old), len(lit)), bool)
                new[: len(old)] |= old
                new[: len(lit)] |= lit
                held[tile] = new
        for tile, lit in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([tile], pa.int32()), pa.array([lit.tolist()], pa.list_(pa.bool_()))], names=["tile", "lit"])

    parts = clusters.select(F.col("tile").cast("int").alias("tile"), "signal").mapInArrow(run, "tile int, lit array<boolean>")
    each = parts.select("tile", F.posexplode("lit").alias("cycle", "lit")).groupBy("tile", "cycle").agg(F.max("lit").alias("lit"))
    whole = each.groupBy("tile").agg(F.transform(F.array_sort(F.collect_list(F.struct("cycle", "lit"))), lambda s: s["lit"]).alias("valid"))
    return whole.select("tile", F.when(~F.forall("valid", lambda v: v), F.col("valid")).alias("valid"))


def with_masks(clusters: DataFrame, masks: DataFrame) -> DataFrame:
    """Adds ``valid`` of the clusters' tiles; masks, a row for each tile, go to every task while they are few."""
    few = masks.limit(MOST_TILES + 1).count() <= MOST_TILES
    return clusters.drop("valid").join(F.broadcast(masks) if few else masks, "tile", "left")


def masked_sums(rows: DataFrame) -> DataFrame:
    """J, K and the sums of calls and of signal over the valid cycles of each tile: tile, kind, i, j and v, positions counted among all cycles.

    ``rows`` have tile, signal, calls, brightness, weight and ``valid``; entries that are zero are left out, j is 0 for sums.
    """
    kept = rows.withColumn("signal", sig.kept(F.col("signal"), F.col("valid"), CHANNELS)).withColumn("calls", sig.kept(F.col("calls"), F.col("valid")))
    sums = partial_sums(kept, ["signal", "calls", "brightness", "weight"], lambda tile, c: batch_sums(matrix_of(c[0]), matrix_of(c[1], np.int8), c[2].to_numpy(), c[3].to_numpy()))
    everywhere = F.transform(F.col("signal"), lambda _, k: F.lit(True))
    places = rows.groupBy("tile").agg(F.first(F.coalesce(F.flatten(F.transform("valid", lambda v: F.array_repeat(v, CHANNELS))), everywhere)).alias("ok"))
    place = F.filter(F.transform("ok", lambda ok, k: F.when(ok, k)), lambda k: k.isNotNull())
    held = sums.join(places.select("tile", place.alias("place")), "tile")
    m = F.size("place")
    each = held.select("tile", "place", m.alias("m"), F.posexplode("v").alias("pos", "v")).where("v != 0")
    square = F.col("m") * F.col("m")
    rest = F.col("pos") - 2 * square
    kind = F.when(F.col("pos") < square, "J").when(F.col("pos") < 2 * square, "K").when(rest < F.col("m"), "S").when(rest < 2 * F.col("m"), "I").otherwise("w")
    inside = F.when(F.col("pos") < 2 * square, F.col("pos") % square)
    at = lambda k: F.get("place", k.cast("int"))
    i = F.when(inside.isNotNull(), at(F.floor(inside / F.col("m")))).when(rest < 2 * F.col("m"), at(rest % F.col("m"))).otherwise(0)
    j = F.when(inside.isNotNull(), at(inside % F.col("m"))).otherwise(0)
    return each.select("tile", kind.alias("kind"), i.alias("i"), j.alias("j"), "v")
