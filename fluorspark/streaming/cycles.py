"""Clusters assembled from a stream of cycles, and called as soon as all their cycles have come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fluorspark.functions import nucleotides as nuc
from fluorspark.model import CHANNELS
from fluorspark.plans import entry


def complete(stream: DataFrame, cycles: int, delay: str | None = None) -> DataFrame:
    """Clusters of a stream of (tile, cluster_idx, cycle, signal of that cycle) that have all cycles from 0.

    A cycle that comes twice counts once. With ``delay``, a column ``at`` is the event time, and clusters whose last
    cycle is older than the delay are forgotten.
    """
    rows = stream.withWatermark("at", delay) if delay else stream
    keys = ["tile", "cluster_idx"] + ([F.window("at", delay).alias("seen")] if delay else [])
    held = rows.groupBy(*keys).agg(F.collect_set(F.struct("cycle", "signal")).alias("parts"))
    whole = held.where(F.size(F.array_distinct(F.transform("parts", lambda p: p["cycle"]))) == cycles)
    ordered = F.array_sort("parts")
    return whole.select("tile", "cluster_idx", F.slice(F.flatten(F.transform(ordered, lambda p: p["signal"])), 1, cycles * CHANNELS).alias("signal"))


def call_to(stream: DataFrame, cycles: int, folder: str, checkpoint: str) -> StreamingQuery:
    """Writes quick calls of complete clusters below ``folder``, a folder for each batch, so that a batch that runs again replaces its own."""

    def put(batch: DataFrame, number: int) -> None:
        called = entry.quick_calls(batch).select("tile", "cluster_idx", nuc.chars(F.col("calls")).alias("bases"), "brightness")
        called.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return complete(stream, cycles).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()
