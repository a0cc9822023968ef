"""Clusters put together from a stream of cycles, with state that is bounded: by key, with timers.

A cluster's state is one row: its signal so far, which cycles have come, and whether it has been sent on. A timer, set when the cluster is first
seen, ends it: what has not come by then is missing, the cluster is sent on with what it has, and its state is removed. So state holds
the clusters of the last ``patience`` only, whatever the length of the stream. State is kept by Spark's store and restored from the checkpoint.

Defined results: of a cycle that comes twice the first of the batch order counts; cycles out of range and signals that are null or not of four
channels are ignored; what comes after a cluster was sent on and before its timer is ignored, what comes after the timer is late and, by
the watermark, dropped by Spark, as is an event time not after 1970; rows with a null key are left out; an empty stream gives nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from fluorspark.functions import nucleotides as nuc
from fluorspark.model import AMBIGUOUS, CHANNELS, MIN_PHRED, Options
from fluorspark.plans import entry

KEYS = ["lane", "tile", "cluster_idx"]
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WHOLE = "lane int, tile int, cluster_idx long, signal array<smallint>, missing array<int>"
#: A lane and a tile as one number, the key of a fit.
TILES_A_LANE = 100_000


class Assembler(StatefulProcessor):
    """One cluster's cycles: sent on when the last of ``cycles`` comes, or with what is there ``patience`` milliseconds of event time after its first."""

    def __init__(self, cycles: int, patience: int) -> None:
        self.cycles, self.patience = cycles, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "signal array<int>, seen array<boolean>, sent boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        before = self.held.get() if self.held.exists() else None
        if before is not None and before[2]:
            return
        signal = [0] * (self.cycles * CHANNELS) if before is None else list(before[0])
        seen = [False] * self.cycles if before is None else list(before[1])
        first = None
        for frame in rows:
            for cycle, own, at in zip(frame["cycle"], frame["signal"], frame["at"], strict=True):
                if own is None or len(own) != CHANNELS or not 0 <= cycle < self.cycles:
                    continue
                at = int(pd.Timestamp(at).value // 1_000_000)
                first = at if first is None else min(first, at)
                if not seen[int(cycle)]:
                    seen[int(cycle)] = True
                    signal[int(cycle) * CHANNELS : (int(cycle) + 1) * CHANNELS] = [int(v) for v in own]
        if first is None:
            return
        if before is None:
            self.handle.registerTimer(max(first, timerValues.getCurrentWatermarkInMs()) + self.patience)
        done = all(seen)
        self.held.update(([], [], True) if done else (signal, seen, False))
        if done:
            yield self._row(key, signal, seen)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        held = self.held.get() if self.held.exists() else None
        self.held.clear()
        if held is not None and not held[2]:
            yield self._row(key, held[0], held[1])

    def _row(self, key, signal, seen) -> pd.DataFrame:
        missing = [c for c, there in enumerate(seen) if not there]
        return pd.DataFrame({"lane": [key[0]], "tile": [key[1]], "cluster_idx": [key[2]], "signal": [np.array(signal, dtype=np.int16)], "missing": [np.array(missing, dtype=np.int32)]})

    def close(self) -> None:
        pass


def assembled(stream: DataFrame, cycles: int, patience: int, delay: str = "0 seconds") -> DataFrame:
    """``WHOLE``: the clusters of a stream of (lane, tile, cluster_idx, cycle from 0, signal of that cycle, ``at``, its event time).

    ``missing`` lists the cycles that have not come within ``patience`` milliseconds; they are zeros in ``signal``. The watermark follows ``at`` by ``delay``.
    """
    if stream.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass", "") != PROVIDER:
        raise ValueError(f"spark.sql.streaming.stateStore.providerClass must be {PROVIDER}")
    rows = stream.withWatermark("at", delay).where(" AND ".join(f"{k} IS NOT NULL" for k in (*KEYS, "cycle", "at")))
    rows = rows.select(F.col("lane").cast("int").alias("lane"), F.col("tile").cast("int").alias("tile"), F.col("cluster_idx").cast("long").alias("cluster_idx"), F.col("cycle").cast("int").alias("cycle"), F.col("signal").cast("array<int>").alias("signal"), "at")
    return rows.groupBy(*KEYS).transformWithStateInPandas(Assembler(cycles, patience), WHOLE, "Append", "EventTime")


def called(clusters: DataFrame, options: Options | None = None) -> DataFrame:
    """lane, tile, cluster_idx, bases and quality of clusters (``WHOLE``): quick calls without qualities, or with ``options`` a fit of these clusters by lane and tile. Missing cycles are N with the least quality."""
    if options is None:
        rows = entry.quick_calls(clusters).withColumn("quality", F.lit(None).cast("string"))
    else:
        keyed = clusters.withColumn("tile", F.col("lane") * TILES_A_LANE + F.col("tile"))
        state = entry.run(keyed.select("cluster_idx", "tile", "signal"), options).select("cluster_idx", "tile", "calls", "quality")
        rows = state.join(keyed.select("cluster_idx", "tile", "lane", "missing"), ["cluster_idx", "tile"]).withColumn("tile", F.col("tile") % TILES_A_LANE)
    gone = lambda k: F.array_contains("missing", k)
    calls = F.transform("calls", lambda b, k: F.when(gone(k), F.lit(AMBIGUOUS)).otherwise(b).cast("tinyint"))
    letters = F.transform(F.filter(F.split("quality", ""), lambda q: q != ""), lambda q, k: F.when(gone(k), F.lit(chr(MIN_PHRED))).otherwise(q))
    return rows.select(*KEYS, nuc.chars(calls).alias("bases"), F.when(F.col("quality").isNotNull(), F.array_join(letters, "")).alias("quality"))


def call_to(stream: DataFrame, cycles: int, patience: int, folder: str, checkpoint: str, delay: str = "0 seconds", options: Options | None = None) -> StreamingQuery:
    """Writes the calls of the clusters that a batch completes or ends below ``folder``, a folder for each batch: one that runs again replaces its own.

    With ``options`` each batch's clusters are fitted on their own, so a batch should hold a good part of a tile.
    """

    def put(batch: DataFrame, number: int) -> None:
        rows = batch
        if options is not None:
            # the fit reads its clusters more than once, and the state's operator must run once
            rows.write.mode("overwrite").parquet(f"{folder}/clusters/batch={number}")
            rows = batch.sparkSession.read.parquet(f"{folder}/clusters/batch={number}")
            if rows.isEmpty():
                return
        called(rows, options).write.mode("overwrite").parquet(f"{folder}/calls/batch={number}")

    out = assembled(stream, cycles, patience, delay).writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    return out.foreachBatch(put).trigger(availableNow=True).start()
