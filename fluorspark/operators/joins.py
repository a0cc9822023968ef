"""Joins to truth and calibration: spike-in clusters, observed qualities, coordinates and lane-tile ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluorspark.model import MAX_QUALITY, MIN_PHRED


def last_wins(spikes: DataFrame, keys: list[str]) -> DataFrame:
    """Of the truths of one cluster the one that stands last in its file (``line``)."""
    return spikes.groupBy(*keys).agg(F.max_by("truth", "line").alias("truth"))


def with_truth(clusters: DataFrame, spikes: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``truth`` and ``spiked``."""
    return clusters.join(last_wins(spikes, keys), keys, "left").withColumn("spiked", F.col("truth").isNotNull())


def unmatched(spikes: DataFrame, clusters: DataFrame, keys: list[str]) -> DataFrame:
    """Truths that name no cluster."""
    return spikes.join(clusters.select(*keys), keys, "left_anti")


def quality_counts(calls: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``q``, ``diff``, ``obs`` for every integer quality (of each group ``by``), those unseen as zeros; rows have call, truth and q."""
    seen = calls.groupBy(*by, "q").agg(F.sum((F.col("call") != F.col("truth")).cast("bigint")).alias("diff"), F.count("*").alias("obs"))
    groups = calls.select(*by).distinct() if by else calls.sparkSession.range(1).select()
    every = groups.select(*by, F.explode(F.sequence(F.lit(0), F.lit(MAX_QUALITY))).alias("q"))
    return every.join(seen, [*by, "q"], "left").select(*by, "q", F.coalesce("diff", F.lit(0)).alias("diff"), F.coalesce("obs", F.lit(0)).alias("obs"))


def observed_quality(counts: DataFrame) -> DataFrame:
    """Adds ``actual``, the quality that the counts show, with one pseudo-observation at the predicted rate."""
    rate = (F.col("diff") + F.pow(F.lit(10.0), -F.col("q") / 10)) / (F.col("obs") + 1)
    return counts.withColumn("actual", F.floor(-10 * F.log10(rate) + 0.5).cast("int"))


def recalibrated(calls: DataFrame, counts: DataFrame) -> DataFrame:
    """Calls with ``q`` replaced by what was observed for it."""
    return calls.join(observed_quality(counts).select("q", "actual"), "q").withColumn("q", F.greatest(F.lit(0), F.least(F.lit(MAX_QUALITY), "actual"))).drop("actual")


def recalibrated_text(calls: DataFrame, counts: DataFrame, by: list[str]) -> DataFrame:
    """Calls whose ``quality`` text has every quality replaced by what its group's counts show; groups without counts stay as they are."""
    actual = observed_quality(counts).select(*by, "q", F.greatest(F.lit(0), F.least(F.lit(MAX_QUALITY), "actual")).alias("actual"))
    tables = actual.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("q", "actual"))), lambda s: s["actual"]).alias("_table"))
    letters = F.filter(F.split("quality", ""), lambda c: c != "")
    new = F.array_join(F.transform(letters, lambda c: F.char(F.get("_table", F.ascii(c) - MIN_PHRED) + MIN_PHRED)), "")
    return calls.join(tables, by, "left").withColumn("quality", F.when(F.col("_table").isNull(), F.col("quality")).otherwise(new)).drop("_table")


def with_coordinates(clusters: DataFrame, coordinates: DataFrame, keys: list[str]) -> DataFrame:
    """Clusters with x and y by position; a cluster without coordinates, or the other way round, is an error when the rows are computed."""
    places = coordinates.select(*keys, "x", "y", F.lit(True).alias("_there"))
    both = clusters.drop("x", "y").withColumn("_here", F.lit(True)).join(places, keys, "full")
    odd = F.concat(F.lit("numbers of clusters and coordinates differ at "), F.to_json(F.struct(*keys)))
    x = F.when(F.col("_here").isNull() | F.col("_there").isNull(), F.raise_error(odd).cast("bigint")).otherwise(F.col("x"))
    return both.withColumn("x", x).drop("_here", "_there")


def lanes_and_tiles(spark, lanes: tuple[int, int], tiles: tuple[int, int]) -> DataFrame:
    """Every lane of a range with every tile, the tile running faster."""
    lane = spark.range(lanes[0], lanes[1] + 1).select(F.col("id").cast("int").alias("lane"))
    # a run's ranges are a few lanes and some hundred tiles
    return lane.select("lane", F.explode(F.sequence(F.lit(tiles[0]), F.lit(tiles[1]))).alias("tile"))
