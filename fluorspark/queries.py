"""The registered queries of the base-calling operators, each with DuckDB SQL where SQL can say it.

The tables stand in for intensity data: ``embeddings`` is a run of 10 tiles (label), 16 cycles of four
channels; ``lineitem`` gives signals with cycles that are missing; the others give samples for the statistics.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluorspark.functions import calibration, weights
from fluorspark.functions import nucleotides as nuc
from fluorspark.functions import signal as sig
from fluorspark.model import INITIAL_CROSSTALK, MIN_PHRED, Options, Params, crosstalk
from fluorspark.operators import fit as fits
from fluorspark.operators import joins, kernels, masks, separable, solve
from fluorspark.operators import statistics as stats
from fluorspark.operators import sufficient as suff
from fluorspark.operators.parameters import shared_cut, shared_folder
from fluorspark.plans import blocks, cli, entry
from fluorspark.sources import cif, named, sinks
from fluorspark.sources import text as sources
from fluorspark.streaming import assembly

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as clusters: 16 cycles, tile by label."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cluster_idx"), F.col("label").alias("tile"), sig.decode(F.col("embedding")).alias("signal"))


def sparse_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as clusters of 7 cycles; cycles without a line are dark."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").cast("long").alias("a"), F.round(F.sum(F.col("l_discount") * 100)).cast("long").alias("c"), F.round(F.sum(F.col("l_tax") * 100)).cast("long").alias("g"), F.count("*").alias("t"))
    rows = lines.groupBy(F.col("l_orderkey").alias("cluster_idx")).agg(F.map_from_entries(F.collect_list(F.struct("l_linenumber", F.array("a", "c", "g", "t")))).alias("m"))
    signal = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(7)), lambda c: F.coalesce(F.try_element_at("m", c), F.array_repeat(F.lit(0).cast("long"), 4))))
    return rows.select("cluster_idx", F.transform(signal, lambda v: v.cast("smallint")).alias("signal"))


def called(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters with first calls, brightness and weight on the raw signal (weights vary by cluster)."""
    rows = clusters(spark, sf_dir).withColumn("calls", sig.initial_calls(F.col("signal")))
    rows = rows.withColumn("brightness", sig.brightness_ols(F.transform("signal", lambda v: v.cast("double")), F.col("calls")))
    # cut, as a fit's state is: else calls are made anew for every element that names them
    return shared_cut(rows.withColumn("weight", 1.0 / (1 + F.col("cluster_idx") % 3)))


def r(c: Column | str, digits: int = 4) -> Column:
    """Rounded for comparison, off the ties and without a negative zero."""
    return F.round((F.col(c) if isinstance(c, str) else c) + 1.7e-6, digits) + F.lit(0.0)


def text(signal: Column) -> Column:
    return F.array_join(F.transform(signal, lambda v: v.cast("string")), " ")


# SQL pieces: the clusters, their long form, and first calls with brightness and weight.
SIG = "sig AS (SELECT vec_id AS cluster_idx, label AS tile, list_transform(embedding, lambda x: CAST(greatest(-32768, least(32767, round(CAST(x AS DOUBLE) * 1000))) AS BIGINT)) AS signal FROM embeddings)"
LONG = SIG + ", long AS (SELECT cluster_idx, tile, CAST((i - 1) // 4 AS INTEGER) AS cycle, CAST((i - 1) % 4 AS INTEGER) AS ch, CAST(signal[i] AS DOUBLE) AS v FROM (SELECT *, unnest(range(1, len(signal) + 1)) AS i FROM sig))"
CALL = LONG + ", call AS (SELECT cluster_idx, tile, cycle, min(ch) AS base, max(v) AS v FROM (SELECT *, max(v) OVER (PARTITION BY cluster_idx, cycle) AS top FROM long) WHERE v = top GROUP BY cluster_idx, tile, cycle)"
STATE = CALL + ", st AS (SELECT cluster_idx, tile, greatest(0, avg(v)) AS lam, 1.0 / (1 + cluster_idx % 3) AS w FROM call GROUP BY cluster_idx, tile)"
LINES = """ln AS (SELECT l_orderkey AS k, l_linenumber AS c, CAST(sum(l_quantity) AS BIGINT) AS a, CAST(round(sum(l_discount * 100)) AS BIGINT) AS d, CAST(round(sum(l_tax * 100)) AS BIGINT) AS g, count(*) AS t FROM lineitem GROUP BY 1, 2),
sp AS (SELECT k AS cluster_idx, count(*) FILTER (WHERE a <> 0 OR d <> 0 OR g <> 0 OR t <> 0) AS lit FROM ln GROUP BY k)"""


# scans, projections, slices


@query(f"WITH {SIG} SELECT cluster_idx, tile, array_to_string(signal, ' ') AS signal FROM sig")
def decode_signal(spark, sf_dir):
    return clusters(spark, sf_dir).select("cluster_idx", "tile", text(F.col("signal")).alias("signal"))


@query(f"WITH {SIG} SELECT cluster_idx, 0 AS block, array_to_string(list_concat(signal[1:16], signal[25:32]), ' ') AS signal FROM sig UNION ALL SELECT cluster_idx, 1, array_to_string(signal[37:64], ' ') FROM sig")
def cycle_block_slice(spark, sf_dir):
    return blocks.split(clusters(spark, sf_dir), "R4I2C2I1R7").select("cluster_idx", "block", text(F.col("signal")).alias("signal"))


@query("WITH t AS (SELECT vec_id AS cluster_idx, CAST(floor((1 + sqrt(1 + 8 * CAST(vec_id AS DOUBLE))) / 2) AS BIGINT) AS x FROM embeddings) SELECT cluster_idx, x, 1 + cluster_idx - x * (x - 1) // 2 AS y FROM t")
def cluster_coordinates(spark, sf_dir):
    x, y = sig.synthetic_xy(F.col("cluster_idx"))
    return clusters(spark, sf_dir).select("cluster_idx", x.alias("x"), y.alias("y"))


@query("SELECT CAST(floor((c_custkey * 7 % 1794) * 4 / 1794) * 4 + floor((c_custkey * 13 % 2048) * 4 / 2048) AS INTEGER) AS cell, count(*) AS n FROM customer GROUP BY 1")
def spatial_grid_counts(spark, sf_dir):
    cell = sig.grid_cell(F.col("c_custkey") * 7 % 1794, F.col("c_custkey") * 13 % 2048)
    return read(spark, sf_dir, "customer").groupBy(cell.alias("cell")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey FROM customer WHERE c_custkey * 7 % 1794 BETWEEN 100 AND 900 AND c_custkey * 13 % 2048 BETWEEN 200 AND 1000")
def spatial_box(spark, sf_dir):
    return read(spark, sf_dir, "customer").where(sig.in_box(F.col("c_custkey") * 7 % 1794, F.col("c_custkey") * 13 % 2048, 100, 200, 900, 1000)).select("c_custkey")


@query("WITH l AS (SELECT range AS lane FROM range(1, 4)), t AS (SELECT range AS tile FROM range(5, 11)) SELECT CAST(lane AS INTEGER) AS lane, CAST(tile AS INTEGER) AS tile, (SELECT count(*) FROM supplier WHERE s_suppkey % 3 + 1 = lane AND s_suppkey % 11 = tile) AS n FROM l CROSS JOIN t")
def lane_tile_range(spark, sf_dir):
    lanes, tiles = sources.parse_range("L1-3T5-10")
    have = read(spark, sf_dir, "supplier").groupBy((F.col("s_suppkey") % 3 + 1).cast("int").alias("lane"), (F.col("s_suppkey") % 11).cast("int").alias("tile")).agg(F.count("*").alias("n"))
    return joins.lanes_and_tiles(spark, lanes, tiles).join(have, ["lane", "tile"], "left").fillna(0, ["n"])


@query("SELECT p_partkey, CAST(p_partkey % 8 AS INTEGER) AS lane, CAST(p_size AS INTEGER) AS tile FROM part")
def file_name_parts(spark, sf_dir):
    name = F.concat(F.lit("s_"), F.col("p_partkey") % 8, F.lit("_00"), F.col("p_size"), F.lit("_int.txt"))
    lane, tile = sources.lane_and_tile(name)
    return read(spark, sf_dir, "part").select("p_partkey", lane.alias("lane"), tile.alias("tile"))


@query(f"WITH {SIG} SELECT cluster_idx, '1' || chr(9) || tile || chr(9) || cluster_idx || chr(9) || '7' || chr(9) || list_reduce(list_transform(range(0, 16), lambda c: array_to_string(list_transform(signal[c * 4 + 1 : c * 4 + 4], lambda v: v || '.0'), ' ')), lambda p, q: p || chr(9) || q) AS line FROM sig")
def intensity_lines(spark, sf_dir):
    rows = clusters(spark, sf_dir).withColumns({"lane": F.lit(1), "x": F.col("cluster_idx"), "y": F.lit(7)})
    return rows.select("cluster_idx", sources.intensity_line(rows).alias("line"))


# codes and records


@query(f"WITH {CALL} SELECT cluster_idx, string_agg(substr('ACGT', base + 1, 1), '' ORDER BY cycle) AS bases FROM call GROUP BY cluster_idx")
def argmax_call(spark, sf_dir):
    return clusters(spark, sf_dir).select("cluster_idx", nuc.chars(sig.initial_calls(F.col("signal"))).alias("bases"))


@query("SELECT doc_id, md5(reverse(translate(regexp_replace(translate(text, 'acgt', 'ACGT'), '[^ACGT]', 'N', 'g'), 'ACGT', 'TGCA'))) AS digest FROM documents")
def revcomp_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(nuc.reverse_complement(F.col("text"))).alias("digest"))


@query("SELECT doc_id, CAST(length(u) - length(replace(u, 'A', '')) AS BIGINT) AS a, CAST(length(u) - length(replace(u, 'C', '')) AS BIGINT) AS c, CAST(length(u) - length(replace(u, 'G', '')) AS BIGINT) AS g, CAST(length(u) - length(replace(u, 'T', '')) AS BIGINT) AS t, CAST(length(regexp_replace(u, '[ACGT]', '', 'g')) AS BIGINT) AS n FROM (SELECT doc_id, translate(text, 'acgt', 'ACGT') AS u FROM documents)")
def nuc_parse(spark, sf_dir):
    parsed = nuc.parse(F.col("text"))
    count = lambda ch: (F.length("p") - F.length(F.replace("p", F.lit(ch), F.lit("")))).cast("bigint")
    rows = read(spark, sf_dir, "documents").select("doc_id", parsed.alias("p"))
    return rows.select("doc_id", *(count(ch).alias(ch.lower()) for ch in "ACGTN"))


@query("WITH q AS (SELECT l_orderkey, l_linenumber, least(93, floor(-10 * ln(1 - l_discount * 9.9) / ln(10) + 0.5)) AS q FROM lineitem) SELECT chr(CAST(33 + q AS INTEGER)) AS phred, CAST(q AS INTEGER) AS quality, count(*) AS n FROM q GROUP BY 1, 2")
def phred_encode(spark, sf_dir):
    q = nuc.quality_from_prob(F.col("l_discount") * 9.9)
    rows = read(spark, sf_dir, "lineitem").select(nuc.phred_char(q).alias("phred"), nuc.quality_int(q).alias("quality"))
    return rows.groupBy("phred", "quality").agg(F.count("*").alias("n"))


@query(f"WITH {CALL} SELECT cluster_idx, '@S:1:' || tile || ':' || cluster_idx || ':7' || chr(10) || string_agg(substr('ACGT', base + 1, 1), '' ORDER BY cycle) || chr(10) || '+' || chr(10) || repeat('I', 16) AS record FROM call GROUP BY cluster_idx, tile")
def fastq_records(spark, sf_dir):
    rows = clusters(spark, sf_dir).withColumns({"lane": F.lit(1), "x": F.col("cluster_idx"), "y": F.lit(7), "calls": sig.initial_calls(F.col("signal"))})
    quality = F.array_join(F.transform("calls", lambda b: nuc.phred_char(F.lit(40.0))), "")
    return rows.select("cluster_idx", sinks.sequence_text(sinks.record_name("S", 1), nuc.chars(F.col("calls")), quality).alias("record"))


# filters and counts


@query("SELECT vec_id AS cluster_idx FROM embeddings WHERE vec_id % 7 = 0 OR label = 3")
def thin_factor(spark, sf_dir):
    rows = clusters(spark, sf_dir).withColumn("spiked", F.col("tile") == 3)
    return fits.training_mark(rows, Options(thin=7), "spiked").where("used").select("cluster_idx")


@query(f"WITH {LINES} SELECT cluster_idx, CAST(7 - lit AS INTEGER) AS dark, 7 - lit < 3 AS used FROM sp")
def thin_zero(spark, sf_dir):
    rows = fits.training_mark(sparse_clusters(spark, sf_dir), Options())
    return rows.select("cluster_idx", sig.dark_cycles(F.col("signal")).alias("dark"), "used")


@query(f"WITH {LINES} SELECT count(*) AS n, count(*) FILTER (WHERE 7 - lit < 3 AND cluster_idx % 2 = 0) AS used, round(100.0 * count(*) FILTER (WHERE 7 - lit < 3 AND cluster_idx % 2 = 0) / count(*), 4) AS percent FROM sp")
def used_counts(spark, sf_dir):
    rows = fits.training_mark(sparse_clusters(spark, sf_dir), Options(thin=2))
    return rows.agg(F.count("*").alias("n"), F.count_if("used").alias("used"), F.round(100.0 * F.count_if("used") / F.count("*"), 4).alias("percent"))


@query(f"WITH {STATE} SELECT tile, count(*) FILTER (WHERE lam = 0) AS zero, count(*) AS n FROM st GROUP BY tile")
def zero_brightness(spark, sf_dir):
    return called(spark, sf_dir).groupBy("tile").agg(F.count_if(F.col("brightness") == 0).alias("zero"), F.count("*").alias("n"))


# statistics and fits


@query("SELECT event_type, count(*) AS n, round(sum(value), 3) AS total, round(avg(value), 5) AS mean, round(var_samp(value), 4) AS var, round(avg(value * value), 4) AS meanxx FROM events GROUP BY event_type")
def kahan_stats(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"), F.round(F.avg("value"), 5).alias("mean"), F.round(F.var_samp("value"), 4).alias("var"), F.round(F.avg(F.col("value") * F.col("value")), 4).alias("meanxx"))


@query("WITH m AS (SELECT *, sum(l_quantity * l_tax) OVER (PARTITION BY l_returnflag) / sum(l_quantity) OVER (PARTITION BY l_returnflag) AS m FROM lineitem) SELECT l_returnflag, round(max(m), 7) AS wmean, round(sum(l_quantity * (l_tax - m) * (l_tax - m)) / (count(*) - 1) * count(*) / sum(l_quantity), 9) AS wvar FROM m GROUP BY l_returnflag")
def weighted_stats(spark, sf_dir):
    out = stats.weighted_variance(read(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_tax", "l_quantity")
    return out.select("l_returnflag", F.round("wmean", 7).alias("wmean"), F.round("wvar", 9).alias("wvar"))


@query("SELECT l_returnflag, round(sum(l_quantity * l_tax * l_tax) / sum(l_quantity), 8) AS wxx, round(sum(l_quantity * l_tax * l_discount) / sum(l_quantity), 8) AS wxy, round(avg(l_tax * l_discount), 8) AS xy FROM lineitem GROUP BY l_returnflag")
def weighted_moments(spark, sf_dir):
    w, x, y = F.col("l_quantity"), F.col("l_tax"), F.col("l_discount")
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(stats.weighted(x * x, w), 8).alias("wxx"), F.round(stats.weighted(x * y, w), 8).alias("wxy"), F.round(F.avg(x * y), 8).alias("xy"))


@query("SELECT o_orderpriority, round(median(o_totalprice) FILTER (WHERE o_orderkey % 3 <> 0), 4) AS median FROM orders GROUP BY o_orderpriority")
def median_used(spark, sf_dir):
    out = stats.median(read(spark, sf_dir, "orders").where("o_orderkey % 3 != 0"), ["o_orderpriority"], "o_totalprice")
    return out.select("o_orderpriority", F.round("median", 4).alias("median"))


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 5) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round((regr_syy(l_extendedprice, l_quantity) - regr_slope(l_extendedprice, l_quantity) * regr_sxy(l_extendedprice, l_quantity)) / 1e9, 3) AS rss FROM lineitem GROUP BY l_returnflag")
def ols_fit(spark, sf_dir):
    return _line(stats.line_fit(read(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice"))


def _line(fit: DataFrame) -> DataFrame:
    return fit.select("l_returnflag", F.round("slope", 5).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round(F.col("rss") / 1e9, 3).alias("rss"))


WLS = "sum(w) AS w, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy, sum(w * y * y) AS syy"


def _wls_sql(name: str, source: str) -> str:
    return f"{name}s AS (SELECT g, {WLS} FROM {source} GROUP BY g), {name} AS (SELECT g, (sxy - sx * sy / w) / (sxx - sx * sx / w) AS b, (sy - (sxy - sx * sy / w) / (sxx - sx * sx / w) * sx) / w AS a, (syy - sy * sy / w) - (sxy - sx * sy / w) * (sxy - sx * sy / w) / (sxx - sx * sx / w) AS rss FROM {name}s)"


@query(f"WITH d AS (SELECT l_returnflag AS g, l_quantity AS x, l_extendedprice AS y, 1 + l_tax AS w FROM lineitem), {_wls_sql('f', 'd')} SELECT g AS l_returnflag, round(b, 5) AS slope, round(a, 3) AS intercept, round(rss / 1e9, 3) AS rss FROM f")
def wls_fit(spark, sf_dir):
    return _line(stats.line_fit(read(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice", 1 + F.col("l_tax")))


@query(f"""WITH d AS (SELECT l_returnflag AS g, l_quantity AS x, l_extendedprice AS y, 1.0 AS w FROM lineitem), {_wls_sql('f', 'd')},
r AS (SELECT g, d.x, d.y, d.y - f.a - f.b * d.x AS e FROM d JOIN f USING (g)), m AS (SELECT g, avg(e * e) AS q FROM r GROUP BY g),
d2 AS (SELECT g, x, y, 1 / (1 + 0.5 * e * e / q) AS w FROM r JOIN m USING (g)), {_wls_sql('f2', 'd2')}
SELECT g AS l_returnflag, round(b, 5) AS slope, round(a, 3) AS intercept, round(rss / 1e9, 3) AS rss FROM f2""")
def iwls_fit(spark, sf_dir):
    return _line(stats.iwls_fit(read(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice", weights.cauchy, 1))


@query("WITH f AS (SELECT l_returnflag, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem GROUP BY 1) SELECT l_returnflag, round(sum(abs(l_extendedprice - a - b * l_quantity)) / count(*), 3) AS mean_abs FROM lineitem JOIN f USING (l_returnflag) GROUP BY 1")
def line_residuals(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem")
    fit = stats.line_fit(rows, ["l_returnflag"], "l_quantity", "l_extendedprice")
    out = stats.residuals(rows, fit, ["l_returnflag"], "l_quantity", "l_extendedprice")
    return out.groupBy("l_returnflag").agg(F.round(F.sum(F.abs("residual")) / F.count("*"), 3).alias("mean_abs"))


_D2 = "pow((c_acctbal - 4500) / 800, 2)"


@query(f"SELECT c_custkey, round(1 / (1 + 0.5 * {_D2}), 8) AS cauchy, round(1 / (1 + {_D2}), 8) AS whole, round(CASE WHEN {_D2} < 36 THEN pow(1 - {_D2} / 36, 2) ELSE 0 END, 8) AS tukey FROM customer")
def robust_weight_functions(spark, sf_dir):
    d2 = F.pow((F.col("c_acctbal") - 4500) / 800, 2)
    return read(spark, sf_dir, "customer").select("c_custkey", F.round(weights.cauchy(d2), 8).alias("cauchy"), F.round(weights.cauchy_whole(d2), 8).alias("whole"), F.round(weights.tukey_biweight(d2), 8).alias("tukey"))


@query("WITH m AS (SELECT user_id % 10 AS g, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY 1) SELECT event_id, round(1 / (1 + 0.5 * (value - m) * (value - m) / v), 8) AS weight FROM events JOIN m ON user_id % 10 = g")
def robust_weights(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 10).alias("tile"), F.col("value").alias("lse"))
    return suff.robust_weights(rows, ["tile"]).select("event_id", F.round("weight", 8).alias("weight"))


@query("SELECT event_type, round(avg(value), 5) AS location, round(sqrt(3 * var_samp(value)) / pi(), 5) AS scale FROM events GROUP BY 1")
def logistic_fit(spark, sf_dir):
    location, scale = stats.logistic_fit(F.col("value"))
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.round(location, 5).alias("location"), F.round(scale, 5).alias("scale"))


@query("SELECT event_type, round(avg(value), 5) AS mean, round(stddev_samp(value), 5) AS sd FROM events GROUP BY 1")
def normal_fit(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg("value"), 5).alias("mean"), F.round(F.stddev_samp("value"), 5).alias("sd"))


_WEIBULL = """WITH o AS (SELECT event_type AS g, value, CAST(row_number() OVER (PARTITION BY event_type ORDER BY value) AS DOUBLE) / (count(*) OVER (PARTITION BY event_type) + 1) AS p FROM events),
d AS (SELECT g, ln(value) AS x, ln(-ln(1 - p)) AS y, {w} AS w FROM o WHERE value > 0), {f} SELECT g AS event_type, round(b, 5) AS shape, round(exp(-a / b), 5) AS scale FROM f"""


@query(_WEIBULL.format(w="1.0", f=_wls_sql("f", "d")))
def weibull_fit(spark, sf_dir):
    out = stats.weibull_fit(read(spark, sf_dir, "events"), ["event_type"], "value")
    return out.select("event_type", F.round("shape", 5).alias("shape"), F.round("scale", 5).alias("scale"))


@query(_WEIBULL.format(w="pow((1 - p) * ln(1 - p), 2) / (p * (1 - p))", f=_wls_sql("f", "d")))
def weibull_wfit(spark, sf_dir):
    out = stats.weibull_fit(read(spark, sf_dir, "events"), ["event_type"], "value", weighted_fit=True)
    return out.select("event_type", F.round("shape", 5).alias("shape"), F.round("scale", 5).alias("scale"))


@query("SELECT p_partkey, round(1 - exp(-pow(p_size / 20.0, 1.7)), 9) AS below, round(exp(-pow(p_size / 20.0, 1.7)), 9) AS above, round(1.7 / 20 * pow(p_size / 20.0, 0.7) * exp(-pow(p_size / 20.0, 1.7)), 9) AS density, round(20 * pow(-ln(1 - (p_size - 0.5) / 60), 1 / 1.7), 6) AS quantile FROM part")
def weibull_pqd(spark, sf_dir):
    x = F.col("p_size").cast("double")
    return read(spark, sf_dir, "part").select("p_partkey", F.round(weights.pweibull(x, 1.7, 20.0), 9).alias("below"), F.round(weights.pweibull(x, 1.7, 20.0, upper=True), 9).alias("above"), F.round(weights.dweibull(x, 1.7, 20.0), 9).alias("density"), F.round(weights.qweibull((x - 0.5) / 60, 1.7, 20.0), 6).alias("quantile"))


def _mix_sql(rounds: int) -> str:
    out = ["WITH s AS (SELECT avg(l) AS m, stddev_pop(l) AS s FROM (SELECT ln(value + 1) AS l FROM events))", "x AS (SELECT ln(value + 1) AS v FROM events)", "p0 AS (SELECT 0.5 AS p0, m + (2 - 4.0 / 3) * s AS m0, s / 2 AS s0, 0.5 AS p1, m + (2 - 8.0 / 3) * s AS m1, s / 2 AS s1 FROM s)"]
    for k in range(rounds):
        d = lambda j: f"p{j} / s{j} * exp(-0.5 * pow((v - m{j}) / s{j}, 2))"
        out.append(f"e{k} AS (SELECT v, {d(0)} / ({d(0)} + {d(1)}) AS a, {d(1)} / ({d(0)} + {d(1)}) AS b FROM x CROSS JOIN p{k})")
        out.append(f"p{k + 1} AS (SELECT sum(a) / count(*) AS p0, sum(a * v) / sum(a) AS m0, sqrt(sum(a * v * v) / sum(a) - pow(sum(a * v) / sum(a), 2)) AS s0, sum(b) / count(*) AS p1, sum(b * v) / sum(b) AS m1, sqrt(sum(b * v * v) / sum(b) - pow(sum(b * v) / sum(b), 2)) AS s1 FROM e{k})")
    both = " UNION ALL ".join(f"SELECT {j} AS component, round(p{j}, 5) AS share, round(m{j}, 5) AS mean, round(s{j}, 5) AS sd FROM p{rounds}" for j in (0, 1))
    return ", ".join(out) + " " + both


@query(_mix_sql(4))
def mixnormal_em(spark, sf_dir):
    rows = shared_cut(read(spark, sf_dir, "events").select(F.log(F.col("value") + 1).alias("v")))
    parts, _ = stats.mixture_fit(rows, "v", 2, 4)
    return spark.createDataFrame([(j, round(p, 5), round(m, 5), round(s, 5)) for j, (p, m, s) in enumerate(parts)], "component int, share double, mean double, sd double")


@query()
def mixnormal_em_whole(spark, sf_dir):
    """The mixture with the operator's own components and rounds; ``mixnormal_em`` has as few as SQL can unroll."""
    rows = shared_cut(read(spark, sf_dir, "events").select(F.log(F.col("value") + 1).alias("v")))
    parts, _ = stats.mixture_fit(rows, "v")
    return spark.createDataFrame([(j, round(p, 5), round(m, 5), round(s, 5)) for j, (p, m, s) in enumerate(parts)], "component int, share double, mean double, sd double")


# sufficient statistics


@query(f"WITH {STATE} SELECT tile, round(sum(w), 6) AS wbar FROM st GROUP BY tile")
def wbar(spark, sf_dir):
    return called(spark, sf_dir).groupBy("tile").agg(F.round(F.sum("weight"), 6).alias("wbar"))


@query(f"WITH {STATE} SELECT l.tile AS tile, l.cycle * 4 + l.ch AS pos, round(sum(w * v) + 1.7e-6, 4) + 0.0 AS ibar FROM long l JOIN st USING (cluster_idx) GROUP BY 1, 2")
def ibar(spark, sf_dir):
    return suff.signal_sums(called(spark, sf_dir), ["tile"]).select("tile", "pos", r("ibar").alias("ibar"))


@query(f"WITH {STATE} SELECT c.tile AS tile, c.cycle * 4 + c.base AS pos, round(sum(w * lam) + 1.7e-6, 4) + 0.0 AS sbar FROM call c JOIN st USING (cluster_idx) GROUP BY 1, 2")
def sbar(spark, sf_dir):
    return suff.call_sums(called(spark, sf_dir), ["tile"]).select("tile", "pos", r("sbar").alias("sbar"))


@query(f"WITH {STATE} SELECT a.cycle * 4 + a.base AS i, b.cycle * 4 + b.base AS j, round(sum(w * lam * lam) / 1000 + 1.7e-6, 3) + 0.0 AS v FROM call a JOIN call b USING (cluster_idx) JOIN st USING (cluster_idx) GROUP BY 1, 2")
def gram_j(spark, sf_dir):
    return suff.batch_long(called(spark, sf_dir).drop("tile"), "gram").select("i", "j", r(F.col("v") / 1000, 3).alias("v"))


@query(f"WITH {STATE} SELECT a.cycle * 4 + a.base AS i, l.cycle * 4 + l.ch AS j, round(sum(w * lam * l.v) / 1000 + 1.7e-6, 3) + 0.0 AS v FROM call a JOIN long l USING (cluster_idx) JOIN st USING (cluster_idx) GROUP BY 1, 2")
def cross_k(spark, sf_dir):
    return suff.batch_long(called(spark, sf_dir).drop("tile"), "cross").select("i", "j", r(F.col("v") / 1000, 3).alias("v"))


_REST = STATE + ", rest AS (SELECT cluster_idx, l.cycle, l.cycle * 4 + l.ch AS i, l.v - CASE WHEN l.ch = c.base THEN lam ELSE 0 END AS x, w FROM long l JOIN call c USING (cluster_idx, cycle) JOIN st USING (cluster_idx))"


@query(f"WITH {_REST} SELECT a.i AS i, b.i AS j, round(sum(a.w * a.x * b.x) / sum(a.w) + 1.7e-6, 3) + 0.0 AS v FROM rest a JOIN rest b ON a.cluster_idx = b.cluster_idx AND abs(a.cycle - b.cycle) <= 1 GROUP BY 1, 2")
def band_covariance(spark, sf_dir):
    return suff.batch_band(called(spark, sf_dir).drop("tile")).select("i", "j", r("v", 3).alias("v"))


@query(f"WITH {_REST} SELECT cycle, round(sum(w * x * x) / (sum(w) / 4) + 1.7e-6, 3) + 0.0 AS variance FROM rest GROUP BY 1")
def cycle_variance(spark, sf_dir):
    own = suff.batch_band(called(spark, sf_dir).drop("tile")).where("i = j")
    return own.groupBy(F.floor(F.col("i") / 4).cast("int").alias("cycle")).agg(r(F.sum("v"), 3).alias("variance"))


# row kernels

INVERSE = np.linalg.inv(crosstalk()).tolist()
_P = ", ".join(f"({' + '.join(f'({w!r}) * s[{k + 1}]' for k, w in enumerate(row))})" for row in INVERSE)
PROC = CALL + f", pr AS (SELECT cluster_idx, tile, cycle, [{_P}] AS p FROM (SELECT cluster_idx, tile, cycle, list(v ORDER BY ch) AS s FROM long GROUP BY 1, 2, 3)), pc AS (SELECT cluster_idx, cycle, p, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS b FROM pr)"


@query(f"WITH {PROC} SELECT cluster_idx, cycle, round(p[1] + 1.7e-6, 4) + 0.0 AS a, round(p[2] + 1.7e-6, 4) + 0.0 AS c, round(p[3] + 1.7e-6, 4) + 0.0 AS g, round(p[4] + 1.7e-6, 4) + 0.0 AS t FROM pr")
def process_intensities(spark, sf_dir):
    rows = clusters(spark, sf_dir).select("cluster_idx", sig.unmix(F.col("signal"), INVERSE).alias("p"))
    each = rows.select("cluster_idx", F.posexplode(sig.per_cycle(F.col("p"), lambda ch: ch)).alias("cycle", "q"))
    return each.select("cluster_idx", "cycle", *(r(F.col("q")[k]).alias(n) for k, n in enumerate("acgt")))


@query(f"WITH {PROC} SELECT cluster_idx, string_agg(substr('ACGT', b + 1, 1), '' ORDER BY cycle) AS bases, round(greatest(0, avg(list_max(p))) + 1.7e-6, 4) + 0.0 AS brightness FROM pc GROUP BY 1")
def quick_calls(spark, sf_dir):
    rows = entry.quick_calls(clusters(spark, sf_dir))
    return rows.select("cluster_idx", nuc.chars(F.col("calls")).alias("bases"), r("brightness").alias("brightness"))


_X = "CAST([" + ", ".join("[" + ", ".join(map(repr, row)) + "]" for row in INITIAL_CROSSTALK) + "] AS DOUBLE[][])"
FITTED = PROC + f", lam AS (SELECT cluster_idx, greatest(0, sum(list_dot_product(s.s, ({_X})[b + 1])) / sum(list_dot_product(({_X})[b + 1], ({_X})[b + 1]))) AS lam FROM pc JOIN (SELECT cluster_idx, cycle, list(v ORDER BY ch) AS s FROM long GROUP BY 1, 2) s USING (cluster_idx, cycle) GROUP BY 1)"


@query(f"WITH {FITTED} SELECT cluster_idx, round(lam + 1.7e-6, 4) + 0.0 AS brightness, round(sum(list_dot_product(p, p) - 2 * lam * p[b + 1] + lam * lam) / 1e6 + 1.7e-6, 4) + 0.0 AS lse FROM pc JOIN lam USING (cluster_idx) GROUP BY cluster_idx, lam")
def lambda_a(spark, sf_dir):
    rows = entry.quick_calls(clusters(spark, sf_dir))
    model = sig.expected(F.col("calls"), F.lit(1.0), crosstalk().tolist())
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    lam = F.greatest(F.lit(0.0), dot(F.transform("signal", lambda v: v.cast("double")), F.col("m")) / dot(F.col("m"), F.col("m")))
    rows = rows.withColumn("m", model).withColumn("lam", lam)
    return rows.select("cluster_idx", r("lam").alias("brightness"), r(sig.squared_error(F.col("processed"), F.col("calls"), F.col("lam")) / 1e6).alias("lse"))


@query(f"WITH {PROC}, o AS (SELECT cluster_idx, greatest(0, avg(p[b + 1])) AS lam FROM pc GROUP BY 1), e AS (SELECT cluster_idx, p[b + 1] AS y, list_dot_product(p, p) - 2 * lam * p[b + 1] + lam * lam AS sse FROM pc JOIN o USING (cluster_idx)) SELECT cluster_idx, round(greatest(0, sum(y / (1 + sse / 90000)) / sum(1 / (1 + sse / 90000))) + 1.7e-6, 4) + 0.0 AS brightness FROM e GROUP BY 1")
def lambda_wls(spark, sf_dir):
    rows = entry.quick_calls(clusters(spark, sf_dir))
    each = rows.select("cluster_idx", "brightness", F.posexplode(sig.per_cycle(F.col("processed"), lambda ch: ch)).alias("cycle", "p"), "calls")
    y = F.get("p", F.get("calls", "cycle").cast("int"))
    sse = F.aggregate("p", F.lit(0.0), lambda a, x: a + x * x) - 2 * F.col("brightness") * y + F.col("brightness") * F.col("brightness")
    w = weights.cauchy_whole(sse / 90000)
    return each.groupBy("cluster_idx").agg(r(F.greatest(F.lit(0.0), F.sum(w * y) / F.sum(w))).alias("brightness"))


@query(f"WITH {PROC}, q AS (SELECT cluster_idx, cycle, b, 10 + 2 * (cycle % 5) AS q, lag(b) OVER (PARTITION BY cluster_idx ORDER BY cycle) AS pb, lead(b) OVER (PARTITION BY cluster_idx ORDER BY cycle) AS nb FROM pc), n AS (SELECT cluster_idx, cycle, {calibration.INTERCEPT} + {calibration.SLOPE} * q + coalesce(({list(calibration.PRIOR)})[pb * 4 + b + 1], 0) + coalesce(({list(calibration.NEXT)})[nb * 4 + b + 1], 0) + coalesce(({list(calibration.TRIPLET)})[(nb * 4 + pb) * 4 + b + 1], 0) AS q FROM q) SELECT cluster_idx, cycle, round(q, 6) AS quality FROM n")
def calibrate_table(spark, sf_dir):
    rows = entry.quick_calls(clusters(spark, sf_dir)).withColumn("q", F.transform("calls", lambda b, c: (10 + 2 * (c % 5)).cast("double")))
    new = calibration.calibrate(F.col("q"), F.col("calls"), F.lit(1.0))
    return rows.select("cluster_idx", F.posexplode(new).alias("cycle", "q")).select("cluster_idx", "cycle", F.round("q", 6).alias("quality"))


# truth


def _spikes(spark, sf_dir):
    rows = read(spark, sf_dir, "labels")
    return rows.select(F.col("doc_id").alias("cluster_idx"), F.concat(F.lit("q"), F.col("quality")).alias("truth"), F.col("doc_id").alias("line"))


@query("SELECT d.doc_id AS cluster_idx, 'q' || l.quality AS truth, l.doc_id IS NOT NULL AS spiked FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def spike_join(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("cluster_idx"))
    return joins.with_truth(docs, _spikes(spark, sf_dir), ["cluster_idx"])


@query("SELECT doc_id AS cluster_idx FROM labels WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def spike_unmatched(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cluster_idx"))
    return joins.unmatched(_spikes(spark, sf_dir), rows, ["cluster_idx"]).select("cluster_idx")


_COUNTS = "c AS (SELECT CAST(range AS INTEGER) AS q, count(l_orderkey) AS obs, count(l_orderkey) FILTER (WHERE l_returnflag <> CASE WHEN l_linestatus = 'O' THEN 'N' ELSE 'R' END) AS diff FROM range(94) LEFT JOIN lineitem ON CAST(l_quantity AS INTEGER) = range GROUP BY 1)"


def _counts(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("int").alias("q"), F.col("l_returnflag").alias("call"), F.when(F.col("l_linestatus") == "O", "N").otherwise("R").alias("truth"))
    return joins.quality_counts(rows)


@query(f"WITH {_COUNTS} SELECT q, diff, obs FROM c")
def spike_quality_counts(spark, sf_dir):
    return _counts(spark, sf_dir)


@query("WITH g AS (SELECT DISTINCT l_linenumber FROM lineitem), q AS (SELECT l_linenumber, unnest(range(94)) AS q FROM g) SELECT q.l_linenumber AS l_linenumber, CAST(q.q AS INTEGER) AS q, count(l.o) FILTER (WHERE l.wrong) AS diff, count(l.o) AS obs FROM q LEFT JOIN (SELECT l_linenumber AS n, l_orderkey AS o, CAST(l_quantity AS INTEGER) AS lq, l_returnflag <> CASE WHEN l_linestatus = 'O' THEN 'N' ELSE 'R' END AS wrong FROM lineitem) l ON l.n = q.l_linenumber AND l.lq = q.q GROUP BY 1, 2")
def spike_counts_by_tile(spark, sf_dir):
    """Counts for every quality of every tile (here: line number), as spike-in mode takes them."""
    rows = read(spark, sf_dir, "lineitem").select("l_linenumber", F.col("l_quantity").cast("int").alias("q"), F.col("l_returnflag").alias("call"), F.when(F.col("l_linestatus") == "O", "N").otherwise("R").alias("truth"))
    return joins.quality_counts(rows, ("l_linenumber",))


@query(f"WITH {_COUNTS} SELECT q, CAST(floor(-10 * log10((diff + pow(10, -q / 10.0)) / (obs + 1)) + 0.5) AS INTEGER) AS actual FROM c")
def empirical_quality(spark, sf_dir):
    return joins.observed_quality(_counts(spark, sf_dir)).select("q", "actual")


# best paths and posterior qualities; the SQL recurs over the cycles


# The chain of ``chain_precision``: a base's own cost, and the cost of a base before another. With d = 1e-4 on the diagonal and
# e = -0.3e-4 between the same channel of neighbours, cost(b) = d (lam - 2 p_b) and pair(a, b) = 2 e (lam [a = b] - q_b - p_a), where q is
# the cycle before and p this one; the score is p'Op + lam times the least sum.
_CHAIN = FITTED + """, w AS (SELECT cluster_idx, cycle, p, lam FROM pc JOIN lam USING (cluster_idx)),
bs AS (SELECT cluster_idx, cycle, lam, p, list_transform([1, 2, 3, 4], lambda b: 1e-4 * (lam - 2 * p[b])) AS own, lag(p) OVER (PARTITION BY cluster_idx ORDER BY cycle) AS q, lead(p) OVER (PARTITION BY cluster_idx ORDER BY cycle) AS nx FROM w),
pairs AS (SELECT *, [0, 1, 2, 3] AS k, list_transform([1, 2, 3, 4], lambda b: list_transform([1, 2, 3, 4], lambda a: -0.6e-4 * (CASE WHEN a = b THEN lam ELSE 0 END - q[b] - p[a]))) AS pair,
  list_transform([1, 2, 3, 4], lambda a: list_transform([1, 2, 3, 4], lambda b: -0.6e-4 * (CASE WHEN a = b THEN lam ELSE 0 END - p[b] - nx[a]))) AS after FROM bs),
quad AS (SELECT cluster_idx, sum(1e-4 * list_dot_product(p, p) + coalesce(-0.6e-4 * list_dot_product(p, q), 0)) AS quad FROM bs GROUP BY 1),
fwd AS (SELECT cluster_idx, cycle, CAST([0, 0, 0, 0] AS DOUBLE[]) AS past, own AS cost, ['A', 'C', 'G', 'T'] AS path FROM pairs WHERE cycle = 0
  UNION ALL
  SELECT cluster_idx, cycle, past, list_transform([1, 2, 3, 4], lambda b: past[b] + own[b]), list_transform([1, 2, 3, 4], lambda b: path[CAST(list_position(step[b], list_min(step[b])) AS BIGINT)] || substr('ACGT', b, 1))
  FROM (SELECT n.cluster_idx, n.cycle, n.own, f.path, s.step, list_transform([1, 2, 3, 4], lambda b: list_min(s.step[b])) AS past
        FROM fwd f JOIN pairs n ON n.cluster_idx = f.cluster_idx AND n.cycle = f.cycle + 1, LATERAL (SELECT list_transform([1, 2, 3, 4], lambda b: list_transform([1, 2, 3, 4], lambda a: f.cost[a] + n.pair[b][a])) AS step) s)),
fin AS (SELECT f.cluster_idx, f.path[CAST(list_position(f.cost, list_min(f.cost)) AS BIGINT)] AS bases, q.quad + l.lam * list_min(f.cost) AS score, q.quad, l.lam FROM fwd f JOIN quad q USING (cluster_idx) JOIN lam l USING (cluster_idx) WHERE f.cycle = 15)"""
_RECURSIVE = "WITH RECURSIVE " + _CHAIN


@query(_RECURSIVE + " SELECT cluster_idx, bases, round(score, 4) AS score FROM fin")
def viterbi_calls(spark, sf_dir):
    """Best sequences and their scores under a chain precision with correlated neighbours."""
    return _with_chain(spark, sf_dir).select("cluster_idx", "bases", F.round("score", 4).alias("score"))


_POSTERIOR = _RECURSIVE + """, bwd AS (SELECT cluster_idx, cycle, own, CAST([0, 0, 0, 0] AS DOUBLE[]) AS future FROM pairs WHERE cycle = 15
  UNION ALL
  SELECT n.cluster_idx, n.cycle, n.own, list_transform([1, 2, 3, 4], lambda a: list_min(list_transform([1, 2, 3, 4], lambda b: n.after[a][b] + f.own[b] + f.future[b]))) FROM bwd f JOIN pairs n ON n.cluster_idx = f.cluster_idx AND n.cycle = f.cycle - 1),
st4 AS (SELECT b.cluster_idx, b.cycle, CAST(instr('ACGT', substr(fin.bases, CAST(b.cycle + 1 AS BIGINT), 1)) AS BIGINT) AS k, list_transform([1, 2, 3, 4], lambda x: ln(1 + greatest(0.0, fin.quad + fin.lam * (f.past[x] + b.future[x] + b.own[x])))) AS s
  FROM bwd b JOIN fwd f ON b.cluster_idx = f.cluster_idx AND b.cycle = f.cycle JOIN fin ON b.cluster_idx = fin.cluster_idx),
ql AS (SELECT cluster_idx, cycle, -10 * log10(1 - (1 - pow(10, -3.8)) / list_sum(list_transform(s, lambda x: exp(-32.5 * (x - s[k]))))) AS q FROM st4)
SELECT cluster_idx, string_agg(chr(CAST(greatest(33, least(126, floor(q + 33.5))) AS INTEGER)), '' ORDER BY cycle) AS quality FROM ql GROUP BY 1"""


@query(_POSTERIOR)
def posterior_quality(spark, sf_dir):
    return _with_chain(spark, sf_dir).select("cluster_idx", "quality")


def chain_precision(cycles: int) -> np.ndarray:
    """A simple precision: neighbouring cycles of a channel correlate."""
    side = np.kron(np.eye(cycles, k=1) + np.eye(cycles, k=-1), np.eye(4))
    return (np.eye(4 * cycles) - 0.3 * side) / 1e4


def _with_chain(spark, sf_dir):
    start, omega = Params.initial(16), chain_precision(16)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            signal = suff.matrix_of(batch.column("signal"))
            p = kernels.processed(signal, start.a, start.n)
            lam = kernels.brightness(signal, kernels.strongest(p), start.a, start.n)
            calls, score = kernels.best_path(p, lam, omega)
            quality = kernels.quality_text(kernels.posterior_quality(p, lam, omega, 64.0, calls))
            bases = ["".join("ACGT"[b] for b in row) for row in calls]
            yield pa.RecordBatch.from_arrays([batch.column("cluster_idx"), pa.array(bases, pa.string()), pa.array(score), pa.array(quality, pa.string())], names=["cluster_idx", "bases", "score", "quality"])

    return clusters(spark, sf_dir).select("cluster_idx", "signal").mapInArrow(run, "cluster_idx long, bases string, score double, quality string")


@query()
def fit_tile(spark, sf_dir):
    """The whole fit, tile by tile: bases, qualities and brightness."""
    out = entry.run(clusters(spark, sf_dir), Options())
    return out.select("tile", "cluster_idx", "bases", "quality", F.round("brightness", 3).alias("brightness"))


def _omega(spark, sf_dir) -> DataFrame:
    """tile, i, j and v: the covariance of raw residuals (``v``, zero off the band) and its chain precision (``omega``), both solved for in the task of the sums."""
    rows = called(spark, sf_dir).withColumn("tile", F.lit(0))
    sums = suff.partial_sums(rows, ["signal", "calls", "brightness", "weight"], lambda tile, c: suff.band_sums(suff.matrix_of(c[0]) - c[2].to_numpy()[:, None] * suff.one_hot(suff.matrix_of(c[1], np.int8)), c[3].to_numpy()))

    def solved(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                v = suff.band_matrix(batch.column("v")[k].values.to_numpy())
                omega = solve.precision(v)
                i, j = np.nonzero(np.ones_like(v))
                yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(v.ravel()), pa.array(omega.ravel())], names=["i", "j", "v", "omega"])

    return sums.mapInArrow(solved, "i int, j int, v double, omega double")


@query()
def omega_closed_form(spark, sf_dir):
    """The chain precision of the band covariance of raw residuals, in long form."""
    return _omega(spark, sf_dir).where("omega != 0").select("i", "j", F.round(F.col("omega") * 1e6, 6).alias("v"))


@query(f"WITH {_REST} SELECT a.i AS i, b.i AS j, round(sum(a.w * a.x * b.x) / sum(a.w) + 1.7e-6, 3) + 0.0 AS v FROM rest a JOIN rest b ON a.cluster_idx = b.cluster_idx AND abs(a.cycle - b.cycle) <= 1 GROUP BY 1, 2")
def omega_inverse(spark, sf_dir):
    """The inverse of the chain precision: on the band it is the covariance again, which defines the fit."""
    rows = _omega(spark, sf_dir)

    def inverted(batches):
        import pyarrow as pa

        held = pa.Table.from_batches(batches)
        if held.num_rows:  # 64 x 64 numbers, which the coalesce brings to one task
            i, j = held.column("i").to_numpy(), held.column("j").to_numpy()
            m = np.zeros((i.max() + 1, i.max() + 1))
            m[i, j] = held.column("omega").to_numpy()
            v = np.linalg.inv(m)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(v[i, j])], names=["i", "j", "v"])

    near = F.abs(F.floor(F.col("i") / 4) - F.floor(F.col("j") / 4)) <= 1
    return rows.coalesce(1).mapInArrow(inverted, "i int, j int, v double").where(near).select("i", "j", r("v", 3).alias("v"))


@query("SELECT min(ascii(c)) AS lo, max(ascii(c)) AS hi, count(*) AS n FROM (SELECT substr('!\"#', CAST(1 + vec_id % 3 AS INTEGER), 1) AS c FROM embeddings)")
def clamp_chars(spark, sf_dir):
    char = nuc.clamp_phred(F.substring(F.lit('\t"#'), (1 + F.col("vec_id") % 3).cast("int"), F.lit(1)))
    rows = read(spark, sf_dir, "embeddings").select(nuc.quality_of_char(char).alias("q"))
    return rows.agg((F.min("q") + MIN_PHRED).alias("lo"), (F.max("q") + MIN_PHRED).alias("hi"), F.count("*").alias("n"))


# the row kernels and batch sums against SQL


def _kernel(spark, sf_dir, schema, use):
    """Runs ``use(signal, p, calls, brightness) -> columns`` on Arrow batches of clusters under the default crosstalk."""
    start = Params.initial(16)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            signal = suff.matrix_of(batch.column("signal"))
            p = kernels.processed(signal, start.a, start.n)
            calls = kernels.strongest(p)
            new = use(signal, p, calls, kernels.brightness(signal, calls, start.a, start.n))
            yield pa.RecordBatch.from_arrays([batch.column("cluster_idx"), *(pa.array(v) for v in new.values())], names=["cluster_idx", *new])

    return clusters(spark, sf_dir).select("cluster_idx", "signal").mapInArrow(run, f"cluster_idx long, {schema}")


@query(f"WITH {FITTED} SELECT cluster_idx, round(sum(list_dot_product(p, p) - 2 * lam * p[b + 1] + lam * lam) / 1e6 + 1.7e-6, 4) + 0.0 AS score FROM pc JOIN lam USING (cluster_idx) GROUP BY cluster_idx")
def sequence_score(spark, sf_dir):
    """The score of the strongest channels' sequence under an independent precision: its squared error."""
    out = _kernel(spark, sf_dir, "score double", lambda s, p, calls, lam: {"score": kernels.path_score(p, lam, np.eye(64), calls)})
    return out.select("cluster_idx", r(F.col("score") / 1e6).alias("score"))


def _best(spark, sf_dir):
    """The best sequence of every cluster under an independent precision, and its brightness."""

    def use(signal, p, calls, lam):
        best, _ = kernels.best_path(p, lam, np.eye(64))
        return {"bases": ["".join("ACGT"[b] for b in row) for row in best], "lam": lam}

    return _kernel(spark, sf_dir, "bases string, lam double", use)


@query(f"WITH {FITTED} SELECT cluster_idx, string_agg(substr('ACGT', b + 1, 1), '' ORDER BY cycle) AS bases FROM pc JOIN lam USING (cluster_idx) WHERE lam > 0 GROUP BY 1")
def viterbi_independent(spark, sf_dir):
    """Under an independent precision the best sequence is the strongest channel of every cycle."""

    return _best(spark, sf_dir).where("lam > 0").select("cluster_idx", "bases")


@query(f"WITH {FITTED} SELECT cluster_idx, string_agg(substr('ACGT', b + 1, 1), '' ORDER BY cycle) AS bases FROM pc JOIN lam USING (cluster_idx) GROUP BY 1")
def viterbi_independent_whole(spark, sf_dir):
    """The same for all clusters: without brightness the strongest channels still decide, as the cost is divided by the brightness, and ties go to the lower base."""
    return _best(spark, sf_dir).select("cluster_idx", "bases")


@query(f"WITH {PROC} SELECT cluster_idx, round(greatest(0, avg(p[b + 1])) + 1.7e-6, 4) + 0.0 AS brightness FROM pc GROUP BY 1")
def lambda_ols(spark, sf_dir):
    out = _kernel(spark, sf_dir, "brightness double", lambda s, p, calls, lam: {"brightness": kernels.brightness_ols(p, calls)})
    return out.select("cluster_idx", r("brightness").alias("brightness"))


@query(f"WITH {FITTED} SELECT cluster_idx, cycle, round(lam * ({_X})[b + 1][1] + 1.7e-6, 4) + 0.0 AS a, round(lam * ({_X})[b + 1][4] + 1.7e-6, 4) + 0.0 AS t FROM pc JOIN lam USING (cluster_idx)")
def expected_signal(spark, sf_dir):
    out = _kernel(spark, sf_dir, "e array<double>", lambda s, p, calls, lam: {"e": list(kernels.expected(calls, lam, Params.initial(16).a, np.zeros(64)))})
    each = out.select("cluster_idx", F.posexplode(sig.per_cycle(F.col("e"), lambda ch: ch)).alias("cycle", "q"))
    return each.select("cluster_idx", "cycle", r(F.col("q")[0]).alias("a"), r(F.col("q")[3]).alias("t"))


@query(f"WITH {STATE} SELECT a.tile AS tile, a.cycle * 4 + a.base AS i, b.cycle * 4 + b.base AS j, round(sum(w * lam * lam) / 1000 + 1.7e-6, 3) + 0.0 AS v FROM call a JOIN call b USING (cluster_idx) JOIN st USING (cluster_idx) WHERE lam > 0 GROUP BY 1, 2, 3 HAVING sum(w * lam * lam) > 0")
def batch_gram(spark, sf_dir):
    """J of every tile by the batch sums that the fit uses."""
    rows = called(spark, sf_dir)
    sums = suff.partial_sums(rows, ["signal", "calls", "brightness", "weight"], lambda tile, c: suff.batch_sums(suff.matrix_of(c[0]), suff.matrix_of(c[1], np.int8), c[2].to_numpy(), c[3].to_numpy()))
    each = sums.select("tile", F.posexplode(F.slice("v", 1, 64 * 64)).alias("pos", "v")).where("v != 0")
    return each.select("tile", F.floor(F.col("pos") / 64).cast("int").alias("i"), (F.col("pos") % 64).alias("j"), r(F.col("v") / 1000, 3).alias("v"))


@query(f"WITH {_COUNTS}, a AS (SELECT q, greatest(0, least(93, CAST(floor(-10 * log10((diff + pow(10, -q / 10.0)) / (obs + 1)) + 0.5) AS INTEGER))) AS actual FROM c) SELECT actual AS q, count(*) AS n FROM lineitem JOIN a ON CAST(l_quantity AS INTEGER) = a.q GROUP BY 1")
def recalibrated_qualities(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("int").alias("q"))
    return joins.recalibrated(rows, _counts(spark, sf_dir)).groupBy("q").agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS cluster_idx, c_custkey * 7 % 1794 AS x, c_nationkey + 1000 AS y FROM customer")
def coordinates_by_position(spark, sf_dir):
    rows = read(spark, sf_dir, "customer")
    places = rows.select(F.col("c_custkey").alias("cluster_idx"), (F.col("c_custkey") * 7 % 1794).alias("x"), (F.col("c_nationkey") + 1000).alias("y"))
    return joins.with_coordinates(rows.select(F.col("c_custkey").alias("cluster_idx")), places, ["cluster_idx"]).select("cluster_idx", "x", "y")


@query("SELECT o_orderpriority, CAST(floor(o_totalprice / 100000) AS BIGINT) AS category, count(*) AS n, max(o_orderkey) AS last FROM orders WHERE o_totalprice > 1000 GROUP BY 1, 2")
def split_categories(spark, sf_dir):
    """Rows that pass a predicate, dealt to categories by a function of the row."""
    rows = read(spark, sf_dir, "orders").where("o_totalprice > 1000").withColumn("category", F.floor(F.col("o_totalprice") / 100000))
    return rows.groupBy("o_orderpriority", "category").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last"))


# cycles without data, files and their push-down


_KEPT = "(c.tile % 3 <> 0 OR c.cycle NOT IN (1, 4, 6))"


def _masked(spark, sf_dir):
    """Clusters whose tiles with a number divisible by 3 lack cycles 2, 5 and 7 of 16."""
    gaps = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda c: ~c.isin(1, 4, 6))
    return called(spark, sf_dir).withColumn("valid", F.when(F.col("tile") % 3 == 0, gaps))


@query(f"""WITH {STATE}, c AS MATERIALIZED (SELECT c.*, lam, w FROM call c JOIN st USING (cluster_idx) WHERE {_KEPT}), x AS MATERIALIZED (SELECT c.* FROM long c WHERE {_KEPT}),
e AS (
SELECT a.tile, 'J' AS kind, a.cycle * 4 + a.base AS i, b.cycle * 4 + b.base AS j, sum(a.w * a.lam * a.lam) AS v FROM c a JOIN c b USING (cluster_idx) GROUP BY 1, 3, 4
UNION ALL SELECT a.tile, 'K', a.cycle * 4 + a.base, x.cycle * 4 + x.ch, sum(a.w * a.lam * x.v) FROM c a JOIN x USING (cluster_idx) GROUP BY 1, 3, 4
UNION ALL SELECT tile, 'S', cycle * 4 + base, 0, sum(w * lam) FROM c GROUP BY 1, 3
UNION ALL SELECT x.tile, 'I', x.cycle * 4 + x.ch, 0, sum(w * x.v) FROM x JOIN st USING (cluster_idx) GROUP BY 1, 3
UNION ALL SELECT tile, 'w', 0, 0, sum(w) FROM st GROUP BY 1)
SELECT tile, kind, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(v / 1000 + 1.7e-6, 3) + 0.0 AS v FROM e WHERE abs(v) > 1e-6""")
def masked_sums(spark, sf_dir):
    """The sums of a fit over the valid cycles of each tile."""
    sums = masks.masked_sums(_masked(spark, sf_dir)).where("abs(v) > 1e-6")
    return sums.select("tile", "kind", "i", "j", r(F.col("v") / 1000, 3).alias("v"))


@query(f"WITH {SIG}, d AS (SELECT cluster_idx, tile, list_transform(signal, lambda v, k: CASE WHEN tile % 4 = 1 AND (k - 1) // 4 IN (2, 9) THEN 0 ELSE v END) AS signal FROM sig), u AS (SELECT tile, (k - 1) // 4 AS cycle, max(abs(signal[k])) AS top FROM (SELECT *, unnest(range(1, 65)) AS k FROM d) GROUP BY 1, 2) SELECT tile, CASE WHEN min(top) = 0 THEN string_agg(CASE WHEN top > 0 THEN '1' ELSE '0' END, '' ORDER BY cycle) END AS valid FROM u GROUP BY tile")
def nodata_masks(spark, sf_dir):
    """The cycles that are dark in all clusters of a tile; here two cycles of every fourth tile."""
    rows = clusters(spark, sf_dir)
    dark = F.transform("signal", lambda v, k: F.when((F.col("tile") % 4 == 1) & F.floor(k / 4).isin(2, 9), F.lit(0).cast("smallint")).otherwise(v))
    found = masks.lit_cycles(rows.withColumn("signal", dark))
    return found.select("tile", F.array_join(F.transform("valid", lambda v: v.cast("int").cast("string")), "").alias("valid"))


def _placed(spark, sf_dir):
    """Clusters numbered from 0 in each tile, as files number them."""
    place = F.row_number().over(Window.partitionBy("tile").orderBy("cluster_idx")) - 1
    return clusters(spark, sf_dir).select(F.lit(1).alias("lane"), "tile", place.cast("long").alias("cluster_idx"), "signal")


_PLACED = SIG + ", pl AS (SELECT tile, row_number() OVER (PARTITION BY tile ORDER BY cluster_idx) - 1 AS cluster_idx, signal FROM sig)"


def _folder(spark, name):
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(f"WITH {_PLACED} SELECT 1 AS lane, tile, cluster_idx, array_to_string(list_concat(signal[9:24], signal[45:48]), ' ') AS signal FROM pl WHERE tile BETWEEN 2 AND 7 AND cluster_idx >= 5")
def binary_files(spark, sf_dir):
    """Clusters written as a binary file for each tile; of the files a range of tiles and clusters and the cycles of a block string are read."""
    folder = _folder(spark, "binary")
    cif.write(_placed(spark, sf_dir), folder)
    names = cli._globbed(spark, f"{folder}/*.cif")
    rows = cif.load(spark, cif.CifSource, blocks.wanted("I2R4I5C1")[0], path=",".join(n for n, _ in names))
    return rows.where("tile BETWEEN 2 AND 7 AND cluster_idx >= 5").select("lane", "tile", "cluster_idx", text(F.col("signal")).alias("signal"))


@query(f"WITH {_PLACED} SELECT tile, cluster_idx, CAST(floor((cluster_idx + 0.25) * 10 + 0.5) + 1000 AS BIGINT) AS x, cluster_idx * 20 + 1000 AS y, array_to_string(list_transform(signal, lambda v, k: CASE WHEN tile % 3 = 1 AND (k - 1) // 4 IN (1, 4) THEN 0 ELSE v END), ' ') AS signal, CASE WHEN tile % 3 = 1 THEN '1011011111111111' END AS valid FROM pl")
def run_folder_files(spark, sf_dir):
    """Clusters written as a run folder, a file for each tile and cycle, two cycles missing of every third tile, with position files; then read as a run reads it."""
    folder, rows = _folder(spark, "run"), _placed(spark, sf_dir)
    each = rows.select("tile", "cluster_idx", F.posexplode(sig.per_cycle(F.col("signal"), lambda ch: ch)).alias("c", "signal")).where(~((F.col("tile") % 3 == 1) & F.col("c").isin(1, 4)))
    path = F.format_string("Data/Intensities/L001/C%d.1/s_1_%d.cif", F.col("c") + 1, "tile")
    named.write_intensities(each.select(path.alias("file"), "cluster_idx", "signal", (F.col("c") + 1).alias("first_cycle")), folder)
    places = rows.select(F.format_string("Data/Intensities/s_1_%04d_pos.txt", "tile").alias("file"), "cluster_idx", F.format_string("%d.25 %d.0", "cluster_idx", F.col("cluster_idx") * 2).alias("value"))
    named.write_text(places, folder, ["cluster_idx"])
    read_back = cli.read_folder(spark, folder, ["L1T0-9"])
    valid = F.array_join(F.transform("valid", lambda v: v.cast("int").cast("string")), "")
    return read_back.select("tile", "cluster_idx", "x", "y", text(F.col("signal")).alias("signal"), valid.alias("valid"))


@query(f"WITH {_PLACED} SELECT 3 AS lane, tile, cluster_idx, cluster_idx + 7 AS x, tile AS y, array_to_string(signal[1:40], ' ') AS signal FROM pl")
def text_files(spark, sf_dir):
    """Clusters written as gzipped text, a file for each tile; the first ten cycles are read."""
    folder = _folder(spark, "text")
    rows = _placed(spark, sf_dir).withColumn("lane", F.lit(3)).withColumn("x", F.col("cluster_idx") + 7).withColumn("y", F.col("tile"))
    named.write_text(rows.select(F.concat(F.lit("s_3_"), "tile", F.lit("_int.txt.gz")).alias("file"), "cluster_idx", sources.intensity_line(rows).alias("value")), folder, ["cluster_idx"], "gz")
    read_back = sources.read_intensities(spark, f"{folder}/*_int.txt.gz", 10)
    return read_back.select("lane", "tile", "cluster_idx", "x", "y", text(F.col("signal")).alias("signal"))


@query("SELECT o_orderkey AS cluster_idx, substr('ACGTN', CAST(1 + o_custkey % 5 AS INTEGER), 1) || substr('ACGTN', CAST(1 + o_orderkey % 4 AS INTEGER), 1) AS truth FROM orders")
def truth_files(spark, sf_dir):
    """Truth written as a file, a line for each cluster counted from 1, of three bases; two are read."""
    folder = _folder(spark, "truth")
    base = lambda c, n: F.substring(F.lit("ACGTN"), (1 + F.col(c) % n).cast("int"), F.lit(1))
    rows = read(spark, sf_dir, "orders")
    line = F.concat((F.col("o_orderkey") + 1).cast("string"), F.lit("\t"), base("o_custkey", 5), base("o_orderkey", 4), F.lit("a"))
    named.write_text(rows.select(F.lit("s_1_1_spike.txt").alias("file"), "o_orderkey", line.alias("value")), folder, ["o_orderkey"])
    return sources.read_spikes(spark, f"{folder}/s_1_1_spike.txt", 2).select("cluster_idx", "truth")


_ONE = f"""WITH {FITTED}, one AS (SELECT cluster_idx, p, lam FROM pc JOIN lam USING (cluster_idx) WHERE cycle = 0),
f AS (SELECT cluster_idx, lam, b, 1e-5 * (list_dot_product(p, p) - 2 * lam * p[b + 1] + lam * lam) AS form FROM one, (SELECT unnest(range(4)) AS b)),
g AS (SELECT cluster_idx, any_value(lam) AS lam, arg_min(b, (form, b)) AS b, min(form) AS least, list(form) AS forms FROM f GROUP BY 1),
h AS (SELECT *, greatest(-0.5 * least, ln(1e-5)) AS top FROM g),
q AS (SELECT *, exp(-0.5 * least - top) AS best, exp(ln(1e-5) - top) AS odd FROM h)
SELECT cluster_idx, CAST(CASE WHEN lam = 0 THEN 0 ELSE b END AS INTEGER) AS base,
  round(CASE WHEN lam = 0 THEN 0 ELSE -10 * log10(1 - (odd + best) / (4 * odd + best * list_sum(list_transform(forms, lambda v: exp(-0.5 * (v - least)))))) END + 1.7e-6, 4) + 0.0 AS quality FROM q"""


@query(_ONE)
def single_cycle_calls(spark, sf_dir):
    """Calls and qualities of the first cycle on its own, under a precision of one for all channels."""

    def use(signal, p, calls, lam):
        base, quality = kernels.single_cycle_call(p[:, :4], lam, np.eye(4) * 1e-5, np.zeros(4), 1e-5)
        return {"base": base.astype(np.int32), "quality": quality}

    return _kernel(spark, sf_dir, "base int, quality double", use).select("cluster_idx", "base", r("quality").alias("quality"))


def _group_mix_sql(rounds: int) -> str:
    """EM of two components in each group, ``rounds`` times."""
    steps = ["x AS (SELECT event_type AS g, ln(value + 1) AS v FROM events)", "s0 AS (SELECT g, count(*) AS n, 0.5 AS p0, 0.5 AS p1, avg(v) + (2 - 4 / 3.0) * stddev_pop(v) AS m0, avg(v) + (2 - 8 / 3.0) * stddev_pop(v) AS m1, stddev_pop(v) / 2 AS d0, stddev_pop(v) / 2 AS d1, 0.0 AS l FROM x GROUP BY g)"]
    for k in range(rounds):
        log = lambda j: f"ln(p{j}) - ln(d{j}) - 0.5 * ln(2 * pi()) - 0.5 * pow((v - m{j}) / d{j}, 2)"
        steps.append(f"e{k} AS (SELECT g, n, v, {log(0)} AS a, {log(1)} AS b FROM x JOIN s{k} USING (g))")
        steps.append(f"w{k} AS (SELECT g, n, v, greatest(a, b) AS top, exp(a - greatest(a, b)) AS a, exp(b - greatest(a, b)) AS b FROM e{k})")
        mean = lambda c: f"sum({c} / (a + b) * v) / sum({c} / (a + b))"
        sd = lambda c: f"sqrt(sum({c} / (a + b) * v * v) / sum({c} / (a + b)) - pow({mean(c)}, 2))"
        steps.append(f"s{k + 1} AS (SELECT g, any_value(n) AS n, sum(a / (a + b)) / any_value(n) AS p0, sum(b / (a + b)) / any_value(n) AS p1, {mean('a')} AS m0, {mean('b')} AS m1, {sd('a')} AS d0, {sd('b')} AS d1, sum(top + ln(a + b)) AS l FROM w{k} GROUP BY g)")
    out = " UNION ALL ".join(f"SELECT g AS event_type, {j} AS component, round(p{j} + 1.7e-6, 4) + 0.0 AS share, round(m{j} + 1.7e-6, 4) + 0.0 AS mean, round(d{j} + 1.7e-6, 4) + 0.0 AS sd, round(l + 1.7e-6, 3) + 0.0 AS log_likelihood FROM s{rounds}" for j in (0, 1))
    return f"WITH {', '.join(steps)} {out}"


@query(_group_mix_sql(3))
def mixnormal_em_groups(spark, sf_dir):
    """Mixtures of two components in each type of event, three rounds, all groups in one aggregate a round."""
    rows = shared_cut(read(spark, sf_dir, "events").select("event_type", F.log(F.col("value") + 1).alias("v")))
    fits_ = stats.mixture_fits(rows, ["event_type"], "v", 2, 3)
    each = fits_.select("event_type", "like", F.posexplode(F.arrays_zip("share", "mean", "sd")).alias("component", "c"))
    return each.select("event_type", "component", r("c.share").alias("share"), r("c.mean").alias("mean"), r("c.sd").alias("sd"), r("like", 3).alias("log_likelihood"))


# the separable model, and mixing over non-negative values

#: A phasing that leaks to both neighbouring cycles, and an offset, for sums and un-mixing at fixed parameters.
PHASE = np.where(np.eye(16) > 0, 0.8, 0.0) + 0.1 * (np.eye(16, k=1) + np.eye(16, k=-1))
OFFSET = (np.arange(64) % 7).reshape(16, 4).astype(float)
_MIX = f"CAST({crosstalk().tolist()} AS DOUBLE[][])"
_ALIKE = f"CAST({(crosstalk().T @ crosstalk()).tolist()} AS DOUBLE[][])"


@query(f"""WITH {STATE}, ph AS (SELECT CAST(c AS INTEGER) AS cycle, CAST(d AS INTEGER) AS d, CAST(CASE WHEN c = d THEN 0.8 ELSE 0.1 END AS DOUBLE) AS p FROM range(16) a(c) JOIN range(16) b(d) ON abs(c - d) <= 1),
x AS MATERIALIZED (SELECT call.cluster_idx, call.tile, base, d, sum(lam * p) AS x, any_value(w) AS w FROM call JOIN st USING (cluster_idx) JOIN ph USING (cycle) GROUP BY 1, 2, 3, 4),
e AS (
SELECT a.tile, 'M left' AS side, a.base AS i, b.base AS j, sum(a.w * a.x * b.x) AS v FROM x a JOIN x b USING (cluster_idx, d) GROUP BY 1, 3, 4
UNION ALL SELECT tile, 'M left', base, 4 + d, sum(w * x) FROM x GROUP BY 1, 3, 4
UNION ALL SELECT tile, 'M left', 4 + d, base, sum(w * x) FROM x GROUP BY 1, 3, 4
UNION ALL SELECT tile, 'M left', 4 + d, 4 + d, sum(w) FROM st, range(16) r(d) GROUP BY 1, 3
UNION ALL SELECT x.tile, 'M right', x.base, l.ch, sum(w * x * l.v) FROM x JOIN long l ON x.cluster_idx = l.cluster_idx AND x.d = l.cycle GROUP BY 1, 3, 4
UNION ALL SELECT l.tile, 'M right', 4 + l.cycle, l.ch, sum(w * l.v) FROM long l JOIN st USING (cluster_idx) GROUP BY 1, 3, 4
UNION ALL SELECT a.tile, 'P left', a.cycle, b.cycle, sum(w * lam * lam * ({_ALIKE})[a.base + 1][b.base + 1]) FROM call a JOIN call b USING (cluster_idx) JOIN st USING (cluster_idx) GROUP BY 1, 3, 4
UNION ALL SELECT c.tile, 'P right', c.cycle, l.cycle, sum(w * lam * ({_MIX})[l.ch + 1][c.base + 1] * (l.v - (l.cycle * 4 + l.ch) % 7)) FROM call c JOIN long l USING (cluster_idx) JOIN st USING (cluster_idx) GROUP BY 1, 3, 4)
SELECT tile, side, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(v / 1000 + 1.7e-6, 3) + 0.0 AS v FROM e WHERE abs(v) > 1e-6""")
def separable_sides(spark, sf_dir):
    """Both systems of the separable model, at fixed parameters."""
    found = separable.sides(called(spark, sf_dir), crosstalk(), PHASE, OFFSET).where("abs(v) > 1e-6")
    return found.select("tile", "side", "i", "j", r(F.col("v") / 1000, 3).alias("v"))


@query("""WITH t AS (SELECT DISTINCT label AS tile FROM embeddings), n AS (SELECT CAST(range AS INTEGER) AS n FROM range(16))
SELECT tile, equation, a.n AS i, b.n AS j, 0.0::DOUBLE AS off FROM t, n a, n b, (VALUES ('M', 4, 4), ('P', 16, 16), ('N', 16, 4)) e(equation, rows, columns) WHERE a.n < rows AND b.n < columns""")
def separable_residuals(spark, sf_dir):
    """What is left of the normal equations of each tile's fit, from another reading of its clusters."""
    rows = called(spark, sf_dir)
    _, files = separable.fit(rows, 2000, 1e-14)
    return separable.normal_equations(rows, files).select("tile", "equation", "i", "j", r("off").alias("off"))


@query()
def separable_fit(spark, sf_dir):
    """The separable model of each tile: M, P, N, the cycles' variances and the error."""
    return separable.fit(called(spark, sf_dir), by_variance=True)[0]


_INVERSE_PHASE = f"CAST({np.linalg.inv(PHASE).tolist()} AS DOUBLE[][])"


@query(f"""WITH {LONG}, m AS (SELECT cluster_idx, cycle, list(v - (cycle * 4 + ch) % 7 ORDER BY ch) AS s FROM long GROUP BY 1, 2),
q AS (SELECT cluster_idx, cycle, b, list_dot_product(s, (CAST({INVERSE} AS DOUBLE[][]))[b + 1]) AS q FROM m, range(4) r(b)),
p AS (SELECT cluster_idx, d AS cycle, b, sum(q * ({_INVERSE_PHASE})[cycle + 1][d + 1]) AS p FROM q, range(16) r(d) GROUP BY 1, 2, 3)
SELECT cluster_idx, CAST(cycle AS INTEGER) AS cycle, round(max(p) FILTER (WHERE b = 0) + 1.7e-6, 4) + 0.0 AS a, round(max(p) FILTER (WHERE b = 3) + 1.7e-6, 4) + 0.0 AS t FROM p GROUP BY 1, 2""")
def separable_unmix(spark, sf_dir):
    """M^-1 (I - N) P^-1 at fixed parameters."""
    rows = separable.unmixed(clusters(spark, sf_dir), fixed=separable.Separable(crosstalk(), PHASE, OFFSET))
    each = rows.select("cluster_idx", F.posexplode(sig.per_cycle(F.col("processed"), lambda ch: ch)).alias("cycle", "q"))
    return each.select("cluster_idx", "cycle", r(F.col("q")[0]).alias("a"), r(F.col("q")[3]).alias("t"))


@query("SELECT DISTINCT label AS tile, 0 AS negatives, 0.0::DOUBLE AS off FROM embeddings")
def nonnegative_mixing(spark, sf_dir):
    """Each tile's mixing over A >= 0 from the sums of its clusters: its negative entries, and how far it is from the optimum."""
    rows = called(spark, sf_dir)
    sums = suff.partial_sums(rows, ["signal", "calls", "brightness", "weight"], lambda tile, c: suff.batch_sums(suff.matrix_of(c[0]), suff.matrix_of(c[1], np.int8), c[2].to_numpy(), c[3].to_numpy()))

    def run(batches):
        for batch in batches:
            found = []
            for k in range(batch.num_rows):
                v = batch.column("v")[k].values.to_numpy()
                start = Params.initial(suff.unpacked_width(v) // 4).a
                found.append(solve.off_optimum(*solve.system(v, start, 1.0), solve.mixing(v, start, 1.0, solver="nonnegative")))
            yield pa.RecordBatch.from_arrays([batch.column("tile"), pa.array([n for n, _ in found], pa.int32()), pa.array([x for _, x in found], pa.float64())], names=["tile", "negatives", "off"])

    return sums.mapInArrow(run, "tile int, negatives int, off double").withColumn("off", r("off"))


# a stream of cycles


@query(f"""WITH {PROC}, b AS (SELECT cluster_idx, cycle, CASE WHEN cluster_idx % 5 = 0 AND cycle IN (3, 9) THEN 'N' ELSE substr('ACGT', b + 1, 1) END AS base FROM pc)
SELECT 1 AS lane, tile, cluster_idx, string_agg(base, '' ORDER BY cycle) AS bases FROM b JOIN sig USING (cluster_idx) GROUP BY tile, cluster_idx""")
def streamed_calls(spark, sf_dir):
    """Cycles written as files, read as a stream, put together cluster by cluster and called; two cycles of every fifth cluster never come."""
    folder = _folder(spark, "stream")
    rows = clusters(spark, sf_dir).select(F.lit(1).alias("lane"), "tile", "cluster_idx", F.posexplode(sig.per_cycle(F.col("signal"), lambda ch: ch)).alias("cycle", "signal"))
    sent = rows.where(~((F.col("cluster_idx") % 5 == 0) & F.col("cycle").isin(3, 9)))
    sent.withColumn("at", F.timestamp_seconds(F.lit(1 << 30) + F.col("cycle"))).write.parquet(f"{folder}/in")
    # clusters wait for 5 seconds after their first cycle; the watermark passes that when the first batch has been read
    provider, name = assembly.PROVIDER, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, provider)
    try:
        stream = spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).parquet(f"{folder}/in")
        assembly.call_to(stream, 16, 5000, f"{folder}/out", f"{folder}/state").awaitTermination()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    return spark.read.parquet(f"{folder}/out/calls").select("lane", "tile", "cluster_idx", "bases")
