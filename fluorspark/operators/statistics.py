"""Weighted statistics, regressions and distribution fits as grouped aggregates.

Every fit is sums over the rows of a group, so partial aggregates are all that is shuffled; iterative
fits repeat one aggregate and join its few rows back.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from fluorspark.operators.parameters import shared_cut


def weighted(value: Column, weight: Column) -> Column:
    return F.sum(weight * value) / F.sum(weight)


def weighted_variance(df: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """``wmean`` and ``wvar``, the weighted variance with n - 1, of each group."""
    x, w = F.col(value), F.col(weight)
    means = df.groupBy(*by).agg(weighted(x, w).alias("wmean"))
    own = df.join(means, by)
    n, total = F.count("*"), F.sum(w)
    spread = F.sum(w * F.pow(x - F.col("wmean"), 2)) / (n - 1) * n / total
    return own.groupBy(*by).agg(F.first("wmean").alias("wmean"), spread.alias("wvar"))


def line_fit(df: DataFrame, by: list[str], x: str, y: str, weight: Column | None = None) -> DataFrame:
    """``slope``, ``intercept`` and ``rss`` of the (weighted) least-squares line of each group."""
    w = F.lit(1.0) if weight is None else weight
    a, b = F.col(x), F.col(y)
    sums = df.groupBy(*by).agg(F.sum(w).alias("w"), F.sum(w * a).alias("x"), F.sum(w * b).alias("y"), F.sum(w * a * a).alias("xx"), F.sum(w * a * b).alias("xy"), F.sum(w * b * b).alias("yy"))
    sxx, sxy, syy = (F.col(p) - F.col(q) * F.col(r) / F.col("w") for p, q, r in (("xx", "x", "x"), ("xy", "x", "y"), ("yy", "y", "y")))
    fit = sums.withColumn("slope", sxy / F.nullif(sxx, F.lit(0.0)))
    return fit.select(*by, "slope", ((F.col("y") - F.col("slope") * F.col("x")) / F.col("w")).alias("intercept"), (syy - F.col("slope") * sxy).alias("rss"))


def residuals(df: DataFrame, fit: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    return df.join(fit.select(*by, "slope", "intercept"), by).withColumn("residual", F.col(y) - F.col("intercept") - F.col("slope") * F.col(x))


def iwls_fit(df: DataFrame, by: list[str], x: str, y: str, weight: Callable[[Column], Column], rounds: int) -> DataFrame:
    """Iteratively reweighted line: weights of squared residuals over their mean square."""
    fit = line_fit(df, by, x, y)
    for _ in range(rounds):
        rest = residuals(df, fit, by, x, y)
        size = rest.groupBy(*by).agg(F.avg(F.col("residual") * F.col("residual")).alias("square"))
        weighed = rest.drop("slope", "intercept").join(size, by).withColumn("_w", weight(F.col("residual") * F.col("residual") / F.col("square")))
        fit = line_fit(weighed, by, x, y, F.col("_w"))
    return fit


def logistic_fit(value: Column) -> tuple[Column, Column]:
    """Location and scale by moments."""
    return F.avg(value), F.sqrt(3 * F.var_samp(value)) / math.pi


def ranked(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Adds ``rank``, the place (from 1) of a row in its group by ``value``, and ``n``, the group's size.

    Rows are dealt to ranges of (group, value), a large group to many; places in a range follow those of the ranges before
    it. Rows of one value are told apart by their number, so one value may fill several ranges too.
    """
    own = df.withColumn("_row", F.monotonically_increasing_id())
    dealt = shared_cut(own.repartitionByRange(*by, value, "_row").withColumn("_part", F.spark_partition_id()))
    parts = dealt.groupBy(*by, "_part").agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    places = parts.select(*by, "_part", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_size").over(Window.partitionBy(*by)).alias("n"))
    within = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(value, "_row"))
    return dealt.withColumn("_within", within).join(places, [*by, "_part"]).select(*df.columns, (F.col("_before") + F.col("_within")).alias("rank"), "n")


def median(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The median of each group's values that are known, by rank: no group has to fit in one task."""
    rows = ranked(df.where(F.col(value).isNotNull()).select(*by, value), by, value)
    middle = (2 * F.col("rank")).between(F.col("n"), F.col("n") + 2)
    return rows.where(middle & (F.col("rank") >= F.floor((F.col("n") + 1) / 2)) & (F.col("rank") <= F.floor(F.col("n") / 2) + 1)).groupBy(*by).agg(F.avg(value).alias("median"))


def weibull_fit(df: DataFrame, by: list[str], value: str, weighted_fit: bool = False) -> DataFrame:
    """``shape`` and ``scale`` from the line through the order statistics on Weibull paper.

    The weighted fit counts each point by the inverse variance of its plotting position.
    """
    p = (F.col("rank") / (F.col("n") + 1)).alias("p")
    points = ranked(df.select(*by, value), by, value).where(F.col(value) > 0).select(*by, value, p)
    points = points.select(*by, F.log(value).alias("lx"), F.log(-F.log1p(-F.col("p"))).alias("ly"), (F.pow((1 - F.col("p")) * F.log1p(-F.col("p")), 2) / (F.col("p") * (1 - F.col("p")))).alias("pw"))
    line = line_fit(points, by, "lx", "ly", F.col("pw") if weighted_fit else None)
    return line.select(*by, F.col("slope").alias("shape"), F.exp(-F.col("intercept") / F.col("slope")).alias("scale"))


#: Groups whose mixtures are sent to every task; with more the rows are joined by group.
MOST_GROUPS = 50_000
#: The least deviation of a component, that of one whose values are all equal.
LEAST_SD = 1e-9


def mixture_starts(df: DataFrame, by: list[str], value: str, k: int) -> DataFrame:
    """Each group's ``n``, ``share``, ``mean`` and ``sd`` (arrays of ``k``), spread over two deviations about the mean."""
    x = F.col(value).cast("double")
    own = df.where(x.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(x).alias("_m"), F.stddev_pop(x).alias("_s")).where("n > 0")
    each = lambda use: F.array(*(use(j) for j in range(k)))
    return own.select(*by, "n", each(lambda j: F.lit(1.0 / k)).alias("share"), each(lambda j: F.col("_m") + (2 - 4 * (j + 1) / (k + 1)) * F.col("_s")).alias("mean"), each(lambda j: F.greatest(F.col("_s") / k, F.lit(LEAST_SD))).alias("sd"))


def _mixture_round(rows: DataFrame, parts: DataFrame | Row, by: list[str], value: str, k: int) -> DataFrame:
    """One round of EM for all groups of ``parts``, or of all rows as one group with a row's parameters: ``n``, ``share``, ``mean``, ``sd`` and ``new_like``, by one aggregate."""
    x = F.col(value).cast("double")
    held = rows.where(x.isNotNull()).select(*by, x.alias("_x"))
    if isinstance(parts, Row):
        held = held.select("*", F.lit(parts["n"]).alias("n"), *(F.array(*map(F.lit, parts[c])).alias(c) for c in ("share", "mean", "sd")))
    else:
        held = held.join(parts, by)
    at = lambda name, j: F.get(name, F.lit(j))
    log = lambda j: F.when(at("share", j) > 0, F.log(at("share", j)) - F.log(at("sd", j)) - 0.5 * math.log(2 * math.pi) - 0.5 * F.pow((F.col("_x") - at("mean", j)) / at("sd", j), 2)).otherwise(float("-inf"))
    logs = held.select(*by, "_x", "n", "share", "mean", "sd", F.array(*(log(j) for j in range(k))).alias("_l")).withColumn("_top", F.array_max("_l"))
    weights = logs.withColumn("_w", F.transform("_l", lambda v: F.exp(v - F.col("_top"))))
    whole = weights.withColumn("_t", F.aggregate("_w", F.lit(0.0), lambda a, v: a + v))
    share = lambda j: F.get("_w", F.lit(j)) / F.col("_t")
    sums = [f(j).alias(f"{n}{j}") for j in range(k) for n, f in (("_p", lambda j: F.sum(share(j))), ("_x", lambda j: F.sum(share(j) * F.col("_x"))), ("_y", lambda j: F.sum(share(j) * F.col("_x") * F.col("_x"))))]
    before = [F.first(c).alias(c) for c in ("n", "share", "mean", "sd")]
    found = whole.groupBy(*by).agg(*before, F.sum(F.col("_top") + F.log("_t")).alias("new_like"), *sums)
    # a component that holds nothing keeps its place
    mean = lambda j: F.when(F.col(f"_p{j}") > 0, F.col(f"_x{j}") / F.col(f"_p{j}")).otherwise(at("mean", j))
    sd = lambda j: F.when(F.col(f"_p{j}") > 0, F.greatest(F.lit(LEAST_SD), F.sqrt(F.greatest(F.lit(0.0), F.col(f"_y{j}") / F.col(f"_p{j}") - F.pow(mean(j), 2))))).otherwise(at("sd", j))
    each = lambda use: F.array(*(use(j) for j in range(k)))
    return found.select(*by, "n", each(lambda j: F.col(f"_p{j}") / F.col("n")).alias("share"), each(mean).alias("mean"), each(sd).alias("sd"), "new_like")


def mixture_fits(df: DataFrame, by: list[str], value: str, k: int = 3, rounds: int = 100, tolerance: float = 0.0) -> DataFrame:
    """Normal mixtures of all groups by EM: ``n``, ``share``, ``mean`` and ``sd`` (arrays of ``k``), ``like``, the log-likelihood that the last round began with, and ``rounds``.

    The parameters are a table, a row for each group, joined to the rows; a round is one aggregate for all groups that go on, which tasks
    begin on their own rows, so that a large group is no larger task. While there are no more than ``MOST_GROUPS`` groups the table passes through the driver and is sent to every task;
    with more it stays in the shared folder and the rows are joined by group. With ``tolerance`` a group stops when a round raises its log-likelihood by
    no more than that, and its rows take no further part. Null values take no part; groups without values have no row.
    """
    spark = df.sparkSession
    start = mixture_starts(df, by, value, k).withColumn("like", F.lit(None).cast("double")).withColumn("rounds", F.lit(0))
    known = start.limit(MOST_GROUPS + 1).collect()
    if len(known) > MOST_GROUPS:
        return _many_mixtures(df, shared_cut(start), by, value, k, rounds, tolerance)
    going, stopped = known, []
    for done in range(1, rounds + 1):
        if not going:
            break
        before = {tuple(r[c] for c in by): r["like"] for r in going}
        parts = going[0] if not by else F.broadcast(spark.createDataFrame(going, start.schema).drop("like", "rounds"))
        going = []
        for r in _mixture_round(df, parts, by, value, k).collect():
            key, last = tuple(r[c] for c in by), before[tuple(r[c] for c in by)]
            # a round reports the likelihood of the parameters it began with
            closed = tolerance > 0 and last is not None and r["new_like"] - last <= tolerance
            (stopped if closed else going).append(Row(*start.columns)(*key, r["n"], r["share"], r["mean"], r["sd"], r["new_like"], done))
    return spark.createDataFrame(going + stopped, start.schema)


def _many_mixtures(df: DataFrame, parts: DataFrame, by: list[str], value: str, k: int, rounds: int, tolerance: float) -> DataFrame:
    """``mixture_fits`` of more groups than the driver takes: the parameters are joined to the rows and stay in the shared folder."""
    columns, stopped = parts.columns, parts.limit(0)
    for _ in range(rounds):
        before = parts.select(*by, F.col("like").alias("_like"), "rounds")
        new = _mixture_round(df, parts.drop("like", "rounds"), by, value, k).join(before, by)
        closed = F.coalesce(F.col("new_like") - F.col("_like") <= F.lit(tolerance), F.lit(False)) if tolerance > 0 else F.lit(False)
        step = shared_cut(new.select(*by, "n", "share", "mean", "sd", F.col("new_like").alias("like"), (F.col("rounds") + 1).alias("rounds"), closed.alias("closed")))
        parts = step.where("NOT closed").select(*columns)
        if tolerance > 0:
            stopped = stopped.unionByName(step.where("closed").select(*columns))
            if parts.isEmpty():
                break
    return parts.unionByName(stopped)


def mixture_fit(df: DataFrame, value: str, k: int = 3, rounds: int = 100) -> tuple[list[tuple[float, float, float]], float]:
    """The mixture of all rows: (share, mean, sd) of each component and the log-likelihood that the last round began with."""
    row = mixture_fits(df, [], value, k, rounds).first()
    return list(zip(row["share"], row["mean"], row["sd"], strict=True)), row["like"]
