"""Roll-ups of run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..semantics import finite
from .ranking import quantiles


def run_stats(df: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """(by, n_total, n_feasible, frac_infeasible, mean_score, max_score): signs are turned, higher is better."""
    ok = finite(score)
    return df.groupBy(*by).agg(
        F.count("*").alias("n_total"), F.count(ok).alias("n_feasible"), (1 - F.count(ok) / F.count("*")).alias("frac_infeasible"), (-F.avg(ok)).alias("mean_score"), (-F.min(ok)).alias("max_score")
    )


def spine(df: DataFrame, keys: list[str]) -> DataFrame:
    """All combinations of the keys' values; each key has few values."""
    out = None
    for k in keys:
        own = df.select(k).distinct()
        out = own if out is None else out.crossJoin(F.broadcast(own))
    return out


def fill_first_round(stats: DataFrame, value: str, alpha: str = "alpha", seed: str = "seed", rnd: str = "round") -> DataFrame:
    """A dense grid; a missing round 0 takes the seed's first available alpha's round 0."""
    dense = spine(stats, [alpha, seed, rnd]).join(stats, [alpha, seed, rnd], "left")
    w = Window.partitionBy(seed, rnd).orderBy(alpha).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.first(F.col(value), ignorenulls=True).over(w)
    return dense.withColumn(value, F.when(F.col(rnd) == 0, F.coalesce(F.col(value), first)).otherwise(F.col(value)))


def running_best(df: DataFrame, value: str, by: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("best", F.max(value).over(w))


def mean_and_error(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, n, mean, se): population deviation over the root of the count, of values that are there."""
    c = F.when(~F.isnan(value), F.col(value))
    return df.groupBy(*by).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), (F.stddev_pop(c) / F.sqrt(F.greatest(F.count(c), F.lit(1)))).alias("se"))


def step_bands(df: DataFrame, value: str, step: str, seed: str) -> DataFrame:
    """(step, mean, se, median, low, high): sample deviation over the root of the number of seeds; exact quantiles."""
    moments = df.groupBy(step).agg(F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count_distinct(seed))).alias("se"))
    return moments.join(quantiles(df, value, [0.5, 0.25, 0.75], [step]).withColumnsRenamed({"q0": "median", "q1": "low", "q2": "high"}), step)


def parameter_grid(spark, parameters: dict[str, list]) -> DataFrame:
    """One row per combination of parameter values."""
    out = None
    for name, values in parameters.items():
        own = spark.createDataFrame([(v,) for v in values], [name])
        out = own if out is None else out.crossJoin(own)
    return out
