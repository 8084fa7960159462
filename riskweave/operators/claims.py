"""Thresholds on claim scores that keep false-claim rates under control.

Losses of a response over a whole bounded grid of thresholds need one grouping: each claim knows
how many thresholds it reaches, and every threshold has three conditional sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.maths import hoeffding_bentkus
from ..functions.named import LOSSES, Expression
from .search import interval_of


def threshold_losses(claims: DataFrame, taus: list[float], kind: str | Expression = "rate", min_loss: float = 0.0) -> DataFrame:
    """(response, tau, loss, recall) for every threshold; retained are scores >= tau, recalled > tau.

    ``kind`` names a loss: "rate" is the share of false claims among those retained, "any" whether there is one.
    """
    bounds = sorted(float(t) for t in taus)
    rows = claims.select("response", interval_of("score", bounds).alias("i"), interval_of("score", bounds, strict=True).alias("j"), F.col("supported").cast("int").alias("ok"))
    # one grouping: claims at or above each threshold, false ones among them, and true ones above it
    at = range(len(bounds))
    counts = [F.struct(F.count_if(F.col("i") > k).alias("n"), F.sum(F.when(F.col("i") > k, 1 - F.col("ok")).otherwise(0)).alias("false"), F.sum(F.when(F.col("j") > k, F.col("ok")).otherwise(0)).alias("above"), F.lit(bounds[k]).alias("tau")) for k in at]
    per = rows.groupBy("response").agg(F.sum("ok").alias("all"), F.array(*counts).alias("c"))
    out = per.select("response", "all", F.explode("c").alias("c")).select("response", "c.tau", "c.n", "c.false", "c.above", "all")
    loss = F.when(F.col("n") == 0, min_loss).otherwise(LOSSES(kind)(F.col("n"), F.col("false")))
    recall = F.when(F.col("all") == 0, 0.0).otherwise(F.col("above") / F.greatest("all", F.lit(1)))
    return out.select("response", "tau", loss.alias("loss"), recall.alias("recall"))


def monotone(losses: DataFrame) -> DataFrame:
    """Running maximum of each response's loss from the largest threshold down."""
    w = Window.partitionBy("response").orderBy(F.desc("tau")).rowsBetween(Window.unboundedPreceding, 0)
    return losses.withColumn("loss", F.max("loss").over(w))


def risks(losses: DataFrame, ceiling: float = 1.0) -> DataFrame:
    """(tau, n, mean, risk): risk is (sum of losses + ceiling) / (n + 1)."""
    return losses.groupBy("tau").agg(F.count("*").alias("n"), F.avg("loss").alias("mean"), ((F.sum("loss") + ceiling) / (F.count("*") + 1)).alias("risk"))


def descend(curve: DataFrame, bad) -> DataFrame:
    """(tau, risk): from the largest threshold down, the last one before the first bad one."""
    w = Window.orderBy(F.desc("tau"))  # a bounded grid
    marked = curve.select("tau", "risk", bad.alias("bad"), F.lag("tau").over(w).alias("pt"), F.lag("risk").over(w).alias("pr"))
    stop = marked.filter("bad").agg(F.max_by(F.struct(F.coalesce("pt", "tau").alias("t"), F.coalesce("pr", "risk").alias("r")), "tau").alias("x"))
    end = marked.agg(F.min_by(F.struct(F.col("tau").alias("t"), F.col("risk").alias("r")), "tau").alias("y"))
    return stop.crossJoin(end).select(F.coalesce("x.t", "y.t").alias("tau"), F.coalesce("x.r", "y.r").alias("risk"))


def gcrc(losses: DataFrame, alpha: float, ceiling: float = 1.0) -> DataFrame:
    return descend(risks(losses, ceiling), F.col("risk") > alpha)


def monotised_crc(losses: DataFrame, alpha: float, ceiling: float = 1.0) -> DataFrame:
    return gcrc(monotone(losses), alpha, ceiling)


def standard_crc(losses: DataFrame, alpha: float, ceiling: float = 1.0) -> DataFrame:
    """(tau, risk): the smallest threshold whose risk does not exceed alpha."""
    return risks(losses, ceiling).filter(F.col("risk") <= alpha).agg(F.min_by(F.struct("tau", "risk"), "tau").alias("x")).select("x.tau", "x.risk")


def learn_then_test(losses: DataFrame, alpha: float, delta: float) -> DataFrame:
    """(tau, risk): from the largest threshold down while the p-value stays at or below delta."""
    tested = risks(losses).select("tau", F.col("mean").alias("risk"), hoeffding_bentkus("mean", "n", alpha).alias("p"))
    return descend(tested.select("tau", "risk", "p"), F.col("p") > delta)
