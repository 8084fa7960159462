"""Weighted quantiles, conformal intervals and online controllers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..semantics import INF
from ..storage import cut, drops
from .ranking import Fold, fold_in_order, running, with_totals


def weighted_quantile(df: DataFrame, q: float, by: str, value: str = "v", weight: str = "w", tie: str = "id", check: bool = True) -> DataFrame:
    """(by, quantile): the weighted q-quantile of each group.

    The first value whose running weight reaches q; below one half the value before it unless the
    weight is met exactly; at one half the weighted mean of both. Weights of a group that are NaN
    or do not sum to one (0.99 to 1.01) are an error, as is a q outside 0 to 1.
    """
    if not 0 <= q <= 1:
        raise ValueError("q must be from 0 to 1")
    rows = df.select(by, F.col(value).alias("v"), F.col(weight).alias("w"), F.col(tie).alias("_tie"))
    run = running(rows, "v", ["w", "_tie"], [by], {"c": F.col("w")}).withColumn("c", F.round("c", 12))
    # running weights do not fall, so the row before the first that reaches q is the last below q
    bad = F.max(F.isnan("w") | F.col("w").isNull() | (F.col("w") < 0))
    reached, row = F.col("c") >= q, F.struct("v", "w", "c")
    found = run.groupBy(by).agg(F.min_by(F.when(reached, row), F.when(reached, F.col("rn"))).alias("x"), F.max_by(F.when(~reached, row), F.when(~reached, F.col("rn"))).alias("y"), F.sum("w").alias("t"), bad.alias("bad"))
    found = cut(found, "quantiles")  # a row for each group
    if check and not found.filter("bad or t is null or t < 0.99 or t > 1.01").isEmpty():
        raise ValueError("the weights of a group must be numbers that sum to one")
    both = found.filter("x is not null").select(by, "x.*", F.col("y.v").alias("pv"), F.col("y.w").alias("pw"))
    if q > 0.5:
        out = F.col("v")
    elif q < 0.5:
        out = F.when(F.col("pv").isNull() | (F.col("c") == q), F.col("v")).otherwise(F.col("pv"))
    else:
        out = F.when((F.col("c") == q) | F.col("pv").isNull(), F.col("v")).otherwise((F.col("v") * F.col("w") + F.col("pv") * F.col("pw")) / (F.col("w") + F.col("pw")))
    return both.select(by, out.alias("quantile"))


def split_quantile(df: DataFrame, residual: str, by: str, alpha: float, tie: str = "id") -> DataFrame:
    """(by, n, quantile): the ceil((1 - alpha)(n + 1))-th smallest residual; null if there is none."""
    rank = running(df.select(by, F.col(residual).alias("quantile"), tie), "quantile", [tie], [by], size="n")
    at = F.col("rn") == F.ceil(F.lit(1 - alpha) * (F.col("n") + 1))
    return rank.groupBy(by).agg(F.max("n").alias("n"), F.max(F.when(at, F.col("quantile"))).alias("quantile"))


def aci_quantile(df: DataFrame, residual: str, by: str, levels: DataFrame, tie: str = "id") -> DataFrame:
    """(by, quantile): the (1 - level)-quantile, with linear interpolation, of a group's residuals and infinity.

    ``levels`` holds (by, level). Any share of the step up to infinity is infinite.
    """
    rank = running(df.select(by, F.col(residual).alias("v"), tie), "v", [tie], [by]).select(by, "rn", "v")
    place = df.groupBy(by).agg(F.count("*").alias("n")).join(levels, by).withColumn("h", (1 - F.col("level")) * F.col("n"))
    place = place.withColumns({"low": F.floor("h") + 1, "high": F.ceil("h") + 1})
    # both places in one join; (group, place) is a key of one row on either side
    at = place.select(by, "h", "low", "high", F.explode(F.array_distinct(F.array("low", "high"))).alias("rn")).join(rank, [by, "rn"], "left")
    side = lambda c: F.max(F.when(F.col("rn") == F.col(c), F.col("v"))).alias(f"v_{c}")
    both = at.groupBy(by).agg(F.max("h").alias("h"), side("low"), side("high"))
    low, high = F.coalesce("v_low", F.lit(INF)), F.coalesce("v_high", F.lit(INF))
    return both.select(by, F.when(low == high, low).otherwise(low + (high - low) * (F.col("h") - F.floor("h"))).alias("quantile"))


def _partitions(items: list[int]):
    if not items:
        yield []
        return
    first, *rest = items
    for p in _partitions(rest):
        yield [[first], *p]
        for i in range(len(p)):
            yield [*p[:i], [first, *p[i]], *p[i + 1 :]]


def feedback_weights(df: DataFrame, own: str, factors: list[str], by: str) -> DataFrame:
    """df with ``weight``: own times the sum, over all choices of different other rows, one for each factor, of their product.

    Closed form for any depth (one more than the number of factors): by inclusion and exclusion
    the sum over different rows is a signed sum over the partitions of the factors, each block of
    which needs one total of the group without the row itself. One pass makes all totals.
    """
    n = len(factors)
    blocks = [[i for i in range(n) if m >> i & 1] for m in range(1, 2**n)]
    product = lambda block: _product([F.col(factors[i]) for i in block])
    name = lambda block: "_t" + "_".join(map(str, sorted(block)))
    if not n:
        return df.withColumn("weight", F.col(own))
    joined = with_totals(df, [by], {name(b): F.sum(product(b)) for b in blocks})
    total = F.lit(0.0)
    for parts in _partitions(list(range(n))):
        sign = 1.0
        for block in parts:
            for j in range(1, len(block)):
                sign *= -j
        total = total + sign * _product([F.col(name(b)) - product(b) for b in parts])
    return joined.withColumn("weight", F.col(own) * total).drop(*map(name, blocks))


def _product(columns: list[Column]) -> Column:
    out = F.lit(1.0)
    for c in columns:
        out = out * c
    return out


def mfcs_weights(df: DataFrame, depth: int, by: str, a: str = "a", b: str = "b", c: str = "c") -> DataFrame:
    """Feedback weights of the last one, two or three steps; see feedback_weights for any depth."""
    return feedback_weights(df, a, [b, c][: depth - 1], by)


def weighted_split_quantile(df: DataFrame, residual: str, weight: str, test_weight: DataFrame, by: str, alpha: float, tie: str = "id") -> DataFrame:
    """(by, quantile): the weighted (1 - alpha)-quantile of calibration residuals and one test point at infinity.

    ``test_weight`` holds (by, w) of each test point; weights are normalised with it.
    """
    cal = df.select(by, F.col(residual).alias("v"), F.col(weight).alias("w"), F.col(tie).cast("bigint").alias("id"))
    test = test_weight.select(by, F.lit(INF).alias("v"), "w", F.lit(2**62).cast("bigint").alias("id"))
    rows = cal.unionByName(test)
    rows = with_totals(rows, [by], {"t": F.sum("w")})
    return weighted_quantile(rows.select(by, "id", "v", (F.col("w") / F.col("t")).alias("w")), 1 - alpha, by, check=False)


def intervals(centres: DataFrame, widths: DataFrame, by: str, centre: str = "centre") -> DataFrame:
    """(…, lower, upper): centre minus and plus the quantile of its group."""
    return centres.join(widths.select(by, "quantile"), by).withColumns({"lower": F.col(centre) - F.col("quantile"), "upper": F.col(centre) + F.col("quantile")}).drop("quantile")


def additive_controller(df: DataFrame, by: str, order: str, feasible: Column, alpha: float, rate: float, start: float = 0.0) -> DataFrame:
    """(…, level): the level before each step; it rises by rate * alpha if feasible, else falls by rate * (1 - alpha)."""
    step = F.when(feasible, rate * alpha).otherwise(rate * (alpha - 1))
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("level", F.lit(start) + F.coalesce(F.sum(step).over(w), F.lit(0.0)))


class Clipped(Fold):
    """x -> clip(x + rate * (alpha - miss), 0, 1); stretches are maps x -> clip(x + c, low, high) again."""

    def __init__(self, alpha: float, rate: float):
        self.start, self.alpha, self.rate = float(alpha), alpha, rate

    def step(self, state, row):
        return min(1.0, max(0.0, state + self.rate * (self.alpha - row[2]))), (state,)

    def summary(self, rows):
        low, high, total = 0.0, 1.0, 0.0
        for row in rows:
            c = self.rate * (self.alpha - row[2])
            total, low, high = total + c, min(1.0, max(0.0, low + c)), min(1.0, max(0.0, high + c))
        return low, high, total

    def through(self, summary, state):
        low, high, total = summary
        return min(high, max(low, state + total))


def clipped_controller(df: DataFrame, by: str, order: str, missed: str, alpha: float, rate: float, ranges: int | None = None) -> DataFrame:
    """(by, step, level): adaptive miscoverage, clipped to [0, 1] after each step; alpha and the levels lie in [0, 1].

    Clipping makes it sequential, but clipped steps compose, so a long chain goes in stretches.
    """
    rows = df.select(by, F.col(order).cast("bigint").alias("step"), F.col(missed).cast("double").alias("_m"))
    return fold_in_order(rows, [by], ["step"], Clipped(alpha, rate), "level double", ranges).select(by, "step", "level")


@drops
def bound_by_mass(df: DataFrame, weight: str, tie: str, alpha: float, limit: float) -> DataFrame:
    """(place, bound) of the largest bound of sorted weights, under which points with a capped,
    normalised weight of at least alpha together hold no more than ``limit``; found by bisection.

    Ranks and running sums are made once; a probe is one pass of sums over them. (0, the least
    weight) if no probe holds; an empty table has no row.
    """
    spark = df.sparkSession
    ranked = cut(running(df.select(F.col(weight).cast("double").alias("v"), tie), "v", [tie], sums={"run": F.col("v")}).select("v", (F.col("rn") - 1).alias("place"), "run"), "bound")
    n = ranked.count()
    if not n:
        return spark.createDataFrame([], "place bigint, bound double")
    at = lambda place: ranked.filter(F.col("place") == place).select("v", "run").first()
    low, high, best = 0, n - 1, (0, at(0)["v"])
    while low <= high:
        mid = (low + high) // 2
        b, run = at(mid)
        total = run + b * (n - mid - 1)
        capped = F.least(F.col("v"), F.lit(b)) / total if total else F.lit(0.0)
        mass = ranked.agg(F.coalesce(F.sum(F.when(capped >= alpha, capped)), F.lit(0.0))).first()[0]
        if mass <= limit:
            best, low = (mid, b), mid + 1
        else:
            high = mid - 1
    return spark.createDataFrame([best], "place bigint, bound double")
