"""Grids of bounds, risks over a grid, and the first violation.

A bound beta caps the unconstrained likelihood u at beta * s. Against a whole grid that is a
comparison of each row with each bound; but min(u, beta s) is u below the row's ratio r = u / s
and beta s above it, so one pass that sums u and s by the grid interval of r, and running sums
over the grid, give every bound's totals. Rows meet the grid once, not once per bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..semantics import INF, TINY
from .ranking import global_row_number

ENDS = {"unconstrained": ([], [INF]), "safe": ([TINY], []), "mixed": ([TINY], [INF])}


def coarse_grid(df: DataFrame, value: str, n_grid: int, proposal: str | None = None) -> DataFrame:
    """(beta): every k-th distinct value, k = max(n // n_grid, 1), with a proposal's end points."""
    distinct = df.select(F.col(value).cast("double").alias("beta")).distinct()
    k = max(distinct.count() // n_grid, 1)
    grid = global_row_number(distinct, "beta").filter((F.col("rn") - 1) % k == 0).select("beta")
    if proposal is None:
        return grid
    if proposal not in ENDS:
        raise ValueError(f"no such proposal: {proposal}")
    low, high = ENDS[proposal]
    ends = df.sparkSession.createDataFrame([(x,) for x in low + high], "beta double")
    return grid.union(ends).distinct()


def linspace_grid(spark: SparkSession, low: float, high: float, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("pos"), (F.lit(low) + F.col("id") * F.lit((high - low) / max(n - 1, 1))).alias("beta"))


def grid_values(grid: DataFrame) -> list[float]:
    """A grid's bounds in order; grids are bounded by their parameter."""
    return sorted(r[0] for r in grid.select("beta").collect())


def interval_of(name: str, betas: list[float], strict: bool = False) -> Column:
    """How many of the bounds, in ascending order, do not exceed a column (or are below it).

    A balanced tree of comparisons, compiled with the rest of the stage. Null is below every
    bound and NaN above.
    """
    less = "<" if strict else "<="

    def tree(low: int, high: int) -> str:
        if low == high:
            return str(low)
        mid = (low + high) // 2
        bound = f"{betas[mid]!r}D" if abs(betas[mid]) < INF else f"double('{'-' if betas[mid] < 0 else ''}Infinity')"
        return f"CASE WHEN {bound} {less} `{name}` THEN {tree(mid + 1, high)} ELSE {tree(low, mid)} END"

    return F.expr(tree(0, len(betas)))


def capped_totals(df: DataFrame, betas: list[float], u: Column, s: Column, denominator: Column, parts: dict[str, Column]) -> DataFrame:
    """(beta, <part>_sum, largest) for every bound; parts are conditions on rows.

    w = min(u, beta s) / denominator; largest is the maximum of w over all rows.
    """
    spark = df.sparkSession
    rows = df.select((u / s).alias("_r"), (u / denominator).alias("_u"), (s / denominator).alias("_s"), *[c.alias(k) for k, c in parts.items()])
    sums = [F.sum(F.when(F.col(k), F.col(v))).alias(f"{k}{v}") for k in parts for v in ("_u", "_s")]
    by = rows.withColumn("_i", interval_of("_r", betas)).groupBy("_i").agg(*sums, F.max("_u").alias("_mu"), F.max("_s").alias("_ms"))
    # interval i holds rows whose ratio reaches bounds 0..i-1: bound j caps rows of intervals above j
    grid = spark.createDataFrame([(j, b) for j, b in enumerate(betas)], "_j int, beta double")
    spine = spark.range(len(betas) + 1).select(F.col("id").cast("int").alias("_i")).join(by, "_i", "left")
    below, above = Window.orderBy("_i").rowsBetween(Window.unboundedPreceding, 0), Window.orderBy("_i").rowsBetween(1, Window.unboundedFollowing)
    run = spine.select(
        "_i",
        *[F.coalesce(F.sum(f"{k}_u").over(below), F.lit(0.0)).alias(f"{k}_free") for k in parts],
        *[F.coalesce(F.sum(f"{k}_s").over(above), F.lit(0.0)).alias(f"{k}_capped") for k in parts],
        F.coalesce(F.max("_mu").over(below), F.lit(0.0)).alias("_top_free"),
        F.coalesce(F.max("_ms").over(above), F.lit(0.0)).alias("_top_capped"),
    )
    at = grid.join(F.broadcast(run), grid["_j"] == run["_i"])
    times = lambda c: F.when(F.col(c) == 0, 0.0).otherwise(F.col(c) * F.col("beta"))  # noqa: E731  infinity times nothing is nothing
    return at.select("beta", *[(F.col(f"{k}_free") + times(f"{k}_capped")).alias(f"{k}_sum") for k in parts], F.greatest("_top_free", times("_top_capped")).alias("largest"))


def risk_curve(df: DataFrame, betas: list[float], u: str = "u", s: str = "s", bad: str = "bad", mixture: Column | None = None, factor: float = 1.0) -> DataFrame:
    """(beta, risk): weighted conformal risk with the test point's weight factor * max w."""
    m = (F.col(u) + F.col(s)) / 2 if mixture is None else mixture
    t = capped_totals(df, betas, F.col(u), F.col(s), m, {"bad": F.col(bad), "every": F.lit(True)})
    test = F.col("largest") * factor
    return t.select("beta", ((F.col("bad_sum") + test) / (F.col("every_sum") + test)).alias("risk"))


def first_violation(curve: DataFrame, alpha: float, position: str = "beta", risk: str = "risk") -> DataFrame:
    """(selected, risk_selected): the last bound before the first whose risk exceeds alpha.

    The first bound if it already violates; the last one if none does. A grid is bounded, so the
    window over it is small.
    """
    w = Window.orderBy(position)
    marked = curve.select(F.col(position).alias("b"), F.col(risk).alias("r"), F.lag(position).over(w).alias("pb"), F.lag(risk).over(w).alias("pr"))
    first = marked.filter(F.col("r") > alpha).agg(F.min_by(F.struct(F.coalesce("pb", "b").alias("b"), F.coalesce("pr", "r").alias("r")), "b").alias("f"))
    last = marked.agg(F.max_by(F.struct("b", "r"), "b").alias("l"))
    both = first.crossJoin(last)  # one row each
    return both.select(F.coalesce("f.b", "l.b").alias("selected"), F.coalesce("f.r", "l.r").alias("risk_selected"))


def pool_risk_curve(calib: DataFrame, pool: DataFrame, bounds: list[float], u: str = "u", s: str = "s", bad: str = "bad") -> DataFrame:
    """(beta, risk): bounds on the log-ratio; densities renormalised over a finite pool at each."""
    betas = [2.718281828459045**b for b in bounds]
    totals = capped_totals(pool, betas, F.col(u), F.col(s), F.lit(1.0), {"pool": F.lit(True)}).select("beta", "pool_sum", F.col("largest").alias("pool_top"))
    cal = capped_totals(calib, betas, F.col(u), F.col(s), F.lit(1.0), {"bad": F.col(bad), "every": F.lit(True)}).select("beta", "bad_sum", "every_sum")
    both = cal.join(totals, "beta")
    test = F.col("pool_top") / F.col("pool_sum")
    risk = (F.col("bad_sum") / F.col("pool_sum") + test) / (F.col("every_sum") / F.col("pool_sum") + test)
    return both.select(F.ln("beta").alias("bound"), risk.alias("risk"))
