"""Searches for the bound of a policy, with live proposals or over a finite pool, and their weights.

Every pass over the data meets the whole grid at once (see search.capped_totals); grids come to
the driver, which walks them with the searches' stopping rules. The normaliser psi divides every
weight alike, so a risk needs only min(u, beta s); psi is reported for the chosen bound.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.maths import adjusted_alpha, cap_log
from ..functions.named import VIOLATIONS, Expression
from ..semantics import INF, TINY
from ..storage import cut, drops
from .ranking import running
from .sampling import accept_until
from .search import capped_totals, coarse_grid, grid_values, linspace_grid

_RESULT = "beta double, psi double, grid_size int, position int, risk_margin double, w_test double, proposal string, switch_to_mixture boolean, switch_to_optimized boolean, overlap_safe double, overlap_unconstrained double, envelope double"


@dataclass
class Search:
    """What a bound search is told. ``factor`` scales the test point's weight (2 against the last policy)."""

    alpha: float
    n_grid: int = 200
    starts: int = 1
    factor: float = 1.0
    mixture: bool = False
    mixture_factor: float = 1.0
    optimized_factor: float = 1.0
    by_overlap: bool = True
    least_unconstrained: int = 0
    envelope_scale: float = 1.0
    violation: str | Expression = "infeasible"


def _psi(proposal: str, rows: DataFrame, betas: list[float]) -> list[float]:
    """Normalisers at each bound: mean(min(LR, beta)) on safe samples, mean(min(beta / LR, 1)) on others."""
    wanted = sorted({b for b in betas if b != INF})
    lr = F.col("u") / F.col("s")
    u, s = (lr, F.lit(1.0)) if proposal == "safe" else (F.lit(1.0), 1 / lr)
    every = {"every": F.lit(True)}
    n, top = rows.agg(F.count("*"), F.avg(u)).first()
    got = {r["beta"]: r["every_sum"] / n for r in capped_totals(rows, wanted, u, s, F.lit(1.0), every).collect()} if wanted and n else {}
    return [top if b == INF else got[b] for b in betas]


def _overlap(proposal: str, rows: DataFrame, betas: list[float], psis: list[float]) -> list[float]:
    """Overlaps of the normalised policy with the proposal: the normaliser once more, at bounds that psi moves."""
    moved = [p if proposal == "safe" else b / p for b, p in zip(betas, psis, strict=True)]
    again = _psi(proposal, rows, moved)
    return [a / p for a, p in zip(again, psis, strict=True)] if proposal == "safe" else again


def _largest(rows: DataFrame, betas: list[float], below: list[int] | None = None) -> list[float]:
    """At each bound the largest min(u, beta s) / m, of all rows or of those whose place is below a number of that bound."""
    if below is None:
        at = {r["beta"]: r["largest"] for r in capped_totals(rows, betas, F.col("u"), F.col("s"), F.col("m"), {"every": F.lit(True)}).collect()}
        return [at[b] for b in betas]
    values = [F.max(F.when(F.col("place") <= n, F.least(F.col("u"), _times(b)) / F.col("m"))).alias(f"x{i}") for i, (b, n) in enumerate(zip(betas, below, strict=True))]
    return [x if x is not None else 0.0 for x in rows.agg(*values).first()]  # one pass, a grid's columns


def _times(beta: float) -> Column:
    return F.lit(INF) if beta == INF else F.col("s") * beta


@drops
def beta_search(spark: SparkSession, cal: DataFrame, proposals: dict[str, DataFrame], cfg: Search) -> DataFrame:
    """One row: the largest bound in a row of bounds whose risk stays under control, and how it was found.

    ``cal`` holds u, s, m (mixture of earlier policies) and score; ``proposals`` hold id, u, s and m of
    samples of the "safe" and the "unconstrained" policy. With one start the search begins on safe
    samples and goes on with the others (or with a mixture of both) from the bound where these
    overlap the policy more; with two starts the order is turned and alpha halved.
    """
    alpha = adjusted_alpha(cfg.alpha, cfg.starts)
    names = ["unconstrained"] if cfg.alpha >= 1 else ["unconstrained", "safe"] if cfg.starts == 2 else ["safe", "unconstrained"]
    names = [n for n in names if n in proposals]
    enough = "unconstrained" in proposals and proposals["unconstrained"].count() >= cfg.least_unconstrained
    if not enough and len(names) > 1:
        names = ["safe"]
    placed = lambda r: running(r, "id", [], name="place") if cfg.mixture and len(names) > 1 else r  # noqa: E731  only mixtures take rows by place
    rows = {n: cut(placed(proposals[n].select("id", "u", "s", "m")), n) for n in names}
    counts = {n: rows[n].count() for n in names}
    ratios = {n: rows[n].select((F.col("u") / F.col("s")).alias("lr")) for n in names}
    own_cal = cut(cal.select("u", "s", "m", VIOLATIONS(cfg.violation)("score").alias("bad")), "cal")
    if cfg.alpha >= 1:
        betas = [INF]
    elif len(names) > 1:
        betas = grid_values(coarse_grid(ratios[names[0]].union(ratios[names[1]]), "lr", cfg.n_grid, "mixed"))
    else:
        betas = grid_values(coarse_grid(ratios[names[0]].union(own_cal.select(F.col("u") / F.col("s"))), "lr", cfg.n_grid, names[0]))
    psi = {n: _psi(n, rows[n], betas) for n in names}
    overlap = {n: _overlap(n, rows[n], betas, psi[n]) for n in names}
    o_safe, o_unc = (overlap.get(n, [0.0] * len(betas)) for n in ("safe", "unconstrained"))
    able = enough and cfg.alpha < 1
    to_mixture = [able and cfg.mixture and cfg.mixture_factor * a < b for a, b in zip(o_safe, o_unc, strict=True)]
    to_optimized = [able and not cfg.mixture and cfg.optimized_factor * a < b for a, b in zip(o_safe, o_unc, strict=True)]
    share = [0.0 if cfg.alpha >= 1 else a / (a + b) if cfg.by_overlap and a + b else 1 / (1 + x) for a, b, x in zip(o_safe, o_unc, betas, strict=True)]
    totals = {r["beta"]: r for r in capped_totals(own_cal, betas, F.col("u"), F.col("s"), F.col("m"), {"bad": F.col("bad"), "every": F.lit(True)}).collect()}
    top = {n: _largest(rows[n], betas) for n in names}
    if any(to_mixture):
        part = {"safe": [int(w * counts["safe"]) for w in share], "unconstrained": [int((1 - w) * counts["unconstrained"]) for w in share]}
        mixed = [max(x) for x in zip(*(_largest(rows[n], betas, part[n]) for n in part), strict=True)]
    else:
        mixed = [0.0] * len(betas)

    def risk(i: int, proposal: str) -> tuple[float, float]:
        t = totals[betas[i]]
        w = (mixed[i] if to_mixture[i] else top[proposal][i]) * cfg.factor
        return (t["bad_sum"] + w) / (t["every_sum"] + w), w

    chosen, first, stop = (TINY if alpha < 1 else INF), 0, None
    for turn, proposal in enumerate(names):
        for i in range(first, len(betas)):
            if turn == 0 and len(names) > 1 and (to_mixture[i] or to_optimized[i]):
                first = i
                break
            r, w = risk(i, proposal)
            if r > alpha or betas[i] == INF or alpha >= 1:
                stop = (proposal, i, r, w)
                break
            chosen = betas[i]
        if stop:
            break
    proposal, i, r, w = stop or (names[-1], len(betas) - 1, math.nan, risk(len(betas) - 1, names[-1])[1])
    if not stop:
        chosen = betas[-1]
    at = _psi(proposal, rows[proposal], [chosen])[0]
    # the envelope of the policy over what it is sampled from
    capped = F.least(F.col("u"), _times(betas[i])) / psi[proposal][i]
    if cfg.mixture or cfg.mixture_factor * o_safe[i] < o_unc[i]:
        weight = 0.0 if cfg.alpha >= 1 else o_safe[i] / (o_safe[i] + o_unc[i]) if cfg.by_overlap and o_safe[i] + o_unc[i] else 1 / (1 + chosen)
        below = weight * F.col("s") + (1 - weight) * F.col("u")
    else:
        below = F.col("u") if proposal == "unconstrained" else F.col("s")
    envelope = rows[proposal].agg(F.max(capped / below)).first()[0] * cfg.envelope_scale
    out = (float(chosen), float(at), len(betas) - first, max(i - first - 1, 0), float(alpha - r), float(w), proposal, bool(to_mixture[i]), bool(to_optimized[i]), float(o_safe[i]), float(o_unc[i]), float(envelope))
    return spark.createDataFrame([out], _RESULT)


def pool_curve(cal: DataFrame, pool: DataFrame, bounds: list[float], test: str = "max", factor: float = 1.0) -> DataFrame:
    """(bound, risk) for bounds on ln(u / s); densities are renormalised over the pool at each.

    The test point weighs ``factor`` times the largest ratio of the pool to the mixture m ("max"),
    or the ratio's mean under the policy ("sum").
    """
    betas = [math.exp(b) for b in bounds]
    every = {"every": F.lit(True)}
    mass = capped_totals(pool, betas, F.col("u"), F.col("s"), F.lit(1.0), every).select("beta", F.col("every_sum").alias("mass"))
    if test == "max":
        top = capped_totals(pool, betas, F.col("u"), F.col("s"), F.col("m"), every).select("beta", F.col("largest").alias("top"))
        both = mass.join(top, "beta").select("beta", "mass", (factor * F.col("top") / F.col("mass")).alias("test"))
    elif test == "sum":
        # min(u, beta s) squared is min(u u, beta beta s s)
        squares = capped_totals(pool.select((F.col("u") * F.col("u")).alias("u"), (F.col("s") * F.col("s")).alias("s"), "m"), [b * b for b in betas], F.col("u"), F.col("s"), F.col("m"), every)
        back = {b * b: b for b in betas}
        squares = cal.sparkSession.createDataFrame([(back[r["beta"]], r["every_sum"]) for r in squares.collect()], "beta double, square double")  # a grid
        both = mass.join(squares, "beta").select("beta", "mass", (factor * F.col("square") / (F.col("mass") * F.col("mass"))).alias("test"))
    else:
        raise ValueError(f"no such weight of the test point: {test}")
    own = capped_totals(cal, betas, F.col("u"), F.col("s"), F.col("m"), {"bad": F.col("bad"), "every": F.lit(True)})
    at = cal.sparkSession.createDataFrame(list(zip(betas, map(float, bounds), strict=True)), "beta double, bound double")
    risk = (F.col("bad_sum") / F.col("mass") + F.col("test")) / (F.col("every_sum") / F.col("mass") + F.col("test"))
    return own.join(both, "beta").join(at, "beta").select("bound", risk.alias("risk"))


def pool_search(spark: SparkSession, cal: DataFrame, pool: DataFrame, alpha: float, n_grid: int = 200, test: str = "max", factor: float = 1.0) -> DataFrame:
    """(bound, position): the bound before the first violation on an even grid of log-ratios, or before the grid's end."""
    low, high = pool.agg(F.min(F.ln(F.col("u") / F.col("s"))), F.max(F.ln(F.col("u") / F.col("s")))).first()
    bounds = grid_values(linspace_grid(spark, low, high, n_grid))
    risks = [r["risk"] for r in sorted(pool_curve(cal, pool, bounds, test, factor).collect(), key=lambda r: r["bound"])]  # a grid
    bad = next((i for i, r in enumerate(risks) if r > alpha), len(risks) - 1)
    return spark.createDataFrame([(bounds[max(bad - 1, 0)], max(bad - 1, 0))], "bound double, position int")


def bound_weights(cal: DataFrame, pool: DataFrame, bound: float, test: str = "max", factor: float = 1.0) -> DataFrame:
    """(id, weight): normalised conformal weights of calibration rows under a given bound; the test point has a null id."""
    capped = cap_log(F.col("u"), F.col("s"), bound)
    mass = pool.agg(F.sum(capped)).first()[0]
    ratio = capped / mass / F.col("m")
    extra = pool.agg((factor * (F.max(ratio) if test == "max" else F.sum(ratio * capped / mass))).alias("w")).first()[0]
    rows = cal.select("id", ratio.alias("w"))
    total = rows.agg(F.sum("w")).first()[0] + extra
    point = cal.sparkSession.createDataFrame([(None, extra)], rows.schema)
    return rows.union(point).select("id", (F.col("w") / total).alias("weight"))


def accept_rounds(df: DataFrame, liks: list[str], betas: list[float], psis: list[float], envelopes: list[float], draws: list[Column], target: int, chain: str, order: list[str]) -> DataFrame:
    """Rows that pass every round of a sequence of policies, with ``policy``, the last one's density.

    Round t caps its likelihood at beta_t times the policy of the round before, over psi_t; a row
    that the earlier policy sampled is accepted with min(1, policy_t / (policy_{t-1} envelope_t)),
    up to the target-th acceptance of each chain in each round.
    """
    now = df.withColumn("policy", F.col(liks[0]))
    for lik, beta, psi, envelope, draw in zip(liks[1:], betas, psis, envelopes, draws, strict=True):
        new = F.least(F.col(lik), F.col("policy") * beta) / psi
        probability = F.least(F.lit(1.0), new / (F.col("policy") * envelope))
        judged = accept_until(now.withColumn("_new", new), probability, draw, target, chain, order)
        now = cut(judged.filter("accepted").withColumn("policy", F.col("_new")).drop("_new", "accepted"), "round")
    return now
