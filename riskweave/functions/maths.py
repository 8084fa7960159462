"""Formulas of likelihood control as columns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..semantics import INF, col, infeasible, np_div


def cap_first(safe: Column, lik: Column, beta: float | Column, psi: float | Column = 1.0) -> Column:
    """The constrained likelihood after one round: min(lik, beta * safe) / psi, for safe > 0."""
    return F.least(lik, safe * beta) / psi


def cap_chain(liks: str | Column, betas: list[float], psis: list[float]) -> Column:
    """Constrained likelihoods of all rounds, each capped against the one before."""
    liks, n = col(liks), len(betas)
    bounds = F.array(*[F.struct(F.lit(float(b)).alias("b"), F.lit(float(p)).alias("p")) for b, p in zip(betas, psis, strict=True)])
    start = F.array(F.get(liks, F.lit(0)))
    step = lambda acc, i: F.concat(acc, F.array(F.least(F.get(liks, i), F.element_at(acc, -1) * F.get(bounds, i)["b"]) / F.get(bounds, i)["p"]))
    return F.aggregate(F.sequence(F.lit(1), F.lit(n - 1)), start, step) if n > 1 else start


def cap_log(lik: Column, safe: Column, bound: float | Column) -> Column:
    """Capping of the log-ratio: lik if ln(lik / safe) < bound, else exp(bound) * safe."""
    b = bound if isinstance(bound, Column) else F.lit(float(bound))
    return F.when(F.ln(lik / safe) < b, lik).otherwise(F.exp(b) * safe)


def adjusted_alpha(alpha: float, starts: int = 1) -> float:
    """The level that a search controls: 1 without control, halved for a search from two starts."""
    return 1.0 if alpha >= 1 else alpha / 2 if starts == 2 else alpha


def mixture_weight(alpha: float, beta: Column, psi_safe: Column | None = None, psi_unc: Column | None = None, least: float = 0.0) -> Column:
    """Share of the safe proposal, by overlaps (no less than ``least``) or else by the bound."""
    if alpha >= 1:
        return F.lit(0.0)
    if psi_safe is not None:
        return F.greatest(psi_safe / (psi_safe + psi_unc), F.lit(float(least)))
    return 1 / (1 + beta)


def switches_proposal(alpha: float, overlap_safe: Column, overlap_unc: Column, factor: float = 1.0, enough: bool = True) -> Column:
    """Whether to leave the safe proposal: the other one overlaps the policy more, and has enough samples."""
    if alpha >= 1 or not enough:
        return F.lit(False)
    return factor * overlap_safe < overlap_unc


def accept_unconstrained(lr: Column, beta: float | Column) -> Column:
    return F.least(F.lit(1.0), beta / lr)


def accept_safe(lr: Column, beta: float | Column) -> Column:
    return F.least(F.lit(1.0), lr / beta)


def accept_mixture(target: Column, proposal: Column, envelope: float | Column) -> Column:
    return F.least(F.lit(1.0), target / (proposal * envelope))


def reward(before: Column, after: Column) -> Column:
    """How much better the second score is; infeasible scores count as 0."""
    clean = lambda c: F.when(infeasible(c), 0.0).otherwise(c)
    return F.greatest(clean(before) - clean(after), F.lit(0.0))


def score_distance(a: Column, b: Column) -> Column:
    d = a - b
    return F.when(infeasible(d), 0.0).otherwise(F.abs(d))


def bernoulli_kl(a: Column, b: Column | float) -> Column:
    b = F.lit(b) if isinstance(b, float) else b
    return a * F.ln(a / b) + (1 - a) * F.ln((1 - a) / (1 - b))


def hoeffding_bentkus(risk: str | Column, n: str | Column, alpha: float) -> Column:
    """The p-value min(e * P(Bin(n, alpha) <= ceil(n risk)), exp(-n KL(min(risk, alpha), alpha))).

    At risk 0 the second term is not used. Products within 1e-9 above a whole number count as it.
    For rows of a grid: all of a batch are computed together.
    """
    @F.pandas_udf("double")
    def p_value(r: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series(p_values(r.to_numpy(float), m.to_numpy(float), alpha), index=r.index)

    return p_value(col(risk).cast("double"), col(n).cast("double"))


def p_values(risk: np.ndarray, n: np.ndarray, alpha: float) -> np.ndarray:
    """hoeffding_bentkus of arrays; NaN where risk or n is."""
    known = ~(np.isnan(risk) | np.isnan(n))
    out = np.full(len(risk), np.nan)
    r, m = risk[known], n[known]
    bentkus = math.e * binomial_cdf(np.ceil(m * r - 1e-9), m, alpha)
    q = np.minimum(r, alpha)
    some = q > 0
    a = np.where(some, q, 0.5)
    # a ln(a/b) is 0 at a = 0; the reference quantity is undefined there, so the other bound stands
    divergence = a * np.log(a / alpha) + (1 - a) * np.log((1 - a) / (1 - alpha))
    out[known] = np.where(some, np.minimum(bentkus, np.exp(-m * divergence)), bentkus)
    return out


def binomial_cdf(k: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
    """P(Bin(n, p) <= k): the regularised incomplete beta function of 1 - p at (n - k, k + 1).

    Its continued fraction takes at most about 10 sqrt(n) steps, and no list of n entries.
    """
    inside = (k >= 0) & (k < n)
    out = np.where(k < 0, 0.0, 1.0)
    a, b = (n - k)[inside], (k + 1)[inside]
    if not len(a):
        return out
    log_factorial = lambda x: np.array([math.lgamma(v + 1) for v in x])
    front = np.exp(log_factorial(a + b - 1) - log_factorial(a - 1) - log_factorial(b - 1) + a * math.log1p(-p) + b * math.log(p))
    direct = (1 - p) < (a + 1) / (a + b + 2)
    first, second = np.where(direct, a, b), np.where(direct, b, a)
    share = front * _beta_fraction(first, second, np.where(direct, 1 - p, p)) / first
    out[inside] = np.clip(np.where(direct, share, 1 - share), 0.0, 1.0)
    return out


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function, by Lentz's recurrence."""
    safe = lambda v: np.where(np.abs(v) < 1e-300, 1e-300, v)
    c, d = np.ones_like(a), 1 / safe(1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 100 + 10 * math.ceil(math.sqrt((a + b).max()))):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d, c = 1 / safe(1 + even * d), safe(1 + even / c)
        h = h * d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d, c = 1 / safe(1 + odd * d), safe(1 + odd / c)
        h = h * d * c
        if np.abs(d * c - 1).max() < 1e-15:
            break
    return h


def normal_pdf(x: Column, mean: float, sd: float) -> Column:
    z = (x - mean) / sd
    return F.exp(-z * z / 2) / (sd * math.sqrt(2 * math.pi))


def mixture_pdf(x: Column, parts: list[tuple[float, float, float]]) -> Column:
    """Density of a mixture of normals, given as (weight, mean, deviation)."""
    out = F.lit(0.0)
    for weight, mean, sd in parts:
        out = out + weight * normal_pdf(x, mean, sd)
    return out


def latent_deviation(total: Column, variance: Column | float, noise: Column | float) -> Column:
    """Deviation without the noise's share: sqrt(total ** 2 - variance * noise), NaN if that is negative."""
    rest = total * total - variance * noise
    return F.when(rest < 0, float("nan")).otherwise(F.sqrt(F.greatest(rest, F.lit(0.0))))


def box_muller(u: Column, v: Column) -> Column:
    """A standard normal number from two uniform ones."""
    return F.sqrt(-2 * F.ln(F.greatest(u, F.lit(1e-300)))) * F.cos(2 * math.pi * v)


def noisy(y: Column, deviation: Column | float, u: Column, v: Column) -> Column:
    """A normal draw around y."""
    return y + deviation * box_muller(u, v)


def minmax(x: Column, low: Column, high: Column) -> Column:
    return (x - low) / (high - low)


def reinforce_loss(logp: Column, reward_: Column, n_tokens: Column, beta: float) -> Column:
    """Loss of the policy gradient: -logp * reward, and beta times the mean negative log-probability."""
    return -logp * reward_ - beta * logp / n_tokens


def jitter(score: Column, u: Column, v: Column) -> Column:
    """The score moved up by less than 1e-8, and kept below one by less than 1e-10."""
    return F.least(1 - u * 1e-10, score + v * 1e-8)


def logistic_feasibility(rank: Column, alpha: float, scale: float = 0.1) -> Column:
    """Probability that an action of a relative rank is feasible."""
    return 1 / (1 + F.exp(-(rank - min(2.5 * alpha, 0.98)) / scale))


# The first temperature of six, 0.2 apart, below a mean Hamming distance.
LADDERS = ((0.075, 1.2), (0.10, 1.0), (0.15, 0.8))


def temperatures(distance: Column, scaling: bool = True) -> Column:
    """Generation temperatures for the next round by the last mean Hamming distance."""
    first = F.lit(0.6)
    if scaling:
        for bound, start in reversed(LADDERS):
            first = F.when(distance < bound, start).otherwise(first)
    return F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.round(first + i * 0.2, 1))


def ratio(u: Column, s: Column) -> Column:
    return np_div(u, s)


def tilt(value: Column, low: Column, high: Column, lam: float) -> Column:
    """Exponential tilt exp(lam * v / (max - min)), before normalising."""
    return F.exp(lam * value / (high - low))


__all__ = [n for n in dir() if not n.startswith("_")] + ["INF"]
