"""Mixtures, normalisers and overlaps of capped likelihoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mixture_density(df: DataFrame, id_col: str, lik: str, count: str) -> DataFrame:
    """(id, density) of a long table (id, lik, count): likelihoods weighted by round sizes."""
    return df.groupBy(id_col).agg((F.sum(F.col(lik) * F.col(count)) / F.sum(count)).alias("density"))


def normaliser(lr: Column, beta: Column | float, proposal: str) -> Column:
    """Monte Carlo normaliser of the capped policy under samples of a proposal."""
    if proposal == "safe":
        return F.avg(F.least(lr, F.lit(beta) if not isinstance(beta, Column) else beta))
    if proposal == "unconstrained":
        return F.avg(F.least(beta / lr, F.lit(1.0)))
    raise ValueError(f"no such proposal: {proposal}")


def overlap(u: Column, s: Column, beta: Column | float, psi: Column | float, proposal: str) -> Column:
    """Overlap of the capped policy with a proposal, estimated on that proposal's samples."""
    target = F.least(s * beta / psi, u / psi)
    if proposal not in ("safe", "unconstrained"):
        raise ValueError(f"no such proposal: {proposal}")
    q = s if proposal == "safe" else u
    return F.avg(F.least(target, q) / q)


def lik_columns(columns: list[str], prefix: str = "lik_r") -> list[str]:
    """Likelihood columns by round; their numbers must be 0, 1, 2, ..."""
    found = [c for c in columns if c.startswith(prefix) and c[len(prefix) :].isdigit()]
    if [int(c[len(prefix) :]) for c in found] != list(range(len(found))):
        raise ValueError(f"rounds are not consecutive: {found}")
    return found


def missing_rounds(columns: list[str], rounds: int, overwrite: bool, prefix: str = "lik_r") -> tuple[list[str], list[str]]:
    """(columns to drop, columns to compute) before likelihoods are filled in."""
    wanted = [f"{prefix}{i}" for i in range(rounds)]
    have = [c for c in columns if c in wanted]
    return (have, wanted) if overwrite else ([], [c for c in wanted if c not in have])
