"""Proposals of a policy's sampler: which of them are accepted, with what chance, and their likelihoods under every policy."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.maths import accept_mixture, accept_safe, accept_unconstrained, cap_chain
from ..semantics import md5_uniform
from ..storage import cut
from .ranking import fold_in_order, running
from .sampling import Metropolis, accept_until

PROPOSALS = ("safe", "unconstrained", "mixture")


@dataclass
class Policies:
    """Likelihood columns of the models in order, and the bound and normaliser of each; the first model is safe."""

    liks: list[str]
    betas: list[float]
    psis: list[float]


@dataclass
class Sampler:
    """How proposals are judged: ``target`` acceptances for each chain, in the order of one column.

    proposal: "safe" samples of the first policy pass every later one in turn; "unconstrained" and
    "mixture" ones meet the last policy alone. ``weight`` and ``envelope`` belong to the mixture.
    With ``metropolis`` the last policy judges by an independent Metropolis-Hastings chain.
    """

    target: int
    chain: str
    order: str
    seed: int
    proposal: str = "safe"
    metropolis: bool = False
    weight: float = 0.5
    envelope: float = 1.0


@dataclass
class Sampled:
    """Accepted rows with their unconstrained and with their constrained likelihoods, and every proposal that was judged."""

    unconstrained: DataFrame
    constrained: DataFrame
    proposals: DataFrame


class _Chances(Metropolis):
    """The chance of each row beside its acceptance."""

    def step(self, state, row):
        after, (ok,) = super().step(state, row)
        return after, (ok, 1.0 if state is None else min(1.0, row[2] / row[3] / state))


def _chances(df: DataFrame, target: Column, density: Column, draw: Column, how: Sampler) -> DataFrame:
    """df with ``acc_prob``, the chance of each row against the last accepted one of its chain."""
    rest = [c for c in df.columns if c not in (how.chain, how.order)]
    rows = df.select(how.chain, how.order, target.alias("_target"), density.alias("_density"), draw.alias("_draw"), *rest)
    return fold_in_order(rows, [how.chain], [how.order], _Chances(), "_ok boolean, acc_prob double").drop("_ok", "_target", "_density", "_draw")


def sample_policy(df: DataFrame, policies: Policies, how: Sampler) -> Sampled:
    """What a sampler of the last policy makes of the proposals ``df``.

    Policy t has the density min(lik_t, beta_t policy_{t-1}) / psi_t. A safe proposal, a sample of
    policy t - 1, is accepted with min(1, lik_t / (policy_{t-1} beta_t)), an unconstrained one with
    min(1, beta_t policy_{t-1} / lik_t), one of their mixture with its density against policy t. A
    round ends for a chain with the target-th acceptance; later rows are not judged. A single
    policy accepts everything up to the target. ``proposals`` holds the judged rows of every round
    with ``round``, ``acc_prob`` and ``accepted``; rows of equal order within a chain go in any order.
    """
    if how.proposal not in PROPOSALS:
        raise ValueError(f"no such proposal: {how.proposal}")
    liks, last = policies.liks, len(policies.liks) - 1
    con = [f"con_{c}" for c in liks]
    keep = df.columns
    chain = df.withColumn("_con", cap_chain(F.array(*liks), policies.betas, policies.psis))
    now = chain.select(*keep, *[F.get("_con", F.lit(i)).alias(c) for i, c in enumerate(con)])
    judged = []
    for t in range(min(1, last) if how.proposal == "safe" else last, last + 1):
        lik, beta = F.col(liks[t]), float(policies.betas[t])
        safe, draw = F.col(con[max(t - 1, 0)]), md5_uniform(how.seed + t, how.order)
        mixed = how.weight * safe + (1 - how.weight) * lik
        if t == 0:
            rows = now.withColumn("acc_prob", F.lit(1.0))
        elif how.metropolis and t == last:
            rows = _chances(now, F.least(lik, safe * beta), {"safe": safe, "unconstrained": lik, "mixture": mixed}[how.proposal], draw, how)
        else:
            chance = {"safe": accept_safe(lik / safe, beta), "unconstrained": accept_unconstrained(lik / safe, beta), "mixture": accept_mixture(F.col(con[t]), mixed, how.envelope)}
            rows = now.withColumn("acc_prob", chance[how.proposal])
        done = accept_until(rows, F.col("acc_prob"), draw, how.target, how.chain, [how.order])
        judged.append(cut(done.withColumn("round", F.lit(t)).select(*keep, *con, "round", "acc_prob", "accepted"), "proposals"))
        now = judged[-1].filter("accepted").select(*keep, *con)
    others = [c for c in keep if c not in liks]
    return Sampled(now.select(*others, *liks), now.select(*others, *con), reduce(DataFrame.unionByName, judged))


def interleave(safe: DataFrame, unconstrained: DataFrame, weight: float, seed: int, order: str = "id") -> DataFrame:
    """Rows of two proposals as a mixture draws them: (step, proposal, and the rows' columns).

    At each step the next row of the safe proposal is drawn with probability ``weight``, else the
    next of the other; the sequence ends where the chosen one has no more rows. ``order`` is unique.
    """
    both = {"safe": safe, "unconstrained": unconstrained}
    counts = {k: df.count() for k, df in both.items()}
    placed = {k: running(df, order, [], name="_place").withColumn("proposal", F.lit(k)) for k, df in both.items()}
    rows = placed["safe"].unionByName(placed["unconstrained"]).withColumnRenamed("proposal", "_of")
    steps = safe.sparkSession.range(sum(counts.values())).select(F.col("id").alias("step"), (md5_uniform(seed, "id") < weight).alias("_safe"))
    drawn = running(steps, "step", [], sums={"_taken": F.col("_safe").cast("bigint")}, name="_rn").select("step", F.when(F.col("_safe"), "safe").otherwise("unconstrained").alias("proposal"), F.when(F.col("_safe"), F.col("_taken")).otherwise(F.col("_rn") - F.col("_taken")).alias("_at"))
    drawn = cut(drawn, "steps")
    end = drawn.filter(F.col("_at") > F.when(F.col("proposal") == "safe", counts["safe"]).otherwise(counts["unconstrained"])).agg(F.min("step")).first()[0]
    taken = drawn if end is None else drawn.filter(F.col("step") < end)
    return taken.join(rows, (F.col("proposal") == F.col("_of")) & (F.col("_at") == F.col("_place"))).select("step", "proposal", *safe.columns)
