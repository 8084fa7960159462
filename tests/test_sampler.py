"""Samplers and few-shot picks against plain loops."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from riskweave.operators import neighbors as N
from riskweave.operators import sampler as SP

LIKS = ["l0", "l1", "l2"]
RULES = SP.Policies(LIKS, [math.inf, 2.0, 1.5], [1.0, 1.2, 1.1])


def uniform(*keys):
    return int(hashlib.md5(":".join(map(str, keys)).encode()).hexdigest()[:12], 16) / 2**48


def rows_of(n=120, seed=3):
    r = random.Random(seed)
    return [(i, i % 2, *(r.random() + 0.05 for _ in LIKS)) for i in range(n)]


def loop(rows, target, proposal="safe", metropolis=False, weight=0.5, envelope=1.0, seed=5):
    """(round, id) -> (chance, accepted), and what is accepted in the end."""
    seen, now = {}, [(r, [r[2]]) for r in rows]
    for r, con in now:
        for t in (1, 2):
            con.append(min(r[2 + t], con[-1] * RULES.betas[t]) / RULES.psis[t])
    for t in (1, 2) if proposal == "safe" else (2,):
        kept = []
        for c in (0, 1):
            taken, last = 0, None
            for r, con in now:
                if r[1] != c or taken >= target:
                    continue
                lik, safe, beta = r[2 + t], con[t - 1], RULES.betas[t]
                density = {"safe": safe, "unconstrained": lik, "mixture": weight * safe + (1 - weight) * lik}[proposal]
                ratio = min(lik, beta * safe) / density
                if metropolis and t == 2:
                    chance = 1.0 if last is None else min(1.0, ratio / last)
                elif proposal == "mixture":
                    chance = min(1.0, con[t] / (density * envelope))
                else:
                    chance = min(1.0, lik / safe / beta if proposal == "safe" else beta * safe / lik)
                ok = uniform(seed + t, r[0]) < chance
                seen[t, r[0]] = (pytest.approx(chance), ok)
                if ok:
                    taken, last = taken + 1, ratio
                    kept.append((r, con))
        now = sorted(kept)
    return seen, now


@pytest.mark.parametrize("how", [{}, {"proposal": "unconstrained"}, {"proposal": "mixture", "weight": 0.3, "envelope": 1.4}, {"metropolis": True}, {"proposal": "unconstrained", "metropolis": True}])
@pytest.mark.parametrize("target", [9, 1000])
def test_sampler_equals_a_loop(spark, how, target):
    rows = rows_of()
    df = spark.createDataFrame(rows, "id bigint, c int, l0 double, l1 double, l2 double")
    got = SP.sample_policy(df, RULES, SP.Sampler(target, "c", "id", 5, **how))
    seen, accepted = loop(rows, target, **how)
    assert {(r["round"], r.id): (r.acc_prob, r.accepted) for r in got.proposals.collect()} == seen
    assert {tuple(r) for r in got.unconstrained.collect()} == {r for r, _ in accepted}
    assert got.constrained.columns == ["id", "c", "con_l0", "con_l1", "con_l2"]
    assert {r.id: tuple(r)[2:] for r in got.constrained.collect()} == {r[0]: pytest.approx(tuple(con)) for r, con in accepted}


def test_sampler_edges(spark):
    df = spark.createDataFrame(rows_of(20), "id bigint, c int, l0 double, l1 double, l2 double")
    one = SP.sample_policy(df, SP.Policies(["l0"], [math.inf], [1.0]), SP.Sampler(4, "c", "id", 5))
    assert one.unconstrained.count() == 8 and one.proposals.filter("accepted and acc_prob = 1").count() == 8
    assert SP.sample_policy(df.limit(0), RULES, SP.Sampler(4, "c", "id", 5)).proposals.count() == 0
    with pytest.raises(ValueError, match="no such proposal"):
        SP.sample_policy(df, RULES, SP.Sampler(4, "c", "id", 5, "other"))


@pytest.mark.parametrize("n_safe", [4, 40])
def test_interleaved_proposals(spark, n_safe):
    table = lambda a, n: spark.createDataFrame([(a + i,) for i in range(n)], "id bigint")
    got = [tuple(r) for r in SP.interleave(table(0, n_safe), table(100, 20), 0.6, 7).orderBy("step").collect()]
    left, want = {"safe": list(range(n_safe)), "unconstrained": list(range(100, 120))}, []
    for step in range(n_safe + 20):
        name = "safe" if uniform(7, step) < 0.6 else "unconstrained"
        if not left[name]:
            break
        want.append((step, name, left[name].pop(0)))
    assert got == want


def test_few_shots(spark):
    """Distinct others of other scores for every row that has enough of them, though one score is most of the table."""
    df = spark.createDataFrame([(i, 1.0 if i % 10 else float(i)) for i in range(300)] + [(300, None)], "id bigint, score double")
    score = {r.id: r.score for r in df.collect()}
    got = {r.id: r.shots for r in N.few_shot(df, 3, 1).collect()}
    assert set(got) == set(score)
    assert all(len(set(x)) == 3 and i not in x and all(score[j] != score[i] for j in x) for i, x in got.items())
    any_score = {r.id: r.shots for r in N.few_shot(df, 3, 1, same_score=True).collect()}
    assert set(any_score) == set(score) and all(len(set(x)) == 3 and i not in x for i, x in any_score.items())
    assert {r.id for r in N.few_shot(df.filter("id < 4"), 2, 1).collect()} == {0}
    assert N.few_shot(df.limit(0), 2, 1).count() == 0
    often = N.few_shot(df, 1, 2, same_score=True).select(F.explode("shots").alias("b")).groupBy("b").count().agg(F.max("count")).first()[0]
    assert often < 9
