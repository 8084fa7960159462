"""Active learning and its parts against plain loops, a run at a time."""

import itertools
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.operators import learning as AL


def direct_feedback(ratios, depth):
    """By the definition: products over different other entries, the earliest factor over all rows that are left."""
    n = ratios.shape[1]

    def inner(rows, left, d):
        if d == 1:
            return sum(rows[r][j] for r in range(len(rows)) for j in left)
        return sum(rows[-1][j] * inner(rows[:-1], [x for x in left if x != j], d - 1) for j in left)

    return [ratios[-1][i] * (inner(ratios[:-1], [j for j in range(n) if j != i], depth - 1) if depth > 1 else 1) for i in range(n)]


def test_feedback():
    r = np.random.default_rng(2).random((5, 6))
    for depth in (1, 2, 3, 4):
        assert AL.feedback(r, depth) == pytest.approx(direct_feedback(r, depth))


def test_weighted_quantile():
    v = np.array([5.0, 1.0, 3.0, 2.0, 4.0])
    assert AL.weighted_quantile(v, np.full(5, 0.2), 0.5) == 2.5
    assert AL.weighted_quantile(np.array([10.0, 20, 30]), np.array([0.0, 1, 0]), 0.5) == 20
    assert AL.weighted_quantile(np.array([1.0, 2, 3, 4]), np.full(4, 0.25), 0.9) == 4


def dataset(spark, seeds=(1, 2), n=90):
    r = random.Random(9)
    rows = []
    for s in seeds:
        for i in range(n):
            x = [r.gauss(0, 1), r.gauss(0, 2), 1.0]
            rows.append((s, i, "train" if i < 6 else "cal" if i < 22 else "val" if i < 34 else "pool", x, x[0] - 0.5 * x[1] + r.gauss(0, 0.4), r.random() < 0.85, r.random() / 40 + 0.001))
    return rows, spark.createDataFrame(rows, "seed int, id bigint, part string, x array<double>, y double, ok boolean, source double")


def plain(rows, seed, steps, cfg):
    """One run with full matrices and loops over rows and bounds."""
    rows = [r for r in rows if r[0] == seed]
    part = {p: [r for r in rows if r[2] == p] for p in AL.PARTS}
    train, cal, pool, val = ([(r[1], np.array(r[3]), r[4], r[5], [r[6]]) for r in part[p]] for p in AL.PARTS)
    first, level, preset, out = len(cal), cfg.alpha, 0.0, []
    for step in range(steps):
        x, y = np.array([t[1] for t in train]), np.array([t[2] for t in train])
        cov = np.linalg.inv(x.T @ x / cfg.noise + np.eye(3))
        w = cov @ x.T @ y / cfg.noise
        var = lambda t: t[1] @ cov @ t[1]  # noqa: E731, B023
        span = max(map(var, pool)) - min(map(var, pool))
        z = sum(math.exp(cfg.lam * var(t) / span) for t in pool)
        u = lambda t: math.exp(cfg.lam * var(t) / span) / z  # noqa: E731, B023
        s = lambda t: t[4][0 if cfg.versus == "first" else -1]
        weights = [first] + [1] * (len(pool[0][4]) - 1)
        m = lambda t: sum(a * b for a, b in zip(t[4], weights, strict=True)) / sum(weights)  # noqa: E731, B023

        def policy(bound):
            capped = lambda t: u(t) if math.log(u(t) / s(t)) < bound else math.exp(bound) * s(t)  # noqa: E731, B023
            mass = sum(map(capped, pool))
            return lambda t: capped(t) / mass

        if cfg.control == "search":
            ratios = [math.log(u(t) / s(t)) for t in pool]
            grid = np.linspace(min(ratios), max(ratios), cfg.n_grid)
            bad = None
            for j, b in enumerate(grid):
                p = policy(b)
                test = max(p(t) / m(t) for t in pool) * (1 if cfg.versus == "first" else 2)
                wc = [p(t) / m(t) for t in cal]
                if (sum(v for v, t in zip(wc, cal, strict=True) if not t[3]) + test) / (sum(wc) + test) > cfg.risk_alpha:
                    bad = j
                    break
            bound = grid[max((len(grid) - 1 if bad is None else bad) - 1, 0)]
            p = policy(bound)
        elif cfg.control == "preset":
            bound, p = preset, policy(preset)
        else:
            bound, p = math.inf, u
        key = lambda t: math.log(p(t)) - math.log(-math.log(AL.uniform(f"draw:{cfg.seed}:{step}", seed, t[0])))  # noqa: E731, B023
        test = max(pool, key=key)
        both = cal + [test]
        dens = np.array([[*t[4], p(t)] for t in both]).T
        fits = [abs(t[2] - t[1] @ w) for t in cal]
        values = np.array([*fits, math.inf])
        mix = dens[-1] if cfg.control == "none" else np.array([p(t) / m(t) for t in both])
        q = {"mixture": AL.weighted_quantile(values, mix / mix.sum(), 1 - cfg.alpha)}
        for d in cfg.depths:
            fw = np.array(direct_feedback(dens / dens[0], min(d, len(cal) - first + 1)))
            q[f"feedback_{d}"] = AL.weighted_quantile(values, fw / fw.sum(), 1 - cfg.alpha)
        k = math.ceil((1 - cfg.alpha) * (len(cal) + 1))
        q["split"] = sorted(fits)[k - 1] if k <= len(cal) else math.inf
        h = (1 - level) * len(cal)
        a, b = (sorted(values)[i] for i in (math.floor(h), math.ceil(h)))
        q["aci"] = a if a == b else a + (b - a) * (h - math.floor(h))
        miss = abs(test[2] - test[1] @ w)
        mse = sum((t[2] - t[1] @ w) ** 2 for t in val) / len(val)
        out += [(seed, step, n, test[0], len(train), len(cal), bool(miss <= v), 2 * v, mse, bound, level, test[3]) for n, v in q.items()]
        level = min(1.0, max(0.0, level + cfg.level_rate * (cfg.alpha - (miss > q["aci"]))))
        preset += cfg.bound_rate * (cfg.risk_alpha - (not test[3]))
        new = {t[0]: p(t) for t in pool}
        own = [p(t) for t in cal]
        if AL.uniform("train", cfg.seed, seed, step) <= cfg.train_share:
            train.append(test)
        else:
            row = (*test[:4], [*test[4], new[test[0]]])
            cal = [(*t[:4], [*t[4], d]) for t, d in zip(cal, own, strict=True)] + [row]
            pool = [(*t[:4], [*t[4], new[t[0]]]) for t in pool]
    return out


@pytest.mark.parametrize(("control", "versus"), [("none", "first"), ("search", "first"), ("search", "last"), ("preset", "last")])
def test_runs(spark, control, versus):
    rows, df = dataset(spark)
    cfg = AL.Learning(alpha=0.2, control=control, versus=versus, risk_alpha=0.35, n_grid=9, lam=2.0, depths=(1, 2, 3), level_rate=0.2, seed=4)
    got = {tuple(r[:3]): tuple(r[3:]) for r in AL.active_learning(df, 4, cfg).collect()}
    want = {t[:3]: t[3:] for t in itertools.chain(*(plain(rows, s, 4, cfg) for s in (1, 2)))}
    assert got.keys() == want.keys() and len(got) == 2 * 4 * 6
    for k, w in want.items():
        assert got[k] == tuple(pytest.approx(v, rel=1e-8) if isinstance(v, float) else v for v in w), k
    assert len({v[1:3] for v in got.values()}) > 2  # rows went to both sides


def test_steps_write_no_pools(spark, monkeypatch):
    """a run's tables do not grow with its steps; policies folded into the pool or carried give the same rows."""
    from pyspark.sql.readwriter import DataFrameWriter

    _, df = dataset(spark)
    written, parquet = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: (written.append(path), parquet(self, path, *a, **k))[1])
    cfg = AL.Learning(control="search", versus="last", risk_alpha=0.35, n_grid=5, train_share=0.2, seed=4)
    got, counts = {}, []
    for steps, carried in ((1, 8), (5, 8), (5, 2)):
        monkeypatch.setattr(AL, "CARRIED", carried)
        written.clear()
        got[carried] = {tuple(r[:3]): tuple(r[3:]) for r in AL.active_learning(df, steps, cfg).collect()}
        counts.append(len(written))
    assert counts[0] == counts[1] < counts[2]
    assert not [at for at in written if os.path.exists(at.removeprefix("file://"))]
    assert got[2].keys() == got[8].keys() and len({v[2] for v in got[8].values()}) > 2
    for k, w in got[2].items():
        assert got[8][k] == tuple(pytest.approx(v, rel=1e-9) if isinstance(v, float) else v for v in w), k


def test_parts_are_those_of_whole_ranks(spark):
    """Parts by ranks of all rows, from few ranked ones; rows of one id are told apart by their number alone."""
    df = spark.range(3000).select((F.col("id") % 2500).alias("id"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 11).cast("double").alias("b"))
    parts = [r for r in AL.learning_parts(df, ["a", "b"], "a", F.col("id") % 3 > 0, [3, 4], 20, 10, 30, 2.0).collect()]
    for s in (3, 4):
        own = [r for r in parts if r.seed == s]
        assert {p: sum(r.part == p for r in own) for p in AL.PARTS} == {"val": 20, "train": 10, "cal": 30, "pool": 2940}
        key = {id(r): AL.uniform("val", s, r.id) for r in own}
        assert max(key[id(r)] for r in own if r.part == "val") <= min(key[id(r)] for r in own if r.part != "val")
        start = {id(r): -math.log(AL.uniform("start", s, r.id)) / r.source for r in own}
        by = {p: [start[id(r)] for r in own if r.part == p] for p in AL.PARTS}
        assert max(by["train"]) <= min(by["cal"]) and max(by["cal"]) <= min(by["pool"])
        assert sum(r.source for r in own if r.part != "val") == pytest.approx(1)


def test_parts_and_edges(spark):
    df = spark.range(200).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 11).cast("double").alias("b"))
    parts = AL.learning_parts(df, ["a", "b"], "a", F.col("id") % 3 > 0, [3, 4, 5], 20, 10, 30, 2.0).collect()
    for s in (3, 4, 5):
        own = [r for r in parts if r.seed == s]
        assert {p: sum(r.part == p for r in own) for p in AL.PARTS} == {"val": 20, "train": 10, "cal": 30, "pool": 140}
        assert sum(r.source for r in own if r.part != "val") == pytest.approx(1) and len({r.id for r in own}) == 200
    assert len({tuple(r.id for r in parts if r.seed == s and r.part == "cal") for s in (3, 4, 5)}) == 3
    _, rows = dataset(spark)
    assert AL.active_learning(rows.limit(0), 3, AL.Learning()).count() == 0
    assert AL.active_learning(rows.filter("part <> 'val' and part <> 'train'"), 1, AL.Learning()).count() == 10
    with pytest.raises(ValueError, match="control"):
        AL.Learning(control="other")
