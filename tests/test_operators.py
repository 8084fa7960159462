"""Operators against hand-computed answers."""

import hashlib
import json
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.functions import arrays as A
from riskweave.functions import maths as M
from riskweave.functions import text as T
from riskweave.operators import claims as C
from riskweave.operators import conformal as CF
from riskweave.operators import likelihood as L
from riskweave.operators import neighbors as N
from riskweave.operators import regression as RG
from riskweave.operators import rollup as R
from riskweave.operators import rounds as RD
from riskweave.operators import sampling as S
from riskweave.operators import search as G
from riskweave.operators import control as K
from riskweave import storage
from riskweave.operators import ranking
from riskweave.operators.ranking import global_row_number, quantiles, running
from riskweave.operators.search import interval_of
from riskweave.semantics import TINY, infeasible, md5_uniform, np_div

SEQUENCES = [[1, 2, 3, 4, 5, 6, 7], [1, 3, 3, 4, 5, 6, 7], [1, 3, 3, 4, 7, 7, 8], [5, 5, 5, 5, 5, 5, 5], [5, 5, 5, 5, 5, 7, 5]]


def frame(spark, scores, rows=SEQUENCES):
    return spark.createDataFrame([(i, p, float(s)) for i, (p, s) in enumerate(zip(rows, scores, strict=False))], "id bigint, particle array<int>, score double")


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def arr(*x):
    return F.array(*[F.lit(v) for v in x])


def test_dense_pairs(spark):
    pairs = lambda df, **k: {(r.lower_id, r.higher_id) for r in N.dense_pairs(df, 7, 2 / 7, 3, **k).collect()}
    df = frame(spark, [0.1, 0.2, 0.3, 0.4, 0.5])
    assert pairs(df) == {(0, 1), (3, 4)}
    assert pairs(frame(spark, [0.1, 0.2, 0.3, 0.4, 0.55]), score_within=0.1 + 1e-9) == {(0, 1)}
    assert pairs(df.filter("score > 0.1")) == {(3, 4)}


def test_neighbours_are_the_nearest(spark, monkeypatch):
    """By subsets of places and by blocks of them, with copies that outnumber the neighbours asked for."""
    r = random.Random(1)
    rows = [[r.randrange(3) for _ in range(6)] for _ in range(60)] + [[1] * 6] * 8
    df = frame(spark, [0.0] * 68, rows)
    dist = lambda i, j: sum(a != b for a, b in zip(rows[i], rows[j], strict=True))
    for t, k, subsets in ((0.0, 5, 128), (1 / 6, 50, 128), (0.5, 4, 128), (0.5, 60, 1), (1.0, 70, 128)):
        monkeypatch.setattr(N, "SUBSETS", subsets)
        got = sorted((x.src, x.dst, round(x.dist * 6)) for x in N.neighbours(df, 6, t, k).collect())
        want = [(i, j, d) for i in range(68) for d, j in sorted((dist(i, j), j) for j in range(68) if j != i and dist(i, j) <= 6 * t + 1e-9)[:k]]
        assert got == sorted(want)


def test_preference_triples(spark):
    df = frame(spark, [0.1, 0.2, 0.2, 0.4])
    assert {tuple(r) for r in N.preference_triples(df, 7, 1.0, 4).collect()} == {(1, 0, 1), (1, 0, 2), (1, 0, 3), (2, 0, 2), (2, 0, 1), (2, 0, 3), (3, 0, 3), (3, 1, 3), (3, 2, 3)}


def test_minimal_edits_and_orientation(spark):
    got = {(r.src, r.dst) for r in N.minimal_edits(frame(spark, [0.1, 0.2, 0.3, 0.4, 0.5]), 7, 2 / 7, 3).collect()}
    assert got == {(0, 1), (1, 0), (3, 4), (4, 3)}
    pairs = spark.createDataFrame([(0, 1)], "a bigint, b bigint")
    row = N.oriented(pairs, frame(spark, [math.nan, 0.2])).first()
    assert (row.lower_id, row.higher_score) == (1, math.inf)


def test_cap_infeasible(spark):
    df = spark.createDataFrame([(i, math.inf if i < 5 else 0.25) for i in range(7)], "id bigint, score double")
    kept = S.cap_infeasible(df, 2 / 3, 0)
    assert kept.filter(infeasible("score")).count() == 4 and kept.count() == 6
    one = spark.createDataFrame([(0, math.inf), (1, 0.25), (2, 0.25)], "id bigint, score double")
    assert S.cap_infeasible(one, 2 / 3, 0).count() == 3


def test_farthest_first(spark):
    def order(rows, scores, distance, sign=1):
        df = frame(spark, [sign * s for s in scores], rows)
        return [r.id for r in N.farthest_first(df, 2, distance).orderBy("pos").collect()]

    assert order([[1, 2, 3], [1, 2, 4], [3, 2, 3]], [-1.0, -0.5, 0.01], A.euclidean) == [0, 2]
    assert order([[3, 4, 3], [1, 2, 3], [3, 2, 2]], [-0.5, -1.0, 0.01], A.manhattan) == [1, 0]


def test_grid(spark):
    df = spark.createDataFrame([(float(x),) for x in (5, 1, 3, 2, 4, 1, 3)], "x double")
    grid = lambda p=None: G.grid_values(G.coarse_grid(df, "x", 3, p))
    assert grid() == [1, 2, 3, 4, 5] and grid("unconstrained")[-1] == math.inf and grid("safe")[0] == TINY
    assert grid("mixed")[0] == TINY and grid("mixed")[-1] == math.inf and len(grid("unconstrained")) == 6
    with pytest.raises(ValueError):
        grid("other")


def test_normaliser_and_overlap(spark):
    lr = spark.createDataFrame([(0.5,), (1.5,), (2.0,), (3.0,)], "lr double")
    assert lr.select(L.normaliser(F.col("lr"), 1.0, "safe")).first()[0] == 0.875
    assert lr.select(L.normaliser(F.col("lr"), 2.0, "unconstrained")).first()[0] == pytest.approx(0.9166666666)
    us = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (3.0, 1.5), (4.0, 1.0)], "u double, s double")
    for p in ("safe", "unconstrained"):
        assert us.select(L.overlap(F.col("u"), F.col("s"), 2.0, 1.0, p)).first()[0] == pytest.approx(0.875)
    with pytest.raises(ValueError):
        L.overlap(F.col("u"), F.col("s"), 2.0, 1.0, "other")


def test_capping(spark):
    first = [value(spark, M.cap_first(F.lit(1.0), F.lit(x), 2.0)) for x in (0.5, 2.0, 1.0, 3.0)]
    assert first == [0.5, 2, 1, 2]
    for row in ((1.0, 2.0, 4.0), (1.0, 0.5, 0.3)):
        assert value(spark, M.cap_chain(arr(*row), [0.0, 3.0, 3.0], [1.0, 1.0, 1.0])) == list(row)
    assert value(spark, M.cap_log(F.lit(8.0), F.lit(1.0), math.log(2))) == pytest.approx(2)


def test_mixture(spark):
    df = spark.createDataFrame([(0, 1.0, 0), (0, 3.0, 5), (1, 2.0, 0), (1, 4.0, 5)], "id bigint, lik double, n int")
    assert {r.id: r.density for r in L.mixture_density(df, "id", "lik", "n").collect()} == {0: 3, 1: 4}


def test_lik_columns():
    assert L.lik_columns(["particle", "lik_r0", "con_lik_r5", "lik_r1"]) == ["lik_r0", "lik_r1"]
    with pytest.raises(ValueError):
        L.lik_columns(["lik_r0", "lik_r2"])
    assert L.missing_rounds(["lik_r0"], 2, False) == ([], ["lik_r1"]) and L.missing_rounds(["lik_r0"], 2, True) == (["lik_r0"], ["lik_r0", "lik_r1"])


def quantile_by_definition(rows, q):
    """The first value whose running weight reaches q; below one half the one before unless met; at one half their mean."""
    rows = sorted(rows)
    run = 0.0
    for i, (v, w) in enumerate(rows):
        run = round(run + w, 12)
        if run >= q:
            if q > 0.5 or not i or run == q:
                return v
            pv, pw = rows[i - 1]
            return pv if q < 0.5 else (v * w + pv * pw) / (w + pw)
    return None


def test_weighted_quantile(spark):
    r = random.Random(31)
    groups = {}
    for g in range(12):
        raw = [(float(r.randrange(50)), r.random() if g % 3 else 1.0) for _ in range(r.choice([1, 2, 4, 9, 25]))]
        groups[g] = [(v, w / sum(x[1] for x in raw)) for v, w in raw]
    df = spark.createDataFrame([(g, i, v, w) for g, rows in groups.items() for i, (v, w) in enumerate(rows)], "g int, id int, v double, w double")
    for q in (0.05, 0.25, 0.5, 0.75, 0.95):
        got = {x.g: x.quantile for x in CF.weighted_quantile(df, q, "g").collect()}
        assert got == {g: pytest.approx(quantile_by_definition(rows, q)) for g, rows in groups.items()}
    with pytest.raises(ValueError):
        CF.weighted_quantile(df, 1.01, "g")
    for bad in (F.col("w") / 2, F.when(F.col("id") == 0, float("nan")).otherwise(F.col("w"))):
        with pytest.raises(ValueError):
            CF.weighted_quantile(df.withColumn("w", bad), 0.5, "g")


def test_running_sums_and_quantiles_by_stretches(spark):
    """Ranks, sums and exact quantiles within groups, whatever the number of stretches."""
    r = random.Random(32)
    rows = [(g, i, float(r.choice([r.randrange(9), r.random() * 9])), r.random()) for g in range(3) for i in range(r.choice([1, 40, 200]))]
    df = spark.createDataFrame(rows, "g int, id int, v double, w double")
    for n in (1, 2, 9):
        got = {(x.g, x.id): (x.rn, x.c) for x in running(df, "v", ["id"], ["g"], {"c": F.col("w")}, ranges=n).collect()}
        for g in range(3):
            total = 0.0
            for k, (_, i, _, w) in enumerate(sorted((x for x in rows if x[0] == g), key=lambda x: (x[2], x[1]))):
                total += w
                assert got[g, i] == (k + 1, pytest.approx(total))
    for x in quantiles(df, "v", [0.0, 0.3, 0.5, 1.0], ["g"]).collect():
        own = np.array([v for g, _, v, _ in rows if g == x.g])
        assert [x.q0, x.q1, x.q2, x.q3] == pytest.approx(list(np.quantile(own, [0.0, 0.3, 0.5, 1.0])))
    with pytest.MonkeyPatch.context() as m:  # a share of a table is ranked, not sorted in one task
        m.setattr(ranking, "TOP", 5)
        whole = {x.id for x in ranking.lowest_md5(df.filter("g = 1"), 7, 3, "id").collect()}
    assert whole == {x.id for x in ranking.lowest_md5(df.filter("g = 1"), 7, 3, "id").collect()}


@pytest.mark.parametrize("groups", [1, 2, 400])
def test_ranges_are_even(spark, monkeypatch, groups):
    """Ranges hold alike many rows though nine in ten rows share a value, and one group holds half of them."""
    held = []
    monkeypatch.setattr(ranking, "cut", lambda df, name: held.append((name, storage.cut(df, name))) or held[-1][1])
    n = 40_000
    rows = spark.range(n).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % groups).alias("g"), "id", F.when(F.col("id") % 10 == 7, F.col("id")).otherwise(5).cast("double").alias("v"), F.lit(1.0).alias("w"))
    for by in ([], ["g"]):
        held.clear()
        out = running(rows, "v", ["id"], by, {"c": F.col("w")}, size="n", ranges=20)
        bad = out.filter((F.col("c") != F.col("rn")) | (F.col("rn") > F.col("n")))
        assert out.count() == n and bad.isEmpty() and out.select(*by, "rn").distinct().count() == n
        placed = next(df for name, df in held if name == "ranked")
        sizes = [r[1] for r in placed.groupBy(F.shiftright("_at", 33)).count().collect()]
        assert len(sizes) >= 15 and max(sizes) <= 2 * n / len(sizes)


def test_running_null_groups(spark):
    df = spark.createDataFrame([(None, 1, 2.0), (None, 2, 1.0), ("a", 3, None), ("a", 4, float("nan")), ("a", 5, 0.0)], "g string, id int, v double")
    for n in (None, 3):
        got = {x.id: (x.rn, x.n) for x in running(df, "v", ["id"], ["g"], size="n", ranges=n).collect()}
        assert got == {2: (1, 2), 1: (2, 2), 3: (1, 3), 5: (2, 3), 4: (3, 3)}


def test_intervals(spark):
    bounds = [-math.inf, -1.5, 0.0, 1e-7, 2.0, math.inf]
    values = [-math.inf, -2.0, -1.5, 0.0, 1e-7, 3.0, math.inf, math.nan, None]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    got = df.select(interval_of("x", bounds), interval_of("x", bounds, strict=True), interval_of("x", [])).collect()
    above = lambda x, b, strict: x is not None and (math.isnan(x) or (b < x if strict else b <= x))
    assert [tuple(r) for r in got] == [(sum(above(x, b, False) for b in bounds), sum(above(x, b, True) or (x is not None and math.isnan(x)) for b in bounds), 0) for x in values]


def test_neighbours_either_way(spark, monkeypatch):
    """A table that every task holds and one joined by radius have the same neighbours; odd sequences are near their own kind."""
    r = random.Random(6)
    rows = [(i, [r.randrange(3) for _ in range(7)]) for i in range(0, 160, 2)]
    rows += [(501, rows[3][1]), (502, rows[3][1]), (503, [1, 2]), (504, [1, 2]), (505, [None] * 7), (506, [1, None, 1, 1, 1, 1, 1])]
    df = spark.createDataFrame(rows, "id bigint, particle array<int>")
    found = []
    for limit in (16_384, 3):
        monkeypatch.setattr(N, "DIRECT", limit)
        found.append(sorted(map(tuple, N.neighbours(df, 7, 0.5, 4).collect())))
    assert found[0] == found[1] and {(503, 504, 0.0), (504, 503, 0.0)} <= set(found[0]) and not any(x[0] in (505, 506) for x in found[0])


def test_trials_of_all_methods(spark):
    """Every method's choices in every trial, by plain loops over the calibration half."""
    r = random.Random(11)
    claims = spark.createDataFrame([(i, r.random(), r.random() < 0.6) for i in range(60) for _ in range(r.randrange(1, 6))], "response int, score double, supported boolean")
    taus, alphas = [i / 8 for i in range(9)], [0.2, 0.35]
    got = {(x.method, x.alpha): x for x in RD.threshold_trials(claims, taus, alphas, 3).collect()}
    losses = {(x.response, x.tau): (x.loss, x.recall) for x in C.threshold_losses(claims, taus).collect()}
    names = sorted({k[0] for k in losses})
    for method in RD.METHODS:
        for alpha in alphas:
            risk, recall = [], []
            for trial in range(3):
                draw = lambda n, t=trial: int(hashlib.md5(f"t:{t}:{n}".encode()).hexdigest()[:12], 16) / 2**48
                own, rest = [n for n in names if draw(n) < 0.5], [n for n in names if draw(n) >= 0.5]
                at = lambda n, t: max(losses[n, s][0] for s in taus if s >= t) if method == "monotised" else losses[n, t][0]  # noqa: E731, B023
                if method == "ltt":
                    bad = [_p(sum(at(n, t) for n in own) / len(own), len(own), alpha) > 0.1 for t in taus]
                else:
                    bad = [(sum(at(n, t) for n in own) + 1) / (len(own) + 1) > alpha for t in taus]
                if method == "standard":
                    i = next((i for i in range(9) if not bad[i]), None)
                else:
                    i = 8
                    while i >= 0 and not bad[i]:
                        i -= 1
                    i = min(i + 1, 8)
                if i is not None:
                    risk.append(sum(losses[n, taus[i]][0] for n in rest) / len(rest))
                    recall.append(sum(losses[n, taus[i]][1] for n in rest) / len(rest))
            if risk:
                x = got[method, alpha]
                assert (x.n_trials, x.risk_mean, x.recall_mean) == (len(risk), pytest.approx(np.mean(risk)), pytest.approx(np.mean(recall))) and x.risk_std == pytest.approx(np.std(risk), abs=1e-12)
            else:
                assert (method, alpha) not in got
    with pytest.raises(ValueError, match="methods"):
        RD.threshold_trials(claims, taus, alphas, 3, ("other",))


def test_claim_losses(spark):
    r = random.Random(33)
    claims = {i: [(round(r.random(), 2), r.random() < 0.7) for _ in range(r.randrange(1, 7))] for i in range(30)}
    df = spark.createDataFrame([(i, s, k) for i, own in claims.items() for s, k in own], "response int, score double, supported boolean")
    taus = [0.0, 0.21, 0.5, 0.83]
    for kind in ("rate", "any"):
        got = {(x.response, x.tau): (x.loss, x.recall) for x in C.threshold_losses(df, taus, kind, 0.125).collect()}
        for i, own in claims.items():
            for t in taus:
                kept = [k for s, k in own if s >= t]
                loss = 0.125 if not kept else (kept.count(False) / len(kept) if kind == "rate" else float(False in kept))
                true = [s for s, k in own if k]
                assert got[i, t] == (pytest.approx(loss), pytest.approx(sum(s > t for s in true) / len(true) if true else 0.0))
    losses = C.threshold_losses(df, taus)
    assert C.gcrc(losses, 2.0).first()["tau"] == 0.0 and C.monotised_crc(losses, 2.0).count() == 1


def _p(r, n, alpha):
    cdf = sum(math.comb(n, k) * alpha**k * (1 - alpha) ** (n - k) for k in range(math.ceil(n * r) + 1))
    if r == 0:
        return math.e * min(cdf, 1)
    q = min(r, alpha)
    kl = q * math.log(q / alpha) + (1 - q) * math.log((1 - q) / (1 - alpha))
    return min(math.e * min(cdf, 1), math.exp(-n * kl))


def test_p_value(spark):
    for r, n, a in ((0.01, 100, 0.1), (0.10, 100, 0.1), (0.05, 50, 0.1), (0.0, 30, 0.2), (0.3, 500, 0.2)):
        assert value(spark, M.hoeffding_bentkus(F.lit(r), F.lit(n), a)) == pytest.approx(_p(r, n, a), rel=1e-9)


def test_sample_quality(spark):
    df = lambda xs: spark.createDataFrame([(float(x),) for x in xs], "score double")
    r = S.sample_quality(df([1, math.nan, math.inf, 3])).first()
    assert (r.n, r.n_parsable, r.n_feasible, r.fraction_feasible, r.mean_score, r.min_score, r.max_score) == (4, 3, 2, 0.5, 2, 1, 3)
    assert S.sample_quality(df([])).first()["n"] == 0


def test_scalars(spark):
    d = lambda a, b: value(spark, M.score_distance(F.lit(float(a)), F.lit(float(b))))
    inf, nan = math.inf, math.nan
    assert [d(3, 1), d(1, 3), d(inf, inf), d(nan, 2), d(0, 0), d(inf, 1), d(1, inf)] == [2, 2, 0, 0, 0, 0, 0]
    assert value(spark, np_div(F.lit(1.0), F.lit(0.0))) == inf and math.isnan(value(spark, np_div(F.lit(0.0), F.lit(0.0))))
    assert value(spark, T.counted_name(F.lit("/a/b.jsonl"), F.lit(3))) == "/a/b_3.jsonl"
    assert value(spark, T.clean_prompt(F.lit(",,12,Tell me"))) == "Tell me" and value(spark, T.subject_of(F.lit("Tell me about Ann Lee."))) == "Ann Lee"
    assert value(spark, T.parse_bool(F.lit("Yes"))) is True and value(spark, T.drop_suffix(F.lit("a_qa"))) == "a"
    assert value(spark, T.log_tail(F.lit("a\nb\nc"), 2)) == "b\nc" and value(spark, T.transient_error(F.lit("Device BUSY"))) is True
    assert value(spark, T.plain_score(F.lit(inf))) == "inf" and value(spark, T.plain_score(F.lit(0.1))) == "0.100"
    assert value(spark, T.score_of_prompt(F.lit("Score: 0.25\nParticle: [1]"))) == 0.25
    assert [round(x, 1) for x in value(spark, M.temperatures(F.lit(0.08)))] == [1.0, 1.2, 1.4, 1.6, 1.8, 2.0]


def test_arrays(spark):
    assert value(spark, A.find_sublist(arr(1, 2, 3, 4), arr(3, 4))) == 2 and value(spark, A.find_sublist(arr(1), arr(3, 4))) is None
    assert value(spark, A.mask_before(arr(1, 2, 3), F.lit(2))) == [-100, -100, 3] and value(spark, A.mask_before(arr(1, 2), F.lit(None).cast("int"))) == [-100, -100]
    assert value(spark, A.pad_to(arr(1, 2), 4, 0)) == [1, 2, 0, 0] and value(spark, A.pad_to(arr(1, 2), 4, 0, left=True)) == [0, 0, 1, 2]
    assert value(spark, A.starts_with(arr(1, 2, 3), arr(1, 2))) is True
    allowed = F.array(arr(1, 0), arr(1, 1))
    assert value(spark, A.transitions_allowed(arr(1, 0, 0), allowed)) is True and value(spark, A.transitions_allowed(arr(0, 1), allowed)) is False
    assert value(spark, A.log_prob_until(arr(5, 9, 7), arr(-1.0, -2.0, -4.0), 9)) == -3


def test_parsing(spark):
    strict = lambda s: value(spark, T.parse_strict(F.lit(s), 3, 4))
    assert strict("[1, 2, 3]") == [1, 2, 3] and strict("[1, 2.0, 3]") == [1, 2, 3]
    assert strict("[1, 2]") is None and strict("[1, 2, 4]") is None and strict("x") is None and strict('["1", 2, 3]') is None and strict("[1.5, 2, 3]") is None
    assert value(spark, T.parse_permissive(F.lit("[1]"), 3)) == [1, -1, -1] and value(spark, T.scoring_copy(F.lit("[1, 9]"), 3)) == [1, 2, 1]
    assert value(spark, T.parse_permissive(F.lit("[]"), 3)) is None


def test_mfcs_weights_equal_the_recursion(spark):
    rows = [(0, i, 1.0 + i, 2.0 + i * i, 0.5 * i + 1) for i in range(6)]
    df = spark.createDataFrame(rows, "g int, id int, a double, b double, c double")
    want = {i: sum(rows[i][2] * rows[j][3] * rows[k][4] for j in range(6) for k in range(6) if len({i, j, k}) == 3) for i in range(6)}
    assert {r.id: r.weight for r in CF.mfcs_weights(df, 3, "g").collect()} == pytest.approx(want)


def test_chains_and_controllers(spark):
    rows = [(0, i, t, p, u) for i, (t, p, u) in enumerate([(1.0, 1.0, 0.9), (0.5, 1.0, 0.6), (2.0, 1.0, 0.9), (1.0, 4.0, 0.2)])]
    df = spark.createDataFrame(rows, "c int, id bigint, t double, p double, u double")
    assert [r.accepted for r in S.metropolis_chain(df, "c", "id", "t", "p", "u").orderBy("id").collect()] == [True, False, True, False]
    steps = spark.createDataFrame([(0, i, bool(m)) for i, m in enumerate([1, 1, 0, 0])], "g int, s bigint, m boolean")
    assert [round(r.level, 6) for r in CF.clipped_controller(steps, "g", "s", "m", 0.1, 0.2).orderBy("step").collect()] == [0.1, 0.0, 0.0, 0.02]
    until = S.accept_until(df, F.lit(0.7), F.col("u"), 1, "c", ["id"])
    assert [(r.id, r.accepted) for r in until.orderBy("id").collect()] == [(0, False), (1, True)]
    many = spark.createDataFrame([(i, i // 50, i % 3 == 0) for i in range(150)], "s bigint, g int, m boolean")
    assert CF.clipped_controller(many, "g", "s", "m", 0.2, 0.05).groupBy("g").count().count() == 3


def test_bound_by_mass(spark):
    """Against the same bisection over a list."""
    r = random.Random(41)
    for _ in range(3):
        w = sorted(r.random() for _ in range(60))
        alpha, limit, low, high, best = 0.015, 0.4, 0, 59, (0, w[0])
        while low <= high:
            mid = (low + high) // 2
            capped = [min(x, w[mid]) / sum(min(y, w[mid]) for y in w) for x in w]
            if sum(x for x in capped if x >= alpha) <= limit:
                best, low = (mid, w[mid]), mid + 1
            else:
                high = mid - 1
        df = spark.createDataFrame(list(enumerate(w)), "id int, w double")
        assert tuple(CF.bound_by_mass(df, "w", "id", alpha, limit).first()) == (best[0], pytest.approx(best[1]))
    assert CF.bound_by_mass(df.limit(0), "w", "id", 0.1, 0.1).count() == 0


def test_feedback_weights_of_four_steps(spark):
    r = random.Random(42)
    rows = [(0, i, *(r.random() for _ in range(4))) for i in range(6)]
    df = spark.createDataFrame(rows, "g int, id int, a double, b double, c double, e double")
    want = {i: rows[i][2] * sum(rows[j][3] * rows[k][4] * rows[m][5] for j in range(6) for k in range(6) for m in range(6) if len({i, j, k, m}) == 4) for i in range(6)}
    assert {x.id: x.weight for x in CF.feedback_weights(df, "a", ["b", "c", "e"], "g").collect()} == pytest.approx(want)


def test_search_over_a_mixture(spark):
    """Against a plain loop over all bounds, with the mixture's shares and places."""
    r = random.Random(43)
    make = lambda n, shift: [(i, r.random() + shift, r.random() + 0.1, r.random() + 0.3) for i in range(n)]
    cal = [(u, s, m, float("inf") if r.random() < 0.2 else 1.0) for _, u, s, m in make(80, 0.1)]
    safe, other = make(60, 0.1), make(50, 0.3)
    frame_of = lambda rows: spark.createDataFrame(rows, "id int, u double, s double, m double")
    cfg = K.Search(0.55, 15, mixture=True)
    got = K.beta_search(spark, spark.createDataFrame(cal, "u double, s double, m double, score double"), {"safe": frame_of(safe), "unconstrained": frame_of(other)}, cfg).first()
    ratios = sorted({u / s for _, u, s, _ in safe + other})
    grid = sorted({*ratios[:: max(len(ratios) // 15, 1)], TINY, math.inf})
    cap = lambda u, s, b: u if b == math.inf else min(u, b * s)
    mean = lambda x: sum(x) / len(x)
    at, turn, chosen, start, i = None, 0, TINY, 0, 0
    while at is None:
        moved = False
        for i in range(start, len(grid)):
            b = grid[i]
            ps, pu = mean([min(u / s, b) for _, u, s, _ in safe]), mean([1 if b == math.inf else min(b / (u / s), 1) for _, u, s, _ in other])
            os_, ou = mean([min(cap(u, s, b) / ps, s) / s for _, u, s, _ in safe]), mean([min(cap(u, s, b) / pu, u) / u for _, u, s, _ in other])
            mix = os_ < ou
            if turn == 0 and mix:
                start, turn, moved = i, 1, True
                break
            weight = os_ / (os_ + ou)
            rows = safe[: int(weight * 60)] + other[: int((1 - weight) * 50)] if mix else (other if turn else safe)
            w = max(cap(u, s, b) / m for _, u, s, m in rows)
            each = [cap(u, s, b) / m for u, s, m, _ in cal]
            risk = (sum(x for x, row in zip(each, cal, strict=True) if row[3] == math.inf) + w) / (sum(each) + w)
            if risk > 0.55 or b == math.inf:
                at = (risk, w, mix)
                break
            chosen = b
        assert moved or at is not None
    assert (got.beta, got.risk_margin, got.w_test, got.switch_to_mixture) == (pytest.approx(chosen), pytest.approx(0.55 - at[0]), pytest.approx(at[1]), at[2])


def test_rounds_rank_no_table(spark, monkeypatch):
    """a round's rows are neither placed nor ranked as a whole; the accepted rows are those of ranks."""
    from riskweave.operators import control, sampling

    df = spark.range(500).select("id", (1 + F.col("id") % 7).cast("double").alias("u"), (1 + F.col("id") % 5).cast("double").alias("s"), F.lit(2.0).alias("m"), F.lit(1.0).alias("score"), F.lit(1).alias("c"))
    draw = md5_uniform(5, "id")
    rows = lambda d: sorted(tuple(r) for r in d.select("id", "accepted").collect())
    want = {n: rows(sampling.accept_until(df, F.lit(0.4), draw, n, "c", ["id"])) for n in (0, 1, 30, 400)}
    for n, w in want.items():
        assert rows(sampling.accept_first(df, F.lit(0.4), draw, n, "id")) == w
    none = lambda *a, **k: pytest.fail("a whole table is ranked")
    monkeypatch.setattr(control, "running", none)
    monkeypatch.setattr(sampling, "running", none)
    assert len(rows(sampling.accept_first(df, F.lit(0.4), draw, 30, "id"))) == len(want[30])
    assert control.beta_search(spark, df, {"safe": df, "unconstrained": df}, control.Search(0.6, 20)).count() == 1


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are not here")
def test_policy_rounds(spark):
    """Three rounds against SQL that builds every policy anew from the log's bounds and round sizes."""
    import duckdb

    from riskweave.plans import trials
    from riskweave.plans.derive import CAL, calibration

    sf = "/root/testdata/sf0.001"
    log, cal = trials.policies(spark, sf)
    log, cal = {x["round"]: x for x in log.collect()}, {x.id: x.con for x in cal.collect()}
    assert len(log) == 3 and all(x.n_accepted <= min(2000, x.n_proposals) and x.n_feasible <= x.n_accepted for x in log.values())
    sizes = [250] + [log[r].n_cal - (log[r - 1].n_cal if r > 1 else 250) for r in (1, 2, 3)]
    assert min(sizes) > 0 and len(cal) == log[3].n_cal == sum(sizes)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS FROM '{sf}/events.parquet'")
    model = lambda r: f"{1 - r / 4} * s + {r / 4} * u"
    policy, nested = "s", "s AS p0"
    for r in (1, 2, 3):
        policy = f"least({model(r)}, {log[r].beta!r} * ({policy})) / {log[r].psi!r}"
        nested += f", {policy} AS p{r}"
    rows = {x[0]: x[1:] for x in con.sql(f"WITH {CAL} SELECT id, {nested} FROM cal").fetchall()}
    for i, own in cal.items():
        assert own == pytest.approx(list(rows[i]))
    # each round's bound is the one of a search over rows that SQL describes
    for r in (1, 2, 3):
        mixture = " + ".join(f"{n} * p{t}" for t, n in enumerate(sizes[:r]))
        known = con.sql(f"WITH {CAL} SELECT id, {model(r)} AS u, p{r - 1} AS s, ({mixture}) / {sum(sizes[:r])} AS m FROM (SELECT *, {nested} FROM cal)").fetchall()
        base = spark.createDataFrame([tuple(x) for x in known], "id bigint, u double, s double, m double").join(calibration(spark, sf).select("id", "score", "grp"), "id")
        own = [i for i in cal if i % 4 < r]
        fit = base.join(spark.createDataFrame([(i,) for i in own], "id bigint"), "id")
        new = base.filter(F.col("id") % 4 == r)
        again = K.beta_search(spark, fit, {"safe": new.filter("grp <> 'click'"), "unconstrained": new.filter("grp = 'click'")}, K.Search(0.6, 20)).first()
        assert (again.proposal, again.beta, again.psi) == (log[r].proposal, pytest.approx(log[r].beta), pytest.approx(log[r].psi))


def test_policy_chain(spark):
    """Each policy capped against the last one, or against the first."""
    df = spark.createDataFrame([([1.0, 2.0, 4.0],), ([1.0, 0.5, 0.3],)], "liks array<double>")
    for versus, want in (("last", [[1.0, 0.75, 0.75], [1.0, 0.25, 0.15]]), ("first", [[1.0, 0.75, 1.0], [1.0, 0.25, 0.15]])):
        got = df.select(RD.policy_chain(F.col("liks"), [1.0, 1.5, 2.0], [1.0, 2.0, 2.0], versus).alias("c")).collect()
        assert [x.c for x in got] == [pytest.approx(w) for w in want]


def test_fitted_process(spark):
    """The largest evidence against a fine grid of the definition, with the matrix of all rows."""
    r = np.random.default_rng(5)
    x = r.normal(size=(40, 2))
    y = x @ [1.5, -0.7] + 2.0 + r.normal(size=40) * 0.6
    df = spark.createDataFrame([(i, *map(float, a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id int, a double, b double, y double")

    def evidence(noise, offset):
        k = x @ x.T + offset**2 + noise * np.eye(40)
        return -0.5 * (y @ np.linalg.solve(k, y) + np.linalg.slogdet(k)[1] + 40 * math.log(2 * math.pi))

    got = {(v.noise, v.offset): v.evidence for v in RG.process_evidence(df, ["a", "b"], "y", [0.1, 0.5, 3.0], [0.5, 2.0]).collect()}
    assert got == {k: pytest.approx(evidence(*k)) for k in got} and len(got) == 6
    noise, offset, best = RG.fit_process(df, ["a", "b"], "y")
    assert best == pytest.approx(evidence(noise, offset))
    fine = max(evidence(n, o) for n in np.geomspace(0.05, 5, 60) for o in np.geomspace(0.1, 20, 60))
    assert fine <= best + 1e-9 and best < fine + 0.02
    assert evidence(noise * 1.01, offset) <= best and evidence(noise, offset * 0.99) <= best


def test_nystroem(spark):
    """With a point for each row the features' products are the kernel, and a linear process over them is the exact one."""
    r = np.random.default_rng(7)
    x, y = r.normal(size=(14, 2)), r.normal(size=14)
    df = spark.createDataFrame([(i, *map(float, a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id int, a double, b double, y double")
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / (2 * 1.3**2))
    out, names = RG.nystroem(df, ["a", "b"], 14, 1.3)
    phi = np.array([[v[n] for n in names] for v in out.orderBy("id").collect()])
    assert phi @ phi.T == pytest.approx(kernel, abs=1e-6)
    got = {v.id: (v.mean, v.std) for v in RG.gaussian_process(out, out, names, "y", noise=0.5, offset=0.0).collect()}
    k = kernel @ np.linalg.inv(kernel + 0.5 * np.eye(14))
    for i in range(14):
        assert got[i] == (pytest.approx((k @ y)[i], abs=1e-5), pytest.approx(math.sqrt(kernel[i, i] - (k @ kernel)[i, i] + 0.5), abs=1e-5))
    few, some = RG.nystroem(df, ["a", "b"], 5, 1.3)
    assert len(some) == 5 and RG.nystroem(df, ["a", "b"], 0, 1.0)[1] == []


def test_placements(spark):
    """Against all choices of places; odd sequences have none."""
    allowed = [[int((a + 1) % 4 != b) for b in range(4)] for a in range(4)]
    rows = [(1, [None] * 5), (2, [0, None, None, 3, None]), (3, [0, 1, None, None, None]), (4, []), (5, None), (6, [None, None, 1, None, 2])]
    df = spark.createDataFrame(rows, "id int, x array<int>")
    motifs, spacings = [[0, 0], [3, 1]], [[0, 2], [0, 1]]
    got = sorted((v.id, v.places, v.placed) for v in A.motif_placements(df, "x", motifs, spacings, allowed).collect())
    want = []
    for i, x in rows:
        for a in range(3) if x else []:
            for b in range(4):
                wish = [(a, 0), (a + 2, 0), (b, 3), (b + 1, 1)]
                y = list(x)
                ok = all(x[p] in (None, v) for p, v in wish) and all(v == w for p, v in wish for q, w in wish if p == q)
                for p, v in wish:
                    y[p] = v
                if ok and all(y[j] is None or y[j + 1] is None or allowed[y[j]][y[j + 1]] for j in range(4)):
                    want.append((i, [a, b], y))
    assert got == sorted(want) and {w[0] for w in want} >= {1, 2}


def test_totals(spark, monkeypatch):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "g string, x int")
    for few in (100, 0):
        monkeypatch.setattr(ranking, "FEW", few)
        assert sorted((r.x, r.t, r.n) for r in ranking.with_totals(df, ["g"], {"t": F.sum("x"), "n": F.count("*")}).collect()) == [(1, 3, 2), (2, 3, 2), (3, 3, 1)]


def test_cut_tables_go(spark):
    """Tables cut within a step are deleted when it ends, but for those that stay."""
    with storage.dropping(spark):
        gone, kept = storage.cut(spark.range(3), "gone"), storage.cut(spark.range(4), "kept", stays=True)
        assert gone.count() == 3
    assert kept.count() == 4
    path = lambda df: df.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path(kept)) and not os.path.exists(path(gone))


@pytest.mark.parametrize("ranges", [None, 1, 9])
def test_chains_in_stretches(spark, ranges):
    """Long chains cut into stretches equal a loop: a clipped controller and a Metropolis-Hastings chain."""
    r = random.Random(3)
    rows = [(c, i, float(r.random() < 0.3), r.choice([0.1, 1.0, 5.0]) * r.random() + 0.01, r.random() + 0.05, r.random()) for c, n in (("a", 1), ("b", 3000), ("c", 40), ("d", 900), (None, 5)) for i in range(n)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "c string, i int, missed double, t double, p double, u double")
    level = {(x.c, x.step): x.level for x in CF.clipped_controller(df, "c", "i", "missed", 0.1, 0.2, ranges).collect()}
    taken = {(x.c, x.i): x.accepted for x in S.metropolis_chain(df, "c", "i", "t", "p", "u", ranges).collect()}
    assert len(level) == len(taken) == len(rows)
    for c in {x[0] for x in rows}:
        at, last = 0.1, None
        for _, i, missed, t, p, u in sorted((x for x in rows if x[0] == c), key=lambda x: x[1]):
            assert level[c, i] == pytest.approx(at, abs=1e-9)
            at = min(1.0, max(0.0, at + 0.2 * (0.1 - missed)))
            ok = last is None or u < min(1.0, (t / p) / last)
            assert taken[c, i] == ok
            last = t / p if ok else last


def test_numbers_as_text(spark):
    """Halves and near halves, as C's printf writes them."""
    r = random.Random(44)
    xs = [0.125, 0.0625, 0.165, 2.675, -0.001, 1e14 + 0.5, 0.9995, 99.9995, 1e20, *(r.randrange(10**5) / 1000 + 0.0005 for _ in range(300)), *(r.uniform(-1e6, 1e6) for _ in range(300))]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for digits in (2, 3):
        assert [v[0] for v in df.select(T.decimals(F.col("x"), digits)).collect()] == [f"{x:.{digits}f}" for x in xs]


def test_risk_curve_equals_nested_loop(spark):
    r = random.Random(4)
    rows = [(i, r.random() + 0.1, r.random() + 0.1, r.random() < 0.3) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, u double, s double, bad boolean")
    betas = [0.2, 0.5, 1.0, 2.0, 5.0, math.inf]
    got = {x.beta: x.risk for x in G.risk_curve(df, betas).collect()}
    for b in betas:
        w = [min(u, b * s) / ((u + s) / 2) for _, u, s, _ in rows]
        want = (sum(x for x, row in zip(w, rows, strict=True) if row[3]) + max(w)) / (sum(w) + max(w))
        assert got[b] == pytest.approx(want)


def test_ranks_and_rollups(spark):
    r = random.Random(2)
    xs = [(i, float(r.randrange(40))) for i in range(300)]
    df = spark.createDataFrame(xs, "id bigint, x double")
    got = {v.id: v.rn for v in global_row_number(df, "x", "id", ranges=7).collect()}
    assert got == {i: k + 1 for k, (i, _) in enumerate(sorted(xs, key=lambda t: (t[1], t[0])))}
    assert R.parameter_grid(spark, {"a": [1, 2, 3], "b": [0.1, 0.2]}).count() == 6
    assert A.path_counts([[1, 1], [1, 0]], 5) == [2, 3, 5, 8, 13]


def test_sources(spark, tmp_path):
    from riskweave.sources import io

    (tmp_path / "a.jsonl").write_text('{"Question": "q1", "score": "inf"}\n{"Question": "q2", "score": "0.250"}\n')
    (tmp_path / "b.jsonl").write_text('{"Question": "q1"}\n')
    scores = io.read_jsonl(spark, f"{tmp_path}/a.jsonl", "Question string, score string", ("score",))
    assert {r.Question: r.score for r in scores.collect()} == {"q1": math.inf, "q2": 0.25}
    assert {tuple(r) for r in io.read_named_jsonl(spark, str(tmp_path), "Question").collect()} == {("q1", "b"), ("q2", "a")}
    (tmp_path / "c.csv").write_text("1,2,3,4,5,6,?,8\n1,2,3,4,5,7,1,9\n")
    assert [tuple(r) for r in io.read_without_missing(spark, f"{tmp_path}/c.csv").collect()] == [(6.0, 8.0), (7.0, 9.0)]
    (tmp_path / "d.arff").write_text("% note\n@relation r\n@attribute 'x y' numeric\n@ATTRIBUTE z real\n@data\n1, 2\n3,4.5\n")
    arff = io.read_arff(spark, f"{tmp_path}/d.arff")
    assert arff.columns == ["x y", "z"] and {tuple(r) for r in arff.collect()} == {(1.0, 2.0), (3.0, 4.5)}
    (tmp_path / "e.txt").write_text(" 1  2\t3 \n")
    assert io.read_whitespace(spark, f"{tmp_path}/e.txt").first()["values"] == [1, 2, 3]
    (tmp_path / "f.tsv").write_text("2.718281828459045\t1\t1\t1\t1\t9\n")
    assert io.read_airfoil(spark, f"{tmp_path}/f.tsv").first()["Frequency"] == pytest.approx(1)
    (tmp_path / "g.json").write_text('{"s": ["f1", "f2"]}')
    assert io.read_demonstrations(spark, f"{tmp_path}/g.json").count() == 2
    io.write_jsonl(scores, f"{tmp_path}/out")
    io.write_jsonl(scores.limit(0), f"{tmp_path}/out", overwrite=False)
    back = spark.read.json(f"{tmp_path}/out")
    assert {r.Question: r.score for r in back.collect()} == {"q1": None, "q2": 0.25}
    assert io.largest_file(spark, f"{tmp_path}/*.jsonl").endswith("a.jsonl") and io.first_file(spark, f"{tmp_path}/*.jsonl").endswith("a.jsonl")
    record = json.loads(io.metrics_json({"bound": math.inf, "margin": math.nan, "sampling": None}))
    assert record["bound"] == math.inf and math.isnan(record["margin"])


def test_stream_of_acceptances(spark, tmp_path):
    from riskweave.streaming.controllers import acceptance_by_window

    src = tmp_path / "in"
    spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id) as t, id % 4 = 0 as ok from range(20)").write.parquet(str(src))
    stream = spark.readStream.schema("t timestamp, ok boolean").parquet(str(src))
    q = acceptance_by_window(stream, "t", F.col("ok")).writeStream.format("memory").queryName("acc").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.n_proposals, r.n_accepted) for r in spark.table("acc").collect()) == [(10, 2), (10, 3)]
