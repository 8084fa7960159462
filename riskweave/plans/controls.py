"""Queries of bound searches, pool searches, weights, intervals and quantiles, each beside its SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import maths as M
from ..operators import conformal as CF
from ..operators import control as K
from ..operators import regression as RG
from ..operators import sampler as SP
from ..operators import sampling as S
from ..semantics import infeasible, md5_uniform
from .catalogue import _r, _U, query, r6
from .derive import CAL, calibration, runs, table

_PROPS = {"safe": "view", "unconstrained": "click"}
_MIX = "(0.4 * s + 0.6 * u)"


def _inputs(spark, d):
    cal = calibration(spark, d).withColumn("m", 0.4 * F.col("s") + 0.6 * F.col("u"))
    return cal.filter("grp not in ('view', 'click')"), {k: cal.filter(F.col("grp") == g).select("id", "u", "s", "m") for k, g in _PROPS.items()}


def _search_sql(first: str, second: str, alpha: float, factor: float, n_grid: int) -> str:
    """A search over the safe and the unconstrained samples, the second from where the overlaps cross."""
    return f"""WITH {CAL}, x AS (SELECT *, u / s AS lr, {_MIX} AS m FROM cal), c AS (SELECT * FROM x WHERE grp NOT IN ('view', 'click')), ps AS (SELECT * FROM x WHERE grp = 'view'), pu AS (SELECT * FROM x WHERE grp = 'click'),
 d AS (SELECT DISTINCT lr AS beta FROM (SELECT lr FROM ps UNION ALL SELECT lr FROM pu)), k AS (SELECT greatest(CAST(floor(count(*) / {n_grid}) AS BIGINT), 1) AS k FROM d),
 g0 AS (SELECT beta FROM (SELECT beta, row_number() OVER (ORDER BY beta) AS rn FROM d), k WHERE (rn - 1) % k = 0 UNION SELECT CAST('inf' AS DOUBLE) UNION SELECT 2.2250738585072014e-308),
 g AS (SELECT beta, row_number() OVER (ORDER BY beta) - 1 AS pos FROM g0),
 psi AS (SELECT g.beta, any_value(g.pos) AS pos, (SELECT avg(least(lr, g.beta)) FROM ps) AS a, (SELECT avg(CASE WHEN isinf(g.beta) THEN 1 ELSE least(g.beta / lr, 1) END) FROM pu) AS b FROM g GROUP BY g.beta),
 o AS (SELECT psi.*, (SELECT avg(least(CASE WHEN isinf(psi.beta) THEN lr ELSE least(lr, psi.beta) END / psi.a, 1)) FROM ps) AS os, (SELECT avg(CASE WHEN isinf(psi.beta) THEN 1 ELSE least(least(psi.beta / lr, 1) / psi.b, 1) END) FROM pu) AS ou FROM psi),
 w AS (SELECT o.*, (SELECT sum(CASE WHEN isinf(o.beta) THEN u ELSE least(u, o.beta * s) END / m) FROM c) AS e, (SELECT sum(CASE WHEN isinf(o.beta) THEN u ELSE least(u, o.beta * s) END / m) FROM c WHERE NOT isfinite(score)) AS bad,
  (SELECT max(CASE WHEN isinf(o.beta) THEN u ELSE least(u, o.beta * s) END / m) FROM ps) AS ts, (SELECT max(CASE WHEN isinf(o.beta) THEN u ELSE least(u, o.beta * s) END / m) FROM pu) AS tu FROM o),
 r AS (SELECT *, coalesce((bad + ts) / (e + ts), 1) AS risk_safe, coalesce((bad + tu) / (e + tu), 1) AS risk_unconstrained, {factor} * os < ou AS crossed FROM w),
 b0 AS (SELECT coalesce(min(pos), 1000000) AS p FROM r WHERE crossed), v0 AS (SELECT coalesce(min(pos), 1000000) AS p FROM r WHERE risk_{first} > {alpha} OR isinf(beta)),
 s0 AS (SELECT CASE WHEN v0.p < b0.p THEN 0 ELSE b0.p END AS f, v0.p < b0.p AS stopped, v0.p AS v FROM b0, v0),
 v1 AS (SELECT min(pos) AS p FROM r, s0 WHERE pos >= f AND (risk_{second} > {alpha} OR isinf(beta))),
 z AS (SELECT CASE WHEN stopped THEN '{first}' ELSE '{second}' END AS proposal, CASE WHEN stopped THEN v ELSE v1.p END AS at FROM s0, v1)
 SELECT z.proposal, round(coalesce(q.beta, 2.2250738585072014e-308), 6) AS beta, round({alpha} - CASE WHEN z.proposal = 'safe' THEN r.risk_safe ELSE r.risk_unconstrained END, 6) AS risk_margin, round(r.os, 6) AS overlap_safe, round(r.ou, 6) AS overlap_unconstrained, r.crossed AS switch_to_optimized
 FROM z JOIN r ON r.pos = z.at LEFT JOIN r q ON q.pos = z.at - 1"""


def _found(df):
    return df.select("proposal", r6("beta").alias("beta"), r6("risk_margin").alias("risk_margin"), r6("overlap_safe").alias("overlap_safe"), r6("overlap_unconstrained").alias("overlap_unconstrained"), "switch_to_optimized")


@query("beta_search_sequence", _search_sql("safe", "unconstrained", 0.45, 1.0, 40))
def beta_search_sequence(spark, d):
    """One start on safe samples; the other proposal takes over where it overlaps the policy more."""
    cal, props = _inputs(spark, d)
    return _found(K.beta_search(spark, cal, props, K.Search(0.45, 40)))


@query("beta_search_two_starts", _search_sql("unconstrained", "safe", 0.45, 1e9, 40))
def beta_search_two_starts(spark, d):
    """Two starts at half the level, never changing over within a start."""
    cal, props = _inputs(spark, d)
    return _found(K.beta_search(spark, cal, props, K.Search(0.9, 40, starts=2, optimized_factor=1e9)))


@query("beta_search_by_limit", _search_sql("safe", "unconstrained", 0.45, 1.0, 40).replace("NOT isfinite(score)", "NOT coalesce(score <= 90, false)"))
def beta_search_by_limit(spark, d):
    """The search under another constraint: scores that are infeasible or above a limit."""
    cal, props = _inputs(spark, d)
    over = lambda score: infeasible(score) | (F.col(score) > 90)
    return _found(K.beta_search(spark, cal, props, K.Search(0.45, 40, violation=over)))


@query("beta_search_mixture")
def beta_search_mixture(spark, d):
    """A mixture of both proposals in place of the change; checked against a loop over all bounds in the tests."""
    cal, props = _inputs(spark, d)
    return K.beta_search(spark, cal, props, K.Search(0.45, 20, mixture=True))


@query("beta_search_uncontrolled", f"WITH {CAL}, x AS (SELECT *, {_MIX} AS m FROM cal), p AS (SELECT * FROM x WHERE grp = 'click') SELECT 'unconstrained' AS proposal, round(max(u / u), 6) AS envelope, 1.0::DOUBLE AS psi, round(max(u / m), 6) AS w_test FROM p")
def beta_search_uncontrolled(spark, d):
    cal, props = _inputs(spark, d)
    return _r(K.beta_search(spark, cal, props, K.Search(1.0, 20)).select("proposal", "envelope", "psi", "w_test"))


_POOL = f"""WITH {CAL}, x AS (SELECT *, {_MIX} AS m FROM cal), lim AS (SELECT min(ln(u / s)) AS lo, max(ln(u / s)) AS hi FROM x WHERE id % 3 = 0), g AS (SELECT pos, lo + pos * ((hi - lo) / 20) AS bound FROM lim, range(21) t(pos)),
 w AS (SELECT g.pos, g.bound, id % 3 = 0 AS pool, NOT isfinite(score) AS bad, m, CASE WHEN ln(u / s) < g.bound THEN u ELSE exp(g.bound) * s END AS w FROM g, x),
 p AS (SELECT pos, bound, sum(w) FILTER (WHERE pool) AS mass, max(w / m) FILTER (WHERE pool) AS top, sum(w * w / m) FILTER (WHERE pool) AS square, sum(w / m) FILTER (WHERE NOT pool AND bad) AS b, sum(w / m) FILTER (WHERE NOT pool) AS e FROM w GROUP BY pos, bound),
 c AS (SELECT pos, bound, mass, (b / mass + {{0}}) / (e / mass + {{0}}) AS risk FROM p)"""
_STOP = " , f AS (SELECT coalesce(min(pos) FILTER (WHERE risk > {0}), max(pos)) AS p FROM c) SELECT round(bound, 6) AS bound, CAST(pos AS INTEGER) AS position FROM c, f WHERE pos = greatest(p - 1, 0)"


def _pool(spark, d):
    x = calibration(spark, d).withColumns({"m": 0.4 * F.col("s") + 0.6 * F.col("u"), "bad": ~(F.abs("score") < float("inf")) | F.isnan("score")})
    return x.filter("id % 3 <> 0"), x.filter("id % 3 = 0")


@query("pool_search_max", _POOL.format("top / mass") + _STOP.format(0.42))
def pool_search_max(spark, d):
    cal, pool = _pool(spark, d)
    return _r(K.pool_search(spark, cal, pool, 0.42, 21))


@query("pool_search_sum", _POOL.format("2 * square / (mass * mass)") + _STOP.format(0.26))
def pool_search_sum(spark, d):
    """The test point by its mean weight, twice as heavy as against the last policy."""
    cal, pool = _pool(spark, d)
    return _r(K.pool_search(spark, cal, pool, 0.26, 21, "sum", 2.0))


@query("preset_bound_weights", f"""WITH {CAL}, x AS (SELECT *, {_MIX} AS m, CASE WHEN ln(u / s) < 0.5 THEN u ELSE exp(0.5) * s END AS w FROM cal), p AS (SELECT sum(w) AS mass, max(w / m) AS top FROM x WHERE id % 3 = 0),
 y AS (SELECT id, w / mass / m AS w FROM x, p WHERE id % 3 <> 0 UNION ALL SELECT NULL, top / mass FROM p) SELECT id, round(w / sum(w) OVER () * 1000, 6) AS weight FROM y""")
def preset_bound_weights(spark, d):
    cal, pool = _pool(spark, d)
    return K.bound_weights(cal, pool, 0.5).select("id", r6(F.col("weight") * 1000).alias("weight"))


@query("accept_two_rounds", f"""WITH {CAL}, a AS (SELECT id, grp, s AS p0, least(u, s * 2.0) / 1.2 AS p1, least(value / 50 + 0.1, least(u, s * 2.0) / 1.2 * 1.5) / 1.1 AS p2, {_U.format(31)} AS d1, {_U.format(32)} AS d2 FROM cal),
 j AS (SELECT *, d1 < least(1, p1 / (p0 * 1.7)) AS ok FROM a), b AS (SELECT * FROM (SELECT *, coalesce(sum(ok::INT) OVER (PARTITION BY grp ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM j) WHERE before < 150 AND ok),
 k AS (SELECT *, d2 < least(1, p2 / (p1 * 1.4)) AS ok2 FROM b), c AS (SELECT * FROM (SELECT *, coalesce(sum(ok2::INT) OVER (PARTITION BY grp ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before2 FROM k) WHERE before2 < 150 AND ok2)
 SELECT id, round(p2, 9) AS policy FROM c""")
def accept_two_rounds(spark, d):
    """Samples of the first policy pass two later, capped policies."""
    rows = calibration(spark, d).withColumn("l2", F.col("value") / 50 + 0.1)
    out = K.accept_rounds(rows, ["s", "u", "l2"], [2.0, 1.5], [1.2, 1.1], [1.7, 1.4], [md5_uniform(31, "id"), md5_uniform(32, "id")], 150, "grp", ["id"])
    return out.select("id", F.round("policy", 9).alias("policy"))


_RULES = SP.Policies(["s", "u", "l2"], [float("inf"), 2.0, 1.5], [1.0, 1.2, 1.1])
_DENSITIES = "a AS (SELECT id, grp, s, u, value / 50 + 0.1 AS l2, s AS c0, least(u, s * 2.0) / 1.2 AS c1, least(value / 50 + 0.1, least(u, s * 2.0) / 1.2 * 1.5) / 1.1 AS c2 FROM cal)"


def _until(source: str, chance: str, seed: int, order: str = "id") -> str:
    """Rows of ``source`` up to the 150th acceptance of each group."""
    draw = _U.format(seed).replace("|| id)", f"|| {order})")
    return f"""(SELECT * EXCLUDE (taken) FROM (SELECT *, sum(accepted::INT) OVER (PARTITION BY grp ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS taken FROM (SELECT *, {draw} < acc_prob AS accepted FROM (SELECT *, {chance} AS acc_prob FROM {source}))) WHERE taken - accepted::INT < 150)"""


_SAMPLED = f"WITH {CAL}, {_DENSITIES}, r1 AS {_until('a', 'least(1, u / c0 / 2.0)', 34)}, r2 AS {_until('(SELECT * EXCLUDE (acc_prob, accepted) FROM r1 WHERE accepted)', 'least(1, l2 / c1 / 1.5)', 35)}"


def _by_pi(c: str):
    """A column over pi, rounded: quotients of short decimals may lie on a rounding edge."""
    return F.round(F.col(c) / math.pi, 9).alias(c)


def _policy_rows(spark, d):
    return calibration(spark, d).select("id", "grp", "s", "u", (F.col("value") / 50 + 0.1).alias("l2"))


def _sampled(rows, **how):
    order = how.pop("order", "id")
    return SP.sample_policy(rows, _RULES, SP.Sampler(150, "grp", order, 33, **how))


@query("sampled_likelihoods", f"{_SAMPLED} SELECT id, round(s, 9) AS s, round(u, 9) AS u, round(l2, 9) AS l2 FROM r2 WHERE accepted")
def sampled_likelihoods(spark, d):
    """Accepted samples of the last policy, with their likelihoods under every model."""
    return _sampled(_policy_rows(spark, d)).unconstrained.select("id", *[F.round(c, 9).alias(c) for c in ("s", "u", "l2")])


@query("sampled_constrained", f"{_SAMPLED} SELECT id, round(c0, 9) AS con_s, round(c1, 9) AS con_u, round(c2, 9) AS con_l2 FROM r2 WHERE accepted")
def sampled_constrained(spark, d):
    """The same samples with their densities under every policy."""
    return _sampled(_policy_rows(spark, d)).constrained.select("id", *[F.round(c, 9).alias(c) for c in ("con_s", "con_u", "con_l2")])


@query("sampled_proposals", f"{_SAMPLED} SELECT id, 1 AS round, round(acc_prob / pi(), 9) AS acc_prob, accepted FROM r1 UNION ALL SELECT id, 2, round(acc_prob / pi(), 9), accepted FROM r2")
def sampled_proposals(spark, d):
    """Every proposal that a round judged, accepted or not."""
    return _sampled(_policy_rows(spark, d)).proposals.select("id", "round", _by_pi("acc_prob"), "accepted")


@query("sampled_unconstrained", f"WITH {CAL}, {_DENSITIES} SELECT id, round(acc_prob / pi(), 9) AS acc_prob, accepted FROM {_until('a', 'least(1, 1.5 / (l2 / c1))', 35)}")
def sampled_unconstrained(spark, d):
    """Samples of the last model, judged by the last policy alone."""
    return _sampled(_policy_rows(spark, d), proposal="unconstrained").proposals.select("id", _by_pi("acc_prob"), "accepted")


@query("sampled_mixture", f"""WITH {CAL}, {_DENSITIES}, t AS (SELECT *, CASE WHEN id % 3 = 0 THEN 'unconstrained' ELSE 'safe' END AS proposal, row_number() OVER (PARTITION BY id % 3 = 0 ORDER BY id) AS place FROM a),
 n AS (SELECT proposal, count(*) AS n FROM t GROUP BY proposal), k AS (SELECT step, {_U.format(36).replace('|| id)', '|| step)')} < 0.7 AS safe FROM range((SELECT count(*) FROM a)) r(step)),
 w AS (SELECT step, CASE WHEN safe THEN 'safe' ELSE 'unconstrained' END AS proposal, row_number() OVER (PARTITION BY safe ORDER BY step) AS place FROM k),
 e AS (SELECT coalesce(min(step), 9223372036854775807) AS e FROM w JOIN n USING (proposal) WHERE place > n.n), m AS (SELECT w.step, t.* FROM w JOIN t USING (proposal, place), e WHERE w.step < e.e)
 SELECT step, id, proposal, round(acc_prob / pi(), 9) AS acc_prob, accepted FROM {_until('m', 'least(1, c2 / ((0.7 * c1 + (1 - 0.7) * l2) * 1.2))', 35, 'step')}""")
def sampled_mixture(spark, d):
    """Samples of both proposals in the order of a mixture's draws, judged by the last policy."""
    rows = _policy_rows(spark, d)
    drawn = SP.interleave(rows.filter("id % 3 <> 0"), rows.filter("id % 3 = 0"), 0.7, 36)
    return _sampled(drawn, order="step", proposal="mixture", weight=0.7, envelope=1.2).proposals.select("step", "id", "proposal", _by_pi("acc_prob"), "accepted")


@query("sampled_metropolis")
def sampled_metropolis(spark, d):
    """The last policy by a chain; the tests hold it equal to a plain loop."""
    return _sampled(_policy_rows(spark, d), metropolis=True).proposals.select("id", "round", _by_pi("acc_prob"), "accepted")


@query("alpha_correction", "SELECT * FROM (VALUES (0.2::DOUBLE, 1, 0.2::DOUBLE), (0.2, 2, 0.1), (1.0, 2, 1.0), (1.5, 1, 1.0)) t(alpha, starts, adjusted)")
def alpha_correction(spark, d):
    return spark.createDataFrame([(a, s, M.adjusted_alpha(a, s)) for a, s in ((0.2, 1), (0.2, 2), (1.0, 2), (1.5, 1))], "alpha double, starts int, adjusted double")


@query("proposal_switch", f"WITH {CAL}, p AS (SELECT grp, avg(least(least(s * 2.0 / 1.3, u / 1.3), s) / s) AS a, avg(least(least(s * 2.0 / 1.3, u / 1.3), u) / u) AS b FROM cal GROUP BY grp) SELECT grp, 0.6 * a < b AS switches, round(greatest(a / (a + b), 0.45), 6) AS floored FROM p")
def proposal_switch(spark, d):
    from ..operators import likelihood as L

    u, s = F.col("u"), F.col("s")
    p = calibration(spark, d).groupBy("grp").agg(L.overlap(u, s, 2.0, 1.3, "safe").alias("a"), L.overlap(u, s, 2.0, 1.3, "unconstrained").alias("b"))
    return p.select("grp", M.switches_proposal(0.2, F.col("a"), F.col("b"), 0.6).alias("switches"), r6(M.mixture_weight(0.2, F.lit(2.0), F.col("a"), F.col("b"), 0.45)).alias("floored"))


@query("safe_action_count", f"WITH {CAL}, t AS (SELECT sum(u / s) AS e, sum(u / s) FILTER (WHERE NOT isfinite(score)) AS b, avg(s / u) AS w FROM cal WHERE grp <> 'view'), n AS (SELECT unnest(range(0, 501)) AS n) SELECT max(n) AS n FROM n, t WHERE (b + n * w) / (e + n * w) <= 0.5")
def safe_action_count(spark, d):
    """The most test points for which the weighted risk stays under control."""
    t = calibration(spark, d).filter("grp <> 'view'").agg(F.sum(F.col("u") / F.col("s")).alias("e"), F.sum(F.when(~(F.abs("score") < float("inf")) | F.isnan("score"), F.col("u") / F.col("s"))).alias("b"), F.avg(F.col("s") / F.col("u")).alias("w"))
    n = spark.range(501).withColumnRenamed("id", "n")
    return n.crossJoin(F.broadcast(t)).filter((F.col("b") + F.col("n") * F.col("w")) / (F.col("e") + F.col("n") * F.col("w")) <= 0.5).agg(F.max("n").alias("n"))


_W4 = f"WITH {CAL}, t AS (SELECT grp, sum(s) AS b, sum(value / 50) AS c, sum(u) AS d, sum(s * value / 50) AS bc, sum(s * u) AS bd, sum(value / 50 * u) AS cd, sum(s * value / 50 * u) AS bcd FROM cal GROUP BY grp)"


@query("feedback_weights_d4", _W4 + " SELECT id, round(1e-9 * u * ((b - s) * (c - value / 50) * (d - u) - (bc - s * value / 50) * (d - u) - (bd - s * u) * (c - value / 50) - (cd - value / 50 * u) * (b - s) + 2 * (bcd - s * value / 50 * u)), 4) AS weight FROM cal JOIN t USING (grp)")
def feedback_weights_d4(spark, d):
    """Four steps: any depth has a closed form over the partitions of its factors."""
    rows = calibration(spark, d).withColumn("c", F.col("value") / 50).withColumn("e", F.col("u"))
    return CF.feedback_weights(rows, "u", ["s", "c", "e"], "grp").select("id", F.round(1e-9 * F.col("weight"), 4).alias("weight"))


_RES = f"WITH {CAL}, r AS (SELECT id, grp, abs(value - 50) AS e, s AS w FROM cal)"


@query("weighted_split_interval", _RES + """, a AS (SELECT id, grp, e, w FROM r UNION ALL SELECT 4611686018427387904, grp, CAST('inf' AS DOUBLE), max(w) FROM r GROUP BY grp), t AS (SELECT *, w / sum(w) OVER (PARTITION BY grp) AS v FROM a),
 c AS (SELECT *, round(sum(v) OVER (PARTITION BY grp ORDER BY e, v, id ROWS UNBOUNDED PRECEDING), 12) AS c, row_number() OVER (PARTITION BY grp ORDER BY e, v, id) AS rn FROM t),
 q AS (SELECT grp, min_by(e, rn) AS q FROM c WHERE c >= 0.9 GROUP BY grp) SELECT grp, round(50 - q, 6) AS lower, round(50 + q, 6) AS upper FROM q""")
def weighted_split_interval(spark, d):
    """A weighted split-conformal interval whose test point weighs as much as the heaviest row."""
    rows = calibration(spark, d).select("id", "grp", F.abs(F.col("value") - 50).alias("e"), F.col("s").alias("w"))
    test = rows.groupBy("grp").agg(F.max("w").alias("w"))
    q = CF.weighted_split_quantile(rows, "e", "w", test, "grp", 0.1)
    return _r(CF.intervals(rows.select("grp").distinct().withColumn("centre", F.lit(50.0)), q, "grp").select("grp", "lower", "upper"))


@query("aci_interval", _RES + """, n AS (SELECT grp, count(*) AS n, CASE WHEN grp = 'view' THEN 0.0 ELSE 0.13 END AS level FROM r GROUP BY grp), h AS (SELECT grp, n, (1 - level) * n AS h FROM n),
 k AS (SELECT grp, e, row_number() OVER (PARTITION BY grp ORDER BY e, id) AS rn FROM r), x AS (SELECT h.grp, h.h, coalesce((SELECT e FROM k WHERE k.grp = h.grp AND rn = floor(h.h) + 1), CAST('inf' AS DOUBLE)) AS lo, coalesce((SELECT e FROM k WHERE k.grp = h.grp AND rn = ceil(h.h) + 1), CAST('inf' AS DOUBLE)) AS hi FROM h)
 SELECT grp, round(CASE WHEN lo = hi THEN lo ELSE lo + (hi - lo) * (h - floor(h)) END, 6) AS quantile FROM x""")
def aci_interval(spark, d):
    """The quantile that an adaptive controller's level asks for; a level of 0 asks for infinity."""
    rows = calibration(spark, d).select("id", "grp", F.abs(F.col("value") - 50).alias("e"))
    levels = rows.select("grp").distinct().withColumn("level", F.when(F.col("grp") == "view", 0.0).otherwise(0.13))
    return CF.aci_quantile(rows, "e", "grp", levels).select("grp", r6("quantile").alias("quantile"))


@query("mass_bound", f"""WITH RECURSIVE {CAL}, v AS (SELECT s * u AS v, row_number() OVER (ORDER BY s * u, id) - 1 AS place, sum(s * u) OVER (ORDER BY s * u, id ROWS UNBOUNDED PRECEDING) AS run FROM cal), n AS (SELECT count(*) AS n FROM v),
 f(step, low, high, best) AS (SELECT 0, 0::BIGINT, n - 1, 0::BIGINT FROM n UNION ALL
  SELECT step + 1, CASE WHEN ok THEN mid + 1 ELSE low END, CASE WHEN ok THEN high ELSE mid - 1 END, CASE WHEN ok THEN mid ELSE best END FROM (
   SELECT step, low, high, best, mid, (SELECT coalesce(sum(least(v.v, m.v) / (m.run + m.v * (n.n - mid - 1))) FILTER (WHERE least(v.v, m.v) / (m.run + m.v * (n.n - mid - 1)) >= 0.002), 0) FROM v, v m, n WHERE m.place = mid) <= 0.3 AS ok
   FROM (SELECT *, (low + high) // 2 AS mid FROM f WHERE low <= high)))
 SELECT place, round(v, 6) AS bound FROM v WHERE place = (SELECT best FROM f ORDER BY step DESC LIMIT 1)""")
def mass_bound(spark, d):
    return _r(CF.bound_by_mass(calibration(spark, d).select("id", (F.col("s") * F.col("u")).alias("w")), "w", "id", 0.002, 0.3))


@query("bootstrap_draws", f"WITH {CAL}, r AS (SELECT id, row_number() OVER (ORDER BY id) AS rn, count(*) OVER () AS n FROM cal), d AS (SELECT i AS draw, CAST(('0x' || substr(md5('41:' || i), 1, 12))::BIGINT AS DOUBLE) / 281474976710656.0 AS u FROM range(200) t(i)) SELECT draw, r.id FROM d JOIN r ON r.rn = CAST(floor(u * r.n) AS BIGINT) + 1")
def bootstrap_draws(spark, d):
    return S.bootstrap(calibration(spark, d).select("id"), 200, 41)


@query("weighted_draws", f"WITH {CAL} SELECT id FROM cal ORDER BY ln(greatest({_U.format(43)}, 1e-300)) / s DESC, id LIMIT 120")
def weighted_draws(spark, d):
    return S.weighted_sample(calibration(spark, d), 120, "s", 43).select("id")


@query("generation_until_target", f"WITH {CAL}, n AS (SELECT user_id AS batch, count(*) AS n FROM cal GROUP BY 1), b AS (SELECT batch, sum(n) OVER (ORDER BY batch) - n AS before FROM n) SELECT id FROM cal JOIN b ON b.batch = user_id WHERE before < 150")
def generation_until_target(spark, d):
    """Batches of a generation loop up to the one that reaches 150 rows."""
    return S.until_target(calibration(spark, d), "user_id", 150).select("id")


@query("pca_projection", """WITH p AS (SELECT p_partkey AS id, p_size / 10.0 AS x, p_retailprice / 1000 AS y FROM part), m AS (SELECT avg(x) AS mx, avg(y) AS my, var_pop(x) AS a, var_pop(y) AS c, covar_pop(x, y) AS b FROM p),
 e AS (SELECT *, (a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b * b) AS l FROM m), v AS (SELECT *, CASE WHEN abs(b) > 1e-15 THEN b ELSE (CASE WHEN a >= c THEN 1 ELSE 0 END) END AS vx, CASE WHEN abs(b) > 1e-15 THEN l - a ELSE (CASE WHEN a >= c THEN 0 ELSE 1 END) END AS vy FROM e),
 s AS (SELECT id, ((x - mx) * vx + (y - my) * vy) * CASE WHEN abs(vx) >= abs(vy) THEN sign(vx) ELSE sign(vy) END AS s FROM p, v) SELECT id, round((s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()), 6) AS pc1 FROM s""")
def pca_projection(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 10).alias("x"), (F.col("p_retailprice") / 1000).alias("y"))
    return RG.project(p, ["x", "y"]).select("id", r6("pc1").alias("pc1"))


@query("ridge_residuals", f"""WITH {CAL}, t AS (SELECT sum(u * u) + 1 AS a, sum(u * s) AS b, sum(s * s) + 1 AS c, sum(u * value / 100) AS p, sum(s * value / 100) AS q FROM cal WHERE id % 2 = 0),
 w AS (SELECT (c * p - b * q) / (a * c - b * b) AS wu, (a * q - b * p) / (a * c - b * b) AS ws FROM t) SELECT id, round(abs(value / 100 - u * wu - s * ws), 6) AS residual FROM cal, w WHERE id % 2 = 1""")
def ridge_residuals(spark, d):
    rows = calibration(spark, d).withColumn("y", F.col("value") / 100)
    return RG.ridge_residuals(rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1"), ["u", "s"], "y").select("id", r6("residual").alias("residual"))


@query("process_mean_std", f"""WITH {CAL}, t AS (SELECT sum(u * u) / 0.5 + 1 AS a, sum(u) / 0.5 AS b, count(*) / 0.5 + 1 AS c, sum(u * s) / 0.5 AS p, sum(s) / 0.5 AS q FROM cal WHERE id % 2 = 0), i AS (SELECT c / (a * c - b * b) AS i11, -b / (a * c - b * b) AS i12, a / (a * c - b * b) AS i22, p, q FROM t)
 SELECT id, round(u * (i11 * p + i12 * q) + (i12 * p + i22 * q), 6) AS mean, round(sqrt(0.5 + u * u * i11 + 2 * u * i12 + i22), 6) AS std, round(sqrt(0.5 + u * u * i11 + 2 * u * i12 + i22 - 0.25), 6) AS latent FROM cal, i WHERE id % 2 = 1""")
def process_mean_std(spark, d):
    rows = calibration(spark, d)
    out = RG.gaussian_process(rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1"), ["u"], "s", noise=0.5)
    return out.select("id", r6("mean").alias("mean"), r6("std").alias("std"), r6(M.latent_deviation(F.col("std"), 1.0, 0.25)).alias("latent"))


@query("source_density", """WITH p AS (SELECT p_partkey AS id, p_retailprice AS x FROM part), r AS (SELECT min(x) AS lo, max(x) AS hi FROM p WHERE id % 5 <> 0), t AS (SELECT sum(exp(2.0 * (x - lo) / (hi - lo))) AS z FROM p, r WHERE id % 5 <> 0) SELECT id, round(exp(2.0 * (x - lo) / (hi - lo)) / z * 1000, 6) AS density FROM p, r, t""")
def source_density(spark, d):
    """Density by the first component, with range and sum of the rows that are not held back."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("x"))
    return RG.source_density(p, p.filter("id % 5 <> 0"), ["x"], 2.0).select("id", r6(F.col("density") * 1000).alias("density"))


@query("tilt_normaliser", f"WITH {CAL} SELECT round(ln(sum(exp(0.1 * (u * 0.5 + s * 0.25)))), 9) AS log_z FROM cal")
def tilt_normaliser(spark, d):
    return RG.tilt_normaliser(calibration(spark, d), ["u", "s"], [0.5, 0.25], 0.1).select(F.round(F.ln("z"), 9).alias("log_z"))


@query("noisy_label", f"WITH {CAL} SELECT id, round(value + 2.0 * sqrt(-2 * ln(greatest({_U.format(51)}, 1e-300))) * cos(2 * pi() * {_U.format(52)}), 6) AS label FROM cal")
def noisy_label(spark, d):
    return calibration(spark, d).select("id", r6(M.noisy(F.col("value"), 2.0, md5_uniform(51, "id"), md5_uniform(52, "id"))).alias("label"))


@query("mixture_pdf", f"WITH {CAL} SELECT id, round(0.3 * exp(-(((value - 20) / 5) ** 2) / 2) / (5 * sqrt(2 * pi())) + 0.7 * exp(-(((value - 60) / 15) ** 2) / 2) / (15 * sqrt(2 * pi())), 9) AS pdf FROM cal")
def mixture_pdf(spark, d):
    return calibration(spark, d).select("id", F.round(M.mixture_pdf(F.col("value"), [(0.3, 20.0, 5.0), (0.7, 60.0, 15.0)]), 9).alias("pdf"))


@query("capped_density_integral", f"WITH {CAL}, f AS (SELECT value AS x, least(u, 2.0 * s) AS f FROM cal) SELECT round(sum(f) * (max(x) - min(x)) / count(*), 4) AS integral FROM f")
def capped_density_integral(spark, d):
    f = calibration(spark, d).select(F.col("value").alias("x"), F.least("u", 2.0 * F.col("s")).alias("f"))
    return f.agg(F.round(F.sum("f") * (F.max("x") - F.min("x")) / F.count("*"), 4).alias("integral"))


@query("reinforce_terms", f"WITH {CAL}, t AS (SELECT id, user_id, ln(u) AS lp, value / 100 AS r FROM cal) SELECT id, round(-lp * r - 0.1 * lp / 10, 6) AS loss, round((sum(r) OVER w - r) / row_number() OVER w / pi(), 6) AS baseline FROM t WINDOW w AS (PARTITION BY user_id ORDER BY id ROWS UNBOUNDED PRECEDING)")
def reinforce_terms(spark, d):
    """The policy-gradient variant of the loss, with the running baseline of rewards before each step."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    t = calibration(spark, d).select("id", "user_id", F.ln("u").alias("lp"), (F.col("value") / 100).alias("r"))
    baseline = (F.sum("r").over(w) - F.col("r")) / F.row_number().over(Window.partitionBy("user_id").orderBy("id"))
    return _r(t.select("id", M.reinforce_loss(F.col("lp"), F.col("r"), F.lit(10), 0.1).alias("loss"), (baseline / math.pi).alias("baseline")))  # by pi, as finite decimals may lie on a rounding edge


@query("jittered_scores", f"WITH {CAL} SELECT id, round((least(1 - {_U.format(61)} * 1e-10, value / 500 + {_U.format(62)} * 1e-8) - value / 500) * 1e9, 3) AS moved FROM cal")
def jittered_scores(spark, d):
    c = calibration(spark, d)
    return c.select("id", F.round((M.jitter(F.col("value") / 500, md5_uniform(61, "id"), md5_uniform(62, "id")) - F.col("value") / 500) * 1e9, 3).alias("moved"))


@query("true_region", f"WITH {CAL}, x AS (SELECT value AS x, u / s >= 1.5 AS ok FROM cal) SELECT round(min(x) FILTER (WHERE ok), 6) AS low, round(max(x) FILTER (WHERE ok), 6) AS high, round(avg(CASE WHEN ok THEN 1 ELSE 0 END), 6) AS share FROM x")
def true_region(spark, d):
    """The range where a policy's ratio reaches a bound."""
    x = calibration(spark, d).select(F.col("value").alias("x"), (F.col("u") / F.col("s") >= 1.5).alias("ok"))
    return _r(x.agg(F.min(F.when(F.col("ok"), F.col("x"))).alias("low"), F.max(F.when(F.col("ok"), F.col("x"))).alias("high"), F.avg(F.col("ok").cast("int")).alias("share")))


__all__ = ["math", "runs"]
