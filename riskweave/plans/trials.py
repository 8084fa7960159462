"""Queries of whole procedures: trials of thresholds, simulations, rounds and active learning."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import control as K
from ..operators import learning as AL
from ..operators import regression as RG
from ..operators import rounds as RD
from ..operators import tables as B
from .catalogue import _LOSS, _r, query
from .derive import CAL, PART, TAUS, calibration, claims, particles, table

_TRIAL = f"""WITH {_LOSS}, b AS (SELECT l.response, l.tau, l.loss, l.recall, mono.loss AS mono FROM l JOIN mono USING (response, tau)),
 t AS (SELECT trial, tau, response, loss, recall, mono, CAST(('0x' || substr(md5('t:' || trial || ':' || response), 1, 12))::BIGINT AS DOUBLE) / 281474976710656.0 < 0.5 AS cal FROM b, range(4) r(trial)),
 s AS (SELECT trial, tau, (sum(loss) FILTER (WHERE cal) + 1) / (count(*) FILTER (WHERE cal) + 1) AS risk, (sum(mono) FILTER (WHERE cal) + 1) / (count(*) FILTER (WHERE cal) + 1) AS mono_risk, avg(loss) FILTER (WHERE cal) AS mean, count(*) FILTER (WHERE cal) AS n, avg(loss) FILTER (WHERE NOT cal) AS test_loss, avg(recall) FILTER (WHERE NOT cal) AS test_recall FROM t GROUP BY trial, tau),
 a AS (SELECT * FROM (VALUES (0.15::DOUBLE), (0.25::DOUBLE)) v(alpha)), k AS (SELECT trial, tau, alpha, n, mean, CAST(ceil(n * mean - 1e-9) AS BIGINT) AS k FROM s, a),
 pv AS (SELECT *, least((SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(alpha) + (n - j) * ln(1 - alpha))) FROM range(0, (SELECT max(k) + 1 FROM k)) r(j) WHERE j <= k AND j <= n), 1) AS cdf, least(mean, alpha) AS q FROM k),
 lt AS (SELECT trial, tau, alpha, least(exp(1) * cdf, CASE WHEN mean > 0 THEN exp(-n * (q * ln(q / alpha) + (1 - q) * ln((1 - q) / (1 - alpha)))) ELSE exp(1) * cdf END) AS p FROM pv),
 m AS (SELECT trial, tau, alpha, 'gcrc' AS method, risk > alpha AS bad FROM s, a UNION ALL SELECT trial, tau, alpha, 'monotised', mono_risk > alpha FROM s, a UNION ALL SELECT trial, tau, alpha, 'standard', risk > alpha FROM s, a UNION ALL SELECT trial, tau, alpha, 'ltt', p > 0.1 FROM lt),
 d AS (SELECT method, alpha, trial, max(tau) FILTER (WHERE bad) AS b, min(tau) AS low, min(tau) FILTER (WHERE NOT bad) AS ok FROM m GROUP BY method, alpha, trial),
 c AS (SELECT d.*, CASE WHEN method = 'standard' THEN ok WHEN b IS NULL THEN low ELSE coalesce((SELECT min(s.tau) FROM s WHERE s.trial = d.trial AND s.tau > d.b), b) END AS tau FROM d)
 SELECT method, alpha, count(*) AS n_trials, round(avg(test_loss), 6) AS risk_mean, round(stddev_pop(test_loss), 6) AS risk_std, round(avg(test_recall), 6) AS recall_mean, round(stddev_pop(test_recall), 6) AS recall_std FROM c JOIN s ON s.trial = c.trial AND s.tau = c.tau GROUP BY method, alpha"""


@query("threshold_trials", _TRIAL)
def threshold_trials(spark, d):
    """All methods and levels over random splits, in one set of sums."""
    return _r(RD.threshold_trials(claims(spark, d), TAUS, [0.15, 0.25], 4))


@query("risk_simulation", """WITH a AS (SELECT * FROM (VALUES (0.2::DOUBLE), (0.4::DOUBLE)) v(alpha)), g AS (SELECT alpha, e AS trial, k AS draw, i, i / 10 AS lam FROM a, range(30) r(e), range(10) q(k), range(11) p(i)),
 x AS (SELECT *, least(greatest(cos(lam) / 50 + 0.6 * (alpha + 1) * (1 - lam), 0), 1) AS chance FROM g), c AS (SELECT alpha, trial, i, any_value(lam) AS tau, any_value(chance) AS truth, (sum(CASE WHEN CAST(('0x' || substr(md5('1:' || trial || ':' || draw || ':' || i), 1, 12))::BIGINT AS DOUBLE) / 281474976710656.0 < chance THEN 1 ELSE 0 END) + 1) / 11 AS risk FROM x GROUP BY alpha, trial, i),
 d AS (SELECT alpha, trial, max(tau) FILTER (WHERE risk > alpha) AS b, min(tau) AS low, min(tau) FILTER (WHERE risk <= alpha) AS ok FROM c GROUP BY alpha, trial),
 p AS (SELECT alpha, trial, 'gcrc' AS method, CASE WHEN b IS NULL THEN low ELSE coalesce((SELECT min(c.tau) FROM c WHERE c.alpha = d.alpha AND c.trial = d.trial AND c.tau > d.b), b) END AS tau FROM d UNION ALL SELECT alpha, trial, 'standard', ok FROM d)
 SELECT p.alpha, p.method, count(c.truth) AS n_experiments, round(avg(c.truth), 6) AS mean_loss FROM p LEFT JOIN c ON c.alpha = p.alpha AND c.trial = p.trial AND c.tau = p.tau GROUP BY p.alpha, p.method""")
def risk_simulation(spark, d):
    """Losses that do not fall with the threshold: the scan from above against the first threshold that fits."""
    return _r(RD.simulate(spark, 30, 10, [0.2, 0.4], 10))


def _model(r: int):
    """A row's likelihood under model r: from the safe model towards the other one."""
    return (1 - r / 4) * F.col("s") + (r / 4) * F.col("u")


def policies(spark, d):
    """(log, calibration) of three rounds over proposals from the table."""
    cal = calibration(spark, d)

    def propose(r, seeds):
        own = cal.filter(F.col("id") % 4 == r).select("id", "score", "grp", F.array(*[_model(k) for k in range(r + 1)]).alias("liks"))
        return {"safe": own.filter("grp <> 'click'"), "unconstrained": own.filter("grp = 'click'")}

    likelihood = lambda r, rows: cal.select("id", _model(r).alias("lik"))  # noqa: E731  the join with the calibration rows keeps theirs
    start = cal.filter("id % 4 = 0").select("id", "score", _model(0).alias("lik"))
    return RD.improve(spark, start, propose, likelihood, 3, K.Search(0.6, 20), 50, 2000, 0.5)


@query("policy_rounds")
def policy_rounds(spark, d):
    """Rounds with their bounds; the tests recompute them by nested SQL."""
    return policies(spark, d)[0]


@query("active_learning_runs")
def active_learning_runs(spark, d):
    """Two runs over all line items; the tests hold such runs equal to plain loops."""
    li = table(spark, d, "lineitem")
    rows = li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), (F.col("l_quantity") / 50).alias("quantity"), (F.col("l_discount") * 10).alias("discount"), (F.col("l_tax") * 10).alias("tax"), (F.col("l_extendedprice") / 50_000).alias("price"), "l_returnflag")
    parts = AL.learning_parts(rows, ["quantity", "discount", "tax"], "price", F.col("l_returnflag") != "R", [1, 2], 200, 20, 60, 1.0)
    return AL.active_learning(parts, 4, AL.Learning(control="search", risk_alpha=0.6, level_rate=0.1))


@query("process_evidence", f"""WITH {CAL}, x AS (SELECT value / 100 AS x, ln(u) AS y FROM cal), s AS (SELECT count(*) AS n, sum(x * x) AS xx, sum(x) AS sx, sum(x * y) AS xy, sum(y) AS sy, sum(y * y) AS yy FROM x),
 g AS (SELECT * FROM (VALUES (0.01::DOUBLE), (0.1::DOUBLE), (1.0::DOUBLE), (10.0::DOUBLE)) a(noise), (VALUES (0.1::DOUBLE), (1.0::DOUBLE), (5.0::DOUBLE)) b("offset")),
 m AS (SELECT noise, "offset", n, yy, xx + noise AS a, "offset" * sx AS b, "offset" * "offset" * n + noise AS d, xy AS p, "offset" * sy AS q FROM s, g)
 SELECT noise, "offset", round(-0.5 * ((yy - (d * p * p - 2 * b * p * q + a * q * q) / (a * d - b * b)) / noise + ln(a * d - b * b) + (n - 2) * ln(noise) + n * ln(2 * pi())), 4) AS evidence FROM m""")
def process_evidence(spark, d):
    """Evidence of a linear kernel over a grid of noises and offsets."""
    rows = calibration(spark, d).select((F.col("value") / 100).alias("x"), F.ln("u").alias("y"))
    return RG.process_evidence(rows, ["x"], "y", [0.01, 0.1, 1.0, 10.0], [0.1, 1.0, 5.0]).withColumn("evidence", F.round("evidence", 4))


@query("parameter_follow", "SELECT * FROM (VALUES ('initial_seed=3 alpha=0.1 last_seed=3'), ('initial_seed=7 alpha=0.1 last_seed=7')) t(job)")
def parameter_follow(spark, d):
    from ..sources.io import parse_sweep

    grid = parse_sweep("initial_seed: [3, 7]\nalpha: [0.1]")
    rows = [(f"initial_seed={s} alpha={a} last_seed={s}",) for s in grid["initial_seed"] for a in grid["alpha"]]
    return spark.createDataFrame(rows, "job string")


@query("mean_hamming_of_rounds", f"""WITH {PART}, h AS (SELECT b.id % 5 AS round, CASE WHEN b.score = 3 THEN CAST('nan' AS DOUBLE) ELSE list_sum(list_transform(range(1, 9), lambda i: CASE WHEN a.particle[i] <> b.particle[i] THEN 1 ELSE 0 END)) / 8 END AS value FROM part8 a JOIN part8 b ON b.id = a.id + 1)
 SELECT round, round(avg(value) FILTER (WHERE NOT isnan(value)) / pi(), 6) AS mean FROM h GROUP BY round""")
def mean_hamming_of_rounds(spark, d):
    """Distances of each generated particle (here: of the next id) to the one it came from, without those of rows that are no particle."""
    p = particles(spark, d)
    source = p.select((F.col("id") + 1).alias("id"), F.col("particle").alias("source"))
    value = F.when(F.col("score") == 3, float("nan")).otherwise(A.hamming("source", "particle"))  # label 3 plays the rows that do not parse
    out = B.mean_distance(p.join(source, "id").select((F.col("id") % 5).alias("round"), value.alias("value")), "value", ("round",))
    return out.withColumn("mean", F.round(F.col("mean") / math.pi, 6))  # by pi, as finite decimals may lie on a rounding edge

