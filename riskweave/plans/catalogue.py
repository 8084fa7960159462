"""Every query of the engine, each beside its SQL."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import maths as M
from ..functions import text as T
from ..functions.named import LOSSES
from ..operators import claims as C
from ..operators import conformal as CF
from ..operators import likelihood as L
from ..operators import neighbors as N
from ..operators import rollup as R
from ..operators import sampling as S
from ..operators import search as G
from ..operators.ranking import with_totals
from ..semantics import INF, feasible, finite, greater, infeasible, list_text, md5_uniform, np_div
from .derive import CAL, CLAIMS, PART, RUNS, STATS, TAUS, calibration, claims, particles, runs, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


ALPHA, GRID = 0.25, 50
_GRID_SQL = """d AS (SELECT DISTINCT u / s AS beta FROM cal),
 k AS (SELECT greatest(CAST(floor(count(*) / 50) AS BIGINT), 1) AS k FROM d),
 grid AS (SELECT beta FROM (SELECT beta, row_number() OVER (ORDER BY beta) AS rn FROM d), k WHERE (rn - 1) % k = 0 UNION SELECT CAST('inf' AS DOUBLE))"""
_CURVE_SQL = f"""WITH {CAL}, {_GRID_SQL},
 w AS (SELECT beta, bad, least(u, CASE WHEN isinf(beta) THEN u ELSE beta * s END) / ((u + s) / 2) AS w FROM grid, cal),
 curve AS (SELECT beta, (sum(CASE WHEN bad THEN w ELSE 0 END) + max(w)) / (sum(w) + max(w)) AS risk FROM w GROUP BY beta)"""
_FIRST_SQL = """, m AS (SELECT beta, risk, lag(beta) OVER (ORDER BY beta) AS pb, lag(risk) OVER (ORDER BY beta) AS pr FROM curve),
 f AS (SELECT min(beta) AS b FROM m WHERE risk > 0.25)"""


def _ratio_grid(spark, d):
    cal = calibration(spark, d)
    return cal, G.grid_values(G.coarse_grid(cal.withColumn("lr", F.col("u") / F.col("s")), "lr", GRID, "unconstrained"))


@query("flagship_beta_search", _CURVE_SQL + _FIRST_SQL + """
SELECT round(CASE WHEN f.b IS NULL THEN (SELECT max(beta) FROM m) ELSE coalesce(m.pb, m.beta) END, 6) AS selected,
       round(CASE WHEN f.b IS NULL THEN (SELECT max_by(risk, beta) FROM m) ELSE coalesce(m.pr, m.risk) END, 6) AS risk_selected
FROM f LEFT JOIN m ON m.beta = f.b""")  # fmt: skip
def flagship_beta_search(spark, d):
    """The last capped bound whose weighted conformal risk stays under control."""
    cal, betas = _ratio_grid(spark, d)
    return G.first_violation(G.risk_curve(cal, betas), ALPHA).select(r6("selected").alias("selected"), r6("risk_selected").alias("risk_selected"))


@query("beta_risk_curve", _CURVE_SQL + " SELECT round(beta, 6) AS beta, round(risk, 6) AS risk FROM curve WHERE NOT isinf(beta)")
def beta_risk_curve(spark, d):
    cal, betas = _ratio_grid(spark, d)
    return G.risk_curve(cal, betas).filter(F.col("beta") != INF).select(r6("beta").alias("beta"), r6("risk").alias("risk"))


@query("coarse_grid", f"WITH {CAL}, {_GRID_SQL} SELECT round(beta, 9) AS beta FROM grid WHERE NOT isinf(beta)")
def coarse_grid(spark, d):
    return G.coarse_grid(calibration(spark, d).withColumn("lr", F.col("u") / F.col("s")), "lr", GRID).select(F.round("beta", 9).alias("beta"))


@query("grid_end_points", "SELECT * FROM (VALUES ('mixed', 2), ('safe', 1), ('unconstrained', 1)) t(proposal, ends)")
def grid_end_points(spark, d):
    return spark.createDataFrame([(p, len(a) + len(b)) for p, (a, b) in G.ENDS.items()], "proposal string, ends int")


@query("linspace_grid", f"WITH {CAL}, r AS (SELECT min(ln(u / s)) AS lo, max(ln(u / s)) AS hi FROM cal) SELECT pos, round(lo + pos * (hi - lo) / 20, 6) AS beta FROM r, range(21) t(pos)")
def linspace_grid(spark, d):
    lo, hi = calibration(spark, d).select(F.min(F.ln(F.col("u") / F.col("s"))), F.max(F.ln(F.col("u") / F.col("s")))).first()
    return G.linspace_grid(spark, lo, hi, 21).select("pos", r6("beta").alias("beta"))


@query("cap_likelihoods_init", f"WITH {CAL} SELECT id, round(CASE WHEN u / s < 2.0 THEN u / 1.5 ELSE s * 2.0 / 1.5 END, 9) AS con_lik_r1 FROM cal")
def cap_likelihoods_init(spark, d):
    return calibration(spark, d).select("id", F.round(M.cap_first(F.col("s"), F.col("u"), 2.0, 1.5), 9).alias("con_lik_r1"))


@query("cap_likelihoods_chain", f"WITH {CAL}, a AS (SELECT id, s AS c0, least(u, s * 2.0) / 1.1 AS c1, value / 50 + 0.1 AS l2 FROM cal) SELECT id, round(c0, 9) AS con_lik_r0, round(c1, 9) AS con_lik_r1, round(least(l2, c1 * 3.0) / 1.2, 9) AS con_lik_r2 FROM a")
def cap_likelihoods_chain(spark, d):
    chain = M.cap_chain(F.array("s", "u", F.col("value") / 50 + 0.1), [0.0, 2.0, 3.0], [1.0, 1.1, 1.2])
    return calibration(spark, d).select("id", chain.alias("c")).select("id", *[F.round(F.get("c", F.lit(i)), 9).alias(f"con_lik_r{i}") for i in range(3)])


@query("mixture_density", f"WITH {CAL} SELECT id, round((s * 5 + u * 3 + (value / 50 + 0.1) * 2) / 10, 9) AS density FROM cal")
def mixture_density(spark, d):
    parts = F.array(*[F.struct(F.col(c).alias("lik"), F.lit(n).alias("n")) for c, n in (("s", 5), ("u", 3), ("l2", 2))])
    long = calibration(spark, d).withColumn("l2", F.col("value") / 50 + 0.1).select("id", F.explode(parts).alias("p")).select("id", "p.lik", "p.n")
    return L.mixture_density(long, "id", "lik", "n").select("id", F.round("density", 9).alias("density"))


@query("norm_const_by_proposal", f"WITH {CAL} SELECT grp, round(avg(least(u / s, 2.0)), 6) AS psi_safe, round(avg(least(2.0 / (u / s), 1.0)), 6) AS psi_unconstrained FROM cal GROUP BY grp")
def norm_const_by_proposal(spark, d):
    lr = F.col("u") / F.col("s")
    return calibration(spark, d).groupBy("grp").agg(r6(L.normaliser(lr, 2.0, "safe")).alias("psi_safe"), r6(L.normaliser(lr, 2.0, "unconstrained")).alias("psi_unconstrained"))


@query("overlap_by_proposal", f"WITH {CAL} SELECT grp, round(avg(least(least(s * 2.0 / 1.3, u / 1.3), s) / s), 6) AS overlap_safe, round(avg(least(least(s * 2.0 / 1.3, u / 1.3), u) / u), 6) AS overlap_unconstrained FROM cal GROUP BY grp")
def overlap_by_proposal(spark, d):
    return calibration(spark, d).groupBy("grp").agg(*[r6(L.overlap(F.col("u"), F.col("s"), 2.0, 1.3, p)).alias(f"overlap_{p}") for p in ("safe", "unconstrained")])


@query("envelope_constant", f"WITH {CAL} SELECT grp, round(max(least(u, 2.0 * s) / ((u + s) / 2)) * 1.1, 6) AS envelope FROM cal GROUP BY grp")
def envelope_constant(spark, d):
    return calibration(spark, d).groupBy("grp").agg(r6(F.max(F.least(F.col("u"), 2.0 * F.col("s")) / ((F.col("u") + F.col("s")) / 2)) * 1.1).alias("envelope"))


@query("mixture_weight", f"WITH {CAL}, p AS (SELECT grp, avg(least(u / s, 2.0)) AS a, avg(least(2.0 / (u / s), 1.0)) AS b FROM cal GROUP BY grp) SELECT grp, round(a / (a + b), 6) AS by_overlap, round(1 / (1 + a), 6) AS by_beta, 0.0::DOUBLE AS uncontrolled FROM p")
def mixture_weight(spark, d):
    lr = F.col("u") / F.col("s")
    p = calibration(spark, d).groupBy("grp").agg(L.normaliser(lr, 2.0, "safe").alias("a"), L.normaliser(lr, 2.0, "unconstrained").alias("b"))
    return p.select("grp", r6(M.mixture_weight(0.1, F.col("a"), F.col("a"), F.col("b"))).alias("by_overlap"), r6(M.mixture_weight(0.1, F.col("a"))).alias("by_beta"), M.mixture_weight(1.0, F.col("a")).alias("uncontrolled"))


@query("acceptance_probabilities", f"WITH {CAL} SELECT id, round(least(1, 2.0 / (u / s)) / pi(), 9) AS unconstrained, round(least(1, (u / s) / 2.0) / pi(), 9) AS safe, round(least(1, least(u, 2 * s) / ((0.3 * s + 0.7 * u) * 1.5)) / pi(), 9) AS mixture FROM cal")
def acceptance_probabilities(spark, d):
    # divided by pi, as finite decimals may lie on a rounding edge
    lr = F.col("u") / F.col("s")
    mixed = M.accept_mixture(F.least(F.col("u"), 2 * F.col("s")), 0.3 * F.col("s") + 0.7 * F.col("u"), 1.5)
    return calibration(spark, d).select("id", *[F.round(c / math.pi, 9).alias(n) for n, c in (("unconstrained", M.accept_unconstrained(lr, 2.0)), ("safe", M.accept_safe(lr, 2.0)), ("mixture", mixed))])


_PAIR_SQL = f"""WITH {PART},
 p AS (SELECT a.id AS x, b.id AS y, list_sum(list_transform(range(1, 9), lambda i: CASE WHEN a.particle[i] <> b.particle[i] THEN 1 ELSE 0 END)) / 8 AS dist FROM part8 a JOIN part8 b ON a.id <> b.id),
 n AS (SELECT x AS src, y AS dst, dist FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY dist, y) AS rn FROM p WHERE dist <= 0.5) WHERE rn <= 30)"""
DIM, WITHIN, NEAREST = 8, 0.5, 30


@query("neighbour_pairs", _PAIR_SQL + " SELECT src, dst, CAST(dist AS DOUBLE) AS dist FROM n")
def neighbour_pairs(spark, d):
    return N.neighbours(particles(spark, d), DIM, WITHIN, NEAREST)


_DENSE_SQL = _PAIR_SQL + """, q AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM n),
 o AS (SELECT CASE WHEN (x.score, x.id) < (y.score, y.id) THEN x.id ELSE y.id END AS lower_id, CASE WHEN (x.score, x.id) < (y.score, y.id) THEN y.id ELSE x.id END AS higher_id,
   least(x.score, y.score) AS lower_score, greatest(x.score, y.score) AS higher_score FROM q JOIN part8 x ON x.id = a JOIN part8 y ON y.id = b WHERE x.score <> y.score)"""


@query("dense_pairs", _DENSE_SQL + " SELECT * FROM o")
def dense_pairs(spark, d):
    return N.dense_pairs(particles(spark, d), DIM, WITHIN, NEAREST)


@query("dense_pairs_xy", _DENSE_SQL + " SELECT * FROM o WHERE abs(higher_score - lower_score) <= 2")
def dense_pairs_xy(spark, d):
    return N.dense_pairs(particles(spark, d), DIM, WITHIN, NEAREST, 2.0)


@query("minimal_edit_pairs", _PAIR_SQL + """ SELECT src, dst, CAST(dist AS DOUBLE) AS dist FROM (SELECT n.*, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS r FROM n JOIN part8 a ON a.id = src JOIN part8 b ON b.id = dst WHERE a.score <> b.score) WHERE r = 1""")
def minimal_edit_pairs(spark, d):
    return N.minimal_edits(particles(spark, d), DIM, WITHIN, NEAREST)


@query("preference_triples", _PAIR_SQL + """, e AS (SELECT src, dst, a.score AS s, b.score AS t FROM n JOIN part8 a ON a.id = src JOIN part8 b ON b.id = dst),
 j AS (SELECT src, dst FROM e WHERE t >= s UNION SELECT id, id FROM part8)
 SELECT DISTINCT c.src AS prompt, c.dst AS chosen, j.dst AS rejected FROM e c JOIN j ON j.src = c.src WHERE c.t < c.s""")  # fmt: skip
def preference_triples(spark, d):
    return N.preference_triples(particles(spark, d), DIM, WITHIN, NEAREST)


@query("dedup_particles", f"WITH {PART} SELECT min(id) AS id, particle FROM part8 GROUP BY particle")
def dedup_particles(spark, d):
    return N.dedup_first(particles(spark, d)).select("id", "particle")


_NEXT = "JOIN part8 b ON b.id = a.id + 1"


def _next(spark, d):
    p = particles(spark, d)
    return p.join(p.select((F.col("id") - 1).alias("id"), F.col("particle").alias("other")), "id")


@query("hamming_distance", f"WITH {PART} SELECT a.id, CAST(list_sum(list_transform(range(1, 9), lambda i: CASE WHEN a.particle[i] <> b.particle[i] THEN 1 ELSE 0 END)) / 8 AS DOUBLE) AS dist FROM part8 a {_NEXT}")
def hamming_distance(spark, d):
    return _next(spark, d).select("id", A.hamming("particle", "other").alias("dist"))


@query("euclid_distance", f"WITH {PART} SELECT a.id, round(sqrt(list_sum(list_transform(range(1, 9), lambda i: (a.particle[i] - b.particle[i]) ** 2))), 9) AS l2, CAST(list_sum(list_transform(range(1, 9), lambda i: abs(a.particle[i] - b.particle[i]))) AS DOUBLE) AS l1 FROM part8 a {_NEXT}")
def euclid_distance(spark, d):
    return _next(spark, d).select("id", F.round(A.euclidean("particle", "other"), 9).alias("l2"), A.manhattan("particle", "other").alias("l1"))


@query("farthest_first", f"""WITH RECURSIVE {PART}, f(pos, ids) AS (SELECT 0, [(SELECT id FROM part8 ORDER BY score, id LIMIT 1)] UNION ALL
 SELECT pos + 1, list_append(ids, (SELECT p.id FROM part8 p, (SELECT unnest(ids) AS c) t JOIN part8 q ON q.id = t.c WHERE NOT list_contains(ids, p.id)
  GROUP BY p.id, p.score ORDER BY min(list_sum(list_transform(range(1, 9), lambda i: CASE WHEN p.particle[i] <> q.particle[i] THEN 1 ELSE 0 END))) DESC, p.score, p.id LIMIT 1)) FROM f WHERE pos < 3)
 SELECT unnest(ids) AS id, CAST(unnest(range(4)) AS INTEGER) AS pos FROM f WHERE pos = 3""")  # fmt: skip
def farthest_first(spark, d):
    return N.farthest_first(particles(spark, d), 4)


@query("farthest_first_manhattan", f"""WITH RECURSIVE {PART}, f(pos, ids) AS (SELECT 0, [(SELECT id FROM part8 ORDER BY score, id LIMIT 1)] UNION ALL
 SELECT pos + 1, list_append(ids, (SELECT p.id FROM part8 p, (SELECT unnest(ids) AS c) t JOIN part8 q ON q.id = t.c WHERE NOT list_contains(ids, p.id)
  GROUP BY p.id, p.score ORDER BY min(list_sum(list_transform(range(1, 9), lambda i: abs(p.particle[i] - q.particle[i])))) DESC, p.score, p.id LIMIT 1)) FROM f WHERE pos < 3)
 SELECT unnest(ids) AS id, CAST(unnest(range(4)) AS INTEGER) AS pos FROM f WHERE pos = 3""")  # fmt: skip
def farthest_first_manhattan(spark, d):
    return N.farthest_first(particles(spark, d), 4, "manhattan")


@query("filter_score_floor", f"WITH {CAL} SELECT id FROM cal WHERE score > 50 AND NOT isnan(score)")
def filter_score_floor(spark, d):
    return calibration(spark, d).filter(greater(F.col("score"), 50)).select("id")


@query("filter_lik_quantile", f"WITH {CAL}, q AS (SELECT quantile_cont(u, 0.3) AS q FROM cal) SELECT id FROM cal, q WHERE u >= q")
def filter_lik_quantile(spark, d):
    return S.quantile_filter(calibration(spark, d), "u", 0.3).select("id")


@query("filter_lik_range", f"WITH {CAL}, q AS (SELECT quantile_cont(u, 0.2) AS a, quantile_cont(u, 0.8) AS b FROM cal) SELECT id FROM cal, q WHERE u BETWEEN a AND b")
def filter_lik_range(spark, d):
    return S.quantile_filter(calibration(spark, d), "u", 0.2, 0.8).select("id")


def _md5(seed):
    return f"md5('{seed}:' || id)"


@query("cap_infeasible", f"""WITH {CAL}, c AS (SELECT round_even(count(*) * 0.1 / 0.9, 0) AS cap FROM cal WHERE isfinite(score)),
 b AS (SELECT id, row_number() OVER (ORDER BY {_md5(3)}, id) AS rn FROM cal WHERE NOT isfinite(score)) SELECT id FROM cal WHERE isfinite(score) UNION ALL SELECT id FROM b, c WHERE rn <= cap""")
def cap_infeasible(spark, d):
    return S.cap_infeasible(calibration(spark, d), 0.1, 3).select("id")


_BEST = "ORDER BY NOT isfinite(score), score, id LIMIT"


@query("seed_mix_best", f"""WITH {CAL}, o AS (SELECT * FROM cal WHERE grp = 'click'), n AS (SELECT * FROM cal WHERE grp <> 'click')
 SELECT id FROM (SELECT id FROM o {_BEST} 40) UNION ALL SELECT id FROM (SELECT id FROM n {_BEST} 160)""")
def seed_mix_best(spark, d):
    cal = calibration(spark, d)
    return S.seed_mix(cal.filter("grp = 'click'"), cal.filter("grp <> 'click'"), 200, 0.2).select("id")


@query("seed_mix_uniform", f"WITH {CAL} SELECT id FROM cal ORDER BY {_md5(7)}, id LIMIT 150")
def seed_mix_uniform(spark, d):
    return S.uniform(calibration(spark, d), 150, 7).select("id")


@query("seed_combination", f"WITH {CAL} SELECT id FROM (SELECT id FROM cal {_BEST} 50) UNION ALL SELECT id FROM (SELECT id FROM cal ORDER BY {_md5(7)}, id LIMIT 50)")
def seed_combination(spark, d):
    return S.combination(calibration(spark, d), 100, 7).select("id")


@query("largest_scoring", f"WITH {CAL} SELECT id FROM cal ORDER BY isnan(score), score DESC, id LIMIT 700")
def largest_scoring(spark, d):
    return S.largest_scoring(calibration(spark, d), 700).select("id")


@query("cal_train_split", f"WITH {CAL}, r AS (SELECT id, row_number() OVER (ORDER BY {_md5(11)}, id) AS rn, count(*) OVER () AS n FROM cal) SELECT id, CASE WHEN rn <= round_even(n * 0.3, 0) THEN 'cal' ELSE 'train' END AS part FROM r")
def cal_train_split(spark, d):
    cal, train = S.calibration_split(calibration(spark, d), 0.3, 11)
    return cal.select("id", F.lit("cal").alias("part")).union(train.select("id", F.lit("train").alias("part")))


@query("old_data_mix", f"WITH {CAL} SELECT id, grp FROM (SELECT id, grp, row_number() OVER (PARTITION BY grp ORDER BY {_md5(5)}, id) AS rn FROM cal) WHERE rn <= 40")
def old_data_mix(spark, d):
    return S.old_data_mix(calibration(spark, d), "grp", 5, 1000, 0.2, 100, 5).select("id", "grp")


_QUALITY = """count(*) AS n, count(*) FILTER (WHERE NOT isnan(score)) AS n_parsable, count(*) FILTER (WHERE isfinite(score)) AS n_feasible,
 round(count(*) FILTER (WHERE isfinite(score)) / count(*), 6) AS fraction_feasible, round(avg(score) FILTER (WHERE isfinite(score)), 6) AS mean_score, min(score) FILTER (WHERE isfinite(score)) AS min_score, max(score) FILTER (WHERE isfinite(score)) AS max_score"""


def _rounded(df):
    return df.withColumns({c: r6(c) for c in ("fraction_feasible", "mean_score")})


@query("sample_quality", f"WITH {CAL} SELECT grp, {_QUALITY} FROM cal GROUP BY grp")
def sample_quality(spark, d):
    return _rounded(S.sample_quality(calibration(spark, d), by=("grp",)))


_U = "CAST(('0x' || substr(md5('{0}:' || id), 1, 12))::BIGINT AS DOUBLE) / 281474976710656.0"


@query("accepted_vs_rejected_quality", f"WITH {CAL}, a AS (SELECT *, {_U.format(13)} < least(1, 2.0 / (u / s)) AS accepted FROM cal) SELECT accepted, {_QUALITY} FROM a GROUP BY accepted")
def accepted_vs_rejected_quality(spark, d):
    cal = calibration(spark, d).withColumn("accepted", md5_uniform(13, "id") < M.accept_unconstrained(F.col("u") / F.col("s"), 2.0))
    return _rounded(S.sample_quality(cal, by=("accepted",)))


_JUDGED = f"judged AS (SELECT *, {_U.format(13)} < least(1, 2.0 / (u / s)) AS accepted FROM cal), b AS (SELECT *, coalesce(sum(CASE WHEN accepted THEN 1 ELSE 0 END) OVER (PARTITION BY grp ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM judged)"


@query("ar_accept_stage", f"WITH {CAL}, {_JUDGED} SELECT id, grp, accepted FROM b WHERE before < 100")
def ar_accept_stage(spark, d):
    lr = F.col("u") / F.col("s")
    return S.accept_until(calibration(spark, d), M.accept_unconstrained(lr, 2.0), md5_uniform(13, "id"), 100, "grp", ["id"]).select("id", "grp", "accepted")


@query("acceptance_rate", f"WITH {CAL}, {_JUDGED} SELECT grp, count(*) FILTER (WHERE accepted) AS n_accepted, count(*) AS n_proposals, round(count(*) FILTER (WHERE accepted) / greatest(count(*), 1), 6) AS rate FROM b WHERE before < 100 GROUP BY grp")
def acceptance_rate(spark, d):
    return ar_accept_stage(spark, d).groupBy("grp").agg(F.count_if("accepted").alias("n_accepted"), F.count("*").alias("n_proposals"), r6(F.count_if("accepted") / F.greatest(F.count("*"), F.lit(1))).alias("rate"))


@query("imh_chain", f"""WITH RECURSIVE {CAL}, o AS (SELECT user_id, id, least(u, 2 * s) AS t, u AS p, {_U.format(17)} AS d, row_number() OVER (PARTITION BY user_id ORDER BY id) AS rn FROM cal),
 f AS (SELECT user_id, id, rn, t, p, true AS accepted FROM o WHERE rn = 1 UNION ALL
  SELECT user_id, id, rn, CASE WHEN ok THEN nt ELSE t END, CASE WHEN ok THEN np ELSE p END, ok FROM (SELECT o.user_id, o.id, o.rn, f.t, f.p, o.t AS nt, o.p AS np, o.d < least(1, (o.t / f.t) * (f.p / o.p)) AS ok FROM f JOIN o ON o.user_id = f.user_id AND o.rn = f.rn + 1))
 SELECT user_id, id, accepted FROM f""")
def imh_chain(spark, d):
    """Independent Metropolis-Hastings per user: each row against the last accepted one."""
    rows = calibration(spark, d).select("user_id", "id", F.least(F.col("u"), 2 * F.col("s")).alias("target"), "u", md5_uniform(17, "id").alias("draw"))
    return S.metropolis_chain(rows, "user_id", "id", "target", "u", "draw")


_LOSS = f"""{CLAIMS}, grid AS (SELECT i / 10 AS tau FROM range(11) t(i)),
 l AS (SELECT response, tau, coalesce(avg(CASE WHEN supported THEN 0 ELSE 1 END) FILTER (WHERE score >= tau), 0) AS loss, coalesce(CAST(max(CASE WHEN supported THEN 0 ELSE 1 END) FILTER (WHERE score >= tau) AS DOUBLE), 0) AS any_loss,
  CASE WHEN count(*) FILTER (WHERE supported) = 0 THEN 0 ELSE count(*) FILTER (WHERE supported AND score > tau) / count(*) FILTER (WHERE supported) END AS recall FROM claims, grid GROUP BY response, tau),
 mono AS (SELECT response, tau, max(loss) OVER (PARTITION BY response ORDER BY tau DESC) AS loss FROM l)"""


def _risk_sql(source, column="loss"):
    return f"c AS (SELECT tau, count(*) AS n, avg({column}) AS mean, (sum({column}) + 1) / (count(*) + 1) AS risk FROM {source} GROUP BY tau)"


_DESC = """, m AS (SELECT tau, risk, lag(tau) OVER (ORDER BY tau DESC) AS pt, lag(risk) OVER (ORDER BY tau DESC) AS pr FROM c), f AS (SELECT max(tau) AS t FROM m WHERE risk > {0})
 SELECT round(CASE WHEN f.t IS NULL THEN (SELECT min(tau) FROM m) ELSE coalesce(m.pt, m.tau) END, 6) AS tau, round(CASE WHEN f.t IS NULL THEN (SELECT min_by(risk, tau) FROM m) ELSE coalesce(m.pr, m.risk) END, 6) AS risk FROM f LEFT JOIN m ON m.tau = f.t"""


def _losses(spark, d, kind="rate"):
    return C.threshold_losses(claims(spark, d), TAUS, kind)


def _r(df):
    return df.select(*[r6(c).alias(c) if t == "double" else c for c, t in df.dtypes])


@query("gcrc_threshold", f"WITH {_LOSS}, {_risk_sql('l')}" + _DESC.format(0.2))
def gcrc_threshold(spark, d):
    return _r(C.gcrc(_losses(spark, d), 0.2))


@query("monotised_crc_threshold", f"WITH {_LOSS}, {_risk_sql('mono')}" + _DESC.format(0.2))
def monotised_crc_threshold(spark, d):
    return _r(C.monotised_crc(_losses(spark, d), 0.2))


@query("standard_crc_threshold", f"WITH {_LOSS}, {_risk_sql('l')} SELECT round(min(tau), 6) AS tau, round(min_by(risk, tau), 6) AS risk FROM c WHERE risk <= 0.2")
def standard_crc_threshold(spark, d):
    return _r(C.standard_crc(_losses(spark, d), 0.2))


@query("any_loss_threshold", f"WITH {_LOSS}, {_risk_sql('l', 'any_loss')}" + _DESC.format(0.3))
def any_loss_threshold(spark, d):
    return _r(C.gcrc(_losses(spark, d, "any"), 0.3))


@query("ltt_threshold", f"""WITH {_LOSS}, {_risk_sql('l')}, b AS (SELECT tau, n, mean, CAST(ceil(n * mean - 1e-9) AS BIGINT) AS k FROM c),
 t AS (SELECT tau, n, mean, least((SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(0.2) + (n - j) * ln(0.8))) FROM range(0, (SELECT max(k) + 1 FROM b)) r(j) WHERE j <= k AND j <= n), 1) AS cdf FROM b),
 h AS (SELECT tau, mean AS risk, least(exp(1) * cdf, CASE WHEN mean > 0 THEN exp(-n * (least(mean, 0.2) * ln(least(mean, 0.2) / 0.2) + (1 - least(mean, 0.2)) * ln((1 - least(mean, 0.2)) / 0.8))) ELSE exp(1) * cdf END) AS p FROM t),
 m AS (SELECT tau, risk, p, lag(tau) OVER (ORDER BY tau DESC) AS pt, lag(risk) OVER (ORDER BY tau DESC) AS pr FROM h), f AS (SELECT max(tau) AS t FROM m WHERE p > 0.1)
 SELECT round(CASE WHEN f.t IS NULL THEN (SELECT min(tau) FROM m) ELSE coalesce(m.pt, m.tau) END, 6) AS tau, round(CASE WHEN f.t IS NULL THEN (SELECT min_by(risk, tau) FROM m) ELSE coalesce(m.pr, m.risk) END, 6) AS risk FROM f LEFT JOIN m ON m.tau = f.t""")
def ltt_threshold(spark, d):
    """Learn-then-test with the Hoeffding-Bentkus p-value."""
    return _r(C.learn_then_test(_losses(spark, d), 0.2, 0.1))


@query("claim_fdr_by_tau", f"WITH {_LOSS} SELECT CAST(tau AS DOUBLE) AS tau, count(*) AS n, round(avg(loss), 6) AS fdr, round((sum(loss) + 1) / (count(*) + 1), 6) AS risk FROM l GROUP BY tau")
def claim_fdr_by_tau(spark, d):
    return C.risks(_losses(spark, d)).select("tau", "n", r6("mean").alias("fdr"), r6("risk").alias("risk"))


@query("risks_by_loss_name", f"WITH {_LOSS}, a AS (SELECT tau, CASE WHEN loss > 0 THEN 1 ELSE 0 END AS loss FROM l) SELECT name, CAST(tau AS DOUBLE) AS tau, round((sum(loss) + 1) / (count(*) + 1) / pi(), 6) AS risk FROM (SELECT 'any' AS name, tau, loss FROM a UNION ALL SELECT 'rate', tau, loss FROM l) GROUP BY name, tau")
def risks_by_loss_name(spark, d):
    """The risk of every named loss at every threshold."""
    each = [C.risks(_losses(spark, d, name)).select(F.lit(name).alias("name"), "tau", F.round(F.col("risk") / math.pi, 6).alias("risk")) for name in LOSSES.names()]
    return reduce(DataFrame.unionByName, each)


@query("claim_recall_by_tau", f"WITH {_LOSS} SELECT CAST(tau AS DOUBLE) AS tau, round(avg(recall), 6) AS recall FROM l GROUP BY tau")
def claim_recall_by_tau(spark, d):
    return _losses(spark, d).groupBy("tau").agg(r6(F.avg("recall")).alias("recall"))


@query("trial_summary", f"""WITH {_LOSS}, t AS (SELECT trial, tau, (sum(loss) + 1) / (count(*) + 1) AS risk FROM l, range(5) r(trial) WHERE CAST(('0x' || substr(md5(trial || ':' || response), 1, 12))::BIGINT AS DOUBLE) / 281474976710656.0 < 0.5 GROUP BY trial, tau),
 s AS (SELECT trial, min(tau) AS tau FROM t WHERE risk <= 0.2 GROUP BY trial) SELECT count(*) AS n_trials, round(avg(tau), 6) AS tau_mean, round(stddev_pop(tau), 6) AS tau_std FROM s""")
def trial_summary(spark, d):
    """Random halves of the responses: the loss table is made once and shared by all trials."""
    losses = _losses(spark, d).select("response", "tau", "loss")
    trials = F.explode(F.array(*[F.lit(i) for i in range(5)]))
    split = losses.select("*", trials.alias("trial"))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("trial").cast("string"), F.col("response").cast("string"))), 1, 12), 16, 10).cast("double") / float(2**48)
    risk = split.filter(draw < 0.5).groupBy("trial", "tau").agg(((F.sum("loss") + 1) / (F.count("*") + 1)).alias("risk"))
    best = risk.filter("risk <= 0.2").groupBy("trial").agg(F.min("tau").alias("tau"))
    return best.agg(F.count("*").alias("n_trials"), r6(F.avg("tau")).alias("tau_mean"), r6(F.stddev_pop("tau")).alias("tau_std"))


_WQ = f"""WITH {CAL}, t AS (SELECT grp, id, value AS v, u / sum(u) OVER (PARTITION BY grp) AS w FROM cal),
 c AS (SELECT grp, v, w, round(sum(w) OVER (PARTITION BY grp ORDER BY v, w, id ROWS UNBOUNDED PRECEDING), 12) AS c, lag(v) OVER (PARTITION BY grp ORDER BY v, w, id) AS pv, lag(w) OVER (PARTITION BY grp ORDER BY v, w, id) AS pw, row_number() OVER (PARTITION BY grp ORDER BY v, w, id) AS rn FROM t),
 h AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY grp ORDER BY CASE WHEN c >= {{0}} THEN rn END) = 1)"""


def _weighted(spark, d, q):
    cal = calibration(spark, d)
    return CF.weighted_quantile(with_totals(cal, ["grp"], {"t": F.sum("u")}).select("grp", "id", F.col("value").alias("v"), (F.col("u") / F.col("t")).alias("w")), q, "grp").select("grp", r6("quantile").alias("quantile"))


@query("weighted_quantile_upper", _WQ.format(0.9) + " SELECT grp, round(v, 6) AS quantile FROM h")
def weighted_quantile_upper(spark, d):
    return _weighted(spark, d, 0.9)


@query("weighted_quantile_lower", _WQ.format(0.1) + " SELECT grp, round(CASE WHEN pv IS NULL OR c = 0.1 THEN v ELSE pv END, 6) AS quantile FROM h")
def weighted_quantile_lower(spark, d):
    return _weighted(spark, d, 0.1)


@query("weighted_quantile_median", _WQ.format(0.5) + " SELECT grp, round(CASE WHEN pv IS NULL OR c = 0.5 THEN v ELSE (v * w + pv * pw) / (w + pw) END, 6) AS quantile FROM h")
def weighted_quantile_median(spark, d):
    return _weighted(spark, d, 0.5)


@query("split_cp_interval", f"WITH {CAL}, r AS (SELECT grp, abs(value - 50) AS e, row_number() OVER (PARTITION BY grp ORDER BY abs(value - 50), id) AS rn, count(*) OVER (PARTITION BY grp) AS n FROM cal) SELECT grp, n, round(max(CASE WHEN rn = ceil((1 - 0.1) * (n + 1)) THEN e END), 6) AS quantile FROM r GROUP BY grp, n")
def split_cp_interval(spark, d):
    cal = calibration(spark, d).withColumn("e", F.abs(F.col("value") - 50))
    return _r(CF.split_quantile(cal, "e", "grp", 0.1))


_MF = f"WITH {CAL}, t AS (SELECT grp, sum(s) AS b, sum(value / 50) AS c, sum(s * value / 50) AS bc FROM cal GROUP BY grp)"


@query("mfcs_weights_d2", _MF + " SELECT id, round(u * (b - s), 4) AS weight FROM cal JOIN t USING (grp)")
def mfcs_weights_d2(spark, d):
    return CF.mfcs_weights(calibration(spark, d).withColumn("c", F.col("value") / 50), 2, "grp", "u", "s", "c").select("id", F.round("weight", 4).alias("weight"))


@query("mfcs_weights_d3", _MF + " SELECT id, round(u * ((b - s) * (c - value / 50) - (bc - s * value / 50)) / 1e6, 5) AS weight FROM cal JOIN t USING (grp)")
def mfcs_weights_d3(spark, d):
    return CF.mfcs_weights(calibration(spark, d).withColumn("c", F.col("value") / 50), 3, "grp", "u", "s", "c").select("id", F.round(F.col("weight") / 1e6, 5).alias("weight"))


_BOUNDS = [i / 4 - 3 for i in range(25)]


@query("pool_beta_search", f"""WITH {CAL}, g AS (SELECT i / 4 - 3 AS bound FROM range(25) t(i)),
 w AS (SELECT bound, id % 3 = 0 AS pool, bad, CASE WHEN ln(u / s) < bound THEN u ELSE exp(bound) * s END AS w FROM g, cal),
 p AS (SELECT bound, sum(w) FILTER (WHERE pool) AS t, max(w) FILTER (WHERE pool) AS m, sum(w) FILTER (WHERE NOT pool AND bad) AS b, sum(w) FILTER (WHERE NOT pool) AS e FROM w GROUP BY bound),
 c AS (SELECT bound, (b / t + m / t) / (e / t + m / t) AS risk FROM p) SELECT round(bound, 6) AS bound, round(risk, 6) AS risk FROM c""")
def pool_beta_search(spark, d):
    cal = calibration(spark, d)
    return _r(G.pool_risk_curve(cal.filter("id % 3 <> 0"), cal.filter("id % 3 = 0"), _BOUNDS))


@query("cdt_controller", f"WITH {CAL} SELECT id, round(CAST(1 AS DOUBLE) + coalesce(sum(CAST(CASE WHEN isfinite(score) THEN 0.05 * 0.2 ELSE 0.05 * (0.2 - 1) END AS DOUBLE)) OVER (PARTITION BY user_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS level FROM cal")
def cdt_controller(spark, d):
    return CF.additive_controller(calibration(spark, d), "user_id", "id", feasible("score"), 0.2, 0.05, 1.0).select("id", r6("level").alias("level"))


@query("aci_controller", f"""WITH RECURSIVE {CAL}, o AS (SELECT user_id, id, CASE WHEN bad THEN 1.0 ELSE 0.0 END AS m, row_number() OVER (PARTITION BY user_id ORDER BY id) AS rn FROM cal),
 f AS (SELECT user_id, id, rn, m, CAST(0.1 AS DOUBLE) AS level FROM o WHERE rn = 1 UNION ALL SELECT o.user_id, o.id, o.rn, o.m, least(1, greatest(0, f.level + 0.05 * (0.1 - f.m))) FROM f JOIN o ON o.user_id = f.user_id AND o.rn = f.rn + 1)
 SELECT user_id, id AS step, round(level, 6) AS level FROM f""")
def aci_controller(spark, d):
    return _r(CF.clipped_controller(calibration(spark, d), "user_id", "id", "bad", 0.1, 0.05))


@query("sweep_rollup", f"WITH {RUNS}, {STATS} SELECT alpha, seed, round, n_total, n_feasible, round(frac_infeasible, 6) AS frac_infeasible, round(mean_score, 6) AS mean_score, round(max_score, 6) AS max_score FROM stats")
def sweep_rollup(spark, d):
    return _r(R.run_stats(runs(spark, d), ["alpha", "seed", "round"]))


_DENSE = f"""WITH {RUNS}, {STATS}, s0 AS (SELECT * FROM stats WHERE NOT (alpha = 2 AND round = 0)), sp AS (SELECT * FROM (SELECT DISTINCT alpha FROM s0), (SELECT DISTINCT seed FROM s0), (SELECT DISTINCT round FROM s0)),
 j AS (SELECT sp.*, s0.max_score AS v FROM sp LEFT JOIN s0 USING (alpha, seed, round)),
 dense AS (SELECT alpha, seed, round, CASE WHEN round = 0 THEN coalesce(v, first_value(v IGNORE NULLS) OVER (PARTITION BY seed, round ORDER BY alpha ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) ELSE v END AS v FROM j)"""


def _dense(spark, d):
    stats = R.run_stats(runs(spark, d), ["alpha", "seed", "round"]).filter("not (alpha = 2 and round = 0)")
    return R.fill_first_round(stats.select("alpha", "seed", "round", F.col("max_score").alias("v")), "v")


@query("sweep_fill", _DENSE + " SELECT alpha, seed, round, round(v, 6) AS v FROM dense")
def sweep_fill(spark, d):
    return _r(_dense(spark, d).select("alpha", "seed", "round", "v"))


@query("sweep_cummax", _DENSE + " SELECT alpha, seed, round, round(max(v) OVER (PARTITION BY alpha, seed ORDER BY round ROWS UNBOUNDED PRECEDING), 6) AS best FROM dense")
def sweep_cummax(spark, d):
    return _r(R.running_best(_dense(spark, d), "v", ["alpha", "seed"], "round").select("alpha", "seed", "round", "best"))


@query("sweep_mean_se", _DENSE + " SELECT alpha, round, count(v) AS n, round(avg(v) / pi(), 6) AS mean, round(stddev_pop(v) / sqrt(greatest(count(v), 1)) / pi(), 6) AS se FROM dense GROUP BY alpha, round")
def sweep_mean_se(spark, d):
    out = R.mean_and_error(_dense(spark, d), "v", ["alpha", "round"])
    return out.withColumns({c: F.round(F.col(c) / math.pi, 6) for c in ("mean", "se")})


@query("step_mean_stderr", "SELECT month(l_shipdate) AS step, l_linestatus AS method, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity) / sqrt(count(DISTINCT l_suppkey)), 6) AS se, count(DISTINCT l_suppkey) AS seeds FROM lineitem GROUP BY ALL")
def step_mean_stderr(spark, d):
    li = table(spark, d, "lineitem").select(F.month("l_shipdate").cast("bigint").alias("step"), F.col("l_linestatus").alias("method"), "l_quantity", "l_suppkey")
    seeds = F.count_distinct("l_suppkey")
    return _r(li.groupBy("step", "method").agg(F.avg("l_quantity").alias("mean"), (F.stddev_samp("l_quantity") / F.sqrt(seeds)).alias("se"), seeds.alias("seeds")))


@query("step_width_quantiles", "SELECT month(l_shipdate) AS step, round(median(l_extendedprice), 6) AS median, round(quantile_cont(l_extendedprice, 0.25), 6) AS low, round(quantile_cont(l_extendedprice, 0.75), 6) AS high FROM lineitem GROUP BY 1")
def step_width_quantiles(spark, d):
    li = table(spark, d, "lineitem").select(F.month("l_shipdate").cast("bigint").alias("step"), "l_extendedprice", "l_suppkey")
    return _r(R.step_bands(li, "l_extendedprice", "step", "l_suppkey").select("step", "median", "low", "high"))


@query("param_grid", "SELECT a.v AS initial_seed, b.v AS alpha, a.v AS last_seed FROM (VALUES (3), (7), (9)) a(v), (VALUES (0.1::DOUBLE), (0.2::DOUBLE)) b(v)")
def param_grid(spark, d):
    return R.parameter_grid(spark, {"initial_seed": [3, 7, 9], "alpha": [0.1, 0.2]}).select(F.col("initial_seed").cast("int").alias("initial_seed"), "alpha", F.col("initial_seed").cast("int").alias("last_seed"))


@query("rel_rank_feasibility", "WITH r AS (SELECT p_partkey AS id, (row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1) / count(*) OVER () AS rank FROM part) SELECT id, round(rank, 6) AS rank, round(1 / (1 + exp(-(rank - 0.25) / 0.1)), 6) AS p FROM r")
def rel_rank_feasibility(spark, d):
    from ..operators.ranking import global_row_number

    part = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_retailprice")
    n = part.count()
    ranked = global_row_number(part, "p_retailprice", "id").select("id", ((F.col("rn") - 1) / n).alias("rank"))
    return _r(ranked.select("id", "rank", M.logistic_feasibility(F.col("rank"), 0.1).alias("p")))


@query("temperature_schedule", f"WITH {CAL} SELECT id, [round(f + i * 0.2, 1) for i in range(6)] AS temperatures FROM (SELECT id, CASE WHEN value / 1000 < 0.075 THEN 1.2 WHEN value / 1000 < 0.1 THEN 1.0 WHEN value / 1000 < 0.15 THEN 0.8 ELSE 0.6 END::DOUBLE AS f FROM cal)")
def temperature_schedule(spark, d):
    return calibration(spark, d).select("id", M.temperatures(F.col("value") / 1000).alias("temperatures"))


@query("reward_margin", f"WITH {CAL} SELECT id, round(greatest(CASE WHEN isfinite(score) THEN score ELSE 0 END - 40, 0), 6) AS reward, round(CASE WHEN isfinite(score - 40) THEN abs(score - 40) ELSE 0 END, 6) AS distance FROM cal")
def reward_margin(spark, d):
    return _r(calibration(spark, d).select("id", M.reward(F.col("score"), F.lit(40.0)).alias("reward"), M.score_distance(F.col("score"), F.lit(40.0)).alias("distance")))


@query("marge_terms", f"""WITH {CAL}, t AS (SELECT id, grp, exp(ln(u) - ln(s)) AS r, ln(u) AS lp, 10 AS n, value / 100 AS reward FROM cal), z AS (SELECT *, r / avg(r) OVER (PARTITION BY grp) AS rw FROM t)
 SELECT id, round(rw * (lp / n - reward), 6) AS kl_t, round(-lp / n, 6) AS kl_ref, round(0.5 * rw * (lp / n - reward) + 0.1 * (-lp / n), 6) AS loss FROM z""")
def marge_terms(spark, d):
    t = calibration(spark, d).select("id", "grp", F.exp(F.ln("u") - F.ln("s")).alias("r"), (F.ln("u") / 10).alias("lpn"), (F.col("value") / 100).alias("reward"))
    mean = t.groupBy("grp").agg(F.avg("r").alias("m"))
    z = t.join(mean, "grp").withColumn("kl_t", F.col("r") / F.col("m") * (F.col("lpn") - F.col("reward")))
    return _r(z.select("id", "kl_t", (-F.col("lpn")).alias("kl_ref"), (0.5 * F.col("kl_t") - 0.1 * F.col("lpn")).alias("loss")))


_TXT = "t AS (SELECT id, CASE id % 6 WHEN 0 THEN '[1, 2]' WHEN 1 THEN '[1.5, 2]' WHEN 2 THEN 'junk' WHEN 3 THEN '[1, 2, 3, 0, 1, 2, 3, 0, 1, 2]' ELSE '[' || array_to_string(list_transform(particle, lambda x: abs(x)), ', ') || ']' || CASE WHEN id % 6 = 4 THEN ' tail] x' ELSE '' END END AS s FROM part8)"


def _texts(spark, d):
    p = particles(spark, d)
    m = F.col("id") % 6
    own = F.concat(list_text(F.transform("particle", F.abs)), F.when(m == 4, " tail] x").otherwise(""))
    return p.select("id", F.when(m == 0, "[1, 2]").when(m == 1, "[1.5, 2]").when(m == 2, "junk").when(m == 3, "[1, 2, 3, 0, 1, 2, 3, 0, 1, 2]").otherwise(own).alias("s"))


@query("truncate_bracket", f"WITH {PART}, {_TXT} SELECT id, CASE WHEN instr(s, ']') > 0 THEN substr(s, 1, instr(s, ']')) ELSE s END AS text, CASE WHEN instr(s, ']') > 0 THEN length(s) - instr(s, ']') ELSE 0 END AS cut FROM t")
def truncate_bracket(spark, d):
    return _texts(spark, d).select("id", T.truncate_bracket("s").alias("text"), T.truncated_chars("s").cast("bigint").alias("cut"))


_NUM = f"WITH {PART}, {_TXT}, n AS (SELECT id, CASE WHEN s = 'junk' THEN NULL ELSE list_transform(string_split(trim(substr(s, 1, instr(s, ']')), '[]'), ', '), lambda x: CAST(x AS DOUBLE)) END AS p FROM t), i AS (SELECT id, p, p IS NOT NULL AND len(list_filter(p, lambda x: x <> floor(x))) = 0 AS whole FROM n)"


@query("parse_strict", _NUM + " SELECT id, CASE WHEN whole AND len(p) = 8 AND list_max(p) < 4 AND list_min(p) >= 0 THEN list_transform(p, lambda x: CAST(x AS INTEGER)) END AS particle FROM i")
def parse_strict(spark, d):
    return _texts(spark, d).select("id", T.parse_strict(T.truncate_bracket("s"), 8, 4).alias("particle"))


@query("parse_permissive", _NUM + """ SELECT id, CASE WHEN whole THEN list_transform(range(1, 9), lambda k: CASE WHEN k <= len(p) THEN CAST(p[k] AS INTEGER) ELSE -1 END) END AS particle,
 CASE WHEN whole THEN list_transform(range(0, 8), lambda k: CAST(least(greatest(p[k % len(p) + 1], 0), 7) AS INTEGER)) END AS scored FROM i""")
def parse_permissive(spark, d):
    s = T.truncate_bracket("s")
    return _texts(spark, d).select("id", T.parse_permissive(s, 8).alias("particle"), T.scoring_copy(s, 8).alias("scored"))


@query("format_pair_text", f"WITH {PART} SELECT a.id, '<inc> [' || array_to_string(a.particle, ', ') || ']' || chr(10) || '[' || array_to_string(b.particle, ', ') || ']' AS text FROM part8 a {_NEXT}")
def format_pair_text(spark, d):
    return _next(spark, d).select("id", T.pair_text("particle", "other").alias("text"))


@query("clean_prompt", "SELECT conv_id, turn, regexp_replace(regexp_replace(',,' || conv_id || ',' || text, '^,+', ''), '^[0-9]+,+', '') AS prompt, length(text) AS n FROM conversations")
def clean_prompt(spark, d):
    c = table(spark, d, "conversations")
    raw = F.concat(F.lit(",,"), F.col("conv_id").cast("string"), F.lit(","), F.col("text"))
    return c.select("conv_id", "turn", T.clean_prompt(raw).alias("prompt"), F.length("text").cast("bigint").alias("n"))


@query("regex_run_keys", """WITH p AS (SELECT o_orderkey AS id, 'run_alpha' || (o_orderkey % 9) || '.' || (o_orderkey % 7) || '_seed' || o_custkey || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '_r' || (o_orderkey % 11) END AS path FROM orders)
 SELECT id, TRY_CAST(nullif(regexp_extract(path, 'alpha([0-9]+(?:\\.[0-9]+)?)', 1), '') AS DOUBLE) AS alpha, TRY_CAST(regexp_extract(path, 'seed([0-9]+)', 1) AS INTEGER) AS seed, TRY_CAST(nullif(regexp_extract(path, '_r([0-9]+)$', 1), '') AS INTEGER) AS round FROM p""".replace("\\\\", "\\"))
def regex_run_keys(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    path = F.concat(F.lit("run_alpha"), (k % 9).cast("string"), F.lit("."), (k % 7).cast("string"), F.lit("_seed"), F.col("o_custkey").cast("string"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("_r"), (k % 11).cast("string"))))
    return o.select(k.alias("id"), path.alias("path")).select("id", *[c.alias(n) for n, c in zip(("alpha", "seed", "round"), T.run_keys("path"), strict=True)])


_MOTIFS, _SPACINGS, _Q = [[0, 1], [1, 0]], [[0, 1], [0, 2]], 2


@query("ehrlich_score", f"""WITH {PART}, q AS (SELECT id, list_transform(particle, lambda x: abs(x) % 2) AS p FROM part8),
 m AS (SELECT id, list_max(list_transform(range(1, 8), lambda i: (p[i] = 0)::INT + (p[i + 1] = 1)::INT)) AS a, list_max(list_transform(range(1, 7), lambda i: (p[i] = 1)::INT + (p[i + 2] = 0)::INT)) AS b FROM q)
 SELECT id, -CAST(a / 2 * b / 2 AS DOUBLE) AS score FROM m""")
def ehrlich_score(spark, d):
    p = particles(spark, d).withColumn("p", F.transform("particle", lambda x: F.abs(x) % 2))
    return p.select("id", A.ehrlich(F.col("p"), _MOTIFS, _SPACINGS, _Q).alias("score"))


@query("motif_placements", f"WITH {PART} SELECT id, len(list_filter(range(1, 7), lambda i: abs(particle[i]) % 2 = 1 AND abs(particle[i + 2]) % 2 = 0)) AS n_places FROM part8")
def motif_placements(spark, d):
    p = particles(spark, d)
    fits = F.filter(F.sequence(F.lit(0), F.lit(5)), lambda i: (F.abs(F.get("particle", i)) % 2 == 1) & (F.abs(F.get("particle", i + 2)) % 2 == 0))
    return p.select("id", F.size(fits).cast("bigint").alias("n_places"))


@query("path_counts", "WITH RECURSIVE e AS (SELECT i, j FROM range(4) a(i), range(4) b(j) WHERE (i + 1) % 4 <> j), f(n, s, w) AS (SELECT 1, i, 1::HUGEINT FROM range(4) a(i) UNION ALL SELECT f.n + 1, e.j, f.w FROM f JOIN e ON e.i = f.s WHERE f.n < 6) SELECT CAST(n AS INTEGER) AS length, CAST(CAST(sum(w) AS BIGINT) AS VARCHAR) AS ways FROM f GROUP BY n")
def path_counts(spark, d):
    allowed = [[int((i + 1) % 4 != j) for j in range(4)] for i in range(4)]
    return spark.createDataFrame([(i + 1, str(w)) for i, w in enumerate(A.path_counts(allowed, 6))], "length int, ways string")


@query("generation_funnel", _NUM + """, x AS (SELECT id, p IS NOT NULL AS parsable, whole AS integral, whole AND len(p) = 8 AS sized FROM i)
 SELECT count(*) AS n, round(count(*) FILTER (WHERE parsable) / count(*), 6) AS pct_parsable, round(count(*) FILTER (WHERE integral) / count(*) FILTER (WHERE parsable), 6) AS pct_integral, round(count(*) FILTER (WHERE sized) / count(*) FILTER (WHERE integral), 6) AS pct_sized FROM x""")
def generation_funnel(spark, d):
    p = F.from_json(T.truncate_bracket("s"), "array<double>")
    whole = F.coalesce(F.forall(p, lambda x: x == F.floor(x)), F.lit(False))
    x = _texts(spark, d).select(p.isNotNull().alias("a"), whole.alias("b"), (whole & (F.size(p) == 8)).alias("c"))
    share = lambda c, of: r6(F.try_divide(F.count_if(c), of))
    return x.agg(F.count("*").alias("n"), share("a", F.count("*")).alias("pct_parsable"), share("b", F.count_if("a")).alias("pct_integral"), share("c", F.count_if("b")).alias("pct_sized"))


@query("score_rmse", f"WITH {CAL} SELECT grp, round(sqrt(avg((score - 50) ** 2) FILTER (WHERE isfinite(score))), 6) AS rmse, round(avg((value - 50) ** 2), 6) AS mse FROM cal GROUP BY grp")
def score_rmse(spark, d):
    err = finite("score") - 50
    return _r(calibration(spark, d).groupBy("grp").agg(F.sqrt(F.avg(err * err)).alias("rmse"), F.avg((F.col("value") - 50) * (F.col("value") - 50)).alias("mse")))


@query("coverage_width", f"WITH {CAL} SELECT grp, round(avg(CASE WHEN value BETWEEN 20 AND 20 + s * 100 THEN 1 ELSE 0 END), 6) AS coverage, round(median(s * 100), 6) AS width FROM cal GROUP BY grp")
def coverage_width(spark, d):
    inside = F.col("value").between(F.lit(20), 20 + F.col("s") * 100)
    return _r(calibration(spark, d).groupBy("grp").agg(F.avg(inside.cast("int")).alias("coverage"), F.median(F.col("s") * 100).alias("width")))


@query("history_dedup", f"WITH {PART}, f AS (SELECT particle, min(id) AS first_id FROM part8 GROUP BY particle) SELECT first_id, row_number() OVER (ORDER BY first_id) AS seen FROM f")
def history_dedup(spark, d):
    """First occurrence of each particle and the running count of those seen."""
    from ..operators.ranking import global_row_number

    first = particles(spark, d).groupBy("particle").agg(F.min("id").alias("first_id"))
    return global_row_number(first, "first_id", name="seen").select("first_id", F.col("seen").cast("bigint").alias("seen"))


@query("retained_best", f"WITH {CAL} SELECT id, min(value) OVER w AS best, round(sum(value - 0.01) OVER w, 4) AS regret FROM cal WINDOW w AS (PARTITION BY user_id ORDER BY id ROWS UNBOUNDED PRECEDING)")
def retained_best(spark, d):
    w = Window.partitionBy("user_id").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    return calibration(spark, d).select("id", F.min("value").over(w).alias("best"), F.round(F.sum(F.col("value") - 0.01).over(w), 4).alias("regret"))


@query("sequence_likelihood", """WITH t AS (SELECT l_orderkey AS seq, l_suppkey % 3 AS seed, ln(l_discount + 0.01) AS lp FROM lineitem), a AS (SELECT seq, seed, exp(sum(lp)) AS p, sum(lp) / count(*) AS m FROM t GROUP BY seq, seed)
 SELECT seq, round(avg(p) / pi(), 9) AS likelihood, round(avg(m), 6) AS mean_log FROM a GROUP BY seq""")
def sequence_likelihood(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("seq"), (F.col("l_suppkey") % 3).alias("seed"), F.ln(F.col("l_discount") + 0.01).alias("lp"))
    a = t.groupBy("seq", "seed").agg(F.exp(F.sum("lp")).alias("p"), (F.sum("lp") / F.count("*")).alias("m"))
    return a.groupBy("seq").agg(F.round(F.avg("p") / math.pi, 9).alias("likelihood"), r6(F.avg("m")).alias("mean_log"))


@query("one_hot", "SELECT event_id AS id, (event_type = 'click')::INT AS is_click, (event_type = 'error')::INT AS is_error, (event_type = 'view')::INT AS is_view FROM events")
def one_hot(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), *[(F.col("event_type") == k).cast("int").alias(f"is_{k}") for k in ("click", "error", "view")])


@query("set_operations", f"WITH {CAL}, a AS (SELECT id FROM cal WHERE u > 0.5), b AS (SELECT id FROM cal WHERE s > 1) SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS n_except, (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS n_intersect, (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS n_union, (SELECT count(*) FROM (SELECT * FROM a UNION ALL SELECT * FROM b)) AS n_union_all")
def set_operations(spark, d):
    cal = calibration(spark, d)
    a, b = cal.filter("u > 0.5").select("id"), cal.filter("s > 1").select("id")
    parts = {"except": a.join(b, "id", "left_anti").distinct(), "intersect": a.join(b, "id", "left_semi").distinct(), "union": a.union(b).distinct(), "union_all": a.unionAll(b)}
    counts = None
    for k, v in parts.items():
        own = v.agg(F.count("*").alias(f"n_{k}"))
        counts = own if counts is None else counts.crossJoin(own)  # one row each
    return counts


@query("interval_join", f"WITH {CAL}, i AS (SELECT k, k * 50.0 AS lo, k * 50.0 + 75 AS hi FROM range(10) t(k)) SELECT k, count(*) AS n FROM i JOIN cal ON value BETWEEN lo AND hi GROUP BY k")
def interval_join(spark, d):
    """Ten overlapping intervals, a bounded side."""
    i = spark.range(10).select(F.col("id").alias("k"), (F.col("id") * 50.0).alias("lo"), (F.col("id") * 50.0 + 75).alias("hi"))
    return calibration(spark, d).join(F.broadcast(i), F.col("value").between(F.col("lo"), F.col("hi"))).groupBy("k").agg(F.count("*").alias("n"))


@query("round_summary", f"WITH {RUNS}, {STATS} SELECT round, CAST(sum(n_total) AS BIGINT) AS n_total, CAST(sum(n_feasible) AS BIGINT) AS n_feasible, count(*) AS n_runs FROM stats GROUP BY round")
def round_summary(spark, d):
    return R.run_stats(runs(spark, d), ["alpha", "seed", "round"]).groupBy("round").agg(F.sum("n_total").alias("n_total"), F.sum("n_feasible").alias("n_feasible"), F.count("*").alias("n_runs"))


@query("tilted_density", f"WITH {CAL}, m AS (SELECT min(value) AS lo, max(value) AS hi FROM cal), e AS (SELECT id, exp(2.0 * value / (hi - lo)) AS t FROM cal, m) SELECT id, round(t / sum(t) OVER () * 1000, 6) AS density FROM e")
def tilted_density(spark, d):
    cal = calibration(spark, d)
    lo_hi = cal.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    t = cal.crossJoin(F.broadcast(lo_hi)).select("id", M.tilt(F.col("value"), F.col("lo"), F.col("hi"), 2.0).alias("t"))
    total = t.agg(F.sum("t").alias("total"))  # one row
    return t.crossJoin(F.broadcast(total)).select("id", r6(F.col("t") / F.col("total") * 1000).alias("density"))


@query("safe_division", f"WITH {CAL} SELECT id, CASE WHEN id % 3 = 0 THEN CAST('inf' AS DOUBLE) ELSE round(u / (id % 3), 9) END AS q FROM cal")
def safe_division(spark, d):
    q = np_div("u", F.col("id") % 3)
    return calibration(spark, d).select("id", (F.round(q * 1e9) / 1e9).alias("q"))  # the product is rounded, as in SQL, and not the decimal text


@query("infeasible_rows", f"WITH {CAL} SELECT grp, count(*) AS n FROM cal WHERE NOT isfinite(score) GROUP BY grp")
def infeasible_rows(spark, d):
    return calibration(spark, d).filter(infeasible("score")).groupBy("grp").agg(F.count("*").alias("n"))


@query("density_pdf", f"WITH {CAL} SELECT id, round(exp(-(((value - 50) / 20) ** 2) / 2) / (20 * sqrt(2 * pi())), 9) AS pdf FROM cal")
def density_pdf(spark, d):
    return calibration(spark, d).select("id", F.round(M.normal_pdf(F.col("value"), 50.0, 20.0), 9).alias("pdf"))


@query("synthetic_risk", "WITH g AS (SELECT e, i, i / 20 AS lam FROM range(50) a(e), range(21) b(i)), p AS (SELECT *, least(greatest(cos(lam) / 50 + 1.1 * 0.6 * (1 - lam), 0), 1) AS p FROM g) SELECT i, round(avg(CASE WHEN CAST(('0x' || substr(md5('1:' || e || ':' || i), 1, 12))::BIGINT AS DOUBLE) / 281474976710656.0 < p THEN 1 ELSE 0 END), 6) AS loss FROM p GROUP BY i")
def synthetic_risk(spark, d):
    """Losses of simulated experiments over a grid of thresholds."""
    g = spark.range(50).select(F.col("id").alias("e"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(20).cast("bigint"))).alias("i")).withColumn("lam", F.col("i") / 20)
    p = F.least(F.greatest(F.cos("lam") / 50 + 1.1 * 0.6 * (1 - F.col("lam")), F.lit(0.0)), F.lit(1.0))
    return g.groupBy("i").agg(r6(F.avg((md5_uniform(1, "e", "i") < p).cast("int"))).alias("loss"))
