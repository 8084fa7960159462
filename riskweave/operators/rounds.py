"""Loops: rounds of policy improvement, and trials of threshold selection.

Models stay outside: a round's proposals come from a function that the caller gives, as rows with
likelihoods and scores. Everything else of a round is a DataFrame job; what a round keeps is
written, so a later round does not compute it again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.maths import accept_safe, accept_unconstrained, cap_chain, hoeffding_bentkus
from ..semantics import TINY, md5_uniform
from ..storage import cut, drops
from .claims import threshold_losses
from .control import Search, beta_search
from .sampling import accept_first, best_scoring, calibration_split, sample_quality


def policy_chain(liks: Column, betas: list[float], psis: list[float], versus: str = "last") -> Column:
    """Densities of a sequence of policies: the first likelihood, then min(lik_t, beta_t * base) / psi_t, where base is the last policy or the first."""
    if versus == "last":
        return cap_chain(liks, betas, psis)
    bounds = F.array(*[F.struct(F.lit(float(b)).alias("b"), F.lit(float(p)).alias("p")) for b, p in zip(betas, psis, strict=True)])
    first = F.get(liks, F.lit(0))
    capped = lambda x, i: F.when(i == 0, x).otherwise(F.least(x, first * F.get(bounds, i)["b"]) / F.get(bounds, i)["p"])
    return F.transform(F.slice(liks, 1, len(betas)), capped)


def _mixture(con: str, sizes: list[int]) -> Column:
    """The mixture of policies, each weighed by the calibration rows that it gave."""
    n = F.array(*[F.lit(float(s)) for s in sizes])
    return F.aggregate(F.zip_with(con, n, lambda c, k: c * k), F.lit(0.0), lambda a, b: a + b) / float(sum(sizes))


@drops
def improve(spark: SparkSession, start: DataFrame, propose: Callable[[int, DataFrame], dict[str, DataFrame]], likelihood: Callable[[int, DataFrame], DataFrame], rounds: int, cfg: Search, seeds: int, target: int, share: float, seed: int = 0, versus: str = "last") -> tuple[DataFrame, DataFrame]:
    """(log, calibration): one row a round, and the calibration rows with their densities under every policy.

    ``start`` holds id, score and lik, the likelihood under the first, safe model. In round r
    ``propose(r, best rows so far)`` gives samples "safe" (of the last policy) and "unconstrained"
    (of model r) with id, score and liks, the likelihoods under models 0 to r; ``likelihood(r, rows)``
    gives (id, lik) of calibration rows under model r. The bound beta of the new policy
    min(lik_r, beta * base) / psi is searched on the calibration rows, weighed against the mixture
    of the policies they came from. Rows carry ``con``, their densities under all policies so far; a
    round adds one entry to it, and only samples new to the run go through the whole chain. Up to
    ``target`` samples are accepted; a share of them joins the calibration rows.

    The log has round, proposal, beta, psi, n_proposals, n_accepted, n_feasible, best and n_cal.
    """
    if versus not in ("first", "last"):
        raise ValueError("versus must be first or last")
    cal = cut(start.select("id", "score", F.array("lik").alias("con")), "cal")
    known = start.select("id", "score")
    betas, psis, sizes, log = [1.0], [1.0], [cal.count()], []
    base = F.element_at("con", 1 if versus == "first" else -1).alias("s")
    for r in range(1, rounds + 1):
        mixture = _mixture("con", sizes).alias("m")
        own = cut(cal.join(likelihood(r, cal.select("id", "score")).select("id", F.col("lik").alias("u")), "id").select("id", "score", "con", "u", base, mixture), "own")
        props = {}
        for name, rows in propose(r, best_scoring(known, seeds)).items():
            chained = rows.select("id", "score", F.get("liks", F.lit(r)).alias("u"), policy_chain(F.slice("liks", 1, r), betas, psis, versus).alias("con"))
            props[name] = cut(chained.select("id", "score", "con", "u", base, mixture), name)
        found = beta_search(spark, own, props, cfg).first()
        beta, psi, proposal = max(found["beta"], TINY), found["psi"], found["proposal"]
        lr = F.col("u") / F.col("s")
        chance = accept_safe(lr, beta) if proposal == "safe" else accept_unconstrained(lr, beta)
        judged = cut(accept_first(props[proposal], chance, md5_uniform(seed + r, "id"), target, "id"), "judged")
        kept = judged.filter("accepted").drop("accepted")
        quality = sample_quality(kept).first()
        new, _ = calibration_split(kept, share, seed + r)
        extended = F.concat("con", F.array(F.least(F.col("u"), F.col("s") * beta) / psi)).alias("con")
        new = cut(new.select("id", "score", extended), "new")
        cal = cut(own.select("id", "score", extended).unionByName(new), "cal")
        known = cut(known.unionByName(kept.select("id", "score")), "known")
        betas, psis, sizes = [*betas, beta], [*psis, psi], [*sizes, new.count()]
        log.append((r, proposal, float(beta), float(psi), judged.count(), quality["n"], quality["n_feasible"], quality["min_score"], sum(sizes)))
    schema = "round int, proposal string, beta double, psi double, n_proposals bigint, n_accepted bigint, n_feasible bigint, best double, n_cal bigint"
    return spark.createDataFrame(log, schema), cut(cal, "policies", stays=True)


METHODS = ("gcrc", "monotised", "standard", "ltt")


def _selected(marked: DataFrame, by: list[str]) -> DataFrame:
    """(by, tau): for each group of ``by``, of rows (method, tau, bad), what its method selects.

    "standard" takes the least threshold that is not bad, or none; the others go down from the
    largest threshold and stop above the first bad one, or at it if there is none above.
    """
    above = F.lead("tau").over(Window.partitionBy(*by).orderBy("tau"))  # a bounded grid each
    stop = F.max_by(F.when(F.col("bad"), F.struct(F.coalesce("above", "tau").alias("t"))), F.when(F.col("bad"), F.col("tau")))["t"]
    fit = F.min(F.when(~F.col("bad"), F.col("tau")))
    found = marked.withColumn("above", above).groupBy(*by).agg(F.coalesce(stop, F.min("tau")).alias("_scan"), fit.alias("_fit"))
    return found.select(*by, F.when(F.col("method") == "standard", F.col("_fit")).otherwise(F.col("_scan")).alias("tau"))


def threshold_trials(claims: DataFrame, taus: list[float], alphas: list[float], trials: int, methods: tuple[str, ...] = METHODS, share: float = 0.5, ceiling: float = 1.0, kind: str = "rate", delta: float = 0.1) -> DataFrame:
    """(method, alpha, n_trials, risk_mean, risk_std, recall_mean, recall_std) over random splits of the responses.

    Losses are made once; every trial sums its calibration half and its test half over the
    bounded grid, and one grouping over methods, levels and trials chooses on those sums alone.
    "ltt" tests each threshold's mean loss by its p-value at ``delta``, all trials' at once.
    """
    if not set(methods) <= set(METHODS):
        raise ValueError(f"methods must be of {', '.join(METHODS)}")
    losses = threshold_losses(claims, taus, kind)
    own_mono = F.max("loss").over(Window.partitionBy("response").orderBy(F.desc("tau")).rowsBetween(Window.unboundedPreceding, 0))
    split = losses.withColumn("mono", own_mono).withColumn("trial", F.explode(F.array(*[F.lit(i) for i in range(trials)])))
    split = split.withColumn("cal", md5_uniform("t", "trial", "response") < share)
    own, rest = F.col("cal"), ~F.col("cal")
    sums = split.groupBy("trial", "tau").agg(
        ((F.sum(F.when(own, F.col("loss"))) + ceiling) / (F.count_if(own) + 1)).alias("risk"), ((F.sum(F.when(own, F.col("mono"))) + ceiling) / (F.count_if(own) + 1)).alias("mono_risk"),
        F.avg(F.when(own, F.col("loss"))).alias("mean"), F.count_if(own).alias("n"), F.avg(F.when(rest, F.col("loss"))).alias("test_loss"), F.avg(F.when(rest, F.col("recall"))).alias("test_recall"),
    )
    sums = cut(sums, "sums")
    p = {a: f"_p{i}" for i, a in enumerate(alphas)} if "ltt" in methods else {}
    tested = sums.withColumns({c: hoeffding_bentkus("mean", "n", a) for a, c in p.items()}) if p else sums
    bad = {"gcrc": lambda a: F.col("risk") > a, "monotised": lambda a: F.col("mono_risk") > a, "standard": lambda a: ~F.coalesce(F.col("risk") <= a, F.lit(False)), "ltt": lambda a: F.col(p[a]) > delta}
    cases = [F.struct(F.lit(m).alias("method"), F.lit(float(a)).alias("alpha"), F.coalesce(bad[m](a), F.lit(False)).alias("bad")) for m in methods for a in alphas]
    marked = tested.select("trial", "tau", F.explode(F.array(*cases)).alias("x")).select("trial", "tau", "x.*")
    picked = _selected(marked, ["method", "alpha", "trial"]).join(sums, ["trial", "tau"])
    return picked.groupBy("method", "alpha").agg(F.count("*").alias("n_trials"), F.avg("test_loss").alias("risk_mean"), F.stddev_pop("test_loss").alias("risk_std"), F.avg("test_recall").alias("recall_mean"), F.stddev_pop("test_recall").alias("recall_std"))


def simulate(spark: SparkSession, experiments: int, n: int, alphas: list[float], grid: int, seed: int = 1, ceiling: float = 1.0) -> DataFrame:
    """(alpha, method, n_experiments, mean_loss): chosen thresholds of simulated losses, judged by their true risk.

    A loss at threshold i / grid is Bernoulli with chance clip(cos(l) / 50 + 0.6 (alpha + 1)(1 - l), 0, 1);
    experiments times draws times the grid is the simulation's own size.
    """
    base = spark.range(experiments).withColumnRenamed("id", "trial").crossJoin(spark.range(n).withColumnRenamed("id", "draw")).crossJoin(F.broadcast(spark.range(grid + 1).withColumnRenamed("id", "i")))
    base = base.withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))
    lam = F.col("i") / grid
    chance = F.least(F.greatest(F.cos(lam) / 50 + 0.6 * (F.col("alpha") + 1) * (1 - lam), F.lit(0.0)), F.lit(1.0))
    loss = (md5_uniform(seed, "trial", "draw", "i") < chance).cast("double")
    curve = base.groupBy("alpha", "trial", "i").agg(((F.sum(loss) + ceiling) / (n + 1)).alias("risk"), F.first(chance).alias("truth")).withColumn("tau", F.col("i") / grid)
    curve = cut(curve, "curve")
    marked = curve.select("alpha", "trial", "tau", F.explode(F.array(F.lit("gcrc"), F.lit("standard"))).alias("method"), (F.col("risk") > F.col("alpha")).alias("bad"))
    picked = _selected(marked, ["method", "alpha", "trial"]).join(curve.select("alpha", "trial", "tau", "truth"), ["alpha", "trial", "tau"], "left")
    return picked.groupBy("alpha", "method").agg(F.count("truth").alias("n_experiments"), F.avg("truth").alias("mean_loss"))
