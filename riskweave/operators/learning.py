"""Active learning under risk control: many runs at once, a few passes over their pools for each step.

A run (a seed) has training, calibration, validation and pool rows. What the driver keeps of a run
is small: the posterior of its linear model (features squared, moved by one rank for each row that
training gains), its calibration rows, its level and its latest policies; at most ``RUNS`` runs.
Pools stay one table with the densities that the run's rows were drawn from, in p0, p1 and so on. A step reads
it a few times and writes nothing: tasks work the latest policies' densities out from their models
and return sums of their rows by run (and by the intervals of a grid of bounds). After ``CARRIED``
policies the table is written once with these densities, and the one before it goes.

Draws are ranks of MD5 keys: the pool row with the largest ln(density) + Gumbel number is a draw in
proportion to the density. A drawn row stays in the pool.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..semantics import INF, md5_uniform
from ..storage import cut, delete, drops, write
from .conformal import _partitions
from .ranking import first_rows
from .regression import _dot, first_component

#: Runs whose models the driver holds.
RUNS = 10_000
#: Policies of a run that tasks evaluate anew before its pool is written with their densities.
CARRIED = 8
PARTS = ("train", "cal", "pool", "val")


@dataclass
class Learning:
    """What the runs are told. ``control``: "none", "search" (a bound by conformal risk) or "preset" (a bound that follows outcomes).

    ``versus`` caps each policy against the "first" or the "last" one; ``lam`` tilts by variance;
    ``train_share`` is the chance that a drawn row goes to training instead of calibration.
    """

    alpha: float = 0.1
    control: str = "none"
    risk_alpha: float = 0.2
    versus: str = "first"
    lam: float = 1.0
    noise: float = 1.0
    n_grid: int = 20
    level_rate: float = 0.05
    bound_rate: float = 0.1
    depths: tuple[int, ...] = (1, 2)
    train_share: float = 0.5
    seed: int = 0

    def __post_init__(self):
        if self.control not in ("none", "search", "preset") or self.versus not in ("first", "last"):
            raise ValueError("control must be none, search or preset, and versus first or last")


def uniform(*keys) -> float:
    """semantics.md5_uniform of constants."""
    return int(hashlib.md5(":".join(map(str, keys)).encode()).hexdigest()[:12], 16) / 2**48


def weighted_quantile(v: np.ndarray, w: np.ndarray, q: float) -> float:
    """conformal.weighted_quantile of one small group."""
    order = np.lexsort((np.arange(len(v)), w, v))
    v, w = v[order], w[order]
    c = np.round(np.cumsum(w), 12)
    i = int(np.argmax(c >= q)) if (c >= q).any() else len(v) - 1
    if q > 0.5 or i == 0 or c[i] == q:
        return float(v[i])
    return float(v[i - 1] if q < 0.5 else (v[i] * w[i] + v[i - 1] * w[i - 1]) / (w[i] + w[i - 1]))


def feedback(ratios: np.ndarray, depth: int) -> np.ndarray:
    """Weights of the last ``depth`` policies' feedback: the last row times, for each entry, the sum over
    different other entries of products of the rows before; the earliest factor sums all rows that are left."""
    own, n = ratios[-1], depth - 1
    if not n:
        return own
    factors = [*(ratios[-2 - j] for j in range(n - 1)), ratios[: len(ratios) - n].sum(0)]
    total = np.zeros_like(own)
    for parts in _partitions(list(range(n))):
        term = np.ones_like(own)
        for block in parts:
            product = np.prod([factors[j] for j in block], axis=0)
            term = term * (-1.0) ** (len(block) - 1) * math.factorial(len(block) - 1) * (product.sum() - product)
        total = total + term
    return own * total


def _variance(x: np.ndarray, posterior: np.ndarray) -> np.ndarray:
    return ((x @ posterior) * x).sum(1)


@dataclass
class _Policy:
    """A step's policy: u = exp(lam v / span) / z, capped at exp(bound) times the policy s before it, over its mass."""

    posterior: np.ndarray
    lam: float
    span: float
    z: float = 1.0
    bound: float = INF
    mass: float = 1.0

    def tilt(self, x: np.ndarray) -> np.ndarray:
        return np.exp(self.lam * _variance(x, self.posterior) / self.span)

    def density(self, x: np.ndarray, s: np.ndarray) -> np.ndarray:
        u = self.tilt(x) / self.z
        return np.where(np.log(u / s) < self.bound, u, math.exp(min(self.bound, 700)) * s) / self.mass


@dataclass
class _Run:
    """A run's posterior and calibration rows. ``dens[k]`` are the calibration rows' densities under policy k.

    The pool holds densities under the first ``written`` policies; ``carried`` are those after them.
    """

    posterior: np.ndarray
    moment: np.ndarray
    x: np.ndarray
    y: np.ndarray
    ok: np.ndarray
    dens: np.ndarray
    level: float
    first: int
    bound: float = 0.0
    weights: list[float] = field(default_factory=list)
    carried: list[_Policy] = field(default_factory=list)
    written: int = 1

    def train(self, x: np.ndarray, y: float, noise: float) -> None:
        """One row more, by a change of rank one."""
        gain = self.posterior @ x
        self.posterior = self.posterior - np.outer(gain, gain) / (noise + x @ gain)
        self.moment = self.moment + x * y / noise

    @property
    def coefficients(self) -> np.ndarray:
        return self.posterior @ self.moment


def learning_parts(df: DataFrame, features: list[str], label: str, ok: Column, seeds: list[int], n_val: int, n_train: int, n_cal: int, bias: float) -> DataFrame:
    """(seed, id, part, x, y, ok, source): a dataset dealt to each run's parts.

    Validation rows are uniform; the others have a source density exp(bias * minmax(first
    component)) over their sum, by which training and calibration rows are drawn.
    """
    mean, direction = first_component(df, features)
    score = _dot([F.col(f) - m for f, m in zip(features, mean, strict=True)], np.array(direction))
    x = F.array(*[F.col(f).cast("double") for f in features], F.lit(1.0))
    rows = df.select("id", x.alias("x"), F.col(label).cast("double").alias("y"), ok.alias("ok"), score.alias("_score")).withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))
    few = lambda k: k + 8 * math.sqrt(k) + 20  # noqa: E731  so many keys are enough for k of them, but for a rare chance
    val, rows = first_rows(rows, n_val, md5_uniform("val", "seed", "id"), few(n_val) / max(df.count(), 1), ["seed"], ["id"], len(set(seeds)), "_rn")
    span = cut(rows.groupBy("seed").agg(F.min("_score").alias("_low"), F.max("_score").alias("_high")), "span")  # a row for each seed, as below
    weight = F.exp(bias * (F.col("_score") - F.col("_low")) / F.when(F.col("_high") > F.col("_low"), F.col("_high") - F.col("_low")).otherwise(1.0))
    weighed = lambda r: r.join(F.broadcast(span), "seed", "left").withColumn("_w", weight)
    total = cut(weighed(rows).groupBy("seed").agg(F.sum("_w").alias("_sum")), "total")
    sourced = lambda r: weighed(r).join(F.broadcast(total), "seed", "left").withColumn("source", F.col("_w") / F.col("_sum"))
    key = -F.ln(F.greatest(md5_uniform("start", "seed", "id"), F.lit(1e-300))) / F.col("source")
    # source densities sum to one, so about t keys are below t
    begun, pool = first_rows(sourced(rows), n_train + n_cal, key, few(n_train + n_cal), ["seed"], ["id", "_score"], len(set(seeds)), "_rn")
    parts = [(sourced(val), F.lit("val")), (begun, F.when(F.col("_rn") <= n_train, "train").otherwise("cal")), (pool, F.lit("pool"))]
    val, begun, pool = (r.select("seed", "id", part.alias("part"), "x", "y", "ok", "source") for r, part in parts)
    return val.unionByName(begun).unionByName(pool)


def _by_run(rows: DataFrame, state: dict, make, schema: str) -> DataFrame:
    """What ``make(one run's state, its rows of a batch)`` returns, as rows after the seed.

    Rows go to it as a dict of arrays; columns x0, x1, ... and p0, p1, ... as two of two dimensions.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    sent = rows.sparkSession.sparkContext.broadcast(state)  # RUNS small states at most
    names = rows.columns
    wide = {k: [names.index(c) for c in names if c[0] == k and c[1:].isdigit()] for k in "xp"}
    plain = [(i, c) for i, c in enumerate(names) if not any(i in at for at in wide.values())]
    out_schema = to_arrow_schema(_parse_datatype_string(f"seed int, {schema}"))

    def run(batches):
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            seeds = columns[names.index("seed")]
            order = np.argsort(seeds, kind="stable")
            ends = np.append(np.flatnonzero(np.diff(seeds[order])) + 1, len(order))
            made = []
            for low, high in zip(np.append(0, ends[:-1]), ends, strict=True):
                if low == high:
                    continue
                own = order[low:high]
                part = {c: columns[i][own] for i, c in plain}
                part |= {k: np.column_stack([columns[i][own] for i in at]) for k, at in wide.items() if at}
                seed = int(seeds[own[0]])
                made += [(seed, *r) for r in make(sent.value[seed], part)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in made], f.type) for i, f in enumerate(out_schema)], schema=out_schema)

    return rows.mapInArrow(run, f"seed int, {schema}")


@dataclass
class _State:
    """What tasks know of a run in a step."""

    policy: _Policy
    carried: list[_Policy]
    weights: np.ndarray
    first: bool
    coefficients: np.ndarray
    written: int
    grid: np.ndarray | None = None

    def densities(self, part: dict) -> np.ndarray:
        """The rows' densities under all policies so far, a column each."""
        dens = part["p"][:, : self.written]
        for p in self.carried:
            dens = np.column_stack([dens, p.density(part["x"], dens[:, 0 if self.first else -1])])
        return dens

    def capped(self, part: dict) -> tuple[np.ndarray, np.ndarray]:
        """(densities so far, the one that caps the next policy)."""
        dens = self.densities(part)
        return dens, dens[:, 0 if self.first else -1]


def _variances(state: _State, part: dict):
    v = _variance(part["x"], state.policy.posterior)
    return [(float(v.min()), float(v.max()))]


def _errors(state: _State, part: dict):
    miss = part["y"] - part["x"] @ state.coefficients
    return [(float((miss * miss).sum()), len(miss))]


def _tilts(state: _State, part: dict):
    e, (_, s) = state.policy.tilt(part["x"]), state.capped(part)
    ratio = np.log(e / s)
    return [(float(e.sum()), float(ratio.min()), float(ratio.max()))]


def _intervals(state: _State, part: dict):
    """By the place of u / s in the grid of bounds: sums of u and s, the largest u / m and s / m."""
    dens, s = state.capped(part)
    u, m = state.policy.tilt(part["x"]) / state.policy.z, dens @ state.weights / state.weights.sum()
    at = np.searchsorted(state.grid, np.log(u / s), side="right")
    n = len(state.grid) + 1
    top = np.zeros((2, n))
    np.maximum.at(top[0], at, u / m)
    np.maximum.at(top[1], at, s / m)
    sums = [np.bincount(at, x, n) for x in (u, s)]
    return [(int(i), *(float(x[i]) for x in (*sums, *top))) for i in np.unique(at)]


def _masses(state: _State, part: dict):
    _, s = state.capped(part)
    return [(float(state.policy.density(part["x"], s).sum()),)]


def _draws(state: _State, part: dict):
    """The rows' draw: the largest ln(density) + Gumbel number, and the largest id of equal ones."""
    dens, s = state.capped(part)
    p = state.policy.density(part["x"], s)
    key = np.log(p) + part["gumbel"]
    i = np.lexsort((part["id"], key))[-1]
    m = float(dens[i] @ state.weights / state.weights.sum())
    x = part["x"][i]
    return [(float(key[i]), int(part["id"][i]), x.tolist(), float(part["y"][i]), bool(part["ok"][i]), [*dens[i].tolist(), float(p[i])], float(x @ state.coefficients), m)]


def _folded(pool: DataFrame, states: dict) -> DataFrame:
    """The pool with the carried policies' densities in further columns, as many as the longest run has."""
    d, n = sum(c[0] == "x" for c in pool.columns), max(s.written + len(s.carried) for s in states.values())

    def rows(state, part):
        dens = state.densities(part)
        dens = np.pad(dens, ((0, 0), (0, n - dens.shape[1])), constant_values=np.nan)
        return zip(part["id"].tolist(), part["y"].tolist(), part["ok"].tolist(), *part["x"].T.tolist(), *dens.T.tolist(), strict=True)

    doubles = ", ".join(f"{c} double" for c in [f"x{i}" for i in range(d)] + [f"p{i}" for i in range(n)])
    return _by_run(pool, states, rows, f"id bigint, y double, ok boolean, {doubles}")


def _choose(run: _Run, u: np.ndarray, low: float, high: float, sums: dict[int, list[float]], cfg: Learning, m: np.ndarray) -> tuple[float, float]:
    """(bound, mass) of a run: the grid's bound before the first whose risk exceeds the level.

    ``sums[i]`` holds, for the pool rows between bounds i - 1 and i of the log-ratio, the sums of u
    and s and the largest u / m and s / m.
    """
    n = cfg.n_grid
    s = run.dens[0] if cfg.versus == "first" else run.dens[-1]
    ratio = np.log(u / s)
    total = np.zeros((n + 1, 4))
    for i, own in sums.items():
        total[i] = own
    chosen = None
    for j, bound in enumerate(np.linspace(low, high, n)):
        # rows below the bound keep u, the others are capped
        mass = total[: j + 1, 0].sum() + math.exp(bound) * total[j + 1 :, 1].sum()
        top = max(total[: j + 1, 2].max(), math.exp(bound) * total[j + 1 :, 3].max(initial=0.0)) / mass
        w = np.where(ratio < bound, u, math.exp(bound) * s) / mass / m
        test = top * (1 if cfg.versus == "first" else 2)
        if (w[~run.ok].sum() + test) / (w.sum() + test) > cfg.risk_alpha:
            break
        chosen = (float(bound), float(mass)) if j < n - 1 or chosen is None else chosen
    if chosen is None:  # the least bound violates and stands
        bound = low
        chosen = (float(bound), float(total[0, 0] + math.exp(bound) * total[1:, 1].sum()))
    return chosen


def _quantiles(residual: np.ndarray, weights: dict[str, np.ndarray], alpha: float, level: float) -> dict[str, float]:
    """Half-widths by method: "split", the weighted ones, and "aci" at the run's own level."""
    n = len(residual)
    ordered, values = np.sort(residual), np.append(residual, INF)
    k = math.ceil((1 - alpha) * (n + 1))
    out = {"split": float(ordered[k - 1]) if k <= n else INF}
    for name, w in weights.items():
        out[name] = weighted_quantile(values, w / w.sum(), 1 - alpha)
    place = (1 - level) * n
    low = math.floor(place)
    a, b = (float(ordered[i]) if i < n else INF for i in (low, math.ceil(place)))
    out["aci"] = a if a == b else a + (b - a) * (place - low)
    return out


@drops
def active_learning(rows: DataFrame, steps: int, cfg: Learning) -> DataFrame:
    """(seed, step, method, id, n_train, n_cal, covered, width, mse, bound, level, feasible) of every step of every run.

    ``rows`` hold seed, id, part, x, y, ok and source (see learning_parts). Each step fits the
    model, tilts the pool by its variance, caps the policy at the bound, draws a row, holds each
    method's interval against it, moves the level and the bound by the outcome, and adds the row to
    training (then its policy is forgotten) or to calibration.

    A run without training rows starts from the prior; one without pool rows ends at once; null
    and NaN features or labels are not allowed.
    """
    spark = rows.sparkSession
    first = rows.select("x").first()
    d = len(first["x"]) if first else 0
    xs = [f"x{i}" for i in range(d)]
    rows = cut(rows.select("seed", "id", "part", *[F.get("x", F.lit(i)).alias(c) for i, c in enumerate(xs)], "y", "ok", F.col("source").alias("p0")), "rows")
    starts = [r[0] for r in rows.filter("part = 'pool'").select("seed").distinct().limit(RUNS + 1).collect()]
    if len(starts) > RUNS:
        raise ValueError(f"at most {RUNS} runs go together")
    runs: dict[int, _Run] = {}
    begun: dict[int, dict[str, list]] = {s: {"train": [], "cal": []} for s in starts}
    for r in rows.filter("part in ('train', 'cal')").orderBy("seed", "id").toLocalIterator():  # sizes are parameters
        if r["seed"] in begun:
            begun[r["seed"]][r["part"]].append(r)
    for s, own in begun.items():
        cal = own["cal"]
        run = _Run(np.eye(d), np.zeros(d), np.array([[r[c] for c in xs] for r in cal], float).reshape(-1, d), np.array([r["y"] for r in cal], float), np.array([r["ok"] for r in cal], bool), np.array([[r["p0"] for r in cal]], float), cfg.alpha, len(cal))
        for r in own["train"]:
            run.train(np.array([r[c] for c in xs], float), r["y"], cfg.noise)
        runs[s] = run
    n_train = {s: len(own["train"]) for s, own in begun.items()}
    val = cut(rows.filter("part = 'val'").join(F.broadcast(spark.createDataFrame([(s,) for s in starts], "seed int")), "seed", "left_semi").select("seed", *xs, "y"), "val") if starts else None
    pool, at = rows.filter("part = 'pool'").select("seed", "id", "y", "ok", *xs, "p0"), None
    out: list[tuple] = []
    for step in range(steps if starts else 0):
        states = {}
        for s, r in runs.items():
            r.weights = [float(r.first), *[1.0] * (len(r.dens) - 1)]
            states[s] = _State(_Policy(r.posterior, cfg.lam, 1.0), r.carried, np.array(r.weights), cfg.versus == "first", r.coefficients, r.written)
        mse = dict(_by_run(val, states, _errors, "total double, n bigint").groupBy("seed").agg(F.sum("total") / F.sum("n")).collect())
        for s, low, high in _by_run(pool.select("seed", *xs), states, _variances, "low double, high double").groupBy("seed").agg(F.min("low"), F.max("high")).collect():
            states[s].policy.span = float(high - low) or 1.0
        known = pool.drop("id", "y", "ok")
        spans = {r[0]: r[1:] for r in _by_run(known, states, _tilts, "e double, low double, high double").groupBy("seed").agg(F.sum("e"), F.min("low"), F.max("high")).collect()}
        picked = {}
        for s in runs:
            states[s].policy.z = spans[s][0]
        u_cal = {s: states[s].policy.tilt(r.x) / spans[s][0] for s, r in runs.items()}
        m_cal = {s: np.average(r.dens, axis=0, weights=r.weights) for s, r in runs.items()}
        low = {s: spans[s][1] - math.log(spans[s][0]) for s in runs}
        high = {s: spans[s][2] - math.log(spans[s][0]) for s in runs}
        if cfg.control == "search":
            for s in runs:
                states[s].grid = np.linspace(low[s], high[s], cfg.n_grid)
            sums: dict = {s: {} for s in runs}
            made = _by_run(known, states, _intervals, "i int, u double, s double, u_top double, s_top double")
            for s, i, *own in made.groupBy("seed", "i").agg(F.sum("u"), F.sum("s"), F.max("u_top"), F.max("s_top")).collect():  # runs times a grid
                sums[s][i] = own
            picked = {s: _choose(runs[s], u_cal[s], low[s], high[s], sums[s], cfg, m_cal[s]) for s in runs}
        elif cfg.control == "preset":
            for s in runs:
                states[s].policy.bound = runs[s].bound
            picked = {s: (runs[s].bound, mass) for s, mass in _by_run(known, states, _masses, "mass double").groupBy("seed").agg(F.sum("mass")).collect()}
        else:
            picked = {s: (INF, 1.0) for s in runs}
        for s in runs:
            states[s].policy.bound, states[s].policy.mass = picked[s]
        gumbel = -F.ln(-F.ln(F.greatest(md5_uniform(f"draw:{cfg.seed}:{step}", "seed", "id"), F.lit(1e-300))))
        drawn = _by_run(pool.withColumn("gumbel", gumbel), states, _draws, "_key double, id bigint, x array<double>, y double, ok boolean, dens array<double>, fit double, m double")
        row = F.struct("_key", "id", "x", "y", "ok", "dens", "fit", "m")
        for got in drawn.groupBy("seed").agg(F.max_by(row, F.struct("_key", "id")).alias("r")).collect():
            s, r = got["seed"], got["r"]
            run, (bound, mass) = runs[s], picked[s]
            x = np.array(r["x"], float)
            own = states[s].policy.density(run.x, run.dens[0] if cfg.versus == "first" else run.dens[-1])
            dens = np.vstack([np.vstack([run.dens, own]).T, r["dens"]]).T  # calibration rows, then the drawn one
            ratios = dens / dens[0]
            active = len(run.y) - run.first + 1
            weights = {f"feedback_{k}": feedback(ratios, min(k, active)) for k in cfg.depths}
            weights["mixture"] = dens[-1] if cfg.control == "none" else dens[-1] / np.append(m_cal[s], r["m"])
            widths = _quantiles(np.abs(run.y - run.x @ run.coefficients), weights, cfg.alpha, run.level)
            miss = abs(r["y"] - r["fit"])
            out += [(s, step, method, r["id"], n_train[s], len(run.y), bool(miss <= q), float(2 * q), float(mse.get(s, math.nan)), float(bound), float(run.level), bool(r["ok"])) for method, q in widths.items()]
            run.level = min(1.0, max(0.0, run.level + cfg.level_rate * (cfg.alpha - (miss > widths["aci"]))))
            run.bound += cfg.bound_rate * (cfg.risk_alpha - (not r["ok"]))
            if uniform("train", cfg.seed, s, step) <= cfg.train_share:
                run.train(x, r["y"], cfg.noise)
                n_train[s] += 1
            else:
                run.x, run.y, run.ok, run.dens = np.vstack([run.x, x]), np.append(run.y, r["y"]), np.append(run.ok, r["ok"]), dens
                run.carried = [*run.carried, states[s].policy]
        if step + 1 < steps and max(len(r.carried) for r in runs.values()) >= CARRIED:
            for s, r in runs.items():
                states[s].carried, r.carried, r.written = r.carried, [], r.written + len(r.carried)
            folded = _folded(pool, states)
            before, at = at, write(folded, "pool")
            pool = spark.read.schema(folded.schema).parquet(at)
            if before:
                delete(spark, [before])
    if at:
        delete(spark, [at])
    return spark.createDataFrame(out, "seed int, step int, method string, id bigint, n_train int, n_cal int, covered boolean, width double, mse double, bound double, level double, feasible boolean")
