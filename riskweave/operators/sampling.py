"""Samples, splits and mixes of scored rows, and decisions over proposals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..semantics import finite, infeasible, md5_key, md5_uniform
from .ranking import TOP, Fold, fold_in_order, lowest, lowest_md5, quantiles, running


def best_scoring(df: DataFrame, k: int, score: str = "score", id_col: str = "id") -> DataFrame:
    """The k lowest scores; infeasible ones last."""
    return lowest(df, k, infeasible(score), F.asc_nulls_last(score), F.col(id_col))


def largest_scoring(df: DataFrame, k: int, score: str = "score", id_col: str = "id") -> DataFrame:
    """The k highest feasible-first scores, NaN last (the direction that train splits take)."""
    return lowest(df, k, F.desc_nulls_last(F.when(~F.isnan(score), F.col(score))), F.col(id_col))


def uniform(df: DataFrame, n: int, seed: int, id_col: str = "id") -> DataFrame:
    """n rows without replacement: the lowest MD5 keys."""
    return lowest_md5(df, n, seed, id_col)


def fraction(df: DataFrame, share: float, seed: int, id_col: str = "id") -> DataFrame:
    return uniform(df, round(df.count() * share), seed, id_col)


def combination(df: DataFrame, n: int, seed: int, score: str = "score", id_col: str = "id") -> DataFrame:
    """Half the best, half uniform; a row may come twice."""
    return best_scoring(df, n // 2, score, id_col).unionAll(uniform(df, n - n // 2, seed, id_col))


def seed_mix(old: DataFrame, current: DataFrame, k: int, old_share: float, first_iteration: bool = False) -> DataFrame:
    """int(k * share) of the old rows and the rest of the new ones; fewer new rows leave more to the old."""
    if first_iteration:
        return best_scoring(current, k)
    have = current.count()
    if not have:
        return old
    new = min(k - int(k * old_share), have)
    return best_scoring(old, k - new).unionByName(best_scoring(current, new))


def calibration_split(df: DataFrame, share: float, seed: int, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """(calibration, train): a uniform share, and the rows that are not in it."""
    cal = fraction(df, share, seed, id_col)
    return cal, df.join(cal.select(id_col), id_col, "left_anti")


def old_data_mix(old: DataFrame, file_col: str, n_files: int, n_current: int, share: float, least: int, seed: int, id_col: str = "id") -> DataFrame:
    """ceil(max(n_current * share, least) / n_files) rows of each old file."""
    n = -(-max(int(n_current * share), least) // n_files)
    w = Window.partitionBy(file_col).orderBy(md5_key(seed, id_col), id_col)
    return old.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def cap_infeasible(df: DataFrame, share: float, seed: int, score: str = "score", id_col: str = "id") -> DataFrame:
    """Infeasible rows down to at most ``share`` of the result; feasible ones all stay."""
    counts = df.agg(F.count_if(~infeasible(score)).alias("ok")).first()["ok"]
    cap = round(counts * share / (1 - share))  # half to even
    bad = lowest_md5(df.filter(infeasible(score)), cap, seed, id_col)
    return df.filter(~infeasible(score)).unionByName(bad)


def quantile_filter(df: DataFrame, lik: str, low: float, high: float | None = None) -> DataFrame:
    """Rows whose likelihood is at least the lower quantile (and at most the upper); NaN never stays."""
    q = quantiles(df, lik, [low] if high is None else [low, high]).first()
    if q is None:
        return df.limit(0)
    out = df.filter(~F.isnan(lik) & (F.col(lik) >= q[0]))
    return out if high is None else out.filter(F.col(lik) <= q[1])


def accept_until(df: DataFrame, probability: Column, draw: Column, target: int, chain: str, order: list[str]) -> DataFrame:
    """Rows with ``accepted``, up to the target-th acceptance of each chain; later ones are not judged."""
    judged = df.withColumn("accepted", draw < probability)
    ranked = running(judged, order[0], order[1:], [chain], {"_run": F.col("accepted").cast("bigint")}, name="_rn")
    return ranked.filter(F.col("_run") - F.col("accepted").cast("bigint") < target).drop("_run", "_rn").select(*judged.columns)


def accept_first(df: DataFrame, probability: Column, draw: Column, target: int, order: str) -> DataFrame:
    """accept_until of one chain: a small target is a top-k of the accepted rows, without ranks of all."""
    judged = df.withColumn("accepted", draw < probability)
    if not 0 < target <= TOP:
        return accept_until(df.withColumn("_chain", F.lit(0)), probability, draw, target, "_chain", [order]).drop("_chain")
    last = lowest(judged.filter("accepted").select(order), target, order).agg(F.max(order), F.count("*")).first()
    return judged.filter(F.col(order) <= last[0]) if last[1] == target else judged


class Metropolis(Fold):
    """A row (chain, order, target, proposal, draw) against the ratio w = target / proposal of the last accepted one.

    A row takes its place if w < (its own ratio) / draw, whatever else went before. So a stretch is
    a short table over w: the first row that would take its place, among the rows whose limit
    exceeds those of all rows before, decides what stands at the end.
    """

    def step(self, state, row):
        own = row[2] / row[3]
        ok = state is None or row[4] < min(1.0, own / state)
        return own if ok else state, (ok,)

    def summary(self, rows):
        own = [r[2] / r[3] for r in rows]
        limits = [w / r[4] if r[4] > 0 else math.inf for w, r in zip(own, rows, strict=True)]
        # from the end: rows whose limit exceeds those of the rows between, nearest last
        records: list[int] = []
        final = [0.0] * len(rows)
        for i in range(len(rows) - 1, -1, -1):
            taken = self._first(records, limits, own[i])
            final[i] = own[i] if taken is None else final[taken]
            while records and limits[records[-1]] <= limits[i]:
                records.pop()
            records.append(i)
        table: list[tuple[float, float]] = []
        for i in reversed(records):  # rising limits
            if table and table[-1][1] == final[i]:
                table.pop()
            table.append((limits[i], final[i]))
        return final[0], table

    @staticmethod
    def _first(records, limits, w):
        """The nearest record whose limit exceeds w; limits rise from the nearest, the last, to the farthest."""
        low, high = 0, len(records)
        while low < high:  # how many of the farther ones exceed w
            mid = (low + high) // 2
            if limits[records[mid]] > w:
                low = mid + 1
            else:
                high = mid
        return records[low - 1] if low else None

    def through(self, summary, state):
        first, table = summary
        if state is None:
            return first  # the first row of a chain is accepted
        return next((w for limit, w in table if state < limit), state)


def metropolis_chain(df: DataFrame, chain: str, order: str, target: str, proposal: str, draw: str, ranges: int | None = None) -> DataFrame:
    """Independent Metropolis-Hastings: each row against the last accepted one of its chain.

    The first row of a chain is accepted. A chain is sequential, but stretches of it compose, so a
    long one goes over all tasks.
    """
    rows = df.select(chain, order, target, proposal, draw)
    return fold_in_order(rows, [chain], [order], Metropolis(), "accepted boolean", ranges).select(chain, order, "accepted")


def weighted_sample(df: DataFrame, n: int, weight: str, seed: int, id_col: str = "id") -> DataFrame:
    """n rows without replacement in proportion to weight: the largest ln(u) / w."""
    key = F.ln(F.greatest(md5_uniform(seed, id_col), F.lit(1e-300))) / F.when(F.isnan(weight), 1.0).otherwise(F.col(weight))
    keyed = df.withColumn("_key", -key)
    if n <= TOP:
        return lowest(keyed, n, "_key", id_col).drop("_key")
    return running(keyed, "_key", [id_col], name="_rn").filter(F.col("_rn") <= n).drop("_key", "_rn")


def bootstrap(df: DataFrame, n: int, seed: int, id_col: str = "id") -> DataFrame:
    """n draws with replacement: (draw, and the row's columns); a draw is a uniform place among the rows."""
    total = df.count()
    ranked = running(df, id_col, [], name="_rn")
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), (F.floor(md5_uniform(seed, "id") * total) + 1).alias("_rn"))
    return draws.join(ranked, "_rn").drop("_rn")


def until_target(df: DataFrame, batch: str, target: int) -> DataFrame:
    """Rows of a generation loop's batches, up to the batch that reaches the target."""
    sizes = df.groupBy(batch).agg(F.count("*").alias("_n"))
    before = running(sizes, batch, [], sums={"_run": F.col("_n")}).select(batch, (F.col("_run") - F.col("_n")).alias("_before"))
    return df.join(before.filter(F.col("_before") < target).select(batch), batch, "left_semi")


def sample_quality(df: DataFrame, score: str = "score", by: tuple[str, ...] = ()) -> DataFrame:
    """Counts of rows, parsable and feasible ones, and statistics of feasible scores."""
    c = F.col(score)
    parsable = c.isNotNull() & ~F.isnan(c)
    ok = finite(score)
    return df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(parsable).alias("n_parsable"),
        F.count(ok).alias("n_feasible"),
        (F.count(ok) / F.greatest(F.count("*"), F.lit(1))).alias("fraction_feasible"),
        F.avg(ok).alias("mean_score"),
        F.min(ok).alias("min_score"),
        F.max(ok).alias("max_score"),
    )
