"""Running summaries of proposal streams on Structured Streaming.

The batch operators judge finished tables; these keep the same figures for tables that grow.
Sequential figures (controllers, chains, a generation loop's end) are the same folds as in batch,
with each chain's state kept by the stream. An addition of this engine.
"""

from __future__ import annotations

import pickle

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from ..operators.conformal import Clipped
from ..operators.ranking import Fold
from ..semantics import finite


def acceptance_by_window(stream: DataFrame, time: str, accepted: Column, window: str = "10 minutes", late: str = "1 hour", by: tuple[str, ...] = ()) -> DataFrame:
    """(window, by, n_proposals, n_accepted, rate) with a watermark for late rows."""
    counted = stream.withWatermark(time, late).groupBy(F.window(time, window), *by).agg(F.count("*").alias("n_proposals"), F.count_if(accepted).alias("n_accepted"))
    return counted.withColumn("rate", F.col("n_accepted") / F.greatest("n_proposals", F.lit(1)))


def quality_by_window(stream: DataFrame, time: str, score: str = "score", window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(window, n, n_feasible, mean_score, min_score) over feasible scores."""
    ok = finite(score)
    return stream.withWatermark(time, late).groupBy(F.window(time, window)).agg(F.count("*").alias("n"), F.count(ok).alias("n_feasible"), F.avg(ok).alias("mean_score"), F.min(ok).alias("min_score"))


class Additive(Fold):
    """A level that rises by rate * alpha after a feasible row and falls by rate * (1 - alpha) after another."""

    def __init__(self, alpha: float, rate: float, start: float = 0.0):
        self.start, self.alpha, self.rate = start, alpha, rate

    def step(self, state, row):
        return state + self.rate * (self.alpha if row[2] else self.alpha - 1), (state,)


class Until(Fold):
    """Whether a row's batch began before ``target`` rows had come."""

    start = (None, 0, 0)

    def __init__(self, target: int):
        self.target = target

    def step(self, state, row):
        batch, before, n = state
        if row[1] != batch:
            batch, before = row[1], n
        return (batch, before, n + 1), (before < self.target,)


def fold_stream(stream: DataFrame, by: str, order: str, fold: Fold, columns: str) -> DataFrame:
    """The stream's rows with what a fold makes of them; ``by`` names their chain.

    Rows of a chain come in order over the batches; within one they are sorted. The state of a
    chain outlives a restart. In append mode, as every row is answered once.
    """
    import pandas as pd

    added = _parse_datatype_string(columns)
    names = stream.columns

    def run(key, parts, state):
        now = pickle.loads(state.get[0]) if state.exists else fold.start
        rows = pd.concat(list(parts)).sort_values(order, kind="stable")
        out = []
        for row in rows.itertuples(index=False, name=None):
            now, values = fold.step(now, row)
            out.append((*row, *values))
        state.update((pickle.dumps(now),))
        yield pd.DataFrame(out, columns=[*names, *added.names])

    return stream.groupBy(by).applyInPandasWithState(run, StructType([*stream.schema.fields, *added.fields]), "state binary", "append", "NoTimeout")


def clipped_levels(stream: DataFrame, by: str, order: str, missed: str, alpha: float, rate: float) -> DataFrame:
    """(by, order, missed, level) as conformal.clipped_controller has them."""
    return fold_stream(stream.select(by, F.col(order).cast("bigint").alias(order), F.col(missed).cast("double").alias(missed)), by, order, Clipped(alpha, rate), "level double")


def additive_levels(stream: DataFrame, by: str, order: str, feasible: str, alpha: float, rate: float, start: float = 0.0) -> DataFrame:
    """(by, order, feasible, level) as conformal.additive_controller has them."""
    return fold_stream(stream.select(by, order, feasible), by, order, Additive(alpha, rate, start), "level double")


def rows_until(stream: DataFrame, by: str, batch: str, target: int) -> DataFrame:
    """Rows of each loop's batches up to the one that reaches the target, as sampling.until_target has them."""
    rest = [c for c in stream.columns if c not in (by, batch)]
    return fold_stream(stream.select(by, batch, *rest), by, batch, Until(target), "_kept boolean").filter("_kept").drop("_kept")
