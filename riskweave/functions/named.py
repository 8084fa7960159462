"""Losses, distances, rewards and checks by name: column expressions that a plan looks up when it is built."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..semantics import col, infeasible
from .arrays import euclidean, hamming, manhattan
from .maths import reward, score_distance

Expression = Callable[..., Column]


class Named:
    """Expressions of one kind. A name must be known and is added once; an expression itself is taken as it is."""

    def __init__(self, kind: str, **known: Expression):
        self.kind, self._known = kind, dict(known)

    def add(self, name: str, expression: Expression) -> None:
        if name in self._known:
            raise ValueError(f"there is a {self.kind} of this name: {name}")
        self._known[name] = expression

    def names(self) -> list[str]:
        return sorted(self._known)

    def __call__(self, wanted: str | Expression) -> Expression:
        if callable(wanted):
            return wanted
        if wanted not in self._known:
            raise ValueError(f"no such {self.kind}: {wanted} (known: {', '.join(self.names())})")
        return self._known[wanted]


#: Of a response's retained claims: (how many, how many of them are false).
LOSSES = Named("loss", rate=lambda n, false: false / F.greatest(n, F.lit(1)), any=lambda n, false: F.when(false > 0, 1.0).otherwise(0.0))
#: Of two sequences of one length.
DISTANCES = Named("distance", hamming=hamming, euclidean=euclidean, manhattan=manhattan)
#: Of the scores before and after an edit.
REWARDS = Named("reward", margin=reward, distance=score_distance)
#: Whether a score breaks the constraint that a bound search controls.
VIOLATIONS = Named("violation", infeasible=infeasible, positive=lambda score: infeasible(score) | (col(score) > 0))
