"""Column helpers for the rules that all operators share.

Lower scores are better. A score is *feasible* when it is finite; null, NaN and both infinities
are infeasible. Comparisons with NaN are false. Draws are replaced by ranks of an MD5 key, so
results do not depend on partitioning and repeat in any SQL engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
#: The smallest positive normal double; the lower end of a safe grid.
TINY = 2.2250738585072014e-308


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def infeasible(score: str | Column) -> Column:
    c = col(score)
    return c.isNull() | F.isnan(c) | (F.abs(c) == INF)


def feasible(score: str | Column) -> Column:
    return ~infeasible(score)


def finite(score: str | Column) -> Column:
    """The score, or null if infeasible; what aggregates over feasible scores read."""
    return F.when(feasible(score), col(score))


def np_div(a: str | Column, b: str | Column) -> Column:
    """Division that gives infinities and NaN instead of an error."""
    a, b = col(a).cast("double"), col(b).cast("double")
    zero = F.when(F.isnan(a) | (a == 0), float("nan")).when(a > 0, INF).otherwise(-INF)
    return F.when(b == 0, zero).otherwise(F.try_divide(a, b))


def greater(a: Column, b) -> Column:
    """a > b, false for NaN and null."""
    return F.coalesce(~F.isnan(a) & (a > b), F.lit(False))


def list_text(values: str | Column) -> Column:
    """``[1, 2]`` with a space after each comma."""
    return F.concat(F.lit("["), F.array_join(F.transform(col(values), lambda x: x.cast("string")), ", "), F.lit("]"))


def md5_key(seed: int | str, *keys: str | Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[col(k).cast("string") for k in keys]))


def md5_uniform(seed: int | str, *keys: str | Column) -> Column:
    """A uniform number in [0, 1) from the first 48 bits of the key."""
    return F.conv(F.substring(md5_key(seed, *keys), 1, 12), 16, 10).cast("double") / F.lit(float(2**48))
