"""Ranks, running sums and quantiles without gathering a table or a group in one task.

A large table is sorted by ranges of (group, value, ties) and written with the number of each row
where it stands. Ranges are cut at any of these columns, so neither a large group nor a value that
most rows share ends up in one of them, as long as the ties tell rows apart. A small table of counts and sums by group and range gives
what stands before each range.
"""

from __future__ import annotations

import pickle

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..semantics import col, md5_key
from ..storage import cut

#: Rows that one window may rank; a table with no more is ranked as it is.
ROWS = 200_000
#: Up to so many rows a top-k keeps them in each task; more are ranked by ranges.
TOP = 20_000
#: Counts by group and range are broadcast up to so many rows, else joined.
FEW = 100_000


def running(df: DataFrame, value: str, ties: list[str], by: list[str] = (), sums: dict[str, Column] | None = None, name: str = "rn", size: str | None = None, ranges: int | None = None) -> DataFrame:
    """df with a row number, and running sums, by ``value`` and ``ties`` within each group of ``by``.

    ``size`` adds the number of rows of each row's group. Null sorts first and NaN last; rows of a
    null group are a group. ``ranges`` deals the rows to so many ranges whatever their number.
    """
    by, sums = list(by), sums or {}
    order = [value, *ties]
    if ranges is None and df.count() <= ROWS:
        w = Window.partitionBy(*by).orderBy(*order)
        out = df.withColumns({name: F.row_number().over(w).cast("bigint"), **{k: F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)) for k, c in sums.items()}})
        return out.withColumn(size, F.count("*").over(Window.partitionBy(*by))) if size else out
    parts = {f"_s{i}": c for i, c in enumerate(sums.values())}
    dealt = df.withColumns(parts).repartitionByRange(*([ranges] if ranges else []), *by, *order).sortWithinPartitions(*by, *order)
    placed = cut(dealt.withColumn("_at", F.monotonically_increasing_id()), "ranked").withColumn("_part", F.shiftright("_at", 33))
    own = Window.partitionBy(*by)
    earlier = own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # at most one row a range
    runs = placed.groupBy(*by, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"), *[F.sum(c).alias(c) for c in parts])
    runs = cut(runs.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_part").alias("_p"), "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(own).alias("_size"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_b{c}") for c in parts]), "runs")
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    both = placed.join(F.broadcast(runs) if runs.count() <= FEW else runs, same)
    so_far = Window.partitionBy("_part", *by).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    added = {name: F.col("_at") - F.col("_first") + F.col("_before") + 1, **{k: F.sum(p).over(so_far) + F.col(f"_b{p}") for k, p in zip(sums, parts, strict=True)}}
    out = both.withColumns(added | ({size: F.col("_size")} if size else {}))
    return out.select(*df.columns, *[c for c in [*added, size] if c and c not in df.columns])


def global_row_number(df: DataFrame, value: str, *ties: str, name: str = "rn", ranges: int | None = None) -> DataFrame:
    """row_number() over (order by value, ties)."""
    return running(df, value, list(ties), name=name, ranges=ranges)


def lowest(df: DataFrame, k: int, *order) -> DataFrame:
    """The first k rows by an order that ends in a unique column; a distributed top-k for a small k."""
    return df.orderBy(*order).limit(k)


def lowest_md5(df: DataFrame, k: int, seed: int | str, id_col: str) -> DataFrame:
    """The k rows with the lowest MD5 keys, for any k: a share of a table is ranked by ranges."""
    if k <= TOP:
        return lowest(df, k, md5_key(seed, id_col), F.col(id_col))
    prefix = F.conv(F.substring(md5_key(seed, id_col), 1, 12), 16, 10).cast("bigint")
    marked = df.withColumns({"_prefix": prefix, "_md5": md5_key(seed, id_col)})
    return running(marked, "_prefix", ["_md5", id_col], name="_rn").filter(F.col("_rn") <= k).drop("_prefix", "_md5", "_rn")


def first_rows(df: DataFrame, k: int, value: Column, bound: float, by: list[str], fixed: list[str], groups: int, name: str = "rn", ranges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(the first k rows of each group by ``value`` and ``fixed``, with their number; the other rows as they are).

    ``fixed`` columns and the group tell the value, which is made once: rows up to ``bound`` are
    written and numbered, the others are those whose columns are not among them. If one of so many
    ``groups`` has fewer than k rows up to the bound, all rows are numbered. No column is null.
    """
    near = cut(df.withColumn("_value", value).filter(F.col("_value") <= bound), "near")
    if near.groupBy(*by).count().filter(F.col("count") >= k).count() >= groups:
        rest = df.join(F.broadcast(near.select(*by, *fixed).distinct()), [*by, *fixed], "left_anti").select(*df.columns)
    else:
        near, rest = cut(df.withColumn("_value", value), "near"), df.limit(0)
    ranked = cut(running(near, "_value", fixed, by, name=name, ranges=ranges).drop("_value"), "numbered")
    return ranked.filter(F.col(name) <= k), ranked.filter(F.col(name) > k).select(*df.columns).unionByName(rest)


def quantiles(df: DataFrame, value: str | Column, shares: list[float], by: list[str] = (), tie: str | None = None) -> DataFrame:
    """(by, q0, q1, ...): exact quantiles with linear interpolation of values that are neither null nor NaN.

    The two rows around each place are picked by rank; no group is held in one buffer.
    """
    by = list(by)
    v = col(value).cast("double")
    rows = df.select(*by, v.alias("_v"), (F.col(tie) if tie else F.monotonically_increasing_id()).alias("_tie")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    both = running(rows, "_v", ["_tie"], by, name="_rn", size="_all")  # any order of equal values will do
    place = lambda q: (F.col("_all") - 1) * F.lit(float(q))
    picked = []
    for i, q in enumerate(shares):
        low, high = F.floor(place(q)), F.ceil(place(q))
        picked += [F.max(F.when(F.col("_rn") - 1 == low, F.col("_v"))).alias(f"_l{i}"), F.max(F.when(F.col("_rn") - 1 == high, F.col("_v"))).alias(f"_h{i}"), F.max(place(q) - low).alias(f"_f{i}")]
    near = F.lit(False)
    for q in shares:
        near = near | (F.abs(F.col("_rn") - 1 - place(q)) < 1)
    found = both.filter(near).groupBy(*by).agg(*picked)
    at = lambda i: F.when(F.col(f"_l{i}") == F.col(f"_h{i}"), F.col(f"_l{i}")).otherwise(F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * F.col(f"_f{i}"))
    return found.select(*by, *[at(i).alias(f"q{i}") for i in range(len(shares))])


def with_totals(df: DataFrame, by: list[str], totals: dict[str, Column], salts: int = 32) -> DataFrame:
    """df with aggregates of each row's group of ``by``; rows of a null group are a group.

    Totals of few groups go to the rows. Many go by a join in which the rows of one group are
    dealt to several tasks.
    """
    sums = cut(df.groupBy(*by).agg(*[c.alias(n) for n, c in totals.items()]).withColumnsRenamed({c: f"_by{i}" for i, c in enumerate(by)}), "totals")
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    if sums.count() <= FEW:
        out = df.join(F.broadcast(sums), same)
    else:
        many = sums.withColumn("_many", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        out = df.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")).join(many, same & (F.col("_salt") == F.col("_many")))
    return out.select(*df.columns, *totals)


class Fold:
    """A sequential step over the rows of a chain, and how a stretch of it acts on any state before it."""

    #: The state before a chain's first row.
    start = None

    def step(self, state, row: tuple) -> tuple:
        """(state after the row, the row's added values)."""
        raise NotImplementedError

    def summary(self, rows: list[tuple]):
        """What ``through`` needs of a stretch: small, and without a state."""
        raise NotImplementedError

    def through(self, summary, state):
        """The state after a stretch that is entered with ``state``."""
        raise NotImplementedError


def _chains(batches, keys: list[int]):
    """(key, rows of one chain) of sorted batches; a chain may come in several pieces, one after the other."""
    for pdf in batches:
        rows = list(pdf.itertuples(index=False, name=None))
        begin = 0
        while begin < len(rows):
            key = tuple(rows[begin][i] for i in keys)
            end = begin + 1
            while end < len(rows) and tuple(rows[end][i] for i in keys) == key:
                end += 1
            yield key, rows[begin:end]
            begin = end


def fold_in_order(df: DataFrame, by: list[str], order: list[str], fold: Fold, columns: str, ranges: int | None = None) -> DataFrame:
    """Rows of ``df`` with what a sequential fold makes of them, chain by chain in order.

    A table of few rows streams each chain through one task. A larger one (or any, with ``ranges``)
    is sorted by ranges that cut long chains into stretches: a first pass sums each range's last
    chain up, the driver carries states over the ranges, one at most for each, and a second pass
    starts every stretch from its state. A chain of any length goes over all tasks.
    """
    import pandas as pd
    from pyspark.sql.types import StructType, _parse_datatype_string

    added = _parse_datatype_string(columns)
    names = df.columns
    keys = [names.index(c) for c in by]
    schema = StructType([*df.schema.fields, *added.fields])

    def folded(batches, entering=None):
        """Rows with the added values; ``entering`` is (key, state) of a chain that began before."""
        last = state = None
        for key, rows in _chains(batches, keys):
            if last is None or key != last:
                last, state = key, entering[1] if last is None and entering and entering[0] == key else fold.start
            out = []
            for row in rows:
                state, values = fold.step(state, row)
                out.append((*row, *values))
            yield pd.DataFrame(out, columns=[*names, *added.names])

    if ranges is None and df.count() <= ROWS:
        return df.repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(folded, schema)
    dealt = df.repartitionByRange(*([ranges] if ranges else []), *by, *order).sortWithinPartitions(*by, *order)
    placed = cut(dealt.withColumn("_at", F.monotonically_increasing_id()), "chains").withColumn("_part", F.shiftright("_at", 33).cast("int"))
    parts = placed.repartition("_part").sortWithinPartitions("_part", "_at")

    def by_part(batches):
        """(part, batches without the places) of sorted batches of several parts."""
        pending = None
        for pdf in batches:
            for part, own in pdf.groupby("_part", sort=True):
                own = own[names]
                if pending and pending[0] == part:
                    pending[1].append(own)
                else:
                    if pending:
                        yield pending
                    pending = (part, [own])
        if pending:
            yield pending

    def ends(batches):
        for part, own in by_part(batches):
            first = last = None
            held: list[tuple] = []
            for key, rows in _chains(own, keys):
                first = key if first is None else first
                held = held + rows if key == last else rows
                last = key
            if first == last:
                through, state = fold.summary(held), None
            else:
                through, state = None, fold.start
                for row in held:
                    state, _ = fold.step(state, row)
            yield pd.DataFrame([(int(part), pickle.dumps((first, last, through, state)))], columns=["part", "end"])

    entering, carried = {}, None
    for part, end in sorted(map(tuple, parts.mapInPandas(ends, "part int, end binary").collect())):  # one row a range
        first, last, through, state = pickle.loads(end)
        if carried and carried[0] == first:
            entering[part] = carried
        if first == last:
            state = fold.through(through, carried[1] if part in entering else fold.start)
        carried = (last, state)
    sent = df.sparkSession.sparkContext.broadcast(entering)

    def finished(batches):
        for part, own in by_part(batches):
            yield from folded(own, sent.value.get(int(part)))

    return parts.mapInPandas(finished, schema)
