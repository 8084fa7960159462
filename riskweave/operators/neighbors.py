"""Pairs of similar sequences, and the pairs and triples that training reads.

Nearest neighbours are found by growing radius over distinct sequences: at radius r (places that
differ) two sequences meet by an equi-join on the places where they agree, so a pair at distance r
meets once, and sequences that have enough neighbours take no part in larger radii. Rows of one
sequence stand behind it with their first ids only, as no row needs more of them. A table of few
sequences is held by every task instead, which compares its share with all of them in vectors and
emits the nearest only.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.maths import score_distance
from ..functions.named import DISTANCES, Expression
from ..semantics import feasible, md5_key, md5_uniform
from ..storage import cut, drops
from .ranking import running, with_totals

#: Up to so many subsets of places are enumerated at a radius; beyond, places are cut into blocks.
SUBSETS = 128
#: Up to so many rows behind distinct sequences are held by every task.
DIRECT = 16_384
#: Parts that the rows of one sequence are dealt to before its first ids are picked.
SALTS = 64


def dedup_first(df: DataFrame, key: str = "particle", order: str = "id") -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def _keys(dim: int, r: int) -> tuple[list[list[int]], bool]:
    """Lists of places such that sequences r places apart agree on one; whether on exactly one."""
    if math.comb(dim, r) <= SUBSETS:
        return [list(c) for c in itertools.combinations(range(dim), dim - r)], True
    cuts = [round(i * dim / (r + 1)) for i in range(r + 2)]
    return [list(range(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)], False


def radius_pairs(left: DataFrame, right: DataFrame, dim: int, r: int) -> DataFrame:
    """(a, b) of ids whose particles differ in exactly r places."""
    places, once = _keys(dim, r)
    key = F.posexplode(F.array(*[F.xxhash64(F.lit(i), *[F.get("particle", F.lit(j)) for j in own]) for i, own in enumerate(places)])) if r < dim else F.posexplode(F.array(F.lit(0).cast("bigint")))
    x = left.select("id", "particle", key.alias("k", "key")).withColumnsRenamed({"id": "a", "particle": "pa"})
    y = right.select("id", "particle", key.alias("k", "key")).withColumnsRenamed({"id": "b", "particle": "pb"})
    differ = F.lit(0)  # compiled, place by place
    for i in range(dim):
        differ = differ + (F.get("pa", F.lit(i)) != F.get("pb", F.lit(i))).cast("int")
    met = x.join(y, ["k", "key"]).filter(differ == r).select("a", "b")
    return met if once else met.distinct()


def neighbours(df: DataFrame, dim: int, threshold: float, k: int) -> DataFrame:
    """(src, dst, dist): at most k nearest others within the threshold, ties by id."""
    most = min(dim, math.floor(threshold * dim + 1e-9))
    df = cut(df.select("id", "particle"), "rows")  # read by every step below
    salted = Window.partitionBy("particle", F.pmod(F.xxhash64("id"), F.lit(SALTS))).orderBy("id")
    first = df.select("id", "particle").withColumn("_rn", F.row_number().over(salted)).filter(F.col("_rn") <= k + 1)
    own = Window.partitionBy("particle")
    first = first.withColumn("_rn", F.row_number().over(own.orderBy("id"))).filter(F.col("_rn") <= k + 1)
    behind = cut(first.select(F.min("id").over(own).alias("pid"), "id", "particle"), "behind")  # at most k + 1 ids of each sequence
    distinct = cut(behind.groupBy("pid").agg(F.first("particle").alias("particle"), F.count("*").alias("c")).withColumnRenamed("pid", "id"), "distinct")
    few = behind.limit(DIRECT + 1).collect()
    nearest = _direct(distinct, few, dim, most, k) if len(few) <= DIRECT else _by_radius(distinct, behind, dim, most, k)
    rows = df.select(F.col("id").alias("src"), "particle").join(distinct.select(F.col("id").alias("a"), "particle"), "particle")
    pairs = rows.select("src", "a").join(nearest.select("a", "dst", "r"), "a").filter("src <> dst")
    rank = F.row_number().over(Window.partitionBy("src").orderBy("r", "dst"))  # at most k + 1 rows each
    return pairs.withColumn("_rn", rank).filter(F.col("_rn") <= k).select("src", "dst", (F.col("r") / F.lit(float(dim))).alias("dist"))


def _direct(distinct: DataFrame, few: list, dim: int, most: int, k: int) -> DataFrame:
    """(a, dst, r): the k + 1 nearest ids of each sequence, itself included, among DIRECT at most."""
    import pyarrow as pa

    few = sorted(few, key=lambda x: x["id"])
    whole = lambda p: p is not None and len(p) == dim and None not in p  # noqa: E731  others are near their own kind only
    points = np.array([x["particle"] if whole(x["particle"]) else [0] * dim for x in few], np.int64).reshape(len(few), dim)
    ids, pids, odd = np.array([x["id"] for x in few], np.int64), np.array([x["pid"] for x in few], np.int64), np.array([not whole(x["particle"]) for x in few], bool)
    sent = distinct.sparkSession.sparkContext.broadcast((points, ids, pids, odd))

    def run(batches):
        points, ids, pids, odd = sent.value
        at = np.arange(len(ids))
        for batch in batches:
            own = batch.column(0).to_numpy()
            place = np.searchsorted(ids, own)  # a sequence's id is its first row's
            for begin in range(0, len(own), 64):
                part = place[begin : begin + 64]
                r = np.zeros((len(part), len(ids)), np.int64)
                for j in range(dim):
                    r += points[part, j][:, None] != points[None, :, j]
                r[:, odd] = dim + 1
                r[odd[part], :] = dim + 1
                r[pids[None, :] == own[begin : begin + 64, None]] = 0
                key = np.where(r <= most, r * len(ids) + at, np.iinfo(np.int64).max)
                n = min(k + 1, len(ids))
                first = np.argpartition(key, n - 1, axis=1)[:, :n]
                row, column = np.nonzero(np.take_along_axis(r, first, 1) <= most)
                dst = first[row, column]
                yield pa.RecordBatch.from_arrays([pa.array(own[begin + row]), pa.array(ids[dst]), pa.array(r[row, dst].astype(np.int32))], names=["a", "dst", "r"])

    return distinct.select(F.col("id").cast("bigint")).repartition(distinct.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, "a bigint, dst bigint, r int")


def _by_radius(distinct: DataFrame, behind: DataFrame, dim: int, most: int, k: int) -> DataFrame:
    """(a, dst, r): the k + 1 nearest ids of each sequence, itself included, by growing radius."""
    found = cut(distinct.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0).alias("r")), "found")
    for r in range(1, most + 1):
        have = found.join(distinct.select(F.col("id").alias("b"), "c"), "b").groupBy("a").agg(F.sum("c").alias("have"))
        short = cut(distinct.join(have.filter(F.col("have") < k + 1).select(F.col("a").alias("id")), "id", "left_semi"), "short")
        if short.isEmpty():
            break
        found = found.union(cut(radius_pairs(short, distinct, dim, r).select("a", "b", F.lit(r).alias("r")), "found"))
    spread = found.join(behind.select(F.col("pid").alias("b"), F.col("id").alias("dst")), "b")
    return spread.withColumn("_rn", F.row_number().over(Window.partitionBy("a").orderBy("r", "dst"))).filter(F.col("_rn") <= k + 1).drop("_rn")


def oriented(pairs: DataFrame, df: DataFrame, same_score: bool = False) -> DataFrame:
    """(lower_id, higher_id, lower_score, higher_score) of id pairs; NaN counts as infinity."""
    s = F.when(F.isnan("score") | F.col("score").isNull(), float("inf")).otherwise(F.col("score"))
    scored = df.select(F.col("id"), s.alias("score"))
    joined = pairs.join(scored.withColumnsRenamed({"id": "a", "score": "sa"}), "a").join(scored.withColumnsRenamed({"id": "b", "score": "sb"}), "b")
    low, high = F.struct(F.col("sa").alias("s"), F.col("a").alias("i")), F.struct(F.col("sb").alias("s"), F.col("b").alias("i"))
    out = joined.select(F.least(low, high).alias("l"), F.greatest(low, high).alias("h"))
    out = out.select(F.col("l.i").alias("lower_id"), F.col("h.i").alias("higher_id"), F.col("l.s").alias("lower_score"), F.col("h.s").alias("higher_score"))
    return out if same_score else out.filter("lower_score <> higher_score")


def dense_pairs(df: DataFrame, dim: int, threshold: float, k: int, score_within: float | None = None) -> DataFrame:
    """Oriented pairs of near neighbours, optionally of near scores."""
    near = neighbours(df, dim, threshold, k).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    out = oriented(near, df)
    if score_within is not None:
        out = out.filter(score_distance(F.col("lower_score"), F.col("higher_score")) <= score_within)
    return out


def minimal_edits(df: DataFrame, dim: int, threshold: float, k: int) -> DataFrame:
    """(src, dst, dist): each row's nearest neighbour of another score; rows without one are left out."""
    scores = df.select("id", "score")
    near = neighbours(df, dim, threshold, k)
    near = near.join(scores.withColumnsRenamed({"id": "src", "score": "s"}), "src").join(scores.withColumnsRenamed({"id": "dst", "score": "d"}), "dst").filter("s <> d")
    best = near.groupBy("src").agg(F.min(F.struct("dist", "dst")).alias("m"))
    return best.select("src", F.col("m.dst").alias("dst"), F.col("m.dist").alias("dist"))


def preference_triples(df: DataFrame, dim: int, threshold: float, k: int) -> DataFrame:
    """(prompt, chosen, rejected): for a prompt, better neighbours over itself and no better ones."""
    scores = df.select("id", "score").filter(feasible("score"))
    near = neighbours(df, dim, threshold, k).select("src", "dst")
    near = near.join(scores.withColumnsRenamed({"id": "dst", "score": "d"}), "dst").join(scores.withColumnsRenamed({"id": "src", "score": "s"}), "src")
    chosen = near.filter("d < s").select("src", F.col("dst").alias("chosen"))
    rejected = near.filter("d >= s").select("src", F.col("dst").alias("rejected")).union(scores.select("id", "id"))
    return chosen.join(rejected, "src").select(F.col("src").alias("prompt"), "chosen", "rejected").distinct()


@drops
def farthest_first(df: DataFrame, n: int, distance: str | Expression = "hamming") -> DataFrame:
    """(id, pos): start at the best score, then each time the row farthest from those chosen.

    n rounds of one aggregate over the table; distances so far are written every few rounds, and
    only the chosen rows come to the driver.
    """
    spark, distance = df.sparkSession, DISTANCES(distance)
    first = df.orderBy("score", "id").limit(1).collect()
    state, chosen = df.withColumn("_near", F.lit(float("inf"))), list(first)
    while first and len(chosen) < n:
        if len(chosen) % 8 == 0:
            state = cut(state, "farthest")
        last = chosen[-1]
        point = F.array(*[F.lit(x) for x in last["particle"]])
        state = state.withColumn("_near", F.least("_near", distance(F.col("particle"), point)))
        best = state.filter(~F.col("id").isin([c["id"] for c in chosen])).orderBy(F.desc("_near"), "score", "id").limit(1).collect()
        if not best:
            break
        chosen.append(best[0])
    return spark.createDataFrame([(c["id"], i) for i, c in enumerate(chosen)], "id bigint, pos int")


def gather_pairs(pairs: DataFrame, df: DataFrame, columns: list[str]) -> DataFrame:
    """(lower_<c>, higher_<c>, ...): the records behind index pairs (a, b), the lower score first; equal scores are left out."""
    out = oriented(pairs.select("a", "b"), df).select("lower_id", "higher_id")
    for side in ("lower", "higher"):
        out = out.join(df.select(F.col("id").alias(f"{side}_id"), *[F.col(c).alias(f"{side}_{c}") for c in columns]), f"{side}_id")
    return out


def skipped_pairs(pairs: DataFrame, df: DataFrame) -> DataFrame:
    """(n_pairs, n_skipped): how many index pairs there are, and how many of them have equal scores."""
    both = oriented(pairs.select("a", "b"), df, same_score=True)
    return both.agg(F.count("*").alias("n_pairs"), F.count_if(F.col("lower_score") == F.col("higher_score")).alias("n_skipped"))


def first_with_prefix(inputs: DataFrame, generations: DataFrame, tokens: str = "tokens", text: str = "tokens") -> DataFrame:
    """(id, match): for each input the first generation, by id, that starts with its tokens; null if none does.

    Inputs and generations meet by the hash of a prefix as long as an input, one join for each
    length of inputs that occurs; nothing is compared across.
    """
    lengths = F.broadcast(inputs.select(F.size(tokens).alias("len")).distinct())  # as many rows as there are lengths
    heads = generations.join(lengths, F.size(text) >= F.col("len")).select(F.col("id").alias("gen"), F.slice(F.col(text), F.lit(1), F.col("len")).alias("_head"))
    first = heads.groupBy("_head").agg(F.min("gen").alias("match"))
    return inputs.join(first, inputs[tokens] == first["_head"], "left").select("id", "match")


def few_shot(df: DataFrame, k: int, seed: int, same_score: bool = False) -> DataFrame:
    """(id, shots): k other rows of the table for each row, of other scores unless ``same_score``; rows with too few are left out.

    Rows stand in the order of (score, MD5 key of the id), so the rows that a row may not take are
    one stretch. The n others are dealt to k even strata and an MD5 key of id and stratum picks a
    place in each: every other row is as likely as the next, none comes twice, and each pick is a
    lookup of one place. A null score is a score of its own.
    """
    keyed = df.select("id", "score", md5_key(seed, "id").alias("_key"))
    placed = running(keyed, "score", ["_key", "id"], name="_rn").select("id", "score", (F.col("_rn") - 1).alias("_at"))
    placed = cut(placed, "places")
    total = placed.count()
    if same_score:
        rows = placed.select("id", F.col("_at").alias("_low"), F.lit(1).alias("_own"))
    else:
        rows = with_totals(placed, ["score"], {"_low": F.min("_at"), "_own": F.count("*")}).select("id", "_low", "_own")
    n = F.lit(total) - F.col("_own")
    first = lambda i: F.floor(i * F.col("_n") / k)
    strata = rows.withColumn("_n", n).filter(F.col("_n") >= k).select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("_i"))
    place = first(F.col("_i")) + F.floor(md5_uniform(seed, "id", "_i") * (first(F.col("_i") + 1) - first(F.col("_i"))))
    picks = strata.withColumn("_place", place).select("id", "_i", (F.col("_place") + F.when(F.col("_place") >= F.col("_low"), F.col("_own")).otherwise(0)).alias("_at"))
    found = picks.join(placed.select("_at", F.col("id").alias("_shot")), "_at")
    order = F.struct(md5_key(seed, "_i", "id").alias("k"), F.col("_shot").alias("b"))
    return found.groupBy("id").agg(F.array_sort(F.collect_list(order)).alias("s")).select("id", F.transform("s", lambda x: x["b"]).alias("shots"))
