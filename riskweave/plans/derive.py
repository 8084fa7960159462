"""How the test tables play the roles of policy data: one definition for Spark and one for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, unconstrained u and safe s likelihoods, bad, score with infeasible values, grp."""
    e = table(spark, sf_dir, "events")
    score = F.when(F.col("event_type") == "error", float("inf")).when(F.col("event_id") % 17 == 0, float("nan")).otherwise(F.col("value"))
    return e.select(F.col("event_id").alias("id"), ((1 + F.col("value")) / 100).alias("u"), ((1 + F.col("user_id")) / 50).alias("s"), (F.col("event_type") == "error").alias("bad"), score.alias("score"), F.col("value"), F.col("event_type").alias("grp"), F.col("user_id"))


CAL = """cal AS (SELECT event_id AS id, (1 + value) / 100 AS u, (1 + user_id) / 50 AS s, event_type = 'error' AS bad,
  CASE WHEN event_type = 'error' THEN CAST('inf' AS DOUBLE) WHEN event_id % 17 = 0 THEN CAST('nan' AS DOUBLE) ELSE value END AS score,
  value, event_type AS grp, user_id FROM events)"""


def particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, particle of eight places (sums of eight embedding values each, quantised), score."""
    e = table(spark, sf_dir, "embeddings")
    part = lambda j: F.aggregate(F.slice("embedding", j * 8 + 1, 8), F.lit(0.0), lambda s, x: s + x.cast("double"))
    particle = F.array(*[F.floor(part(j) * 2).cast("int") for j in range(8)])
    return e.select(F.col("vec_id").alias("id"), particle.alias("particle"), F.col("label").cast("double").alias("score"))


PART = "part8 AS (SELECT vec_id AS id, list_transform(range(0, 8), lambda j: CAST(floor(list_sum(list_transform(embedding[j * 8 + 1:j * 8 + 8], lambda x: CAST(x AS DOUBLE))) * 2) AS INTEGER)) AS particle, CAST(label AS DOUBLE) AS score FROM embeddings)"


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """response, score, supported: line items as claims of an order."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("response"), (F.col("l_discount") * 10).alias("score"), (F.col("l_returnflag") != "R").alias("supported"))


CLAIMS = "claims AS (SELECT l_orderkey AS response, l_discount * 10 AS score, l_returnflag <> 'R' AS supported FROM lineitem)"
TAUS = [i / 10 for i in range(11)]


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seed, alpha, round, score of sampled rows: orders."""
    o = table(spark, sf_dir, "orders")
    score = F.when(F.col("o_orderstatus") == "P", float("inf")).otherwise(-F.col("o_totalprice") / 1000)
    return o.select((F.col("o_custkey") % 8).cast("int").alias("seed"), F.substring("o_orderpriority", 1, 1).cast("int").alias("alpha"), (F.month("o_orderdate") - 1).alias("round"), score.alias("score"), F.col("o_orderkey").alias("id"))


RUNS = "runs AS (SELECT CAST(o_custkey % 8 AS INTEGER) AS seed, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS alpha, CAST(month(o_orderdate) AS INTEGER) - 1 AS round, CASE WHEN o_orderstatus = 'P' THEN CAST('inf' AS DOUBLE) ELSE -o_totalprice / 1000 END AS score, o_orderkey AS id FROM orders)"
STATS = """stats AS (SELECT alpha, seed, round, count(*) AS n_total, count(*) FILTER (WHERE isfinite(score)) AS n_feasible,
  1 - count(*) FILTER (WHERE isfinite(score)) / count(*) AS frac_infeasible, -avg(score) FILTER (WHERE isfinite(score)) AS mean_score,
  -min(score) FILTER (WHERE isfinite(score)) AS max_score FROM runs GROUP BY alpha, seed, round)"""
