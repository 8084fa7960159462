"""Folds on streams, over restarts, against the batch operators."""

import random

import pytest
from pyspark.sql import functions as F

from riskweave.operators import conformal as CF
from riskweave.operators import sampling as S
from riskweave.streaming import controllers as ST

SCHEMA = "chain string, step bigint, missed double, ok boolean, id bigint"


@pytest.fixture(scope="module")
def parts():
    """Three stretches of a few chains, in order."""
    r = random.Random(8)
    rows = [(c, i, float(r.random() < 0.3), r.random() < 0.7, 1000 * k + i) for k, c in enumerate("abc") for i in range(40)]
    return [[x for x in rows if a <= x[1] < b] for a, b in ((0, 15), (15, 17), (17, 40))]


def streamed(spark, parts, folder, make):
    """All rows that a stream gives, started anew for each stretch."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        query = make(spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
        query.awaitTermination(120)
        assert query.exception() is None, i
    return spark.read.parquet(f"{folder}/out")


def test_levels(spark, parts, tmp_path):
    every = spark.createDataFrame([x for p in parts for x in p], SCHEMA)
    got = streamed(spark, parts, f"file://{tmp_path}/clipped", lambda s: ST.clipped_levels(s, "chain", "step", "missed", 0.1, 0.3))
    want = {(r.chain, r.step): r.level for r in CF.clipped_controller(every, "chain", "step", "missed", 0.1, 0.3).collect()}
    assert {(r.chain, r.step): r.level for r in got.collect()} == {k: pytest.approx(v, abs=1e-12) for k, v in want.items()} and got.count() == 120
    got = streamed(spark, parts, f"file://{tmp_path}/additive", lambda s: ST.additive_levels(s, "chain", "step", "ok", 0.2, 0.5))
    want = {(r.chain, r.step): r.level for r in CF.additive_controller(every, "chain", "step", F.col("ok"), 0.2, 0.5).collect()}
    assert {(r.chain, r.step): r.level for r in got.collect()} == {k: pytest.approx(v, abs=1e-12) for k, v in want.items()}


def test_rows_until(spark, parts, tmp_path):
    """Batches of four steps; the batch that reaches the target is the last."""
    coarse = [[(c, i // 4, m, ok, k) for c, i, m, ok, k in p] for p in (parts[0][:0] + [x for x in parts[0] if x[1] < 12], [x for x in parts[0] if x[1] >= 12] + parts[1] + parts[2])]
    got = streamed(spark, coarse, f"file://{tmp_path}/until", lambda s: ST.rows_until(s, "chain", "step", 10))
    one = spark.createDataFrame([x for p in coarse for x in p if x[0] == "a"], SCHEMA)
    want = sorted(r.id for r in S.until_target(one, "step", 10).collect())
    assert sorted(r.id for r in got.filter("chain = 'a'").collect()) == want and len(want) == 12
