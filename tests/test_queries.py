"""Every query beside its SQL on the small tables."""

import math
import os

import duckdb
import pytest

from riskweave.plans import catalogue, columns, controls, files, trials  # noqa: F401

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS FROM '{SF}/{name}'")
    return con


def plain(x):
    if isinstance(x, list):
        return tuple(map(plain, x))
    if isinstance(x, float) and math.isnan(x):
        return None
    return int(x) if isinstance(x, float) and x.is_integer() else x  # 1.0 and 1 are one value


def rank(row):
    """Rows by what is no float, then by their floats to a few digits: those differ by less than that, if at all."""
    flat = [x for x in row]
    return repr([x for x in flat if not isinstance(x, float)]), repr([f"{x:.4g}" for x in flat if isinstance(x, float)])


def same(x, y):
    """Equal, but for the last bits of floats that no query rounds."""
    if isinstance(x, tuple) and isinstance(y, tuple):
        return len(x) == len(y) and all(map(same, x, y))
    if isinstance(x, int | float) and isinstance(y, int | float) and not isinstance(x, bool):
        return x == y or math.isclose(x, y, rel_tol=1e-10, abs_tol=1e-12)
    return x == y


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query(spark, sql, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = sql.sql(catalogue.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    place = [want.columns.index(c) for c in columns]
    a = sorted((tuple(plain(v) for v in r) for r in got.select(*columns).collect()), key=rank)
    b = sorted((tuple(plain(r[i]) for i in place) for r in want.fetchall()), key=rank)
    assert len(a) == len(b)
    assert not [(x, y) for x, y in zip(a, b, strict=True) if not same(x, y)][:5]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())


def test_chain_invariants(spark):
    rows = catalogue.imh_chain(spark, SF)
    assert rows.count() == rows.select("user_id", "id").distinct().count()
    first = rows.groupBy("user_id").agg({"id": "min"}).withColumnRenamed("min(id)", "id")
    assert rows.join(first, ["user_id", "id"]).filter("not accepted").count() == 0
    assert catalogue.ltt_threshold(spark, SF).count() == 1


def test_safe_division_on_rounding_edges(spark, tmp_path):
    """quotients half way between two numbers of nine places."""
    at = f"{tmp_path}/events.parquet"
    con = duckdb.connect()
    con.sql(f"COPY (SELECT i AS event_id, i % 50 AS user_id, 'view' AS event_type, (1000000000 + i * 7919 + 0.5) / 5e6 - 1 AS value FROM range(30000) r(i)) TO '{at}' (FORMAT parquet)")
    con.sql(f"CREATE VIEW events AS FROM '{at}'")
    want = dict(con.sql(catalogue.SQL["safe_division"]).fetchall())
    got = {r.id: r.q for r in catalogue.QUERIES["safe_division"](spark, str(tmp_path)).collect()}
    assert got == want
