"""Texts of rounded figures, where a tie decides, agree with their SQL."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import duckdb
from pyspark.sql import functions as F

from lodestitch.operators import jobs as J
from lodestitch.operators import layout as L
from lodestitch.plans import registry
from tests.compare import differences


def _half_up(x: Decimal, places: str) -> str:
    return str(x.quantize(Decimal(places), ROUND_HALF_UP))


def test_merge_rates_on_ties(spark, tmp_path):
    """One of 16 is 6.25 %."""
    con = duckdb.connect()
    con.execute("CREATE TABLE lineitem AS SELECT n * 100 + m AS l_orderkey, CASE WHEN i < m THEN 40.0 ELSE 2.0 END::DOUBLE AS l_quantity FROM range(1, 65) a(n), range(0, 65) b(m), range(0, n) c(i) WHERE m <= n")
    con.execute(f"COPY lineitem TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    name = "merge_rates"
    assert not differences(spark, registry.QUERIES[name], registry.ORACLE_SQL[name], str(tmp_path), con)
    pairs = [(m, n) for n in (16, 32, 48, 2000, 7, 3) for m in range(0, n + 1)]
    got = spark.createDataFrame(pairs, "m int, n int").select("m", "n", L.optimisation_rate(F.col("m"), F.col("n")).alias("v")).collect()
    assert {(r.m, r.n): r.v for r in got} == {(m, n): _half_up(Decimal(100 * m) / n, "0.1") + "%" for m, n in pairs}


def test_storage_per_user_on_ties(spark, tmp_path):
    """500 of ten millions are 0.005 %; sums do not depend on their order."""
    con = duckdb.connect()
    con.execute("""CREATE TABLE orders AS SELECT c * 100 + i AS o_orderkey, c AS o_custkey, 'F' AS o_orderstatus, TIMESTAMP '1998-01-01 00:00:00' AS o_orderdate, '1-URGENT' AS o_orderpriority,
        CASE WHEN c % 2 = 0 THEN c * 50.1 + i * 0.01 ELSE CASE i WHEN 0 THEN c * 500.0 - 0.3 ELSE 0.1 END END::DOUBLE AS o_totalprice FROM range(1, 400) a(c), range(0, 4) b(i)""")
    con.execute(f"COPY orders TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    name = "storage_per_user"
    assert not differences(spark, registry.QUERIES[name], registry.ORACLE_SQL[name], str(tmp_path), con)
    got = {r["customer_id"]: (r["used"], r["percent"]) for r in registry.QUERIES[name](spark, str(tmp_path)).collect()}
    assert all(got[c] == (c * 500.0, _half_up(Decimal(c) * 500 / 100000, "0.01")) for c in range(1, 400, 2))
    rows = [(1, None), (2, float("nan")), (2, 5.0), (3, -7.0), (4, 2.5e6)]
    odd = spark.createDataFrame(rows, "customer_id long, size double")
    assert sorted(map(tuple, J.storage_per_user(odd, 1e7).collect())) == [(1, 0.0, "0.00"), (2, 5.0, "0.00"), (3, 0.0, "0.00"), (4, 2.5e6, "25.00")]
    assert {r["percent"] for r in J.storage_per_user(odd, 0).collect()} == {"0.00"}
