"""The numeric contract of functions/kpi.py."""

from __future__ import annotations

import random
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from ledgerlens.functions import kpi


def _expected(x: float, n: int) -> float:
    # shortest decimal form of the double, cut to 8 places, then half away from zero
    d = Decimal(repr(x)).quantize(Decimal("1e-8"), rounding=ROUND_HALF_UP)
    return float(d.quantize(Decimal(1).scaleb(-n), rounding=ROUND_HALF_UP))


def test_rnd_matches_decimal_half_up(spark):
    rng = random.Random(3)
    xs = [rng.uniform(-1e4, 1e4) for _ in range(300)] + [0.125, 2.675, -2.5, 92.855, 1.005, 12.345, 0.0]
    xs += [k / 200 for k in range(-50, 50)]  # exact .005 ties
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for n in (0, 1, 2, 3):
        got = [r.v for r in df.select(kpi.rnd("x", n).alias("v")).collect()]
        assert got == [_expected(x, n) for x in xs], n


def test_ratio_and_pct_null_on_zero(spark):
    r = spark.range(1).select(
        kpi.ratio(F.lit(1), F.lit(0)).alias("a"), kpi.pct(F.lit(3), F.lit(4)).alias("b"),
        kpi.pct_change(F.lit(11), F.lit(10)).alias("c"), kpi.pct_change(F.lit(1), F.lit(None).cast("int")).alias("d"),
    ).collect()[0]
    assert r.a is None and r.b == 75.0 and r.c == 10.0 and r.d is None


def test_rag_exact_thresholds(spark):
    df = spark.createDataFrame([(95, 100), (94, 100), (80, 100), (79, 100), (None, 100)], "a long, t long")
    got = [r.g for r in df.select(kpi.rag("a", "t").alias("g")).collect()]
    assert got == ["GREEN", "AMBER", "AMBER", "RED", "RED"]


def test_arrow_text_and_bands(spark):
    df = spark.createDataFrame([(10.0,), (0.05,), (0.0,), (-10.0,), (-10.05,), (None,)], "g double")
    incl = [r.a for r in df.select(kpi.arrow("g", weak_inclusive=True, blank="—").alias("a")).collect()]
    excl = [r.a for r in df.select(kpi.arrow("g", weak_inclusive=False).alias("a")).collect()]
    assert incl == ["▲▲ 10.0%", "▲ 0.1%", "▼ 0.0%", "▼ 10.0%", "▼▼ 10.1%", "—"]
    assert excl[3] == "▼▼ 10.0%"


def test_rounding_parity_with_duckdb(spark):
    import duckdb

    rng = random.Random(11)
    xs = [rng.uniform(-1e6, 1e6) for _ in range(400)] + [rng.randrange(-10**6, 10**6) / 1000 for _ in range(400)]
    xs += [100.0 * a / b for a in range(1, 40) for b in range(1, 40)]  # percentages of small counts
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT UNNEST($1::DOUBLE[]) AS x, UNNEST(range(len($1))) AS i", [xs])
    for n in (0, 1, 2, 3, 4):
        spark_vals = [r.v for r in df.select(kpi.rnd("x", n).alias("v")).collect()]
        duck_vals = [r[0] for r in con.execute(f"SELECT CAST(ROUND(CAST(x AS DECIMAL(28,8)), {n}) AS DOUBLE) FROM t ORDER BY i").fetchall()]
        assert spark_vals == duck_vals, n


def test_ratio_parity_with_duckdb(spark):
    import duckdb

    rng = random.Random(5)
    pairs = [(rng.randrange(0, 10**7), rng.randrange(0, 10**5)) for _ in range(600)]
    df = spark.createDataFrame(pairs, "a long, b long")
    got = [r.v for r in df.select(kpi.rnd(kpi.pct("a", "b"), 2).alias("v")).collect()]
    con = duckdb.connect()
    con.execute(
        "CREATE TABLE p AS SELECT UNNEST($1::BIGINT[]) AS a, UNNEST($2::BIGINT[]) AS b, UNNEST(range(len($1))) AS i",
        [[a for a, _ in pairs], [b for _, b in pairs]],
    )
    want = [r[0] for r in con.execute(
        "SELECT CAST(ROUND(CAST(100.0 * CAST(a AS DOUBLE) / NULLIF(CAST(b AS DOUBLE), 0) AS DECIMAL(28,8)), 2) AS DOUBLE) "
        "FROM p ORDER BY i").fetchall()]
    assert got == want
