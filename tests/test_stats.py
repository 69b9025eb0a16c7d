"""Profiles, statistics and scalar expressions at their edges."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from freshet.functions import (
    add_month_cycle,
    between_times,
    complete_cases,
    percent_text,
    risk_band,
    with_risk_report,
)
from freshet.operators import profile, stats


def test_correlation_null_rules(spark):
    df = spark.createDataFrame(
        [(1.0, 0), (2.0, 0), (None, 1), (4.0, 1), (9.0, 1)], "a double, y int"
    )
    zero = stats.label_correlation(df, ["a"], "y").first().correlation
    skip = stats.label_correlation(df, ["a"], "y", nulls="skip").first().correlation
    assert zero == pytest.approx(df.stat.corr("a", "y")) == pytest.approx(0.435468, abs=1e-6)
    assert skip == pytest.approx(0.811107, abs=1e-6)
    with pytest.raises(ValueError):
        stats.label_correlation(df, ["a"], "y", nulls="drop")


def test_complete_cases_drop_nan_too(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),)], "a double")
    assert complete_cases(df, ["a"]).count() == 1


def test_bounds_are_half_open(spark):
    df = spark.createDataFrame(
        [(datetime(2024, 12, 31, 23, 59, 59, 999999),), (datetime(2025, 1, 1),), (None,)],
        "datetime timestamp_ntz",
    )
    assert between_times(df, "datetime", end="2025-01-01").count() == 1
    assert between_times(df, "datetime", "2025-01-01").count() == 1


def test_bounds_ignore_the_session_zone(spark):
    df = spark.createDataFrame([(datetime(2025, 1, 1),)], "datetime timestamp_ntz")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        assert between_times(df, "datetime", "2025-01-01").count() == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_weights(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,), (None,)], "flood_event int")
    known = df.filter("flood_event is not null")
    weighted = stats.apply_weights(df, stats.class_weights(known)).collect()
    got = {r.flood_event: r.class_weight for r in weighted}
    assert got == {0: pytest.approx(4 / 6), 1: 2.0, None: pytest.approx(4 / 6)}


def test_month_cycle(spark):
    df = spark.createDataFrame([(datetime(2024, m, 1),) for m in range(1, 13)], "datetime timestamp_ntz")
    for r in add_month_cycle(df).collect():
        assert r.month_sin == pytest.approx(math.sin(2 * math.pi * r.month / 12))
        assert r.month_cos == pytest.approx(math.cos(2 * math.pi * r.month / 12))


def test_risk_bands(spark):
    df = spark.createDataFrame([(p,) for p in (0.0, 39.99, 40.0, 69.99, 70.0, 100.0, None)], "p double")
    got = [r[0] for r in df.select(risk_band(F.col("p"))).collect()]
    assert got == ["LOW", "LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH", None]


def test_percent_text_is_python_rounding(spark):
    values = [k / 1000 for k in range(0, 100_001, 7)] + [k / 20 for k in range(2001)]
    values += [12.25, 12.35, 0.05, 0.25, 99.95, 100.0, 1e-9, 33.333333333333336]
    df = spark.createDataFrame([(v,) for v in values], "p double")
    for r in df.select("p", percent_text(F.col("p")).alias("t")).collect():
        assert r.t == f"{r.p:.1f}%"


def test_risk_report(spark):
    df = spark.createDataFrame([(0.7,), (1.2,), (None,)], "s double")
    rows = with_risk_report(df, "s").collect()
    assert [r.risk_progress for r in rows] == [min(int(0.7 * 100), 100), 100, None]
    assert rows[2].risk_text is None and rows[2].risk_level is None


def test_profile_of_every_column(spark):
    df = spark.range(10_000).select(
        F.when(F.col("id") % 10 > 0, F.col("id").cast("double")).alias("x"),
        F.concat(F.lit("k"), (F.col("id") % 300)).alias("a.b"),
        F.create_map(F.lit("k"), F.col("id") % 7).alias("m"),
        F.timestamp_seconds("id").cast("timestamp_ntz").alias("at"),
        F.lit(None).cast("int").alias("none"),
    )
    rows = {r.column_name: r for r in profile.profile_table(df).collect()}
    assert [rows[c].position for c in df.columns] == list(range(5))
    assert {c: rows[c].type for c in df.columns} == dict(df.dtypes)
    assert {rows[c].n_rows for c in df.columns} == {10_000}
    assert [rows[c].n_nulls for c in df.columns] == [1000, 0, 0, 0, 10_000]
    for c, n in (("x", 9000), ("a.b", 300), ("m", 7), ("at", 10_000)):
        assert abs(rows[c].n_distinct - n) <= 0.15 * n
    assert rows["none"].n_distinct == 0 and rows["none"].least is None and rows["none"].quantiles is None
    assert (rows["x"].least, rows["x"].most, rows["m"].least) == ("1.0", "9999.0", None)
    assert [round(q / 10_000, 2) for q in rows["x"].quantiles] == [0.25, 0.5, 0.75]
    empty = profile.profile_table(df.limit(0)).collect()
    assert {(r.n_rows, r.n_nulls, r.n_distinct) for r in empty} == {(0, 0, 0)}
    plan = profile.profile_table(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") == 1


def test_profiles(spark):
    df = spark.createDataFrame(
        [("a", 1.0, None), ("a", 3.0, 2.0), ("b", None, None)], "g string, x double, z double"
    )
    assert profile.schema_of(df) == [("g", "string"), ("x", "double"), ("z", "double")]
    assert profile.row_count(df).first().n_rows == 3
    assert {r[0]: r[1] for r in profile.null_counts(df).collect()} == {"g": 0, "x": 1, "z": 2}
    rows = {(r.g, r.feature): r for r in profile.describe_by(df, ["x", "z"], "g").collect()}
    x = rows[("a", "x")]
    assert (x.n, x["mean"], x.stddev, x.min, x.max) == (2, 2.0, pytest.approx(2**0.5), 1.0, 3.0)
    assert rows[("b", "z")].n == 0 and rows[("b", "z")]["mean"] is None
    assert [r.g for r in profile.distinct_sorted(df, "g").collect()] == ["a", "b"]
    assert [r.x for r in profile.preview(df, [F.desc("x")], 1).collect()] == [3.0]
