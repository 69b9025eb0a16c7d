"""Row frames: edges, gaps, and series cut along time against series left whole."""

import math
import random
from datetime import date, datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from freshet.operators import rowframes
from freshet.operators.rolling import (
    FEATURES_48H,
    MAIN_FEATURES,
    PRESSURE_LAGS,
    RAIN_SHORT,
    RollingSpec,
    lag_change,
    rolling,
    row_features,
)

SCHEMA = (
    "location string, datetime timestamp_ntz, "
    "precipitation double, soil_moisture double, pressure double"
)
START = datetime(2024, 1, 1)
ALL = FEATURES_48H + RAIN_SHORT


def series(spark, points):
    """Rows from (location, seconds, value or None)."""
    rows = [
        (where, START + timedelta(seconds=at), v, None if v is None else v / 7, at % 31 + 0.5)
        for where, at, v in points
    ]
    return spark.createDataFrame(rows, SCHEMA)


def by_hand(points, specs=ALL, lags=PRESSURE_LAGS):
    want = {}
    for where in {p[0] for p in points}:
        mine = sorted((p for p in points if p[0] == where), key=lambda p: p[1])
        for k, (_, at, _) in enumerate(mine):
            row = {}
            for s in specs:
                scale = 7 if s.col == "soil_moisture" else 1
                seen = [v / scale for _, _, v in mine[max(0, k - s.rows + 1) : k + 1] if v is not None]
                fn = {"sum": sum, "max": max, "avg": lambda x: sum(x) / len(x)}[s.fn]
                row[s.out] = fn(seen) if seen else None
            for lag in lags:
                before = mine[k - lag.rows][1] if k >= lag.rows else None
                row[lag.change] = None if before is None else float(at % 31 - before % 31)
            want[(where, START + timedelta(seconds=at))] = row
    return want


def check(df, want):
    got = {(r["location"], r["datetime"]): r for r in df.collect()}
    assert got.keys() == want.keys()
    for key, row in want.items():
        for name, value in row.items():
            if value is None:
                assert got[key][name] is None, (key, name)
            else:
                assert math.isclose(got[key][name], value, rel_tol=1e-9, abs_tol=1e-9), (key, name)


def test_leading_frames_are_kept(spark):
    points = [("a", h * 3600, float(h + 1)) for h in range(30)]
    first = rolling(series(spark, points)).orderBy("datetime").first()
    assert [first[s.out] for s in MAIN_FEATURES] == [1.0, 1.0, 1.0, 1 / 7, 1.0]


def test_frames_count_rows_not_hours(spark):
    points = [("a", h * 3600, 1.0) for h in range(40) if h not in (5, 6, 7)]
    last = rolling(series(spark, points)).orderBy(F.desc("datetime")).first()
    assert last["rainfall_24h"] == 24.0


def test_nulls_are_skipped_and_all_null_is_null(spark):
    points = [("a", h, None if h < 30 else 2.0) for h in range(33)]
    check(row_features(series(spark, points), ALL, PRESSURE_LAGS), by_hand(points))


def test_locations_do_not_mix(spark):
    points = [(w, h, float(h)) for h in range(50) for w in ("a", "b", None)]
    check(row_features(series(spark, points), ALL, PRESSURE_LAGS), by_hand(points))


def test_lag_is_null_for_first_rows(spark):
    points = [("a", h, 0.0) for h in range(10)]
    rows = lag_change(series(spark, points)).orderBy("datetime").collect()
    assert [r["pressure_6h_change"] for r in rows] == [None] * 6 + [6.0] * 4
    assert [r["pressure_drop_6h"] for r in rows] == [None] * 6 + [-6.0] * 4


def uneven(n, seed):
    """A quiet series, and one with long gaps and a burst of a third of all rows."""
    rng = random.Random(seed)
    points, at = [], 0
    for k in range(n):
        if k % 211 == 0:
            at += 86_400 * 40
        at += 1 if n // 3 < k < 2 * n // 3 else rng.randint(1, 7200)
        points.append(("hot", at, None if rng.random() < 0.1 else round(rng.random() * 50, 2)))
    points += [("cold", k * 3600, 1.5) for k in range(60)]
    points += [(None, k * 60, 0.5) for k in range(900)]
    return points


@pytest.mark.parametrize("rows_per_task", [1, 500, 1500, 2500])
def test_cut_series_equal_whole_ones(spark, rows_per_task):
    points = uneven(3000, rows_per_task)
    cut = row_features(
        series(spark, points), ALL, PRESSURE_LAGS, rows_per_task=rows_per_task
    )
    assert "_bucket" not in cut.columns
    check(cut, by_hand(points))


def test_burst_is_divided_again(spark):
    """Most rows within a second of a year: equal spans alone would leave them together."""
    start = [("hot", 0, 1.0), ("hot", 365 * 86_400, 1.0)]
    rows = [("hot", START + timedelta(days=100, microseconds=7 * k), float(k % 5)) for k in range(4000)]
    obs = series(spark, start).select("location", "datetime", "precipitation").union(
        spark.createDataFrame(rows, "location string, datetime timestamp_ntz, precipitation double")
    )
    cut = rowframes._find_cut(obs, ["location"], "datetime", 23, 400)
    assert cut.levels and cut.ties is None
    assert cut.buckets.count() > 20
    spec = (RollingSpec("precipitation", "sum", 24, "s"),)
    whole = rolling(obs, spec)
    assert rolling(obs, spec, rows_per_task=400).exceptAll(whole).isEmpty()
    assert rolling(obs, spec, rows_per_task=400).count() == 4002


def largest_bucket(obs, limit, back=167):
    cut = rowframes._find_cut(obs, ["location"], "datetime", back, limit)
    placed, cells = cut.place(obs, "left"), cut.buckets
    mine = (
        placed.location.eqNullSafe(cells._k0)
        & (placed._cell == cells._start)
        & (placed._tie == cells._part)
    )
    sizes = (
        placed.join(cells, mine)
        .select("location", F.explode("_buckets").alias("b"))
        .groupBy("location", "b")
        .count()
    )
    return sizes.agg(F.max("count")).first()[0]


def test_buckets_stay_small(spark):
    """No bucket holds much more than its share, however the rows lie in time."""
    limit = 400
    assert largest_bucket(series(spark, uneven(6000, 5)), limit) <= 2 * limit + 2 * 167


@pytest.mark.parametrize("when", [START + timedelta(days=3), None])
def test_rows_of_one_time_are_divided(spark, when):
    """A third of the rows at one time, or at none."""
    rows = [("a", START + timedelta(hours=k), 1.0) for k in range(400)]
    rows += [("a", when, float(k)) for k in range(1200)]
    obs = spark.createDataFrame(rows, "location string, datetime timestamp_ntz, precipitation double")
    assert rowframes._find_cut(obs, ["location"], "datetime", 9, 100).ties is not None
    assert largest_bucket(obs, 100, back=9) <= 2 * 100 + 2 * 9

    counted = obs.withColumn("one", F.lit(1.0))
    spec = (RollingSpec("one", "sum", 10, "s"), RollingSpec("precipitation", "max", 10, "m"))
    made = rolling(counted, spec, rows_per_task=100).collect()
    assert len(made) == 1600
    # Only the first nine rows of the series have short frames, whatever the order of ties.
    assert sorted(r.s for r in made) == [float(min(k, 10)) for k in range(1, 1601)]
    assert all(r.m >= r.precipitation for r in made)


@pytest.mark.parametrize("shape", ["even", "exponential", "one burst"])
def test_two_passes_find_any_cut(spark, monkeypatch, shape):
    """One pass for the sketches and one for the cells' counts, however the times bunch."""
    at = {
        "even": lambda k: k * 3_600_000_000,
        "exponential": lambda k: int(1.02**k) * 10 + k,
        "one burst": lambda k: k if k % 100 else k * 10**12,
    }[shape]
    rows = [("a", at(k), float(k % 7)) for k in range(2000)]
    df = spark.createDataFrame(rows, "location string, datetime long, precipitation double")
    counted, sketched = [], []
    count, points = rowframes.Cut.count, rowframes._points
    monkeypatch.setattr(rowframes.Cut, "count", lambda self, d, w=None: counted.append(d is df) or count(self, d, w))
    monkeypatch.setattr(rowframes, "_points", lambda d, *rest: sketched.append(d is df) or points(d, *rest))
    cut = rowframes._find_cut(df, ["location"], "datetime", 5, 100)
    assert sum(counted) + sum(sketched) == 2
    assert cut.buckets.count() > 20
    assert largest_bucket(df, 100, back=5) <= 2 * 100 + 2 * 5
    spec = RollingSpec("precipitation", "sum", 6, "s")
    assert rolling(df, [spec], rows_per_task=100).exceptAll(rolling(df, [spec])).isEmpty()


def test_wide_tables_of_the_cut_are_not_broadcast(spark, monkeypatch):
    points = uneven(1500, 9)
    monkeypatch.setattr(rowframes, "fits_broadcast", lambda table: False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = row_features(series(spark, points), ALL, PRESSURE_LAGS, rows_per_task=300)
        assert "strategy=broadcast" not in made._jdf.queryExecution().optimizedPlan().toString()
        check(made, by_hand(points))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_columns_named_like_its_own(spark):
    points = uneven(900, 2)
    own = ["_turn", "_bucket", "_copy", "_cell", "_tie", "_at", "_n", "_lo", "__k0", "_start"]
    df = series(spark, points).withColumns({c: F.lit(c) for c in own})
    for limit in (200, 10_000):
        made = row_features(df, ALL, PRESSURE_LAGS, rows_per_task=limit)
        check(made, by_hand(points))
        assert made.columns[: len(df.columns)] == df.columns
        assert made.select(*own).distinct().collect() == [tuple(own)]


def test_single_series(spark):
    points = [("a", at, v) for _, at, v in uneven(1000, 1)[:1000]]
    df = series(spark, points)
    check(row_features(df, ALL, PRESSURE_LAGS, keys=()), by_hand(points))
    check(row_features(df, ALL, PRESSURE_LAGS, keys=(), rows_per_task=350), by_hand(points))


@pytest.mark.parametrize(
    "at",
    [
        lambda k: date(2000, 1, 1) + timedelta(days=3 * k),
        lambda k: 10 * k,
        lambda k: datetime(2024, 3, 1) + timedelta(minutes=k),
    ],
)
def test_order_column_types(spark, at):
    rows = [("a", at(k), float(k)) for k in range(500)]
    df = spark.createDataFrame(rows, ["location", "at", "v"])
    spec = (RollingSpec("v", "sum", 10, "s"),)
    cut = rolling(df, spec, ts="at", rows_per_task=50).orderBy("at").collect()
    assert [r["s"] for r in cut] == [float(sum(range(max(0, k - 9), k + 1))) for k in range(500)]


def test_rows_without_time_are_kept(spark):
    rows = [("a", START + timedelta(hours=k), 1.0) for k in range(200)] + [("a", None, 5.0)]
    df = spark.createDataFrame(rows, "location string, datetime timestamp_ntz, precipitation double")
    spec = (RollingSpec("precipitation", "sum", 3, "s"),)
    cut = rolling(df, spec, rows_per_task=20)
    assert cut.exceptAll(rolling(df, spec)).isEmpty() and cut.count() == 201


def test_text_order_is_refused(spark):
    df = spark.createDataFrame([("a", "x", 1.0)], "location string, datetime string, precipitation double")
    with pytest.raises(TypeError):
        rolling(df, (RollingSpec("precipitation", "sum", 3, "s"),))


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.tuples(
            st.sampled_from(["a", "b"]),
            st.integers(0, 5000),
            st.one_of(st.none(), st.integers(0, 400).map(lambda x: x / 4)),
        ),
        unique_by=lambda p: p[:2],
        min_size=1,
        max_size=300,
    ),
    st.integers(1, 60),
)
def test_any_series(spark, points, rows_per_task):
    specs = (
        RollingSpec("precipitation", "sum", 3, "s3"),
        RollingSpec("precipitation", "sum", 9, "s9"),
        RollingSpec("precipitation", "sum", 18, "s18"),
        RollingSpec("soil_moisture", "avg", 4, "a4"),
        RollingSpec("precipitation", "max", 7, "m7"),
    )
    made = row_features(
        series(spark, points), specs, PRESSURE_LAGS[:1], rows_per_task=rows_per_task
    )
    check(made, by_hand(points, specs, PRESSURE_LAGS[:1]))


@pytest.mark.parametrize("kind", ["bigint", "int", "decimal(10,2)", "float", "double"])
def test_sums_keep_their_type_and_digits(spark, kind):
    big = 9_007_199_254_740_993 if kind == "bigint" else 12_345
    df = spark.range(400).select(
        F.lit("a").alias("location"),
        F.col("id").alias("datetime"),
        F.when(F.col("id") % 9 != 0, F.col("id") + big).cast(kind).alias("precipitation"),
    )
    specs = [RollingSpec("precipitation", "sum", n, f"s{n}") for n in (24, 48, 72, 168)]
    together = rolling(df, specs)
    for s in specs:
        alone = rolling(df, [s])
        assert alone.schema[s.out].dataType == together.schema[s.out].dataType
        assert sorted(map(tuple, alone.select("datetime", s.out).collect())) == sorted(
            map(tuple, together.select("datetime", s.out).collect())
        )


def test_a_series_without_times_is_divided(spark):
    df = spark.range(2000).select(
        F.lit("a").alias("location"),
        F.lit(None).cast("bigint").alias("datetime"),
        F.col("id").cast("double").alias("precipitation"),
    )
    spec = RollingSpec("precipitation", "sum", 3, "s")
    cut = rowframes._find_cut(df, ["location"], "datetime", 2, 100)
    assert cut is not None and cut.buckets.count() > 10
    got = rolling(df, [spec], rows_per_task=100).select("precipitation", "s").collect()
    want = rolling(df, [spec]).select("precipitation", "s").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
