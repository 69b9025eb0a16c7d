"""Interval labels against the rule applied row by row, and the documented event list."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from freshet.functions import between_times
from freshet.operators import labeling
from freshet.operators.labeling import label_intervals
from freshet.operators.lookup import lookup
from freshet.operators.stats import class_weights, label_counts, monthly_rate
from freshet.plans.training import temporal_split

OBS = "location string, datetime timestamp_ntz"
EVENTS = "start_date date, end_date date, location string"

INTERVALS = [
    (date(2024, 1, 2), date(2024, 1, 4), "a"),
    (date(2024, 1, 4), date(2024, 1, 5), "a"),  # overlaps
    (date(2024, 1, 3), date(2024, 1, 3), "b"),  # one day
    (date(2024, 1, 9), date(2024, 1, 7), "b"),  # ends before it starts
    (date(2024, 1, 6), None, "a"),
    (None, date(2024, 1, 8), "a"),
    (date(2024, 1, 1), date(2024, 1, 2), None),
    (date(2024, 1, 1), date(2024, 1, 2), "elsewhere"),
    (date(2023, 12, 1), date(2024, 1, 1), "c"),
]


def hours(days=10, locations=("a", "b", "c", None)):
    start = datetime(2024, 1, 1)
    return [(w, start + timedelta(hours=h)) for w in locations for h in range(24 * days)]


def expected(rows, by_location=True):
    out = {}
    for where, at in rows:
        flag = 0
        for a, b, loc in INTERVALS:
            if a is None or b is None or (by_location and (loc is None or loc != where)):
                continue
            if a <= at.date() <= b:
                flag = 1
        out[(where, at)] = flag
    return out


@pytest.mark.parametrize("by_location", [True, False])
@pytest.mark.parametrize(
    "broadcast_rows, rows_per_task", [(1000, 1000), (13, 1000), (0, 1000), (0, 5)]
)
def test_equals_rule(spark, by_location, broadcast_rows, rows_per_task):
    rows = hours()
    made = label_intervals(
        spark.createDataFrame(rows, OBS),
        spark.createDataFrame(INTERVALS, EVENTS),
        keys=("location",) if by_location else (),
        broadcast_rows=broadcast_rows,
        rows_per_task=rows_per_task,
    )
    got = made.collect()
    assert len(got) == len(rows)
    assert {(r.location, r.datetime): r.flood_event for r in got} == expected(rows, by_location)
    assert made.columns == ["location", "datetime", "date", "flood_event"]


def test_a_century_is_one_row_per_bin(spark, monkeypatch):
    events = spark.createDataFrame([(date(1950, 1, 1), date(2049, 12, 31), "a")], EVENTS)
    asked = []
    monkeypatch.setattr(labeling, "lookup", lambda df, dim, *rest: asked.append(dim) or lookup(df, dim, *rest))
    made = label_intervals(spark.createDataFrame(hours(2), OBS), events)
    assert made.filter("flood_event = 1").count() == 48 == made.filter("location = 'a'").count()
    days = (date(2049, 12, 31) - date(1950, 1, 1)).days + 1
    assert days / 64 <= asked[0].count() <= days / 64 + 2


@pytest.mark.parametrize("broadcast_rows", [1000, 0])
def test_hourly_bounds(spark, broadcast_rows):
    kinds = "start_date timestamp_ntz, end_date timestamp_ntz, location string"
    spans = [
        (datetime(2024, 1, 1, 5, 30), datetime(2024, 1, 1, 7, 10), "a"),
        (datetime(2024, 1, 1, 7), datetime(2024, 1, 3, 20), "a"),
        (datetime(2023, 12, 31, 23), datetime(2024, 1, 1, 0, 59), "b"),
        (datetime(1969, 12, 1), datetime(1970, 1, 1, 3), "c"),
    ]
    rows = hours(5) + [("c", datetime(1969, 12, 31, 22)), ("c", datetime(1970, 1, 1, 4)), ("c", None)]
    made = label_intervals(
        spark.createDataFrame(rows, OBS), spark.createDataFrame(spans, kinds), unit="hour", broadcast_rows=broadcast_rows
    )
    hour = lambda t: t.replace(minute=0)
    want = {
        (w, t): int(any(w == k and t is not None and hour(a) <= t <= hour(b) for a, b, k in spans)) for w, t in rows
    }
    assert {(r.location, r.datetime): r.flood_event for r in made.collect()} == want
    assert sum(want.values()) == 64 + 1 + 1
    with pytest.raises(TypeError, match="hour"):
        label_intervals(spark.createDataFrame(rows, OBS), spark.createDataFrame(INTERVALS, EVENTS), unit="hour")


def test_columns_named_like_its_own(spark):
    df = spark.createDataFrame(hours(1), OBS).withColumns({c: F.lit(c) for c in ("_bin", "_unit", "_mask", "_from")})
    made = label_intervals(df, spark.createDataFrame(INTERVALS, EVENTS))
    assert made.columns == [*df.columns, "date", "flood_event"]
    assert made.filter("_bin <> '_bin' or _mask <> '_mask' or _unit <> '_unit'").count() == 0


def test_one_measuring_job(spark, monkeypatch):
    measured = []
    monkeypatch.setattr(labeling, "fits_broadcast", lambda *a: measured.append(a) or True)
    label_intervals(spark.createDataFrame(hours(1), OBS), spark.createDataFrame(INTERVALS, EVENTS))
    assert not measured


def test_no_events(spark):
    made = label_intervals(
        spark.createDataFrame(hours(1), OBS), spark.createDataFrame([], EVENTS)
    )
    assert made.filter("flood_event = 0").count() == 96


# The documented events, as (start, end, location).
DOCUMENTED = [
    ("2022-05-01", "2022-06-30", "Imphal"),
    ("2024-07-01", "2024-07-03", "Imphal"),
    ("2025-05-28", "2025-06-01", "Imphal"),
    ("2025-09-15", "2025-09-19", "Imphal"),
    ("2024-07-02", "2024-07-03", "Bishnupur"),
    ("2024-07-02", "2024-07-03", "Senapati"),
    ("2025-09-15", "2025-09-19", "Thoubal"),
    ("2025-05-28", "2025-06-02", "Senapati"),
    ("2025-05-28", "2025-06-01", "Thoubal"),
    ("2025-05-28", "2025-06-01", "Kakching"),
    ("2024-05-29", "2024-06-03", "Thoubal"),
    ("2024-08-20", "2024-08-26", "Kakching"),
    ("2025-05-28", "2025-06-01", "Bishnupur"),
    ("2025-07-08", "2025-07-09", "Churachandpur"),
]
POSITIVES = {
    "Imphal": 1776,
    "Thoubal": 384,
    "Kakching": 288,
    "Senapati": 192,
    "Bishnupur": 168,
    "Churachandpur": 48,
}
POSITIVES_2025 = {
    "Imphal": 240,
    "Thoubal": 240,
    "Senapati": 144,
    "Bishnupur": 120,
    "Kakching": 120,
    "Churachandpur": 48,
}


@pytest.fixture(scope="module")
def archive(spark):
    """The gap-free hourly grid of six locations over 2020 to 2025, labelled."""
    grid = spark.createDataFrame([(w,) for w in POSITIVES], "location string").withColumn(
        "datetime",
        F.explode(
            F.expr(
                "sequence(timestamp_ntz'2020-01-01', timestamp_ntz'2025-12-31 23:00:00', interval 1 hour)"
            )
        ),
    )
    events = spark.createDataFrame(DOCUMENTED, "start_date string, end_date string, location string")
    return label_intervals(grid, events)


def test_archive_counts(archive):
    assert archive.count() == 315_648
    positive = archive.filter("flood_event = 1")
    counts = label_counts(positive, ("location",)).collect()
    assert {r.location: r.n for r in counts} == POSITIVES
    in_2025 = between_times(positive, "datetime", "2025-01-01", "2026-01-01")
    counts = label_counts(in_2025, ("location",)).collect()
    assert {r.location: r.n for r in counts} == POSITIVES_2025


def test_archive_splits_and_weights(archive):
    train, test = temporal_split(archive, "datetime", ("2025-01-01",))
    assert (train.count(), test.count()) == (263_088, 52_560)
    weights = {r.flood_event: (r.n, r.class_weight) for r in class_weights(train).collect()}
    assert weights[1][0] == 1944
    assert weights[0][1] == pytest.approx(0.5037220844, abs=1e-10)
    assert weights[1][1] == pytest.approx(67.6666666667, abs=1e-10)

    parts = temporal_split(archive, "datetime", ("2024-01-01", "2025-01-01"))
    sizes = [(p.count(), p.filter("flood_event = 1").count()) for p in parts]
    assert sizes == [(210_384, 1464), (52_704, 480), (52_560, 912)]
    weights = {r.flood_event: r.class_weight for r in class_weights(parts[0]).collect()}
    assert weights[0] == pytest.approx(0.5035037335, abs=1e-10)
    assert weights[1] == pytest.approx(71.8524590164, abs=1e-10)


def test_archive_monthly_rate(archive):
    rows = monthly_rate(between_times(archive, "datetime", end="2025-01-01")).collect()
    got = {r.month: (r.flood_records, r.total_records) for r in rows if r.flood_records}
    assert got == {5: (816, 22_320), 6: (792, 21_600), 7: (168, 22_320), 8: (168, 22_320)}
    assert len(rows) == 12


def test_wide_days_are_not_broadcast(spark):
    keys = spark.range(500).select(F.concat(F.lit("k"), "id", F.repeat(F.lit("x"), 200_000)).alias("location"))
    events = keys.select(
        "location", F.lit("2024-01-01").alias("start_date"), F.lit("2024-01-03").alias("end_date")
    )
    obs = keys.limit(5).withColumn("datetime", F.lit("2024-01-02 00:00:00").cast("timestamp_ntz"))
    plan = label_intervals(obs, events)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" not in plan
