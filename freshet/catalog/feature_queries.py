"""Windows, labels, profiles and statistics."""

from pyspark.sql import functions as F

from freshet.catalog import inputs as i
from freshet.catalog.registry import query
from freshet.functions import add_month_cycle, between_times, complete_cases
from freshet.operators import profile, stats
from freshet.operators.labeling import label_intervals
from freshet.operators.rolling import (
    MAIN_FEATURES,
    MAX_RAIN_24,
    RAIN_24,
    RAIN_48,
    RAIN_72,
    RAIN_7D,
    RAIN_SHORT,
    SOIL_24,
    RollingSpec,
    lag_change,
    rolling,
)
from freshet.schemas import MEASURES

PLACES = {"sum": 4, "avg": 6, "max": 4}
RAINS = ("rainfall_24h", "rainfall_72h", "rainfall_7d")
MAIN = tuple(s.out for s in MAIN_FEATURES)
SHORT = tuple(s.out for s in RAIN_SHORT)


def _rounds(specs):
    return ", ".join(f"round({s.out}, {PLACES[s.fn]}) AS {s.out}" for s in specs)


def _rolled(df, specs, keys=("location",), **options):
    made = rolling(df, specs, keys, **options)
    return i.rounded(
        made.select("location", "datetime", *[s.out for s in specs]),
        {s.out: PLACES[s.fn] for s in specs},
    )


def _rolling_query(name, specs):
    @query(name, i.on_features(f"SELECT location, datetime, {_rounds(specs)} FROM features"))
    def run(spark, sf_dir):
        return _rolled(i.observations(spark, sf_dir), specs)


_rolling_query("rolling_sum", (RAIN_24, RAIN_72, RAIN_7D))
_rolling_query("rolling_sum_48", (RAIN_48,))
_rolling_query("rolling_sum_short", RAIN_SHORT)
_rolling_query("rolling_avg", (SOIL_24,))
_rolling_query("rolling_max", (MAX_RAIN_24,))


@query(
    "rolling_bucketed",
    i.on_features(f"SELECT location, datetime, {_rounds(MAIN_FEATURES)} FROM features"),
)
def rolling_bucketed(spark, sf_dir):
    """The windows over series cut along time, here also where a task could hold a series."""
    return _rolled(i.observations(spark, sf_dir), MAIN_FEATURES, rows_per_task=1000)


@query(
    "rolling_gaps",
    i.sql(
        f"SELECT location, datetime, {_rounds(MAIN_FEATURES)} FROM "
        f"(SELECT *, {i.frames(MAIN_FEATURES)} FROM gappy)",
        i.OBS,
        i.GAPPY,
    ),
)
def rolling_gaps(spark, sf_dir):
    """Frames with missing rainfall in them."""
    return _rolled(i.gappy_observations(spark, sf_dir), MAIN_FEATURES)


TYPED_ROWS = (24, 48, 72, 168)
# The sum of a bigint column over 168 rows must keep all its digits.
BIG = 9_007_199_254_740_993


def _typed_frame(column, rows):
    return (
        f"sum({column}) OVER (PARTITION BY location ORDER BY datetime "
        f"ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"
    )


@query(
    "rolling_types",
    i.sql(
        "SELECT location, datetime, "
        + ", ".join(
            f"CAST({_typed_frame('big', n)} AS BIGINT) AS big_{n}, "
            f"CAST(CAST({_typed_frame('dec', n)} AS DECIMAL(22, 2)) AS VARCHAR) AS dec_{n}"
            for n in TYPED_ROWS
        )
        + " FROM typed",
        f"""
typed AS (
  SELECT event_type AS location, ts AS datetime,
         CAST(CASE WHEN event_id % 7 <> 0 THEN {BIG} + event_id END AS BIGINT) AS big,
         CAST(event_id % 997 AS DECIMAL(12, 2)) + CAST(0.25 AS DECIMAL(12, 2)) AS dec
  FROM events)""",
    ),
)
def rolling_types(spark, sf_dir):
    """Sums of whole numbers and decimals, short and long ones together: exact, of their own type."""
    big = F.when(F.col("event_id") % 7 != 0, F.lit(BIG) + F.col("event_id"))
    dec = (F.col("event_id") % 997).cast("decimal(11,2)") + F.lit(0.25).cast("decimal(11,2)")
    rows = i.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("location"),
        F.col("ts").alias("datetime"),
        big.cast("bigint").alias("big"),
        dec.cast("decimal(12,2)").alias("dec"),
    )
    specs = [RollingSpec(c, "sum", n, f"{c}_{n}") for n in TYPED_ROWS for c in ("big", "dec")]
    made = rolling(rows, specs)
    texts = {f"dec_{n}": F.col(f"dec_{n}").cast("string") for n in TYPED_ROWS}
    return made.withColumns(texts).select("location", "datetime", *[s.out for s in specs])


SINGLE_ORDER = "ORDER BY datetime ROWS BETWEEN"


@query(
    "rolling_single",
    i.on_obs(
        f"""
SELECT datetime,
       round(sum(precipitation) OVER ({SINGLE_ORDER} 23 PRECEDING AND CURRENT ROW), 4)
         AS rainfall_24h,
       round(sum(precipitation) OVER ({SINGLE_ORDER} 71 PRECEDING AND CURRENT ROW), 4)
         AS rainfall_72h,
       round(sum(precipitation) OVER ({SINGLE_ORDER} 167 PRECEDING AND CURRENT ROW), 4)
         AS rainfall_7d,
       round(avg(soil_moisture) OVER ({SINGLE_ORDER} 23 PRECEDING AND CURRENT ROW), 6)
         AS soil_moisture_avg_24h,
       round(max(precipitation) OVER ({SINGLE_ORDER} 23 PRECEDING AND CURRENT ROW), 4)
         AS max_rainfall_24h
FROM obs"""
    ),
)
def rolling_single(spark, sf_dir):
    """All observations as one series."""
    return _rolled(i.observations(spark, sf_dir), MAIN_FEATURES, keys=()).drop("location")


CHANGES = [f"pressure_{n}h_change" for n in (6, 12, 24)]
DROPS = [f"pressure_drop_{n}h" for n in (6, 12, 24)]


@query(
    "pressure_change",
    i.on_features(
        "SELECT location, datetime, "
        + ", ".join(f"CAST(0 AS DOUBLE) - {d} AS {c}" for c, d in zip(CHANGES, DROPS))
        + f", {', '.join(DROPS)} FROM features"
    ),
)
def pressure_change(spark, sf_dir):
    return lag_change(i.observations(spark, sf_dir)).select(
        "location",
        "datetime",
        # Without a sign on zero, as in the differences of the SQL.
        *[(F.col(c) + 0.0).alias(c) for c in CHANGES],
        *[(F.col(c) + 0.0).alias(c) for c in DROPS],
    )


@query(
    "interval_label",
    i.on_labeled("SELECT location, datetime, date, flood_event FROM labeled"),
)
def interval_label(spark, sf_dir):
    return i.labeled(spark, sf_dir).select("location", "datetime", "date", "flood_event")


@query(
    "interval_label_shuffled",
    i.on_labeled("SELECT location, datetime, date, flood_event FROM labeled"),
)
def interval_label_shuffled(spark, sf_dir):
    """The way taken where the events' days are too many to broadcast."""
    marked = label_intervals(
        i.observations(spark, sf_dir), i.episodes(spark), broadcast_rows=0, rows_per_task=50
    )
    return marked.select("location", "datetime", "date", "flood_event")


@query(
    "interval_label_any",
    i.sql(
        """
SELECT location, datetime, CAST(datetime AS DATE) AS date,
       CAST(CASE WHEN EXISTS (
         SELECT 1 FROM episodes e
         WHERE CAST(obs.datetime AS DATE) BETWEEN e.start_date AND e.end_date)
       THEN 1 ELSE 0 END AS INTEGER) AS flood_event
FROM obs""",
        i.OBS,
        i.EPISODE_ROWS,
    ),
)
def interval_label_any(spark, sf_dir):
    marked = label_intervals(i.observations(spark, sf_dir), i.episodes(spark), keys=())
    return marked.select("location", "datetime", "date", "flood_event")


@query(
    "labeled_features",
    i.on_labeled_features(
        f"SELECT location, datetime, date, {_rounds(MAIN_FEATURES)}, flood_event FROM labeled"
    ),
)
def labeled_features(spark, sf_dir):
    return i.rounded(
        i.labeled_features(spark, sf_dir).select(
            "location", "datetime", "date", *MAIN, "flood_event"
        ),
        {s.out: PLACES[s.fn] for s in MAIN_FEATURES},
    )


@query(
    "label_counts",
    i.on_labeled("SELECT flood_event, count(*) AS n FROM labeled GROUP BY flood_event"),
)
def label_counts(spark, sf_dir):
    return stats.label_counts(i.labeled(spark, sf_dir)).orderBy("flood_event")


@query(
    "label_counts_loc",
    i.on_labeled(
        "SELECT location, flood_event, count(*) AS n FROM labeled GROUP BY location, flood_event"
    ),
)
def label_counts_loc(spark, sf_dir):
    by = ("location", "flood_event")
    return stats.label_counts(i.labeled(spark, sf_dir), by).orderBy(*by)


YEAR = "date BETWEEN DATE '2024-01-01' AND DATE '2024-12-31' AND flood_event = 1"


@query(
    "positives_by_loc",
    i.on_labeled(
        f"SELECT location, count(*) AS n FROM labeled WHERE {YEAR} GROUP BY location"
    ),
)
def positives_by_loc(spark, sf_dir):
    rows = i.labeled(spark, sf_dir).filter(YEAR)
    return stats.label_counts(rows, ("location",)).orderBy("location")


@query(
    "positives_by_day",
    i.on_labeled(
        "SELECT CAST(datetime AS DATE) AS date, count(*) AS n FROM labeled "
        f"WHERE {YEAR} GROUP BY 1"
    ),
)
def positives_by_day(spark, sf_dir):
    rows = i.labeled(spark, sf_dir).filter(YEAR)
    return stats.label_counts(rows, (F.to_date("datetime").alias("date"),)).orderBy("date")


def _class_query(name, cols, fns, by="flood_event", where=None, training=False):
    aggregates = {"avg": "avg", "max": "max", "stddev": "stddev_samp"}
    parts = [f"round({aggregates[f]}({c}), 6) AS {c}_{f}" for f in fns for c in cols]
    condition = f" WHERE {where}" if where else ""
    text = f"SELECT {by}, {', '.join(parts)} FROM labeled{condition} GROUP BY {by}"

    @query(name, (i.on_training_features if training else i.on_labeled_features)(text))
    def run(spark, sf_dir):
        rows = (i.explored_training if training else i.explored)(spark, sf_dir)
        rows = rows.filter(where) if where else rows
        made = stats.class_stats(rows, cols, (by,), fns)
        return i.rounded(made, {f"{c}_{f}": 6 for f in fns for c in cols}).orderBy(by)


_class_query("class_means", (*SHORT, *RAINS, "rainfall_48h", "pressure", *DROPS), ("avg",), training=True)
_class_query("class_stddev", ("precipitation", *MAIN), ("stddev",), training=True)
_class_query("class_avg_max", MAIN, ("avg", "max"))
_class_query("loc_avg_max", MAIN, ("avg", "max"), by="location", where="flood_event = 1")


CORRELATED = ("precipitation", *MAIN, "rainfall_48h", *SHORT, "pressure", *DROPS)


def _correlation_query(name, nulls):
    value = "coalesce({0}, CAST(0 AS DOUBLE))" if nulls == "zero" else "{0}"
    parts = [
        f"SELECT '{c}' AS feature, round(corr({value.format(c)}, CAST(flood_event AS DOUBLE)), 6)"
        " AS correlation FROM labeled"
        for c in CORRELATED
    ]

    @query(name, i.on_training_features("\nUNION ALL ".join(parts)))
    def run(spark, sf_dir):
        made = stats.label_correlation(i.explored_training(spark, sf_dir), CORRELATED, nulls=nulls)
        return i.rounded(made, {"correlation": 6})


_correlation_query("feature_corr", "zero")
_correlation_query("feature_corr_skip", "skip")


def _orders(spark, sf_dir):
    return i.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.col("o_orderdate").alias("datetime"),
        (F.col("o_orderstatus") == "F").cast("int").alias("flood_event"),
    )


@query(
    "monthly_rate",
    """
SELECT CAST(month(o_orderdate) AS INTEGER) AS month, count(*) AS total_records,
       CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS flood_records,
       round(CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS DOUBLE)
             / CAST(count(*) AS DOUBLE), 6) AS flood_rate
FROM orders WHERE o_orderdate < DATE '2000-01-01' GROUP BY 1""",
)
def monthly_rate(spark, sf_dir):
    """Of the years before the last two, which are held out."""
    made = stats.monthly_rate(between_times(_orders(spark, sf_dir), "datetime", end="2000-01-01"))
    return i.rounded(made, {"flood_rate": 6}).orderBy("month")


@query(
    "seasonal_cycle",
    """
SELECT o_orderkey, month,
       round(sin(CAST(2 AS DOUBLE) * CAST(3.141592653589793 AS DOUBLE) * month / 12), 6)
         + CAST(0 AS DOUBLE) AS month_sin,
       round(cos(CAST(2 AS DOUBLE) * CAST(3.141592653589793 AS DOUBLE) * month / 12), 6)
         + CAST(0 AS DOUBLE) AS month_cos
FROM (SELECT o_orderkey, CAST(month(o_orderdate) AS INTEGER) AS month FROM orders)""",
)
def seasonal_cycle(spark, sf_dir):
    made = add_month_cycle(_orders(spark, sf_dir))
    return made.select(
        "o_orderkey",
        "month",
        (F.round("month_sin", 6) + 0.0).alias("month_sin"),
        (F.round("month_cos", 6) + 0.0).alias("month_cos"),
    )


COLUMNS = [("location", "string"), ("datetime", "timestamp_ntz"), *((m, "double") for m in MEASURES)]
QUARTER = 0.25


def _profiled_sql(position, name, kind):
    quarter = f"quantile_disc({name}, {QUARTER})" if kind == "double" else "NULL"
    return (
        f"SELECT {position} AS position, '{name}' AS column_name, '{kind}' AS type, count(*) AS n_rows, "
        f"count(*) - count({name}) AS n_nulls, true AS distinct_close, "
        f"{quarter} IS NOT NULL AS has_quarter, true AS quarter_close FROM gappy"
    )


@query(
    "schema_listing",
    i.sql(
        "\nUNION ALL ".join(_profiled_sql(k, name, kind) for k, (name, kind) in enumerate(COLUMNS)),
        i.OBS,
        i.GAPPY,
    ),
)
def schema_listing(spark, sf_dir):
    """Columns with their types, rows and nulls; the sketches' figures held against exact ones."""
    rows = i.gappy_observations(spark, sf_dir).select(*(name for name, _ in COLUMNS))
    found = profile.profile_table(rows, (QUARTER,))
    numbers = [name for name, kind in COLUMNS if kind == "double"]
    exact = rows.agg(*(F.count_distinct(name).alias(f"{name}_n") for name, _ in COLUMNS))
    # The rank of each sketched quarter: shares of the rows below it, and up to it.
    quarters = {r["column_name"]: r["quantiles"] for r in found.collect()}
    ranks = rows.agg(
        *(F.avg((F.col(c) < F.lit(quarters[c][0])).cast("double")).alias(f"{c}_below") for c in numbers if quarters[c]),
        *(F.avg((F.col(c) <= F.lit(quarters[c][0])).cast("double")).alias(f"{c}_to") for c in numbers if quarters[c]),
    )

    def of(name, df, tail):
        return df.select(f"{name}_{tail}").scalar()

    n_exact = F.coalesce(*(F.when(F.col("column_name") == c, of(c, exact, "n")) for c, _ in COLUMNS))
    near = [
        F.when(F.col("column_name") == c, (of(c, ranks, "below") <= QUARTER + 0.01) & (of(c, ranks, "to") >= QUARTER - 0.01))
        for c in numbers
        if quarters[c]
    ]
    return found.select(
        "position",
        "column_name",
        "type",
        "n_rows",
        "n_nulls",
        (F.abs(F.col("n_distinct") - n_exact) <= 0.2 * n_exact + 1).alias("distinct_close"),
        F.col("quantiles").isNotNull().alias("has_quarter"),
        F.coalesce(*near, F.lit(True)).alias("quarter_close"),
    )


@query("row_count", "SELECT count(*) AS n_rows FROM events")
def row_count(spark, sf_dir):
    return profile.row_count(i.observations(spark, sf_dir))


@query(
    "preview",
    i.on_obs(
        "SELECT location, datetime, precipitation, soil_moisture FROM obs "
        "ORDER BY datetime, location LIMIT 10"
    ),
)
def preview(spark, sf_dir):
    rows = i.observations(spark, sf_dir)
    rows = rows.select("location", "datetime", "precipitation", "soil_moisture")
    return profile.preview(rows, ["datetime", "location"])


@query(
    "null_counts",
    i.sql(
        "\nUNION ALL ".join(
            f"SELECT '{c}' AS column_name, count(*) - count({c}) AS null_count FROM gappy"
            for c in ("location", "datetime", *MEASURES)
        ),
        i.OBS,
        i.GAPPY,
    ),
)
def null_counts(spark, sf_dir):
    return profile.null_counts(i.gappy_observations(spark, sf_dir))


@query(
    "complete_cases",
    i.sql(
        "SELECT * FROM gappy WHERE precipitation IS NOT NULL AND NOT isnan(humidity)",
        i.OBS,
        i.GAPPY,
    ),
)
def complete(spark, sf_dir):
    return complete_cases(i.gappy_observations(spark, sf_dir), MEASURES)


DESCRIBED = ("pressure", *RAINS, "soil_moisture", "soil_moisture_avg_24h", "temperature", "humidity")


@query(
    "describe_by_class",
    i.on_scored_features(
        "\nUNION ALL ".join(
            f"""SELECT population, '{c}' AS feature, count({c}) AS n, round(avg({c}), 6) AS mean,
       round(stddev_samp({c}), 6) AS stddev, round(min({c}), 4) AS min,
       round(max({c}), 4) AS max FROM population GROUP BY population"""
            for c in DESCRIBED
        )
    ).replace(
        "\nSELECT population",
        """,
population AS (
  SELECT *, CASE WHEN flood_event = 1 THEN 'positive' ELSE 'false_positive' END AS population
  FROM scored WHERE location = 'error' AND (flood_event = 1 OR prediction = 1))
SELECT population""",
        1,
    ),
)
def describe_by_class(spark, sf_dir):
    """Feature profile of one location's false positives and positives, side by side."""
    rows = i.scored_features(spark, sf_dir).filter(
        (F.col("location") == "error") & ((F.col("flood_event") == 1) | (F.col("prediction") == 1))
    )
    population = F.when(F.col("flood_event") == 1, "positive").otherwise("false_positive")
    made = profile.describe_by(rows.withColumn("population", population), DESCRIBED, "population")
    return i.rounded(made, {"mean": 6, "stddev": 6, "min": 4, "max": 4})


@query("distinct_locations", i.on_obs("SELECT DISTINCT location FROM obs"))
def distinct_locations(spark, sf_dir):
    return profile.distinct_sorted(i.observations(spark, sf_dir), "location")
