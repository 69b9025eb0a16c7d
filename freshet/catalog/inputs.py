"""The driver's tables seen as observations, events and scores, in Spark and in SQL.

``events`` serves as the observation table: its type is the location, its value the rainfall.
``orders`` serves where several years are needed.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.functions import between_times
from freshet.operators.labeling import label_intervals
from freshet.operators.rolling import (
    FEATURES_48H,
    MAIN_FEATURES,
    PRESSURE_LAGS,
    RAIN_SHORT,
)
from freshet.plans import features as plan

TRAIN_END = "2024-01-21"
CALIBRATION_START = "2024-01-16"
KEY = ("location", "datetime")
ALL_SPECS = FEATURES_48H + RAIN_SHORT

# Two overlapping intervals, one at another location, one at an unknown and one at no
# location, and one that ends before it starts.
EPISODES = (
    ("E1", "2024-01-05", "2024-01-07", "error"),
    ("E2", "2024-01-07", "2024-01-09", "error"),
    ("E3", "2024-01-24", "2024-01-25", "click"),
    ("E4", "2024-01-10", "2024-01-12", "nowhere"),
    ("E5", "2024-01-13", "2024-01-14", None),
    ("E6", "2024-01-20", "2024-01-18", "view"),
)


def _text(value):
    return "CAST(NULL AS VARCHAR(20))" if value is None else f"'{value}'"


EPISODE_VALUES = ", ".join(
    f"('{name}', DATE '{first}', DATE '{last}', {_text(where)})"
    for name, first, last, where in EPISODES
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark, sf_dir) -> DataFrame:
    digits = F.regexp_extract("props", "([0-9]+)", 1)
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("location"),
        F.col("ts").alias("datetime"),
        (15 + F.col("user_id") % 20).cast("double").alias("temperature"),
        (40 + F.col("event_id") % 60).cast("double").alias("humidity"),
        F.col("value").alias("precipitation"),
        (1000 + F.col("event_id") % 37).cast("double").alias("pressure"),
        ((F.col("event_id") % 17).cast("double") / 2.0).alias("wind_speed"),
        (digits.cast("double") / 100.0).alias("soil_moisture"),
    )


def gappy_observations(spark, sf_dir) -> DataFrame:
    """Observations with some rainfall missing and some humidity not a number."""
    obs = observations(spark, sf_dir)
    return obs.withColumn(
        "precipitation", F.when(F.col("pressure") != 1011, F.col("precipitation"))
    ).withColumn(
        "humidity",
        F.when(F.col("humidity") == 77, F.lit(float("nan"))).otherwise(F.col("humidity")),
    )


def episodes(spark) -> DataFrame:
    names = "event_id, start_date, end_date, location"
    return spark.sql(f"SELECT * FROM VALUES {EPISODE_VALUES} AS episodes({names})")


def labeled(spark, sf_dir) -> DataFrame:
    return label_intervals(observations(spark, sf_dir), episodes(spark))


def with_score(df: DataFrame) -> DataFrame:
    """A deterministic score and prediction, so that evaluation can be checked without a model."""
    rain = F.col("precipitation")
    score = F.when(rain.isNotNull(), F.least(rain / 100.0, F.lit(1.0)))
    return df.withColumn("score", score).withColumn(
        "prediction", (F.col("score") >= 0.5).cast("double")
    )


def scored(spark, sf_dir) -> DataFrame:
    return with_score(labeled(spark, sf_dir))


def labeled_features(spark, sf_dir, specs=MAIN_FEATURES) -> DataFrame:
    return plan.labeled_features(observations(spark, sf_dir), episodes(spark), specs)


def scored_features(spark, sf_dir) -> DataFrame:
    return with_score(labeled_features(spark, sf_dir))


def explored(spark, sf_dir) -> DataFrame:
    """Labelled rows with every rainfall sum and the pressure drops."""
    return plan.labeled_features(
        observations(spark, sf_dir), episodes(spark), ALL_SPECS, PRESSURE_LAGS
    )


def explored_training(spark, sf_dir) -> DataFrame:
    """The same of the training period alone, cut off before any window looks at it."""
    obs = between_times(observations(spark, sf_dir), "datetime", end=TRAIN_END)
    return plan.labeled_features(obs, episodes(spark), ALL_SPECS, PRESSURE_LAGS)


def rounded(df: DataFrame, places: dict) -> DataFrame:
    """Round to the places at which two engines' sums in different order agree."""
    return df.withColumns({c: F.round(c, p) for c, p in places.items()})


# The same, as common table expressions.

OBS = """
obs AS (
  SELECT event_type AS location, ts AS datetime,
         CAST(15 + user_id % 20 AS DOUBLE) AS temperature,
         CAST(40 + event_id % 60 AS DOUBLE) AS humidity,
         value AS precipitation,
         CAST(1000 + event_id % 37 AS DOUBLE) AS pressure,
         CAST(event_id % 17 AS DOUBLE) / CAST(2 AS DOUBLE) AS wind_speed,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) / CAST(100 AS DOUBLE)
           AS soil_moisture
  FROM events)"""

GAPPY = """
gappy AS (
  SELECT location, datetime, temperature,
         CASE WHEN humidity = 77 THEN CAST('NaN' AS DOUBLE) ELSE humidity END AS humidity,
         CASE WHEN pressure <> 1011 THEN precipitation END AS precipitation,
         pressure, wind_speed, soil_moisture
  FROM obs)"""


EPISODE_ROWS = f"""
episodes(event_id, start_date, end_date, location) AS (VALUES {EPISODE_VALUES})"""


def _frame(fn, column, rows):
    return (
        f"{fn}({column}) OVER (PARTITION BY location ORDER BY datetime "
        f"ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"
    )


def frames(specs):
    return ", ".join(f"{_frame(s.fn, s.col, s.rows)} AS {s.out}" for s in specs)


def _drops(lags=(6, 12, 24)):
    over = "OVER (PARTITION BY location ORDER BY datetime)"
    return ", ".join(f"lag(pressure, {n}) {over} - pressure AS pressure_drop_{n}h" for n in lags)


FEATURES = f"""
features AS (SELECT *, {frames(ALL_SPECS)}, {_drops()} FROM obs)"""

FLAG = """CAST(CASE WHEN EXISTS (
           SELECT 1 FROM episodes e
           WHERE e.location = {rows}.location
             AND CAST({rows}.datetime AS DATE) BETWEEN e.start_date AND e.end_date)
         THEN 1 ELSE 0 END AS INTEGER)"""

LABELED = f"""
labeled AS (
  SELECT *, CAST(datetime AS DATE) AS date, {FLAG.format(rows="obs")} AS flood_event FROM obs)"""

LABELED_FEATURES = f"""
labeled AS (
  SELECT *, CAST(datetime AS DATE) AS date, {FLAG.format(rows="features")} AS flood_event
  FROM features)"""

SCORED_ROWS = """
scored AS (
  SELECT *, CAST(CASE WHEN score >= CAST(0.5 AS DOUBLE) THEN 1 WHEN score IS NOT NULL THEN 0 END
             AS DOUBLE) AS prediction
  FROM (SELECT *, CASE WHEN precipitation IS NOT NULL THEN
               least(precipitation / CAST(100 AS DOUBLE), CAST(1 AS DOUBLE)) END AS score
        FROM {rows}))"""


SCORED = SCORED_ROWS.format(rows="labeled")


def sql(body, *ctes):
    return f"WITH {','.join(ctes)}\n{body}"


def on_obs(body):
    return sql(body, OBS)


def on_features(body):
    return sql(body, OBS, FEATURES)


def on_labeled(body):
    return sql(body, OBS, EPISODE_ROWS, LABELED)


def on_labeled_features(body):
    return sql(body, OBS, EPISODE_ROWS, FEATURES, LABELED_FEATURES)


def on_training_features(body):
    early = OBS.replace("FROM events)", f"FROM events WHERE ts < TIMESTAMP '{TRAIN_END} 00:00:00')")
    return sql(body, early, EPISODE_ROWS, FEATURES, LABELED_FEATURES)


def on_scored(body, *more):
    return sql(body, OBS, EPISODE_ROWS, LABELED, SCORED, *more)


def on_scored_features(body):
    return sql(body, OBS, EPISODE_ROWS, FEATURES, LABELED_FEATURES, SCORED)


def rounds(places):
    return ", ".join(f"round({c}, {p}) AS {c}" for c, p in places.items())
