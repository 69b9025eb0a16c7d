"""Ingest, scans and round trips."""

from pyspark.sql import functions as F

from freshet.catalog import inputs as i
from freshet.catalog.registry import query
from freshet.operators.rolling import RAIN_24, rolling
from freshet.schemas import HOURLY_FIELDS, MEASURES
from freshet.sources import (
    read_csv,
    read_observations,
    read_table,
    tag_location,
    unpack_hourly,
    write_csv,
    write_table,
)
from freshet.storage import new_path

# Bounds the documents built here, whatever the table's size and its ids.
ROWS_PER_DOCUMENT = 64


def _documents(spark, sf_dir):
    """The observations as raw documents: of any 64 rows read in turn, one per location."""
    obs = i.observations(spark, sf_dir).withColumn("id", F.monotonically_increasing_id())
    hour = F.struct(
        F.translate(F.col("datetime").cast("string"), " ", "T").alias("time"),
        *[F.col(column).alias(source) for source, column in HOURLY_FIELDS.items()],
    )
    chunk = F.floor(F.col("id") / ROWS_PER_DOCUMENT).alias("chunk")
    documents = obs.groupBy("location", chunk).agg(F.collect_list(hour).alias("hours"))
    arrays = [F.col(f"hours.{name}").alias(name) for name in ("time", *HOURLY_FIELDS)]
    return documents.select(
        "location",
        F.size("hours").cast("long").alias("hours"),
        F.to_json(F.struct(F.struct(*arrays).alias("hourly"))).alias("payload"),
    )


@query("json_unpack", i.on_obs("SELECT * FROM obs"))
def json_unpack(spark, sf_dir):
    rows, _ = unpack_hourly(_documents(spark, sf_dir))
    return rows.select("location", "datetime", *MEASURES)


@query(
    "json_quarantine",
    """
SELECT event_type AS location,
       CASE event_type WHEN 'error' THEN 'unreadable' WHEN 'click' THEN 'unequal_lengths'
       WHEN 'view' THEN 'bad_time' ELSE 'kept' END AS reason, count(*) AS hours
FROM events GROUP BY 1, 2""",
)
def json_quarantine(spark, sf_dir):
    """Documents of three locations damaged, each in its way: hours kept and quarantined."""
    payload, where = F.col("payload"), F.col("location")
    damaged = (
        F.when(where == "error", F.expr("left(payload, length(payload) - 3)"))
        .when(where == "click", F.regexp_replace(payload, '"wind_speed_10m":\\[', "$0-1.0,"))
        .when(where == "view", F.regexp_replace(payload, "T", " at "))
        .otherwise(payload)
    )
    rows, quarantine = unpack_hourly(_documents(spark, sf_dir).withColumn("payload", damaged))
    kept = rows.select("location", F.lit("kept").alias("reason"), F.lit(1).alias("hours"))
    whole = quarantine.select("location", "reason", "hours").unionByName(kept)
    return whole.groupBy("location", "reason").agg(F.sum("hours").alias("hours"))


@query(
    "dim_tag",
    "SELECT c_custkey, c_nationkey AS n_nationkey, n_name, n_regionkey "
    "FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey",
)
def dim_tag(spark, sf_dir):
    customers = i.table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_nationkey").alias("n_nationkey")
    )
    tagged = tag_location(customers, i.table(spark, sf_dir, "nation"), "n_nationkey")
    return tagged.select("c_custkey", "n_nationkey", "n_name", "n_regionkey")


@query("csv_scan", i.on_obs("SELECT * FROM obs"))
def csv_scan(spark, sf_dir):
    path = new_path(spark, "observations-csv")
    write_csv(i.observations(spark, sf_dir), path)
    rows, _ = read_observations(spark, path)
    return rows.select("location", "datetime", *MEASURES)


@query(
    "csv_quarantine",
    i.sql(
        """
SELECT location, 'kept' AS reason, count(*) AS n, round(sum(rainfall_24h), 3) AS rain
FROM (SELECT *, sum(precipitation) OVER (PARTITION BY location ORDER BY datetime
                ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS rainfall_24h
      FROM obs WHERE pressure NOT IN (1011, 1012, 1013)) GROUP BY 1
UNION ALL
SELECT location, CASE WHEN pressure = 1013 THEN 'missing' ELSE 'unreadable' END, count(*), NULL
FROM obs WHERE pressure IN (1011, 1012, 1013) GROUP BY 1, 2""",
        i.OBS,
    ),
)
def csv_quarantine(spark, sf_dir):
    """Lines with a bad time, a bad number and no time: set aside, and no window sees them."""
    obs = i.observations(spark, sf_dir)
    stamp = F.date_format("datetime", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    damaged = {
        "datetime": F.when(F.col("pressure") == 1011, "not-a-time")
        .when(F.col("pressure") == 1013, F.lit(None))
        .otherwise(stamp),
        "precipitation": F.when(F.col("pressure") == 1012, "much").otherwise(
            F.col("precipitation").cast("string")
        ),
    }
    path = new_path(spark, "damaged-csv")
    write_csv(obs.withColumns(damaged), path)
    rows, bad = read_observations(spark, path)
    kept = rolling(rows, (RAIN_24,)).groupBy("location").agg(
        F.lit("kept").alias("reason"),
        F.count("*").alias("n"),
        F.round(F.sum("rainfall_24h"), 3).alias("rain"),
    )
    counted = bad.groupBy("location", "reason").agg(F.count("*").alias("n"))
    return kept.unionByName(counted.withColumn("rain", F.lit(None).cast("double")))


@query(
    "csv_roundtrip",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority "
    "FROM orders",
)
def csv_roundtrip(spark, sf_dir):
    orders = i.table(spark, sf_dir, "orders")
    path = new_path(spark, "orders-csv")
    write_csv(orders, path)
    return read_csv(spark, path, orders.schema).select(*orders.columns)


@query("parquet_roundtrip", i.on_obs("SELECT * FROM obs"))
def parquet_roundtrip(spark, sf_dir):
    path = new_path(spark, "observations")
    write_table(i.observations(spark, sf_dir), path, partition_by="location")
    return read_table(spark, path).select("location", "datetime", *MEASURES)
