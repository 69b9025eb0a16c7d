"""Dimension lookups: broadcast, shuffled, and with hot keys spread over tasks."""

import pytest
from pyspark.sql import functions as F

from freshet.operators import lookup as lookups
from freshet.sources import tag_location

FACTS = [("hot", k) for k in range(600)] + [("b", 1), ("gone", 2)] + [(None, k) for k in range(300)]
DIM = [("hot", 24.8), ("b", 24.6), ("unused", 1.0), (None, 99.0)]


@pytest.fixture
def tables(spark):
    return (
        spark.createDataFrame(FACTS, "location string, v long"),
        spark.createDataFrame(DIM, "location string, latitude double"),
    )


def expected():
    known = {k: v for k, v in DIM if k is not None}
    return sorted(((w, v, known.get(w)) for w, v in FACTS), key=repr)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_broadcast(tables):
    df = tag_location(*tables, "location")
    assert "BroadcastHashJoin" in df._jdf.queryExecution().toString()
    assert collected(df) == expected()


def test_measure(spark, tables):
    _, dim = tables
    wide = spark.range(10).selectExpr("id", "sequence(0, 999) AS many")
    assert lookups.fits_broadcast(wide) and not lookups.fits_broadcast(wide, size=10_000)
    assert lookups.fits_broadcast(dim)
    assert not lookups.fits_broadcast(dim, rows=3)
    assert not lookups.fits_broadcast(dim, size=10)


@pytest.mark.parametrize("rows_per_task", [50, 10_000])
def test_shuffled(tables, rows_per_task):
    df, dim = tables
    made = lookups._spread_lookup(df, dim, ["location"], rows_per_task, lookups.BROADCAST_BYTES)
    assert made.columns == ["location", "v", "latitude"]
    assert collected(made) == expected()


def test_equal_rows_of_a_hot_key_are_spread(spark):
    df = spark.range(4000, numPartitions=8).selectExpr("'hot' AS location", "1 AS v")
    parts = df.select(lookups.spread(df, F.lit(8)).alias("p")).groupBy("p").count()
    assert parts.agg(F.max("count")).first()[0] <= 500


def test_hot_keys_are_found(tables):
    hot = lookups._hot_keys(tables[0], ["location"], 50, "parts", ["key"])
    assert {r["key"]: r["parts"] for r in hot.collect()} == {"hot": 12, None: 6}
    assert lookups._hot_keys(tables[0], ["location"], 10_000, "parts", ["key"]) is None


def test_rows_with_maps_on_the_hot_path(tables):
    df, dim = tables
    nested = F.array(F.struct(F.create_map(F.lit("a"), F.col("v")).alias("m")))
    mapped = df.withColumns({"m": F.create_map(F.lit("a"), F.col("v")), "deep": nested})
    made = lookups._spread_lookup(mapped, dim, ["location"], 50, lookups.BROADCAST_BYTES)
    assert sorted(((r.location, r.v, r.latitude) for r in made.collect()), key=repr) == expected()
    assert all(r.m == {"a": r.v} and r.deep[0].m == {"a": r.v} for r in made.collect())


def test_wide_hot_keys_are_joined_by_shuffle(spark, monkeypatch):
    keys = spark.range(40).select(F.concat(F.lit("k"), "id", F.repeat(F.lit("x"), 20_000)).alias("location"))
    df = keys.crossJoin(spark.range(60)).withColumnRenamed("id", "v")
    dim = keys.select("location", F.length("location").alias("n"), F.xxhash64("location").alias("_part"))
    monkeypatch.setattr(lookups, "ROWS_PER_TASK", 50)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = lookups.lookup(df, dim, ["location"], small=False, rows_per_task=50, size=100_000)
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "strategy=broadcast" not in plan
        assert made.columns == ["location", "v", "n", "_part"]
        wrong = made.filter("n is null or n <> length(location) or _part <> xxhash64(location)").count()
        assert (made.count(), wrong) == (2400, 0)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
