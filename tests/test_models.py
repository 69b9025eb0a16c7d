"""Forests and calibration: properties that hold whatever the trees are."""

import random
import re
import subprocess
import sys
from dataclasses import replace

import duckdb
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from freshet.catalog import inputs as i
from freshet.operators.rolling import FEATURES_48H
from freshet.plans import training
from freshet.plans.calibration import (
    apply_calibrator,
    compare_scores,
    fit_calibrator,
    load_calibrator,
    save_calibrator,
)
from freshet.plans.scoring import dropped_rows, score_table
from freshet.plans.encoding import encode_category, location_ranks
from freshet.plans.training import feature_importance, fit, temporal_split
from freshet.sources import load_model, save_model
from freshet.storage import new_path, stage
from tests.oracle import compare

SMALL = replace(training.MAIN, trees=8, depth=4)


@pytest.fixture(scope="module")
def split(spark, small_dir):
    rows = stage(i.labeled_features(spark, small_dir, FEATURES_48H), "rows")
    return temporal_split(rows, "datetime", (i.TRAIN_END,))


@pytest.fixture(scope="module")
def model(split):
    return fit(split[0], SMALL, partitions=4)


def probabilities(df):
    return sorted((r.location, r.datetime, r.flood_probability) for r in df.collect())


def test_probabilities(split, model):
    scored = score_table(model, split[1], SMALL)
    assert scored.count() == split[1].count()
    pair = scored.select(vector_to_array("probability").alias("p"), "flood_probability").collect()
    for r in pair:
        assert sum(r.p) == pytest.approx(1.0) and 0 <= r.p[1] <= 1
        assert r.flood_probability == r.p[1]


def test_importance(model):
    rows = feature_importance(model).collect()
    assert [r.feature for r in rows if r.importance is None] == []
    assert {r.feature for r in rows} == set(SMALL.inputs) and len(rows) == 12
    assert sum(r.importance for r in rows) == pytest.approx(1.0)
    values = [r.importance for r in rows]
    assert values == sorted(values, reverse=True)


def test_same_seed_same_forest(split, model):
    again = fit(split[0], SMALL, partitions=4)
    assert probabilities(score_table(again, split[1], SMALL)) == probabilities(
        score_table(model, split[1], SMALL)
    )


def test_saved_model_scores_alike(spark, split, model):
    path = new_path(spark, "model")
    save_model(model, path)
    save_model(model, path)
    loaded = load_model(path)
    assert probabilities(score_table(loaded, split[1], SMALL)) == probabilities(
        score_table(model, split[1], SMALL)
    )


@pytest.mark.parametrize(
    "spec, width",
    [
        (training.MAIN, 12),
        (training.WITH_48H, 13),
        (training.NO_LOCATION, 11),
        (training.SEASONAL, 14),
        (training.UNWEIGHTED, 11),
    ],
)
def test_feature_sets(split, spec, width):
    small = replace(spec, trees=2, depth=2)
    made = fit(split[0], small)
    assert len(spec.inputs) == width
    assert made.forest.numFeatures == width + (spec.digits if spec.use_category else 0)
    assert len(made.pipeline.stages) == 2 and (made.encoding is not None) == spec.use_category
    assert {r.feature for r in feature_importance(made).collect()} == set(spec.inputs)
    assert score_table(made, split[1], small).count() == split[1].count()
    forest = training.build_pipeline(spec).getStages()[-1]
    assert (forest.getNumTrees(), forest.getMaxDepth(), forest.getSeed()) == (100, 10, 42)
    assert forest.isSet("weightCol") == spec.weighted


def test_incomplete_rows_are_dropped_and_counted(split, model):
    holed = split[1].withColumn(
        "pressure", F.when(F.col("location") != "click", F.col("pressure"))
    )
    missing = split[1].filter("location = 'click'").count()
    assert score_table(model, holed, SMALL).count() == split[1].count() - missing
    assert tuple(dropped_rows(holed, SMALL).first()) == (split[1].count(), missing)


def test_no_location_model_still_needs_a_location(split):
    spec = replace(training.NO_LOCATION, trees=1, depth=1)
    nameless = split[0].withColumn("location", F.lit(None).cast("string"))
    with pytest.raises(ValueError):
        fit(nameless, spec)


def test_one_class_is_refused(split):
    with pytest.raises(ValueError, match="classes"):
        fit(split[0].filter("flood_event = 0"), SMALL)


def test_indexer(spark):
    train = spark.createDataFrame([("b",), ("b",), ("c",), ("a",), (None,)], "location string")
    encoding = encode_category(train, base=3, digits=2)
    other = spark.createDataFrame([("a",), ("b",), ("c",), ("new",), (None,)], "location string")
    got = {r.location: (r.location_index, r.location_digit0, r.location_digit1) for r in encoding.add(other).collect()}
    assert got == {"b": (0, 0, 0), "a": (1, 0, 0), "c": (2, 0, 0), "new": (2, 1, 0), None: (2, 1, 0)}
    with pytest.raises(ValueError, match="digits"):
        encode_category(spark.range(12), "id", base=3, digits=2)


@pytest.mark.parametrize("places", [30, 31, 32, 33, 120])
def test_inputs_do_not_follow_the_number_of_locations(spark, places):
    rows = spark.range(places * 20).select(F.format_string("p%03d", F.col("id") % places).alias("location"), "id")
    rows = rows.withColumn("flood_event", (F.col("id") % 3 == 0).cast("int"))
    rows = rows.withColumns({c: F.col("id").cast("double") for c in SMALL.numeric})
    spec = replace(SMALL, trees=1, depth=2)
    made = fit(rows, spec)
    assert made.forest.getMaxBins() == 32 and made.forest.numFeatures == 12 + 4
    names = made.pipeline.stages[0].getInputCols()
    assert names == [*spec.inputs, *(f"location_digit{k}" for k in range(4))]
    scored = score_table(made, rows, spec)
    assert scored.agg(F.max("location_index")).first()[0] == min(places - 1, 31)
    assert scored.select("location_index", *names[-4:]).distinct().count() == places


def test_many_values_stay_off_the_driver(spark, monkeypatch):
    """A fit on 100,000 values: what comes to the driver does not grow with them."""
    rows = spark.range(200_000).select(F.expr("concat('p', id % 100000)").alias("location"), "id")
    rows = rows.withColumn("flood_event", (F.col("id") % 3 == 0).cast("int"))
    rows = rows.withColumns({c: (F.col("id") % 97).cast("double") for c in SMALL.numeric})
    fetched = []

    def counted(self, collect=DataFrame.collect):
        out = collect(self)
        fetched.append(len(out))
        return out

    monkeypatch.setattr(DataFrame, "collect", counted)
    spec = replace(SMALL, trees=1, depth=2)
    made = fit(rows, spec)
    assert max(fetched, default=0) <= 2
    assert made.encoding.values == 100_000
    codes = made.encoding.add(rows).select("location_index", *made.encoding.digit_columns)
    assert codes.distinct().count() == 100_000


def test_a_filter_on_a_score_applies_the_forest_once(split, model):
    scored = score_table(model, split[1], SMALL, report=True)
    some = scored.filter("flood_probability > 0.5 and risk_level <> 'LOW' and location = 'click'")
    plan = some._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"UDF\(features", plan)) == 1 and len(re.findall(r"UDF\(struct\(", plan)) == 1
    # Filters on other columns still move below the forest.
    assert plan.index("Filter") < plan.index("Generate") < plan.rindex("= click")
    want = [r for r in scored.collect() if r.flood_probability > 0.5 and r.location == "click"]
    assert some.count() == len(want)


def test_location_index_of_many_locations(spark, small_dir, tmp_path):
    events = spark.read.parquet(f"{small_dir}/events.parquet")
    many = events.withColumn("event_type", F.concat("event_type", (F.pmod(F.xxhash64("ts"), F.lit(60))).cast("string")))
    many.write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert con.execute("SELECT count(DISTINCT event_type) FROM events").fetchone()[0] > 32
    run, sql = queries()["location_index"], oracle_sql()["location_index"]
    assert compare(spark, con, run, sql, str(tmp_path)) == ""
    obs = i.observations(spark, str(tmp_path)).select("location")
    numbers = encode_category(obs).table.collect()
    assert sorted(map(tuple, numbers)) == sorted(map(tuple, location_ranks(obs).collect()))


def test_every_location_has_a_code_of_its_own(spark, split):
    many = split[0].withColumn("location", F.concat("location", (F.xxhash64("datetime") % 400).cast("string")))
    many = stage(many, "many")
    places = many.select("location").distinct().count()
    assert places > 500
    spec = replace(SMALL, trees=2, depth=3)
    path = new_path(spark, "model")
    save_model(fit(many, spec), path)
    made = load_model(path)
    digits = made.encoding.digit_columns
    assert made.forest.numFeatures == 12 + len(digits)
    new = many.limit(1).withColumn("location", F.lit("never seen"))
    scored = score_table(made, many.unionByName(new), spec)
    assert scored.select("location_index", *digits).distinct().count() == places + 1
    assert {r.feature for r in feature_importance(made).collect()} == set(spec.inputs)


def test_a_rare_location_counts(spark, split):
    """A location beyond the 31 most frequent, where alone it floods, is told from the others."""
    rows = spark.range(40 * 200).select(F.expr("concat('p', lpad(id % 40, 2, '0'))").alias("location"), "id")
    rows = rows.withColumn("flood_event", (F.col("location") == "p37").cast("int"))
    rows = rows.withColumns({c: F.lit(1.0) for c in SMALL.numeric})
    scored = score_table(fit(rows, SMALL, partitions=2), rows, SMALL)
    assert scored.filter("prediction <> flood_event").count() == 0


FOREST = """
import sys
from dataclasses import replace
from pyspark.sql import functions as F
from tests.oracle import session
from freshet.catalog import inputs as i
from freshet.operators.rolling import FEATURES_48H
from freshet.plans import training
from freshet.plans.scoring import score_table
from freshet.storage import stage
spark = session(int(sys.argv[1]), int(sys.argv[1]))
rows = stage(i.labeled_features(spark, sys.argv[2], FEATURES_48H), "rows")
train, test = training.temporal_split(rows, "datetime", (i.TRAIN_END,))
spec = replace(training.MAIN, trees=8, depth=4)
scored = score_table(training.fit(train, spec, partitions=4), test, spec)
print("SUM", scored.agg(F.sum(F.xxhash64("location", "datetime", "flood_probability") % 1000000)).first()[0])
"""


def test_same_forest_on_any_number_of_cores(small_dir):
    sums = set()
    for cores in ("2", "4"):
        run = subprocess.run(
            [sys.executable, "-c", FOREST, cores, small_dir], capture_output=True, text=True, timeout=300
        )
        sums.add(next(x for x in run.stdout.splitlines() if x.startswith("SUM")))
    assert len(sums) == 1


def test_isotonic_known_values(spark):
    df = spark.createDataFrame(
        [(0.1, 0), (0.2, 1), (0.3, 0), (0.8, 1), (None, 1), (float("nan"), 0)], "raw_score double, flood_event int"
    )
    model = fit_calibrator(df)
    points = sorted(map(tuple, model.points.collect()))
    assert points == [(0.1, 0.0), (0.2, 0.5), (0.3, 0.5), (0.8, 1.0)]
    test = spark.createDataFrame(
        [(0.0,), (0.15,), (0.25,), (0.55,), (0.9,), (None,), (float("nan"),)], "raw_score double"
    )
    for rows in (None, 0):
        got = apply_calibrator(model, test, rows).orderBy("raw_score").collect()
        values = [r.calibrated_probability for r in got]
        assert values[0] is None and values[-1] is None
        assert values[1:-1] == pytest.approx([0.0, 0.25, 0.5, 0.75, 1.0])


@pytest.mark.parametrize("shape", ["noise", "falling", "steps", "saw"])
@pytest.mark.parametrize("size", [4, 50, 250_000])
def test_pooled_in_rounds_is_the_same_fit(spark, shape, size):
    """Groups far smaller than the data, and a map joined by shuffle, give Spark's own fit."""
    rng = random.Random(11)
    n = 1200
    rate = {
        "noise": lambda x: x,
        "falling": lambda x: 1 - x,
        "steps": lambda x: (int(x * 5) % 2) * 0.6 + 0.2,
        "saw": lambda x: (x * 7) % 1,
    }[shape]
    rows = [(round(rng.random(), 3), 0) for _ in range(n)]
    rows = [(x, int(rng.random() < rate(x))) for x, _ in rows]
    df = spark.createDataFrame(rows, "raw_score double, flood_event int")
    pooled = df.groupBy("raw_score").agg(F.avg("flood_event").alias("y"), F.count("*").cast("double").alias("w"))
    known = IsotonicRegression(
        featuresCol="raw_score", labelCol="y", weightCol="w", predictionCol="known"
    ).fit(pooled)
    tests = spark.range(-20, 1020).selectExpr("id / 1000D + 0.0002D as raw_score")
    want = known.transform(tests)
    for broadcast_rows in (None, 0):
        made = apply_calibrator(fit_calibrator(df, size=size), want, broadcast_rows)
        worst = made.agg(F.max(F.abs(F.col("known") - F.col("calibrated_probability"))), F.count("known")).first()
        assert worst[0] < 1e-9 and worst[1] == 1040


def test_saved_calibrator(spark):
    df = spark.createDataFrame([(0.1, 0), (0.2, 1), (0.3, 0)], "raw_score double, flood_event int")
    model, path = fit_calibrator(df), new_path(spark, "map")
    save_calibrator(model, path)
    again = apply_calibrator(load_calibrator(spark, path), df)
    assert sorted(again.collect()) == sorted(apply_calibrator(model, df).collect())


def test_a_column_of_the_same_name_is_replaced(spark):
    df = spark.createDataFrame([(0.1, 0, "x"), (0.2, 1, "y")], "raw_score double, flood_event int, calibrated_key string")
    model = fit_calibrator(df)
    again = df.withColumn("calibrated_probability", F.lit(9.0))
    for rows in (None, 0):
        made = apply_calibrator(model, again, rows)
        assert sorted(made.columns) == sorted(again.columns)
        assert sorted((r.calibrated_key, r.calibrated_probability) for r in made.collect()) == [("x", 0.0), ("y", 1.0)]


def test_calibration_needs_rows(spark):
    with pytest.raises(ValueError):
        fit_calibrator(spark.createDataFrame([(0.5, None)], "raw_score double, flood_event int"))


def test_calibrated_scores_keep_the_order(split, model):
    raw = score_table(model, split[1], SMALL, out="raw_score")
    made = apply_calibrator(fit_calibrator(raw), raw)
    rows = sorted((r.raw_score, r.calibrated_probability) for r in made.collect())
    values = [c for _, c in rows]
    assert values == sorted(values) and 0 <= values[0] and values[-1] <= 1
    compared = {r.score: r for r in compare_scores(made, ("raw_score", "calibrated_probability")).collect()}
    # Fitted and judged on the same rows, the calibrated score cannot be the worse one.
    assert compared["calibrated_probability"].brier_score <= compared["raw_score"].brier_score


def test_nodes_of_rows_are_kept_between_levels(spark):
    """Trees are not gone through again at every level; the forest is the one without that."""
    rows = spark.range(2000).selectExpr(
        "cast(id % 37 as double) AS a", "cast(id % 11 as double) AS b", "cast(id % 37 + id % 11 > 25 as int) AS flood_event"
    ).coalesce(2)
    spec = training.FeatureSpec(numeric=("a", "b"), category=None, use_category=False, weighted=False, trees=5, depth=6)
    kept = training.build_pipeline(spec)
    forest = kept.getStages()[-1]
    assert forest.getCacheNodeIds() and forest.getCheckpointInterval() == -1
    plain = training.build_pipeline(spec)
    plain.getStages()[-1].setCacheNodeIds(False)
    assert kept.fit(rows).stages[-1].toDebugString.split("\n", 1)[1] == plain.fit(rows).stages[-1].toDebugString.split("\n", 1)[1]


def test_trees_of_many_rows_are_grown_in_groups(spark, split, monkeypatch):
    """Each group's levels hold little; all trees are there, on all rows, and vote as one forest."""
    assert training._tree_groups(100, 1_000_000) == [100]
    assert training._tree_groups(100, 4_000_000) == [25] * 4
    assert training._tree_groups(100, 24_000_000) == [10] * 10
    assert training._tree_groups(26, 4_000_000) == [13, 13]
    monkeypatch.setattr(training, "ROWS_AT_ONCE", 0)
    monkeypatch.setattr(training, "GROUP", (2, 3))
    spec = replace(SMALL, trees=7)
    grouped = fit(split[0], spec, partitions=4)
    assert [f.getNumTrees for f in grouped.forests] == [3, 2, 2]
    assert len({t.toDebugString.split("\n", 1)[1] for f in grouped.forests for t in f.trees}) == 7
    scored = score_table(grouped, split[1], spec).limit(50).collect()
    for row in scored:
        votes = [t.predictProbability(row.features) for f in grouped.forests for t in f.trees]
        mean = [sum(v[k] for v in votes) / 7 for k in (0, 1)]
        assert list(row.probability) == pytest.approx(mean)
        assert list(row.rawPrediction) == pytest.approx([7 * m for m in mean])
        assert row.flood_probability == row.probability[1]
        assert row.prediction == float(row.rawPrediction[1] > row.rawPrediction[0])
    trees = [t for f in grouped.forests for t in f.trees]
    shares = sum(t.featureImportances.toArray() for t in trees) / sum(t.depth > 0 for t in trees)
    named = {r.feature: r.importance for r in feature_importance(grouped).collect()}
    at = grouped.pipeline.stages[0].getInputCols().index("precipitation")
    assert named["precipitation"] == pytest.approx(shares[at]) and sum(named.values()) == pytest.approx(1)
    path = new_path(spark, "groups")
    save_model(grouped, path)
    assert probabilities(score_table(load_model(path), split[1], spec)) == probabilities(
        score_table(grouped, split[1], spec)
    )
    again = fit(split[0], spec, partitions=4)
    assert probabilities(score_table(again, split[1], spec)) == probabilities(score_table(grouped, split[1], spec))


def test_forests_read_rows_assembled_once(split, monkeypatch):
    """Each group of trees is given the same kept vectors, not inputs to be assembled again."""
    monkeypatch.setattr(training, "ROWS_AT_ONCE", 0)
    monkeypatch.setattr(training, "GROUP", (2, 3))
    given = []
    plain = training.RandomForestClassifier.fit

    def recorded(forest, rows, *more):
        given.append((rows, rows.storageLevel.useMemory))
        return plain(forest, rows, *more)

    monkeypatch.setattr(training.RandomForestClassifier, "fit", recorded)
    for spec in (replace(SMALL, trees=5), replace(training.UNWEIGHTED, trees=4, depth=4)):
        given.clear()
        grown = fit(split[0], spec, partitions=2)
        assert len(given) == len(grown.forests) == 2
        assert all(rows is given[0][0] and kept for rows, kept in given)
        weight = ["class_weight"] if spec.weighted else []
        assert given[0][0].columns == ["features", spec.label, *weight]
        assert [type(s).__name__ for s in grown.pipeline.stages][0] == "VectorAssembler"
