"""Metrics against Spark's own evaluators and against counting by hand."""

import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from freshet.operators import evaluation, ordered
from freshet.operators.topk import top_rows
from freshet.plans.calibration import compare_scores
from freshet.storage import stage


def frame(spark, rows):
    return spark.createDataFrame(rows, "score double, flood_event int").withColumn(
        "prediction", (F.col("score") >= 0.5).cast("double")
    )


@pytest.fixture(scope="module")
def scores(spark):
    rng = random.Random(3)
    rows = [(round(rng.random(), 3), int(rng.random() < 0.2)) for _ in range(3000)]
    return frame(spark, rows).cache()


def test_metrics_equal_evaluators(scores):
    got = evaluation.class_metrics(scores).first().asDict()
    names = {
        "accuracy": "accuracy",
        "weighted_precision": "weightedPrecision",
        "weighted_recall": "weightedRecall",
        "weighted_f1": "f1",
        "precision_1": "precisionByLabel",
        "recall_1": "recallByLabel",
        "f1_1": "fMeasureByLabel",
    }
    for name, metric in names.items():
        evaluator = MulticlassClassificationEvaluator(
            labelCol="flood_event", metricName=metric, metricLabel=1.0
        )
        assert got[name] == pytest.approx(evaluator.evaluate(scores), abs=1e-12), name


@pytest.mark.parametrize("exact", [True, False])
def test_areas_equal_evaluator_on_rows(scores, exact):
    got = evaluation.auc(scores, "score", exact=exact).first()
    for value, metric in ((got.roc_auc, "areaUnderROC"), (got.pr_auc, "areaUnderPR")):
        evaluator = BinaryClassificationEvaluator(
            labelCol="flood_event",
            rawPredictionCol="score",
            metricName=metric,
            numBins=0 if exact else 1000,
        )
        assert value == pytest.approx(evaluator.evaluate(scores), abs=1e-12)


def test_exact_area_is_the_rank_sum(scores):
    rows = scores.select("score", "flood_event").collect()
    pos = [r.score for r in rows if r.flood_event]
    neg = [r.score for r in rows if not r.flood_event]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    got = evaluation.auc(scores, "score", exact=True).first().roc_auc
    assert got == pytest.approx(wins / len(pos) / len(neg), abs=1e-12)


@pytest.mark.parametrize("rows", [[(0.2, 1), (0.7, 1)], [(0.2, 0), (0.7, 0), (0.7, 0)]])
def test_areas_of_one_class_equal_evaluator(spark, rows):
    df = frame(spark, rows)
    got = evaluation.auc(df, "score", exact=True).first()
    for value, metric in ((got.roc_auc, "areaUnderROC"), (got.pr_auc, "areaUnderPR")):
        evaluator = BinaryClassificationEvaluator(
            labelCol="flood_event", rawPredictionCol="score", metricName=metric, numBins=0
        )
        assert value == pytest.approx(evaluator.evaluate(df)), metric


def test_areas_of_many_points_are_close(spark):
    rng = random.Random(4)
    df = frame(spark, [(x := rng.random(), int(rng.random() < x * x)) for _ in range(9000)])
    exact, binned = (evaluation.auc(df, "score", exact=e).first() for e in (True, False))
    assert 1000 <= evaluation.curves(df, ["score"]).count() < 2000
    assert binned.roc_auc == pytest.approx(exact.roc_auc, abs=1e-4)
    assert binned.pr_auc == pytest.approx(exact.pr_auc, abs=1e-2)


def test_several_scores_share_one_sort(spark, scores, monkeypatch):
    plans = []

    def stored(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return df.sparkSession.createDataFrame(df.collect(), df.schema)

    df = scores.withColumn("other", 1 - F.col("score")).withColumn("none", F.lit(None).cast("double"))
    want = {s: tuple(evaluation.auc(df, s, exact=True).first()) for s in ("score", "other", "none")}
    monkeypatch.setattr(ordered, "stage", stored)
    got = {r["name"]: (r.roc_auc, r.pr_auc) for r in evaluation.areas(df, list(want), exact=True).collect()}
    assert got.pop("none") == (None, None)
    for name, both in got.items():
        assert both == pytest.approx(want[name])
    assert want["none"] == (None, None) and want["other"][0] == pytest.approx(1 - want["score"][0])
    assert len(plans) == 1 and plans[0].count("RepartitionByExpression") == plans[0].count("Sort [") == 1


def test_running_totals(spark):
    rng = random.Random(5)
    rows = [(k, rng.randrange(-5, 9), rng.random(), None if k % 7 == 0 else k) for k in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, a int, x double, n long").repartition(7)
    got = sorted((r.place, r.id, r.a_to, r.x_to, r.n_to) for r in ordered.running(df, [F.desc("id")], ["a", "x", "n"]).collect())
    a = x = n = 0
    for place, (row, r) in enumerate(zip(got, sorted(rows, reverse=True)), 1):
        a, x, n = a + r[1], x + r[2], n + (r[3] or 0)
        assert row[:3] == (place, r[0], a) and row[3] == pytest.approx(x) and row[4] == n
    assert ordered.running(df.limit(0), ["id"], ["a"]).count() == 0


def test_nothing_counts(spark):
    """A period without rows, or with scores alone that are none: no crash, and stated results."""
    empty = frame(spark, [])
    unscored = frame(spark, [(None, 1), (float("nan"), 0)]).withColumn("prediction", F.lit(None).cast("double"))
    for df in (empty, unscored):
        metrics = evaluation.class_metrics(df).first().asDict()
        assert metrics.pop("left_out") == df.count() and set(metrics.values()) == {0.0}
        assert tuple(evaluation.auc(df, "score").first()) == (None, None)
        assert evaluation.reliability_table(df, "score").count() == 0
        compared = compare_scores(df.withColumn("other", F.col("score")), ("score", "other")).collect()
        assert sorted(map(tuple, compared)) == [("other", None, None), ("score", None, None)]
    one = frame(spark, [(0.4, 1), (0.6, 1)])
    assert evaluation.class_metrics(one).first().accuracy == 0.5


def test_sweep(spark):
    rows = [(k / 10, y) for k in range(11) for y in (0, 1)] + [(None, 1), (0.95, 0)]
    got = {r.threshold: r for r in evaluation.threshold_sweep(frame(spark, rows), "score").collect()}
    assert sorted(got) == list(evaluation.THRESHOLDS)
    for t, r in got.items():
        known = [(s, y) for s, y in rows if s is not None]
        tp = sum(s >= t and y == 1 for s, y in known)
        fp = sum(s >= t and y == 0 for s, y in known)
        fn, tn = 11 - tp, 12 - fp
        assert (r.tp, r.fp, r.fn, r.tn) == (tp, fp, fn, tn)
        assert r.precision == pytest.approx(tp / (tp + fp))
        assert r.recall == pytest.approx(tp / (tp + fn))


def test_empty_denominators_are_zero(spark):
    df = frame(spark, [(0.05, 0), (0.05, 0)])
    last = evaluation.threshold_sweep(df, "score").orderBy(F.desc("threshold")).first()
    assert (last.precision, last.recall, last.f1, last.tn) == (0.0, 0.0, 0.0, 2)
    metrics = evaluation.class_metrics(df).first()
    assert metrics.accuracy == 1.0 and metrics.f1_1 == 0.0 and metrics.weighted_f1 == 1.0


def test_bins(spark):
    rows = [(k / 10, 1) for k in range(11)] + [(0.0999, 0), (0.2999999999999999, 0), (None, 1)]
    made = evaluation.reliability_table(frame(spark, rows), "score").collect()
    got = {r.probability_bin: r.records for r in made}
    names = [f"{k / 10:.1f}-{(k + 1) / 10:.1f}" for k in range(10)]
    want = dict.fromkeys(names, 1)
    want["0.9-1.0"] += 1
    want["0.0-0.1"] += 1
    want["0.2-0.3"] += 1
    assert got == want


def test_brier(spark):
    got = evaluation.brier(frame(spark, [(0.5, 1), (0.1, 0)]), "score").first().brier_score
    assert got == pytest.approx((0.25 + 0.01) / 2)


@pytest.mark.parametrize("k", [3, 1500])
def test_top_rows_per_group(spark, k):
    df = spark.range(9000).select(
        F.when(F.col("id") < 8000, "hot").otherwise("cold").alias("location"),
        F.col("id"),
        (F.col("id") * 7919 % 4001).alias("v"),
    )
    got = top_rows(df, [F.desc("v"), "id"], k, per="location")
    assert got.columns == ["location", "id", "v"]
    rows = df.collect()
    for where in ("hot", "cold"):
        mine = sorted((r for r in rows if r.location == where), key=lambda r: (-r.v, r.id))[:k]
        assert sorted(r.id for r in mine) == sorted(
            r.id for r in got.filter(F.col("location") == where).collect()
        )


def test_a_hot_group_of_any_rank_is_ranked_in_ranges(spark, monkeypatch):
    """100,000 first rows of one group: exact, and no task above twice the stated number of rows."""
    df = spark.range(300_000).select(
        F.when(F.col("id") % 10 < 8, "hot").when(F.col("id") % 10 < 9, "cold").alias("location"),
        (F.col("id") * 7919 % 300_007).alias("v"),
        F.create_map(F.lit("k"), F.col("id")).alias("place"),
    )
    parts = []

    def stored(made, name):
        out = stage(made, name)
        if name == "ranked":
            parts.extend(r["count"] for r in out.groupBy("_part").count().collect())
        return out

    monkeypatch.setattr(ordered, "stage", stored)
    got = top_rows(df, [F.desc("v")], 100_000, per="location", rows_per_task=20_000)
    assert got.columns == df.columns
    made = got.groupBy("location").agg(F.count("*").alias("n"), F.min("v").alias("least")).collect()
    for row in made:
        mine = df.filter(F.col("location").eqNullSafe(F.lit(row.location)))
        n = mine.count()
        want = mine.orderBy(F.desc("v")).limit(100_000).agg(F.min("v")).first()[0]
        assert (row.n, row.least) == (min(n, 100_000), want)
    assert {r.location for r in made} == {"hot", "cold", None}
    assert len(parts) >= 15 and max(parts) <= 40_000


def test_top_rows_overall(spark):
    df = spark.range(100)
    assert [r.id for r in top_rows(df, [F.desc("id")], 2, where=F.col("id") < 50).collect()] == [49, 48]


def test_fp_count_order(spark):
    df = spark.createDataFrame([("b",), ("b",), ("c",), ("a",)], "location string")
    assert [tuple(r) for r in evaluation.fp_count(df).collect()] == [("b", 2), ("a", 1), ("c", 1)]


def test_one_rule_for_missing_scores_and_labels(spark):
    rows = [(0.9, 1), (0.2, 0), (0.7, 0), (0.4, 1), (None, 1), (0.5, None), (0.8, 2), (float("nan"), 0)]
    df = frame(spark, rows)
    clean = frame(spark, rows[:4])
    assert tuple(evaluation.left_out(df, "score").first()) == (8, 4)
    assert evaluation.auc(df, "score", exact=True).first() == evaluation.auc(clean, "score", exact=True).first()
    assert evaluation.brier(df, "score").first() == evaluation.brier(clean, "score").first()
    by = "threshold"
    assert evaluation.threshold_sweep(df, "score").orderBy(by).collect() == (
        evaluation.threshold_sweep(clean, "score").orderBy(by).collect()
    )
    by = "probability_bin"
    assert evaluation.reliability_table(df, "score").orderBy(by).collect() == (
        evaluation.reliability_table(clean, "score").orderBy(by).collect()
    )
    nothing = df.filter("score is null")
    assert tuple(evaluation.auc(nothing, "score").first()) == (None, None)
    metrics = evaluation.class_metrics(df).first()
    # A prediction counts where it is 0 or 1 and the label is too.
    assert metrics.left_out == df.filter("prediction is null or flood_event is null or flood_event = 2").count()
