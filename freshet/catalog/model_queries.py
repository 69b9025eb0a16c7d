"""Random forests: fitted on the first part of the period, applied to the last."""

from functools import reduce

from pyspark.sql import functions as F

from freshet.catalog import inputs as i
from freshet.catalog.registry import query
from freshet.functions import false_positives
from freshet.operators import evaluation
from freshet.operators.ordered import running
from freshet.operators.rolling import FEATURES_48H
from freshet.operators.topk import top_rows
from freshet.plans import training
from freshet.plans.calibration import apply_calibrator, compare_scores, fit_calibrator
from freshet.plans.forests import fit_together
from freshet.plans.scoring import dropped_rows, score_table
from freshet.plans.training import feature_importance, fit, model_rows, temporal_split
from freshet.sources import load_model, save_model
from freshet.storage import new_path, stage

VARIANTS = {
    "main": training.MAIN,
    "48h": training.WITH_48H,
    "no_location": training.NO_LOCATION,
    "seasonal": training.SEASONAL,
}
SHOWN = ("location", "datetime", "flood_event", "prediction", "flood_probability")


def _rows(spark, sf_dir):
    """Labelled features, kept once: fitting and scoring both read them."""
    return stage(i.labeled_features(spark, sf_dir, FEATURES_48H), "labeled")


def _split(spark, sf_dir):
    return temporal_split(_rows(spark, sf_dir), "datetime", (i.TRAIN_END,))


TEST = f"datetime >= TIMESTAMP '{i.TRAIN_END} 00:00:00'"


def _is_probability(column):
    return F.coalesce(F.col(column).between(0.0, 1.0), F.lit(False))


def _checked(scored, *more):
    """Rows and what must hold of their scores, whatever the trees are."""
    agrees = F.col("prediction") == (F.col("flood_probability") > 0.5).cast("double")
    return scored.select(
        "location",
        "datetime",
        "flood_event",
        _is_probability("flood_probability").alias("is_probability"),
        agrees.alias("prediction_agrees"),
        *more,
    )


def _checked_sql(more="", tail=""):
    return i.on_labeled(
        "SELECT location, datetime, flood_event, true AS is_probability, "
        f"true AS prediction_agrees{more} FROM labeled WHERE {TEST} {tail}"
    )


@query("rf_score", _checked_sql(", true AS level_agrees, true AS text_agrees"))
def rf_score(spark, sf_dir):
    """Every scored row: its score is a probability, and prediction, band and text follow from it."""
    train, test = _split(spark, sf_dir)
    scored = stage(
        score_table(fit(train), test, report=True).select(*SHOWN, "risk_text", "risk_level"), "scored"
    )
    percent = F.col("flood_probability") * 100
    level = F.when(percent >= 70, "HIGH").when(percent >= 40, "MEDIUM").otherwise("LOW")
    shown = F.regexp_extract("risk_text", r"^([0-9]+\.[0-9])%$", 1).try_cast("double")
    return _checked(
        scored,
        (F.col("risk_level") == level).alias("level_agrees"),
        F.coalesce(F.abs(shown - percent) <= 0.0500001, F.lit(False)).alias("text_agrees"),
    )


@query("rf_sample", _checked_sql(tail="ORDER BY location, datetime LIMIT 20"))
def rf_sample(spark, sf_dir):
    """The first twenty scored rows, by location and time: chosen before they are scored."""
    train, test = _split(spark, sf_dir)
    chosen = top_rows(model_rows(test, training.MAIN, labelled=False), i.KEY, 20)
    return _checked(score_table(fit(train), chosen))


@query("rf_unweighted", _checked_sql())
def rf_unweighted(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    spec = training.UNWEIGHTED
    return _checked(score_table(fit(train, spec), test, spec))


@query(
    "rf_variants",
    i.on_labeled(
        "SELECT variant, (SELECT count(*) FROM labeled WHERE " + TEST + ") AS n_rows, "
        "CAST(0 AS BIGINT) AS left_out, true AS in_range FROM (VALUES "
        + ", ".join(f"('{name}')" for name in VARIANTS)
        + ") t(variant)"
    ),
)
def rf_variants(spark, sf_dir):
    """Metrics of each feature set, one row per set: all rows count, all metrics lie in 0 to 1."""
    train, test = _split(spark, sf_dir)
    models = fit_together(train, VARIANTS)
    reports = []
    for name, spec in VARIANTS.items():
        scored = stage(score_table(models[name], test, spec).select(*SHOWN), "scored")
        areas = evaluation.auc(scored, "flood_probability")
        metrics = evaluation.class_metrics(scored).withColumns(
            {c: areas.select(c).scalar() for c in areas.columns}
        )
        measured = [c for c in metrics.columns if c != "left_out"]
        in_range = reduce(lambda a, b: a & b, [_is_probability(c) for c in measured])
        n_rows = scored.agg(F.count("*")).scalar()
        reports.append(
            metrics.select(
                F.lit(name).alias("variant"), n_rows.alias("n_rows"), "left_out", in_range.alias("in_range")
            )
        )
    return reduce(lambda a, b: a.unionByName(b), reports)


@query(
    "rf_importance",
    i.on_obs(
        "SELECT feature, CAST(1 AS DOUBLE) AS total, true AS is_share, "
        f"(SELECT count(*) FROM obs WHERE datetime < TIMESTAMP '{i.TRAIN_END} 00:00:00') AS n_train "
        "FROM (VALUES " + ", ".join(f"('{name}')" for name in training.MAIN.inputs) + ") t(feature)"
    ),
)
def rf_importance(spark, sf_dir):
    """Each of the model's inputs once; importances are shares that sum to 1."""
    train = _split(spark, sf_dir)[0]
    made = feature_importance(fit(train))
    total = made.agg(F.round(F.sum("importance"), 9)).scalar()
    return made.select(
        "feature",
        total.alias("total"),
        _is_probability("importance").alias("is_share"),
        train.agg(F.count("*")).scalar().alias("n_train"),
    )


@query(
    "rf_repeated",
    i.on_obs(f"SELECT count(*) AS n_rows, count(*) AS n_equal FROM obs WHERE {TEST}"),
)
def rf_repeated(spark, sf_dir):
    """Rows scored by two forests fitted alike on a stated number of partitions: equal scores."""
    train, test = _split(spark, sf_dir)
    spec = training.replace(training.MAIN, trees=20)
    first = score_table(fit(train, spec, 8), test, spec, out="first").select(*test.columns, "first")
    both = score_table(fit(train, spec, 8), first, spec, out="second")
    return both.agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("first") == F.col("second")).alias("n_equal")
    )


SWEPT = ", ".join(f"('{t}')" for t in evaluation.THRESHOLDS)


@query(
    "rf_evaluation",
    i.on_labeled(
        f"""
SELECT 'sweep' AS part, t.item, count(*) AS n_rows, CAST(sum(flood_event) AS BIGINT) AS positives
FROM labeled, (VALUES {SWEPT}) t(item) WHERE {TEST} GROUP BY t.item
UNION ALL SELECT 'reliability', 'all', count(*), CAST(sum(flood_event) AS BIGINT)
FROM labeled WHERE {TEST}
UNION ALL SELECT 'confusion', location, count(*), CAST(sum(flood_event) AS BIGINT)
FROM labeled WHERE {TEST} GROUP BY location
UNION ALL SELECT 'audit', 'all', 0, 0
UNION ALL SELECT 'top', 'all', 30, 1
UNION ALL SELECT 'brier', 'all', 1, 1"""
    ),
)
def rf_evaluation(spark, sf_dir):
    """A saved forest, loaded, through the whole evaluation, from one stored scored table.

    What must hold of each part: a sweep's four counts and the bins cover all rows and positives,
    as the confusion by location does; the audit lists as many false positives as the sweep
    counts (0: no difference); the top scores are ordered; Brier is the mean of squared errors.
    """
    train, test = _split(spark, sf_dir)
    path = new_path(spark, "forest")
    save_model(fit(train), path)
    score = "flood_probability"
    scored = stage(score_table(load_model(path), test).select(*SHOWN), "scored")
    sweep = stage(evaluation.threshold_sweep(scored, score), "sweep")
    bins = evaluation.reliability_table(scored, score)
    by_place = evaluation.confusion(scored, by=("location",))
    wrong = false_positives(scored, "flood_event", score, 0.5).agg(F.count("*")).scalar()
    counted = sweep.filter("threshold = 0.5").select("fp").scalar()
    top = top_rows(scored, [F.desc(score), *i.KEY], 30).agg(
        F.count("*").alias("n"), F.min(score).alias("least")
    )
    above = scored.filter(F.col(score) > top.select("least").scalar()).agg(F.count("*")).scalar()
    brier = evaluation.brier(scored, score).select("brier_score").scalar()
    error = scored.agg(F.avg((F.col(score) - F.col("flood_event")) ** 2)).scalar()

    def rows(df, part, item, n_rows, positives):
        return df.select(
            F.lit(part).alias("part"),
            item.alias("item"),
            n_rows.cast("bigint").alias("n_rows"),
            positives.cast("bigint").alias("positives"),
        )

    all_rows = F.lit("all")
    one = spark.range(1)
    positives = F.sum(F.col("n") * F.col("flood_event"))
    places = by_place.groupBy("location").agg(F.sum("n").alias("n"), positives.alias("positives"))
    whole = bins.agg(
        F.sum("records").alias("n"),
        F.round(F.sum(F.col("records") * F.col("actual_flood_rate"))).alias("positives"),
    )
    return reduce(
        lambda a, b: a.unionByName(b),
        [
            rows(sweep, "sweep", F.format_string("%.1f", "threshold"), F.expr("tp + fp + fn + tn"), F.expr("tp + fn")),
            rows(whole, "reliability", all_rows, F.col("n"), F.col("positives")),
            rows(places, "confusion", F.col("location"), F.col("n"), F.col("positives")),
            rows(one, "audit", all_rows, wrong - counted, F.lit(0)),
            rows(top, "top", all_rows, F.col("n"), (above < 30).cast("int")),
            rows(one, "brier", all_rows, (F.abs(brier - error) < 1e-9).cast("int"), brier.between(0, 1).cast("int")),
        ],
    )


@query(
    "rf_roundtrip",
    i.on_obs(
        f"SELECT count(*) AS n_rows, count(*) AS n_equal FROM obs "
        f"WHERE datetime >= TIMESTAMP '{i.TRAIN_END} 00:00:00'"
    ),
)
def rf_roundtrip(spark, sf_dir):
    """Rows scored by a model and by the same model saved and loaded again, and equal scores."""
    train, test = _split(spark, sf_dir)
    model, path = fit(train), new_path(spark, "forest")
    save_model(model, path)
    before = score_table(model, test, out="before").select(*test.columns, "before")
    both = score_table(load_model(path), before, out="after")
    return both.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("before") == F.col("after")).alias("n_equal"),
    )


@query(
    "rf_calibrated",
    i.on_labeled(
        "SELECT score, true AS in_range, true AS keeps_order, "
        f"(SELECT count(*) FROM labeled WHERE {TEST}) AS n_rows "
        "FROM (VALUES ('raw_score'), ('calibrated_probability')) t(score)"
    ),
)
def rf_calibrated(spark, sf_dir):
    """Raw against calibrated scores of a forest: three periods, none used twice.

    Each score's Brier score and area lie in 0 to 1, and a higher raw score never has a lower
    calibrated one."""
    cuts = (i.CALIBRATION_START, i.TRAIN_END)
    train, calibration, test = temporal_split(_rows(spark, sf_dir), "datetime", cuts)
    model = fit(train)
    calibrator = fit_calibrator(score_table(model, calibration, out="raw_score"))
    scored = apply_calibrator(calibrator, score_table(model, test, out="raw_score"))
    kept = stage(scored.select("raw_score", "calibrated_probability", "flood_event"), "calibrated")
    made = compare_scores(kept, ("raw_score", "calibrated_probability"))
    in_range = _is_probability("brier_score") & _is_probability("pr_auc")
    points = kept.groupBy("raw_score").agg(
        F.min("calibrated_probability").alias("low"), F.max("calibrated_probability").alias("high")
    )
    placed = running(points, ["raw_score"], name="calibrated-order")
    after = placed.select((F.col("place") - 1).alias("place"), F.col("low").alias("next"))
    falls = placed.join(after, "place").filter((F.col("high") > F.col("next") + 1e-12) | (F.col("low") != F.col("high")))
    return made.select(
        "score",
        in_range.alias("in_range"),
        (falls.agg(F.count("*")).scalar() == 0).alias("keeps_order"),
        kept.agg(F.count("*")).scalar().alias("n_rows"),
    )


@query(
    "rf_dropped",
    i.sql(
        "SELECT count(*) AS n_rows, "
        "count(*) FILTER (WHERE precipitation IS NULL OR isnan(humidity)) AS n_dropped FROM gappy",
        i.OBS,
        i.GAPPY,
    ),
)
def rf_dropped(spark, sf_dir):
    """How many rows scoring leaves out for missing inputs."""
    spec = training.replace(training.NO_LOCATION, numeric=training.MEASURES)
    return dropped_rows(i.gappy_observations(spark, sf_dir), spec)
