"""Splits, weights, evaluation and calibration of a deterministic score."""

from pyspark.sql import functions as F

from freshet.catalog import inputs as i
from freshet.catalog.registry import query
from freshet.functions import false_positives, with_risk_report
from freshet.operators import evaluation, stats
from freshet.operators.labeling import label_intervals
from freshet.operators.lookup import lookup
from freshet.operators.rolling import MAIN_FEATURES
from freshet.operators.topk import top_rows
from freshet.plans.calibration import apply_calibrator, compare_scores, fit_calibrator
from freshet.plans.training import location_ranks, temporal_split, with_split
from freshet.storage import stage

KEY = i.KEY
AUDITED = tuple(s.out for s in MAIN_FEATURES)
AUDIT_PLACES = {c: 6 if "avg" in c else 4 for c in AUDITED}
AUDIT_ROUNDS = i.rounds(AUDIT_PLACES)


def _split_query(name, cuts, names):
    case = "CASE " + " ".join(
        f"WHEN datetime < TIMESTAMP '{c} 00:00:00' THEN '{n}'" for c, n in zip(cuts, names)
    )
    text = (
        f"SELECT {case} ELSE '{names[-1]}' END AS split, flood_event, count(*) AS n "
        "FROM labeled GROUP BY 1, 2"
    )

    @query(name, i.on_labeled(text))
    def run(spark, sf_dir):
        rows = with_split(i.labeled(spark, sf_dir), "datetime", cuts, names)
        return stats.label_counts(rows, ("split", "flood_event"))


_split_query("temporal_split", (i.TRAIN_END,), ("train", "test"))
_split_query(
    "temporal_split3", (i.CALIBRATION_START, i.TRAIN_END), ("train", "calibration", "test")
)


def _training(spark, sf_dir):
    return temporal_split(i.labeled(spark, sf_dir), "datetime", (i.TRAIN_END,))[0]


WEIGHTS = f"""
training AS (SELECT * FROM labeled WHERE datetime < TIMESTAMP '{i.TRAIN_END} 00:00:00'),
weights AS (
  SELECT flood_event, n,
         CAST(sum(n) OVER () AS DOUBLE) / (CAST(count(*) OVER () AS DOUBLE) * n) AS class_weight
  FROM (SELECT flood_event, count(*) AS n FROM training GROUP BY flood_event))"""


@query(
    "class_weights",
    i.sql(
        "SELECT flood_event, n, round(class_weight, 6) AS class_weight FROM weights",
        i.OBS,
        i.EPISODE_ROWS,
        i.LABELED,
        WEIGHTS,
    ),
)
def class_weights(spark, sf_dir):
    return i.rounded(stats.class_weights(_training(spark, sf_dir)), {"class_weight": 6})


@query(
    "class_weight_apply",
    i.sql(
        "SELECT location, datetime, flood_event, round(class_weight, 6) AS class_weight "
        "FROM training JOIN weights USING (flood_event)",
        i.OBS,
        i.EPISODE_ROWS,
        i.LABELED,
        WEIGHTS,
    ),
)
def class_weight_apply(spark, sf_dir):
    train = _training(spark, sf_dir)
    weighted = stats.apply_weights(train, stats.class_weights(train))
    made = weighted.select("location", "datetime", "flood_event", "class_weight")
    return i.rounded(made, {"class_weight": 6})


@query(
    "location_index",
    i.on_obs(
        """
SELECT location, CAST(row_number() OVER (ORDER BY n DESC, location) - 1 AS DOUBLE)
         AS location_index, n
FROM (SELECT location, count(*) AS n FROM obs GROUP BY location)"""
    ),
)
def location_index(spark, sf_dir):
    obs = i.observations(spark, sf_dir).select("location")
    indexed = lookup(obs, location_ranks(obs), ["location"])
    return stats.label_counts(indexed, ("location", "location_index"))


@query(
    "confusion",
    i.on_scored(
        "SELECT flood_event, prediction, count(*) AS n FROM scored "
        "GROUP BY flood_event, prediction"
    ),
)
def confusion(spark, sf_dir):
    return evaluation.confusion(i.scored(spark, sf_dir)).orderBy("flood_event", "prediction")


@query(
    "confusion_loc",
    i.on_scored(
        "SELECT location, flood_event, prediction, count(*) AS n FROM scored "
        "GROUP BY location, flood_event, prediction"
    ),
)
def confusion_loc(spark, sf_dir):
    return evaluation.confusion(i.scored(spark, sf_dir), by=("location",)).orderBy(
        "location", "flood_event", "prediction"
    )


METRICS = """,
counts AS (
  SELECT CAST(count(*) FILTER (WHERE flood_event = 1 AND prediction = 1) AS DOUBLE) AS tp,
         CAST(count(*) FILTER (WHERE flood_event = 0 AND prediction = 1) AS DOUBLE) AS fp,
         CAST(count(*) FILTER (WHERE flood_event = 1 AND prediction = 0) AS DOUBLE) AS fn,
         CAST(count(*) FILTER (WHERE flood_event = 0 AND prediction = 0) AS DOUBLE) AS tn
  FROM scored),
rates AS (
  SELECT *, tp + fp + fn + tn AS n,
         CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p1,
         CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r1,
         CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE 0 END AS p0,
         CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END AS r0
  FROM counts),
f AS (
  SELECT *, CASE WHEN p1 + r1 > 0 THEN 2 * p1 * r1 / (p1 + r1) ELSE 0 END AS f1,
         CASE WHEN p0 + r0 > 0 THEN 2 * p0 * r0 / (p0 + r0) ELSE 0 END AS f0
  FROM rates)
"""


@query(
    "class_metrics",
    i.sql("", i.OBS, i.EPISODE_ROWS, i.LABELED, i.SCORED)
    + METRICS
    + """
SELECT round((tp + tn) / n, 6) AS accuracy,
       round(((tp + fn) * p1 + (tn + fp) * p0) / n, 6) AS weighted_precision,
       round(((tp + fn) * r1 + (tn + fp) * r0) / n, 6) AS weighted_recall,
       round(((tp + fn) * f1 + (tn + fp) * f0) / n, 6) AS weighted_f1,
       round(p1, 6) AS precision_1, round(r1, 6) AS recall_1, round(f1, 6) AS f1_1,
       (SELECT count(*) FROM scored) - CAST(n AS BIGINT) AS left_out
FROM f""",
)
def class_metrics(spark, sf_dir):
    made = evaluation.class_metrics(i.scored(spark, sf_dir))
    return i.rounded(made, {c: 6 for c in made.columns if c != "left_out"})


SWEEP = ", ".join(f"(CAST({t} AS DOUBLE))" for t in evaluation.THRESHOLDS)


@query(
    "threshold_sweep",
    i.on_scored(
        f"""
SELECT threshold, tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall,
       round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1
FROM (
  SELECT *, CAST(CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END AS DOUBLE)
           AS p,
         CAST(CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0 END AS DOUBLE) AS r
  FROM (
    SELECT threshold, count(*) FILTER (WHERE flood_event = 1 AND score >= threshold) AS tp,
           count(*) FILTER (WHERE flood_event = 0 AND score >= threshold) AS fp,
           count(*) FILTER (WHERE flood_event = 1 AND score < threshold) AS fn,
           count(*) FILTER (WHERE flood_event = 0 AND score < threshold) AS tn
    FROM scored, (VALUES {SWEEP}) t(threshold) GROUP BY threshold))"""
    ),
)
def threshold_sweep(spark, sf_dir):
    made = evaluation.threshold_sweep(i.scored(spark, sf_dir), "score")
    return i.rounded(made, {c: 6 for c in ("precision", "recall", "f1")})


BIN = "CASE " + " ".join(
    f"WHEN score < CAST({(k + 1) / 10} AS DOUBLE) THEN '{k / 10:.1f}-{(k + 1) / 10:.1f}'"
    for k in range(9)
) + " ELSE '0.9-1.0' END"


@query(
    "reliability_bins",
    i.on_scored(
        f"""
SELECT {BIN} AS probability_bin, count(*) AS records, round(avg(score), 6) AS average_score,
       round(avg(CAST(flood_event AS DOUBLE)), 6) AS actual_flood_rate
FROM scored WHERE score IS NOT NULL GROUP BY 1"""
    ),
)
def reliability_bins(spark, sf_dir):
    made = evaluation.reliability_table(i.scored(spark, sf_dir), "score")
    places = {"average_score": 6, "actual_flood_rate": 6}
    return i.rounded(made, places).orderBy("probability_bin")


@query(
    "brier",
    i.on_scored(
        "SELECT round(avg((score - flood_event) * (score - flood_event)), 6) AS brier_score "
        "FROM scored"
    ),
)
def brier(spark, sf_dir):
    return i.rounded(evaluation.brier(i.scored(spark, sf_dir), "score"), {"brier_score": 6})


# Curve points per distinct score, best first; {rows} has columns score and flood_event.
CURVE = """
points{tag} AS (
  SELECT score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
         sum(pos) OVER () AS p, sum(neg) OVER () AS n
  FROM (SELECT score, CAST(sum(flood_event) AS DOUBLE) AS pos,
               CAST(sum(1 - flood_event) AS DOUBLE) AS neg
        FROM {rows} GROUP BY score)
  WINDOW w AS (ORDER BY score DESC)),
curve{tag} AS (
  SELECT fp / n AS x, tp / p AS y, lag(fp / n, 1, 0) OVER w AS x0, lag(tp / p, 1, 0) OVER w AS y0,
         tp / p AS recall, tp / (tp + fp) AS prec,
         lag(tp / p, 1, 0) OVER w AS recall0,
         lag(tp / (tp + fp), 1, tp / (tp + fp)) OVER w AS prec0
  FROM points{tag} WINDOW w AS (ORDER BY score DESC))"""
ROC = "sum((x - x0) * (y + y0) / 2)"
PR = "sum((recall - recall0) * (prec + prec0) / 2)"


@query(
    "auc",
    i.on_scored(
        f"SELECT round({ROC}, 6) AS roc_auc, round({PR}, 6) AS pr_auc FROM curve",
        CURVE.format(tag="", rows="scored"),
    ),
)
def auc(spark, sf_dir):
    """Over every distinct score."""
    made = evaluation.auc(i.scored(spark, sf_dir), "score", exact=True)
    return i.rounded(made, {"roc_auc": 6, "pr_auc": 6})


# How far areas over about a thousand curve points may lie from the exact ones.
BINNED_ERROR = 0.01


@query(
    "auc_binned",
    i.on_scored(
        f"""
SELECT CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg,
       CASE WHEN count(*) // {evaluation.CURVE_BINS} >= 2
            THEN CAST(ceil(count(*) / (count(*) // {evaluation.CURVE_BINS})) AS BIGINT)
            ELSE count(*) END AS n_points,
       true AS roc_auc_close, true AS pr_auc_close
FROM (SELECT score, sum(flood_event) AS pos, sum(1 - flood_event) AS neg FROM scored
      WHERE score IS NOT NULL GROUP BY score)"""
    ),
)
def auc_binned(spark, sf_dir):
    """Over about a thousand curve points: their number, and their areas against the exact ones."""
    scored = stage(i.scored(spark, sf_dir).select("score", "flood_event"), "scored")
    binned, exact = (evaluation.auc(scored, "score", exact=exact) for exact in (False, True))
    points = evaluation.curves(scored, ["score"])
    counts = points.agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.count("*").alias("n_points")
    )
    return counts.withColumns(
        {
            f"{a}_close": F.abs(binned.select(a).scalar() - exact.select(a).scalar()) <= BINNED_ERROR
            for a in ("roc_auc", "pr_auc")
        }
    )


@query(
    "gappy_evaluation",
    i.sql(
        f"""
SELECT round({ROC}, 6) AS roc_auc, round({PR}, 6) AS pr_auc,
       (SELECT count(*) FROM scored WHERE score IS NULL) AS left_out,
       (SELECT count(*) FROM known) AS confusion_rows, (SELECT count(*) FROM known) AS sweep_rows,
       (SELECT count(*) FROM known) AS bin_rows,
       (SELECT round(avg(CASE WHEN prediction = flood_event THEN 1.0 ELSE 0.0 END), 6) FROM known)
         AS accuracy
FROM curve""",
        i.OBS,
        i.GAPPY,
        i.EPISODE_ROWS,
        i.LABELED.replace("FROM obs", "FROM gappy").replace("obs.", "gappy."),
        i.SCORED,
        "known AS (SELECT * FROM scored WHERE score IS NOT NULL)",
        CURVE.format(tag="", rows="known"),
    ),
)
def gappy_evaluation(spark, sf_dir):
    """Where scores are missing, all metrics count the same rows, and say how many they leave out."""
    rows = i.with_score(label_intervals(i.gappy_observations(spark, sf_dir), i.episodes(spark)))
    rows = stage(rows.select("location", "flood_event", "score", "prediction"), "gappy-scored")
    areas = evaluation.auc(rows, "score", exact=True)
    counted = evaluation.confusion(rows).filter("prediction is not null")
    sweep = evaluation.threshold_sweep(rows, "score").filter("threshold = 0.5")
    bins = evaluation.reliability_table(rows, "score")
    metrics = evaluation.class_metrics(rows)
    parts = {
        "left_out": metrics.select("left_out"),
        "confusion_rows": counted.agg(F.sum("n")),
        "sweep_rows": sweep.select(F.expr("tp + fp + fn + tn")),
        "bin_rows": bins.agg(F.sum("records")),
        "accuracy": metrics.select("accuracy"),
    }
    made = areas.withColumns({name: part.scalar() for name, part in parts.items()})
    return i.rounded(made, {c: 6 for c in ("roc_auc", "pr_auc", "accuracy")})


@query(
    "fp_by_loc",
    i.on_scored(
        "SELECT location, count(*) AS n FROM scored "
        "WHERE flood_event = 0 AND score >= CAST(0.9 AS DOUBLE) GROUP BY location"
    ),
)
def fp_by_loc(spark, sf_dir):
    rows = false_positives(i.scored(spark, sf_dir), "flood_event", "score", 0.9)
    return evaluation.fp_count(rows)


@query(
    "fp_audit",
    i.on_scored_features(
        f"SELECT location, datetime, flood_event, score, {AUDIT_ROUNDS} FROM scored "
        "WHERE flood_event = 0 AND score >= CAST(0.9 AS DOUBLE) "
        "ORDER BY score DESC, location, datetime LIMIT 30"
    ),
)
def fp_audit(spark, sf_dir):
    rows = false_positives(i.scored_features(spark, sf_dir), "flood_event", "score", 0.9)
    rows = rows.select("location", "datetime", "flood_event", "score", *AUDITED)
    return i.rounded(top_rows(rows, [F.desc("score"), *KEY], 30), AUDIT_PLACES)


@query(
    "top_rain_negatives",
    i.on_labeled_features(
        f"SELECT location, datetime, {AUDIT_ROUNDS} FROM labeled WHERE flood_event = 0 "
        "ORDER BY labeled.rainfall_72h DESC, location, datetime LIMIT 30"
    ),
)
def top_rain_negatives(spark, sf_dir):
    rows = i.labeled_features(spark, sf_dir).filter("flood_event = 0")
    rows = rows.select("location", "datetime", *AUDITED)
    return i.rounded(top_rows(rows, [F.desc("rainfall_72h"), *KEY], 30), AUDIT_PLACES)


# The columns of the site report, in its order.
SITE = (
    "datetime",
    "score",
    "pressure",
    "rainfall_24h",
    "rainfall_72h",
    "rainfall_7d",
    "soil_moisture",
    "soil_moisture_avg_24h",
    "temperature",
    "humidity",
)
SITE_PLACES = {c: AUDIT_PLACES[c] for c in SITE if c in AUDIT_PLACES}
SITE_COLUMNS = ", ".join([*(c for c in SITE if c not in SITE_PLACES), i.rounds(SITE_PLACES)])


@query(
    "fp_location",
    i.on_scored_features(
        f"SELECT {SITE_COLUMNS} FROM scored "
        "WHERE location = 'error' AND flood_event = 0 AND prediction = 1 "
        "ORDER BY score DESC, datetime LIMIT 20"
    ),
)
def fp_location(spark, sf_dir):
    rows = i.scored_features(spark, sf_dir)
    wrong = (F.col("location") == "error") & (F.col("flood_event") == 0) & (
        F.col("prediction") == 1
    )
    top = top_rows(rows.filter(wrong).select(*SITE), [F.desc("score"), "datetime"], 20)
    return i.rounded(top, SITE_PLACES)


@query(
    "fp_per_location",
    i.on_scored(
        """
SELECT location, datetime, score FROM (
  SELECT *, row_number() OVER (PARTITION BY location ORDER BY score DESC, datetime) AS r
  FROM scored WHERE flood_event = 0 AND prediction = 1)
WHERE r <= 20"""
    ),
)
def fp_per_location(spark, sf_dir):
    rows = i.scored(spark, sf_dir).select(
        "location", "datetime", "score", "flood_event", "prediction"
    )
    wrong = (F.col("flood_event") == 0) & (F.col("prediction") == 1)
    top = top_rows(rows, [F.desc("score"), "datetime"], 20, per="location", where=wrong)
    return top.select("location", "datetime", "score")


@query(
    "positives_location",
    i.on_scored_features(
        f"SELECT {SITE_COLUMNS} FROM scored WHERE location = 'error' AND flood_event = 1 "
        "ORDER BY scored.datetime LIMIT 20"
    ),
)
def positives_location(spark, sf_dir):
    rows = i.scored_features(spark, sf_dir)
    chosen = (F.col("location") == "error") & (F.col("flood_event") == 1)
    return i.rounded(
        top_rows(rows.filter(chosen).select(*SITE), ["datetime"], 20), SITE_PLACES
    )


@query(
    "positives_sorted",
    i.on_labeled_features(
        f"SELECT location, datetime, {AUDIT_ROUNDS} FROM labeled WHERE flood_event = 1 "
        "ORDER BY location, datetime LIMIT 100"
    ),
)
def positives_sorted(spark, sf_dir):
    rows = i.labeled_features(spark, sf_dir).filter("flood_event = 1")
    top = top_rows(rows.select("location", "datetime", *AUDITED), KEY, 100)
    return i.rounded(top, AUDIT_PLACES)


@query(
    "top_scores",
    i.on_scored(
        "SELECT location, datetime, flood_event, score FROM scored "
        "ORDER BY score DESC, location, datetime LIMIT 30"
    ),
)
def top_scores(spark, sf_dir):
    rows = i.scored(spark, sf_dir).select("location", "datetime", "flood_event", "score")
    return top_rows(rows, [F.desc("score"), *KEY], 30)


@query(
    "risk_band",
    i.on_scored(
        """
SELECT location, datetime, score, risk_percent, format('{:.1f}%', risk_percent) AS risk_text,
       CAST(least(trunc(risk_percent), 100) AS INTEGER) AS risk_progress,
       CASE WHEN risk_percent >= 70 THEN 'HIGH' WHEN risk_percent >= 40 THEN 'MEDIUM'
            ELSE 'LOW' END AS risk_level
FROM (SELECT *, score * CAST(100 AS DOUBLE) AS risk_percent FROM scored)"""
    ),
)
def risk_band(spark, sf_dir):
    rows = i.scored(spark, sf_dir).select("location", "datetime", "score")
    return with_risk_report(rows, "score")


# The best non-decreasing fit is the slope of the greatest convex curve below the running sums:
# from each of its corners the next is the later point that the smallest slope leads to.
ISOTONIC = f"""
fitting AS (
  SELECT score AS x, count(*) AS w, CAST(sum(flood_event) AS DOUBLE) AS s
  FROM scored WHERE datetime >= TIMESTAMP '{i.CALIBRATION_START} 00:00:00'
                AND datetime < TIMESTAMP '{i.TRAIN_END} 00:00:00'
  GROUP BY score HAVING score IS NOT NULL),
sums AS (
  SELECT x, CAST(sum(w) OVER o AS BIGINT) AS w, sum(s) OVER o AS s FROM fitting WINDOW o AS (ORDER BY x)),
corners(w, s, y) AS (
  SELECT CAST(0 AS BIGINT), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)
  UNION ALL
  SELECT w, s, y FROM (
    SELECT sums.w, sums.s, (sums.s - corners.s) / (sums.w - corners.w) AS y
    FROM corners JOIN sums ON sums.w > corners.w ORDER BY y, sums.w DESC LIMIT 1)),
fitted AS (SELECT x, y FROM sums ASOF JOIN corners ON sums.w <= corners.w),
test AS (
  SELECT location, datetime, score AS raw_score, flood_event FROM scored
  WHERE datetime >= TIMESTAMP '{i.TRAIN_END} 00:00:00'),
below AS (
  SELECT test.*, x AS x0, y AS y0 FROM test ASOF LEFT JOIN fitted ON raw_score >= x),
around AS (
  SELECT below.*, x AS x1, y AS y1 FROM below ASOF LEFT JOIN fitted ON raw_score <= x),
calibrated AS (
  SELECT location, datetime, raw_score, flood_event,
         round(CASE WHEN y0 IS NULL THEN y1 WHEN y1 IS NULL THEN y0 WHEN x0 = x1 THEN y0
              ELSE y0 + (y1 - y0) * (raw_score - x0) / (x1 - x0) END, 9)
           AS calibrated_probability
  FROM around)"""


def _on_calibrated(body, *more):
    return i.on_scored(body, ISOTONIC, *more).replace("WITH", "WITH RECURSIVE", 1)


def _calibrated(spark, sf_dir):
    scored = i.scored(spark, sf_dir).withColumnRenamed("score", "raw_score")
    cuts = (i.CALIBRATION_START, i.TRAIN_END)
    _, calibration, test = temporal_split(scored, "datetime", cuts)
    return apply_calibrator(fit_calibrator(calibration), test)


@query(
    "isotonic_calibrate",
    _on_calibrated(
        "SELECT location, datetime, flood_event, raw_score, "
        "round(calibrated_probability, 6) AS calibrated_probability FROM calibrated"
    ),
)
def isotonic_calibrate(spark, sf_dir):
    made = _calibrated(spark, sf_dir).select(
        "location", "datetime", "flood_event", "raw_score", "calibrated_probability"
    )
    return i.rounded(made, {"calibrated_probability": 6})


ERROR = "avg(({c} - flood_event) * ({c} - flood_event))"


@query(
    "calibration_compare",
    _on_calibrated(
        f"""
SELECT 'raw_score' AS score, (SELECT round({ERROR.format(c="raw_score")}, 6) FROM test)
         AS brier_score, (SELECT round({PR}, 6) FROM curve_raw) AS pr_auc
UNION ALL
SELECT 'calibrated_probability',
       (SELECT round({ERROR.format(c="calibrated_probability")}, 6) FROM calibrated),
       (SELECT round({PR}, 6) FROM curve_calibrated)""",
        CURVE.format(tag="_raw", rows="(SELECT raw_score AS score, flood_event FROM test)"),
        CURVE.format(
            tag="_calibrated",
            rows="(SELECT calibrated_probability AS score, flood_event FROM calibrated)",
        ),
    ),
)
def calibration_compare(spark, sf_dir):
    made = compare_scores(
        _calibrated(spark, sf_dir), ("raw_score", "calibrated_probability"), exact=True
    )
    return i.rounded(made, {"brier_score": 6, "pr_auc": 6})


@query(
    "calibrated_top",
    _on_calibrated(
        "SELECT location, datetime, raw_score, "
        "round(calibrated_probability, 6) AS calibrated_probability, flood_event "
        "FROM calibrated ORDER BY raw_score DESC, location, datetime LIMIT 20"
    ),
)
def calibrated_top(spark, sf_dir):
    rows = _calibrated(spark, sf_dir).select(
        "location", "datetime", "raw_score", "calibrated_probability", "flood_event"
    )
    top = top_rows(rows, [F.desc("raw_score"), *KEY], 20)
    return i.rounded(top, {"calibrated_probability": 6})
