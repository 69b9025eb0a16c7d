"""Evaluation of scores and predictions against a 0/1 label."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.functions import score_bin
from freshet.operators.ordered import PLACE, running

# The swept thresholds, and the usual number of curve points.
THRESHOLDS = (0.10, 0.20, 0.30, 0.40, 0.50, 0.60, 0.70, 0.80, 0.90)
CURVE_BINS = 1000


def confusion(df: DataFrame, label="flood_event", prediction="prediction", by=()) -> DataFrame:
    """Rows per label and prediction, optionally per further columns; all rows, as they are."""
    return df.groupBy(*by, label, prediction).agg(F.count("*").alias("n"))


def fp_count(df: DataFrame, by="location") -> DataFrame:
    """Rows per group, most first; meant for rows already filtered to false positives."""
    return df.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by)


def reliability_table(df: DataFrame, score: str, label="flood_event", bins=10) -> DataFrame:
    """Per score bin: rows, mean score, observed rate, of the rows that count (``left_out``)."""
    return (
        df.filter(_known(label, score))
        .groupBy(score_bin(F.col(score), bins).alias("probability_bin"))
        .agg(
            F.count("*").alias("records"),
            F.avg(score).alias("average_score"),
            F.avg(label).alias("actual_flood_rate"),
        )
    )


def squared_error(score: str, label: str):
    return F.pow(F.col(score) - F.col(label), F.lit(2.0))


def brier(df: DataFrame, score: str, label="flood_event") -> DataFrame:
    """Mean squared error of the score, over the rows that count (``left_out``)."""
    return df.filter(_known(label, score)).agg(F.avg(squared_error(score, label)).alias("brier_score"))


def _known(label, value):
    """Whether a row counts: its label is 0 or 1, and its score or prediction is a number."""
    number = F.col(value).cast("double")
    whole = number.isNotNull() & ~F.isnan(number)
    return F.coalesce(F.col(label).isin(0, 1), F.lit(False)) & whole


def left_out(df: DataFrame, value: str, label="flood_event") -> DataFrame:
    """One row: how many rows there are, and how many no metric of ``value`` counts.

    ``value`` is a score or a prediction. Those left out have a label other than 0 or 1, or no
    number in ``value``.
    """
    return df.agg(
        F.count("*").alias("n_rows"), F.count_if(~_known(label, value)).alias("left_out")
    )


def _ratio(top, bottom):
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def _f1(precision, recall):
    return _ratio(2.0 * precision * recall, precision + recall)


def threshold_sweep(
    df: DataFrame, score: str, label="flood_event", thresholds=THRESHOLDS
) -> DataFrame:
    """Confusion counts, precision, recall and F1 at ``score >= threshold``, in one pass.

    Over the rows that count (``left_out``).
    """
    df = df.filter(_known(label, score))
    is_pos, is_neg = F.col(label) == 1, F.col(label) == 0
    hits = []
    for i, t in enumerate(thresholds):
        above = F.col(score) >= F.lit(float(t))
        hits += [
            F.count_if(is_pos & above).alias(f"tp{i}"),
            F.count_if(is_neg & above).alias(f"fp{i}"),
        ]
    totals = [F.count_if(is_pos).alias("pos"), F.count_if(is_neg).alias("neg")]
    points = F.array(
        *[
            F.struct(
                F.lit(float(t)).alias("threshold"),
                F.col(f"tp{i}").alias("tp"),
                F.col(f"fp{i}").alias("fp"),
                (F.col("pos") - F.col(f"tp{i}")).alias("fn"),
                (F.col("neg") - F.col(f"fp{i}")).alias("tn"),
            )
            for i, t in enumerate(thresholds)
        ]
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return (
        df.agg(*hits, *totals)
        .select(F.inline(points))
        .withColumn("precision", _ratio(tp, tp + fp))
        .withColumn("recall", _ratio(tp, tp + fn))
        .withColumn("f1", _f1(F.col("precision"), F.col("recall")))
    )


def class_metrics(df: DataFrame, label="flood_event", prediction="prediction") -> DataFrame:
    """One row: accuracy, class-weighted and class-1 precision, recall and F1.

    All come from the four confusion counts, so the scored rows are read once. ``left_out`` rows
    have a label or prediction other than 0 and 1 and are in none of the four. Where all are left
    out, every metric is 0.
    """
    pairs = {"tp": (1, 1), "fp": (0, 1), "fn": (1, 0), "tn": (0, 0)}
    counts = df.agg(
        *[
            F.count_if((F.col(label) == y) & (F.col(prediction) == p)).alias(name)
            for name, (y, p) in pairs.items()
        ],
        F.count("*").alias("rows"),
    )
    tp, fp, fn, tn = (F.col(c) for c in pairs)
    n = tp + fp + fn + tn
    per_class = {
        "pos": (tp + fn, _ratio(tp, tp + fp), _ratio(tp, tp + fn)),
        "neg": (tn + fp, _ratio(tn, tn + fn), _ratio(tn, tn + fp)),
    }

    def weighted(metric):
        return _ratio(sum(size * metric(p, r) for size, p, r in per_class.values()), n)

    _, precision, recall = per_class["pos"]
    return counts.select(
        _ratio(tp + tn, n).alias("accuracy"),
        weighted(lambda p, r: p).alias("weighted_precision"),
        weighted(lambda p, r: r).alias("weighted_recall"),
        weighted(_f1).alias("weighted_f1"),
        precision.alias("precision_1"),
        recall.alias("recall_1"),
        _f1(precision, recall).alias("f1_1"),
        (F.col("rows") - n).alias("left_out"),
    )


def curves(df: DataFrame, scores, label="flood_event", exact=False) -> DataFrame:
    """Points of the curves of several score columns, best score first: name, score, pos, neg, tp,
    fp, n_pos, n_neg.

    A point is a distinct score: pos and neg rows have it, tp and fp rows have it or a higher one,
    of n_pos and n_neg in all. Over the rows that count for that score (``left_out``). There are
    about a thousand points a column, each of as many neighbouring scores; ``exact`` keeps every
    distinct score. All columns share one pass over ``df``, one shuffle by score and one sort.
    """
    each = F.array(
        *(
            F.struct(F.lit(s).alias("name"), F.when(_known(label, s), F.col(s).cast("double")).alias("score"))
            for s in scores
        )
    )
    counts = (
        df.select(F.col(label).alias("label"), F.explode(each).alias("each"))
        .select("label", "each.*")
        .filter("score is not null")
        .groupBy("name", "score")
        .agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    )
    placed = running(counts, ["name", F.desc("score")], ["pos", "neg"], "score-counts")
    # A row per column asked for.
    spans = placed.groupBy("name").agg(
        F.min(PLACE).alias("first"),
        F.count("*").alias("n"),
        F.sum("pos").alias("n_pos"),
        F.sum("neg").alias("n_neg"),
        F.min(F.col("pos_to") - F.col("pos")).alias("pos_before"),
        F.min(F.col("neg_to") - F.col("neg")).alias("neg_before"),
    )
    points = placed.join(F.broadcast(spans), "name").select(
        "name",
        "score",
        "pos",
        "neg",
        (F.col("pos_to") - F.col("pos_before")).alias("tp"),
        (F.col("neg_to") - F.col("neg_before")).alias("fp"),
        "n_pos",
        "n_neg",
        (F.col(PLACE) - F.col("first")).alias("k"),
        F.expr(f"n div {CURVE_BINS}").alias("width"),
    )
    if exact:
        return points.drop("k", "width")
    merged = F.when(F.col("width") >= 2, F.expr("k div width")).otherwise(F.col("k"))
    return (
        points.groupBy("name", merged.alias("k"), "n_pos", "n_neg")
        .agg(
            F.min("score").alias("score"),
            F.sum("pos").alias("pos"),
            F.sum("neg").alias("neg"),
            F.max("tp").alias("tp"),
            F.max("fp").alias("fp"),
        )
        .select("name", "score", "pos", "neg", "tp", "fp", "n_pos", "n_neg")
    )


def areas(df: DataFrame, scores, label="flood_event", exact=False) -> DataFrame:
    """One row per score column: name, roc_auc, pr_auc; both null where no row counts.

    Each point knows the counts before it, so both areas are one sum over the points. Where one
    class has no row its rate is 0 throughout: without negative rows the area under the ROC curve
    is 1, without positive rows both areas are 0.
    """
    tp, fp = F.col("tp"), F.col("fp")
    tp0, fp0 = tp - F.col("pos"), fp - F.col("neg")
    precision = _ratio(tp, tp + fp)
    before = F.when(tp0 + fp0 > 0, _ratio(tp0, tp0 + fp0)).otherwise(precision)
    roc = _ratio(F.col("neg"), F.col("n_neg")) * _ratio(tp + tp0, F.col("n_pos")) / 2
    pr = _ratio(F.col("pos"), F.col("n_pos")) * (precision + before) / 2
    made = (
        curves(df, scores, label, exact)
        .groupBy("name")
        .agg(F.when(F.max("n_neg") == 0, F.lit(1.0)).otherwise(F.sum(roc)).alias("roc_auc"), F.sum(pr).alias("pr_auc"))
    )
    names = df.sparkSession.createDataFrame([(s,) for s in scores], "name string")
    return names.join(F.broadcast(made), "name", "left")


def auc(df: DataFrame, score: str, label="flood_event", exact=False) -> DataFrame:
    """One row: both areas of one score; see ``areas``. ``df`` is read once."""
    return areas(df, [score], label, exact).select("roc_auc", "pr_auc")
