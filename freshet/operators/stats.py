"""Counts and statistics of labelled rows. Each function is one aggregation."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freshet.functions import month_of

STATISTICS = {"avg": F.avg, "stddev": F.stddev, "max": F.max, "min": F.min}


def _columns(by):
    return [F.col(c) if isinstance(c, str) else c for c in by]


def label_counts(df: DataFrame, by=("flood_event",)) -> DataFrame:
    """Rows per group; ``by`` may hold expressions."""
    return df.groupBy(*_columns(by)).agg(F.count("*").alias("n"))


def class_weights(train: DataFrame, label="flood_event", n=None) -> DataFrame:
    """Per class: its count and the balanced weight N / (K * count).

    ``n`` names a column of counts, where a row stands for several.
    """
    rows = F.count("*") if n is None else F.sum(n)
    counts = train.groupBy(label).agg(rows.alias("n"))
    # One row per class here, so a single partition is right.
    everything = Window.partitionBy(F.lit(0))
    total, classes = F.sum("n").over(everything), F.count("*").over(everything)
    return counts.withColumn("class_weight", total / (classes * F.col("n")))


def apply_weights(df: DataFrame, weights: DataFrame, label="flood_event", out="class_weight"):
    """Add the weight of class 1 to positives and that of class 0 to all other rows."""

    def weight_of(value):
        return F.max(F.when(F.col(label) == value, F.col("class_weight")))

    # One row, looked up once: both classes come from the same subquery.
    pair = weights.agg(F.struct(weight_of(0).alias("other"), weight_of(1).alias("one"))).scalar()
    chosen = F.when(F.col(label) == 1, pair.getField("one")).otherwise(pair.getField("other"))
    return df.withColumn(out, chosen)


def class_stats(df: DataFrame, cols, by=("flood_event",), fns=("avg",)) -> DataFrame:
    """``<col>_<fn>`` per group, for every column and statistic."""
    return df.groupBy(*_columns(by)).agg(
        *[STATISTICS[fn](c).alias(f"{c}_{fn}") for fn in fns for c in cols]
    )


def monthly_rate(df: DataFrame, ts="datetime", label="flood_event") -> DataFrame:
    """Rows, positives and their ratio per calendar month."""
    return (
        df.groupBy(month_of(ts).alias("month"))
        .agg(F.count("*").alias("total_records"), F.sum(label).alias("flood_records"))
        .withColumn("flood_rate", F.col("flood_records") / F.col("total_records"))
    )


def label_correlation(df: DataFrame, cols, label="flood_event", nulls="zero") -> DataFrame:
    """Pearson correlation of each column with the label, as rows.

    ``nulls="zero"`` counts a null as 0.0, as ``DataFrame.stat.corr`` does; ``"skip"`` leaves
    the pair out, as the ``corr`` aggregate does.
    """
    if nulls not in ("zero", "skip"):
        raise ValueError(f"nulls must be 'zero' or 'skip', not {nulls!r}")

    def value(c):
        number = F.col(c).cast("double")
        return F.coalesce(number, F.lit(0.0)) if nulls == "zero" else number

    wide = df.agg(*[F.corr(value(c), value(label)).alias(c) for c in cols])
    return wide.unpivot([], list(cols), "feature", "correlation")
