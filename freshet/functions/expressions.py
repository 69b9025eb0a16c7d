"""Scalar expressions and row filters. Everything here stays inside generated code."""

from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Band limits in percent, and pi to the digits the features were built with.
HIGH_PERCENT = 70
MEDIUM_PERCENT = 40
PI = 3.141592653589793


def complete_cases(df: DataFrame, cols) -> DataFrame:
    """Rows with neither null nor NaN in ``cols``."""
    return df.dropna(subset=list(cols))


def is_complete(df: DataFrame, cols) -> Column:
    """Whether a row has neither null nor NaN in ``cols``: the rows that ``complete_cases`` keeps."""

    def has(field):
        number = isinstance(field.dataType, (T.FloatType, T.DoubleType))
        return F.col(field.name).isNotNull() & (~F.isnan(field.name) if number else F.lit(True))

    return reduce(lambda a, b: a & b, map(has, df.select(*cols).schema))


def between_times(df: DataFrame, ts: str, start=None, end=None) -> DataFrame:
    """Rows with ``start <= ts < end``; either bound may be left out."""
    kind = df.schema[ts].dataType
    if start is not None:
        df = df.filter(F.col(ts) >= F.lit(start).cast(kind))
    if end is not None:
        df = df.filter(F.col(ts) < F.lit(end).cast(kind))
    return df


def false_positives(df: DataFrame, label: str, score: str, cutoff: float) -> DataFrame:
    """Negatives scored at ``cutoff`` or above."""
    return df.filter((F.col(label) == 0) & (F.col(score) >= F.lit(float(cutoff))))


def month_of(ts: str) -> Column:
    return F.month(F.col(ts))


def add_month_cycle(df: DataFrame, ts: str = "datetime") -> DataFrame:
    """Add ``month`` and its position on the yearly circle."""
    angle = F.lit(2 * PI) * F.col("month") / F.lit(12)
    return (
        df.withColumn("month", month_of(ts))
        .withColumn("month_sin", F.sin(angle))
        .withColumn("month_cos", F.cos(angle))
    )


def positive_score(df: DataFrame, vector: str = "probability", out: str = "score") -> DataFrame:
    """Class-1 element of a probability vector."""
    return df.withColumn(out, vector_to_array(F.col(vector))[1])


def risk_band(percent: Column, high=HIGH_PERCENT, medium=MEDIUM_PERCENT) -> Column:
    """HIGH, MEDIUM or LOW; an unknown score has no band."""
    return (
        F.when(percent.isNull(), F.lit(None).cast("string"))
        .when(percent >= high, "HIGH")
        .when(percent >= medium, "MEDIUM")
        .otherwise("LOW")
    )


def percent_text(percent: Column) -> Column:
    """Percent with one decimal, rounding the binary value half to even.

    Java's formatter rounds the shortest decimal form half up instead, which turns 12.35
    (stored just below) into 12.4. The value is split at 2**-20 so both parts times ten are
    exact, and the sum's sign tells on which side of the half it lies.
    """
    scale = float(2**20)
    coarse = F.floor(percent * scale) / F.lit(scale)
    tenths = coarse * 10.0
    whole = F.floor(tenths)
    side = (tenths - whole - 0.5) + (percent - coarse) * 10.0
    up = F.when(side > 0, 1).when((side == 0) & (whole % 2 == 1), 1).otherwise(0)
    return F.when(percent.isNotNull(), F.format_string("%.1f%%", (whole + up) / 10.0))


def with_risk_report(df: DataFrame, score: str, high=HIGH_PERCENT, medium=MEDIUM_PERCENT):
    """Add ``risk_percent``, ``risk_text``, ``risk_progress`` (0..100) and ``risk_level``."""
    percent = F.col("risk_percent")
    return (
        df.withColumn("risk_percent", F.col(score) * 100.0)
        .withColumn("risk_text", percent_text(percent))
        .withColumn(
            "risk_progress",
            F.when(percent.isNotNull(), F.least(percent.cast("int"), F.lit(100))),
        )
        .withColumn("risk_level", risk_band(percent, high, medium))
    )


def score_bin(score: Column, bins: int = 10) -> Column:
    """Label of the half-open bin ``[a, a + 1/bins)``; the last one takes the rest."""
    places = max(1, len(str(bins)) - 1)
    names = [f"{i / bins:.{places}f}-{(i + 1) / bins:.{places}f}" for i in range(bins)]
    chain = F.when(score.isNull(), F.lit(None).cast("string"))
    for i in range(bins - 1):
        chain = chain.when(score < F.lit((i + 1) / bins), names[i])
    return chain.otherwise(names[-1])
