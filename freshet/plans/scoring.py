"""Scoring with a fitted pipeline."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.functions import positive_score, with_risk_report
from freshet.plans.training import MAIN, FeatureSpec, ForestModel, model_rows


def score_table(
    model: ForestModel,
    df: DataFrame,
    spec: FeatureSpec = MAIN,
    out: str = "flood_probability",
    report: bool = False,
) -> DataFrame:
    """Score the complete rows of ``df``; ``report`` adds the risk columns.

    A filter on a score is applied to the scores: the forest runs once a row. Store the scored
    table before it is read again.
    """
    scored = positive_score(model.transform(model_rows(df, spec, labelled=False)), out=out)
    return with_risk_report(scored, out) if report else scored


def dropped_rows(df: DataFrame, spec: FeatureSpec = MAIN) -> DataFrame:
    """One row: how many rows there are, and how many ``score_table`` leaves out."""
    total = df.agg(F.count("*").alias("n_rows"))
    kept = model_rows(df, spec, labelled=False).agg(F.count("*").alias("n")).scalar()
    return total.withColumn("n_dropped", F.col("n_rows") - kept)
