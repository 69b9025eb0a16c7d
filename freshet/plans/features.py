"""Observations to labelled feature tables."""

from pyspark.sql import DataFrame

from freshet.operators.labeling import label_intervals
from freshet.operators.rolling import MAIN_FEATURES, row_features


def labeled_features(
    obs: DataFrame,
    events: DataFrame,
    specs=MAIN_FEATURES,
    lags=(),
    keys=("location",),
    ts="datetime",
) -> DataFrame:
    """Interval labels and rolling and lagged features of one observation table.

    Labels first: what the label join looks at is then a plain scan, not the windows' result.
    """
    return row_features(label_intervals(obs, events, keys, ts), specs, lags, keys, ts)
