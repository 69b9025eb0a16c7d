"""Event-risk analytics on location-keyed time series, as Spark DataFrame functions."""

from freshet.functions import (
    add_month_cycle,
    between_times,
    complete_cases,
    false_positives,
    positive_score,
    risk_band,
    with_risk_report,
)
from freshet.operators.evaluation import (
    auc,
    brier,
    class_metrics,
    confusion,
    fp_count,
    left_out,
    reliability_table,
    threshold_sweep,
)
from freshet.operators.labeling import label_intervals
from freshet.operators.profile import (
    describe_by,
    distinct_sorted,
    null_counts,
    preview,
    profile_table,
    row_count,
    schema_of,
)
from freshet.operators.rolling import (
    LagSpec,
    RollingSpec,
    lag_change,
    rolling,
    row_features,
)
from freshet.operators.stats import (
    apply_weights,
    class_stats,
    class_weights,
    label_correlation,
    label_counts,
    monthly_rate,
)
from freshet.operators.topk import top_rows
from freshet.plans.calibration import (
    Calibrator,
    apply_calibrator,
    compare_scores,
    fit_calibrator,
    load_calibrator,
    save_calibrator,
)
from freshet.plans.features import labeled_features
from freshet.plans.scoring import dropped_rows, score_table
from freshet.plans.training import (
    FeatureSpec,
    ForestModel,
    build_pipeline,
    feature_importance,
    fit,
    temporal_split,
    with_split,
)
from freshet.sources import (
    load_model,
    quarantine,
    read_csv,
    read_events,
    read_observations,
    read_table,
    replace_partitions,
    save_model,
    tag_location,
    unpack_hourly,
    write_csv,
    write_table,
)
from freshet.storage import scratch

__all__ = [
    "FeatureSpec",
    "ForestModel",
    "LagSpec",
    "RollingSpec",
    "add_month_cycle",
    "Calibrator",
    "apply_calibrator",
    "apply_weights",
    "auc",
    "between_times",
    "brier",
    "build_pipeline",
    "class_metrics",
    "class_stats",
    "class_weights",
    "compare_scores",
    "complete_cases",
    "confusion",
    "describe_by",
    "distinct_sorted",
    "dropped_rows",
    "false_positives",
    "feature_importance",
    "fit",
    "fit_calibrator",
    "load_calibrator",
    "save_calibrator",
    "fp_count",
    "label_correlation",
    "label_counts",
    "label_intervals",
    "labeled_features",
    "lag_change",
    "left_out",
    "load_model",
    "monthly_rate",
    "null_counts",
    "positive_score",
    "preview",
    "profile_table",
    "quarantine",
    "read_csv",
    "read_events",
    "read_observations",
    "read_table",
    "replace_partitions",
    "reliability_table",
    "risk_band",
    "rolling",
    "row_count",
    "row_features",
    "save_model",
    "schema_of",
    "scratch",
    "score_table",
    "tag_location",
    "temporal_split",
    "threshold_sweep",
    "top_rows",
    "unpack_hourly",
    "with_risk_report",
    "with_split",
    "write_csv",
    "write_table",
]
