from freshet.functions.expressions import (
    add_month_cycle,
    between_times,
    complete_cases,
    false_positives,
    is_complete,
    month_of,
    percent_text,
    positive_score,
    risk_band,
    score_bin,
    with_risk_report,
)

__all__ = [
    "add_month_cycle",
    "between_times",
    "complete_cases",
    "false_positives",
    "is_complete",
    "month_of",
    "percent_text",
    "positive_score",
    "risk_band",
    "score_bin",
    "with_risk_report",
]
