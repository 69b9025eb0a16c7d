"""Physical plans: what reaches the scan, and how often rows are shuffled."""

import re

import pytest
from pyspark.sql import functions as F

from freshet.catalog import inputs as i
from freshet.functions import between_times
from freshet.operators import evaluation, profile, stats
from freshet.operators.rolling import FEATURES_48H, PRESSURE_LAGS, RAIN_SHORT, row_features
from freshet.operators.topk import top_rows


@pytest.fixture
def plan(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")

    def physical(df):
        return df._jdf.queryExecution().executedPlan().toString()

    yield physical
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def exchanges(text):
    return len(re.findall(r"\bExchange (?:hash|range|Single|Round)", text))


def test_all_windows_share_one_shuffle(spark, small_dir, plan):
    made = row_features(i.observations(spark, small_dir), FEATURES_48H + RAIN_SHORT, PRESSURE_LAGS)
    text = plan(made)
    assert exchanges(text) == 1 and len(re.findall(r"\bSort \[", text)) == 1


def test_cut_series_shuffle_rows_once(spark, small_dir, plan):
    made = row_features(i.observations(spark, small_dir), rows_per_task=50)
    text = plan(made)
    rows, cells = exchanges(text), len(re.findall("hashpartitioning\\(_k0", text))
    assert rows - cells == 1
    assert "SortMergeJoin" not in text and "CartesianProduct" not in text


def test_label_adds_no_shuffle_of_rows(spark, small_dir, plan):
    text = plan(i.labeled(spark, small_dir))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    assert exchanges(text) == 1  # of the events' days


def test_time_filter_reaches_the_scan(spark, small_dir, plan):
    made = between_times(i.observations(spark, small_dir), "datetime", end="2024-01-10")
    assert re.search(r"PushedFilters: \[[^\]]*LessThan\(ts", plan(made))


def test_only_needed_columns_are_read(spark, small_dir, plan):
    counts = stats.label_counts(i.labeled(spark, small_dir))
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string>" in plan(counts)


def test_unused_windows_are_not_computed(spark, small_dir, plan):
    made = i.labeled_features(spark, small_dir)
    assert "Window" not in plan(stats.label_counts(made))


@pytest.mark.parametrize(
    "make",
    [
        lambda df: evaluation.threshold_sweep(df, "score"),
        lambda df: evaluation.class_metrics(df),
        lambda df: evaluation.brier(df, "score"),
        lambda df: profile.null_counts(df),
        lambda df: stats.label_correlation(df, ["precipitation", "pressure", "score"]),
    ],
)
def test_metrics_read_rows_once(spark, small_dir, plan, make):
    text = plan(make(i.scored(spark, small_dir)))
    assert text.count("FileScan parquet") == 1


def test_top_rows_do_not_sort_everything(spark, small_dir, plan):
    df = i.scored(spark, small_dir)
    assert "TakeOrderedAndProject" in plan(top_rows(df, [F.desc("score"), *i.KEY], 30))
    per = plan(top_rows(df, [F.desc("score"), "datetime"], 5, per="location"))
    assert "WindowGroupLimit" in per


def test_no_cartesian_or_python(spark, small_dir, plan):
    text = plan(i.scored_features(spark, small_dir))
    for word in ("CartesianProduct", "NestedLoop", "EvalPython", "ArrowEval", "MapInPandas"):
        assert word not in text
