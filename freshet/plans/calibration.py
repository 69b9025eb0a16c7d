"""Isotonic calibration of scores, and comparison of raw with calibrated ones.

The best non-decreasing fit pools neighbouring scores whose rates fall, in any order of pooling.
So tasks pool ranges of scores by themselves, and what is left of each, a few blocks, is pooled
again over other ranges until nothing falls any more. The fitted map is a table.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.operators.evaluation import _known, areas, squared_error
from freshet.operators.lookup import fits_broadcast, lookup
from freshet.operators.ordered import PLACE, running
from freshet.storage import stage

CALIBRATED = "calibrated_probability"
BLOCKS_PER_TASK = 250_000
_BLOCK = "lo double, hi double, weight double, total double"


@dataclass(frozen=True)
class Calibrator:
    """Map from ``score`` to ``out``: rows (x, y) by rising x, straight lines between, level beyond."""

    points: DataFrame
    score: str = "raw_score"
    out: str = CALIBRATED


class _Pool:
    """Blocks of neighbouring scores, in order, whose means rise."""

    def __init__(self):
        self.blocks = []

    def add(self, lo, hi, weight, total):
        blocks = self.blocks
        while blocks and blocks[-1][3] * weight >= total * blocks[-1][2]:
            lo, _, w, t = blocks.pop()
            weight += w
            total += t
        blocks.append((lo, hi, weight, total))

    def table(self):
        columns = zip(*self.blocks) if self.blocks else [[]] * 4
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.float64()) for c in columns], ["lo", "hi", "weight", "total"]
        )


def _pooled_ranges(rows):
    """Blocks of the rows (lo, hi, weight, total), pooled within ranges of scores."""

    def run(batches):
        pool = _Pool()
        for batch in batches:
            for block in zip(*(c.to_pylist() for c in batch.columns)):
                pool.add(*block)
        yield pool.table()

    return rows.repartitionByRange("lo").sortWithinPartitions("lo").mapInArrow(run, _BLOCK)


def _pooled_again(placed, size, shift):
    """Blocks pooled within groups of ``size`` neighbours; ``shift`` moves the groups' borders."""

    def run(table: pa.Table) -> pa.Table:
        pool = _Pool()
        for block in zip(*(table.column(c).to_pylist() for c in ("lo", "hi", "weight", "total"))):
            pool.add(*block)
        return pa.Table.from_batches([pool.table()])

    group = F.expr(f"({PLACE} + {shift}) div {size}")
    grouped = placed.select("lo", "hi", "weight", "total", group.alias("group_"))

    def in_order(table: pa.Table) -> pa.Table:
        return run(table.sort_by("lo"))

    return grouped.groupBy("group_").applyInArrow(in_order, _BLOCK)


def fit_calibrator(
    df: DataFrame, score="raw_score", label="flood_event", out=CALIBRATED, size=BLOCKS_PER_TASK
) -> Calibrator:
    """Non-decreasing map from score to observed rate, over rows with a label and a number as score.

    Equal scores are pooled to their mean and count first, then tasks pool ranges of the distinct
    scores. Each round after that pools groups of ``size`` neighbouring blocks, every second one
    with borders half a group further, so that all neighbours meet within two rounds. It ends when
    the blocks left fit one group, which is pooled, or two rounds changed nothing.
    """
    number = F.col(score).cast("double")
    pooled = (
        df.filter(number.isNotNull() & ~F.isnan(number) & F.col(label).isNotNull())
        .groupBy(number.alias("lo"))
        .agg(F.count("*").cast("double").alias("weight"), F.sum(F.col(label).cast("double")).alias("total"))
        .select("lo", F.col("lo").alias("hi"), "weight", "total")
    )
    blocks = stage(_pooled_ranges(pooled), "isotonic-blocks")
    n = blocks.count()
    if not n:
        raise ValueError("no rows with both a score and a label to calibrate on")
    turn = unchanged = 0
    while n > size and unchanged < 2:
        placed = running(blocks, ["lo"], name="isotonic-order")
        blocks = stage(_pooled_again(placed, size, (turn % 2) * (size // 2) - 1), "isotonic-blocks")
        left = blocks.count()
        unchanged = unchanged + 1 if left == n else 0
        n, turn = left, turn + 1
    if n <= size:  # One group holds what is left.
        blocks = _pooled_again(blocks.withColumn(PLACE, F.lit(0)), size, 0)
    mean = (F.col("total") / F.col("weight")).alias("y")
    ends = F.array_distinct(F.array("lo", "hi"))
    points = stage(blocks.select(F.explode(ends).alias("x"), mean), "isotonic-map")
    return Calibrator(points, score, out)


def save_calibrator(calibrator: Calibrator, path: str) -> None:
    """Save the map as a table at ``path``, replacing what is there."""
    calibrator.points.write.mode("overwrite").parquet(path)


def load_calibrator(spark: SparkSession, path: str, score="raw_score", out=CALIBRATED) -> Calibrator:
    return Calibrator(spark.read.parquet(path), score, out)


def apply_calibrator(calibrator: Calibrator, df: DataFrame, broadcast_rows=None) -> DataFrame:
    """Add the calibrated score; between fitted points it is interpolated. Null for no number.

    A map measured small is held by every task. A larger one is joined: the distinct scores and
    the map are put in one order, which gives each score its place in the map.
    """
    points, number = calibrator.points, F.col(calibrator.score).cast("double")
    limits = {} if broadcast_rows is None else {"rows": broadcast_rows}
    if fits_broadcast(points, **limits):
        rows = sorted(tuple(r) for r in points.collect())
        held = df.sparkSession.sparkContext.broadcast(np.array(rows, float).reshape(-1, 2).T)
        return df.withColumn(calibrator.out, _interpolated(number, held))
    distinct = df.select(number.alias("x")).filter("x is not null and not isnan(x)").distinct()
    mapped = _merged(distinct, points).withColumnRenamed("y", calibrator.out)
    kept = [c for c in df.columns if c != calibrator.out]
    key = "calibrated_key"
    while key in df.columns:
        key += "_"
    found = lookup(df.select(*kept).withColumn(key, number), mapped.withColumnRenamed("x", key), [key])
    return found.drop(key)


def _interpolated(score, held):
    @F.arrow_udf(T.DoubleType())
    def value(column: pa.Array) -> pa.Array:
        x, y = held.value
        at = column.fill_null(float("nan")).to_numpy(zero_copy_only=False)
        found = np.interp(at, x, y)
        return pa.array(found, mask=np.isnan(at))

    return value(score)


def _merged(scores: DataFrame, points: DataFrame) -> DataFrame:
    """(x, y) of distinct scores, by the number of points at or below each."""
    both = points.select("x", "y", F.lit(1).alias("point")).union(
        scores.select("x", F.lit(None).cast("double"), F.lit(0))
    )
    placed = running(both, ["x", F.desc("point")], ["point"], "isotonic-merge")
    numbered = placed.where("point = 1").select(F.col("point_to").alias("k"), F.col("x").alias("x0"), F.col("y").alias("y0"))
    after = numbered.select((F.col("k") - 1).alias("k"), F.col("x0").alias("x1"), F.col("y0").alias("y1"))
    segments = stage(numbered.join(after, "k", "full"), "isotonic-segments")
    mine = placed.where("point = 0").select("x", F.col("point_to").alias("k"))
    inside = F.col("y0") + (F.col("y1") - F.col("y0")) * (F.col("x") - F.col("x0")) / (F.col("x1") - F.col("x0"))
    y = F.when(F.col("x0").isNull(), F.col("y1")).when(F.col("x1").isNull(), F.col("y0")).otherwise(inside)
    return lookup(mine, segments, ["k"]).select("x", y.alias("y"))


def compare_scores(df: DataFrame, scores, label="flood_event", exact=False) -> DataFrame:
    """Brier score and area under the precision-recall curve, one row per score column.

    Each over the rows that count for its score; null where none does. ``df`` is stored: it is
    read once for the errors and once for all curves.
    """
    df = stage(df.select(*scores, label), "compared-scores")
    errors = df.agg(
        *[F.avg(F.when(_known(label, s), squared_error(s, label))).alias(s) for s in scores]
    )
    briers = errors.unpivot([], list(scores), "score", "brier_score")
    found = areas(df, scores, label, exact).select(F.col("name").alias("score"), "pr_auc")
    return briers.join(F.broadcast(found), "score")
