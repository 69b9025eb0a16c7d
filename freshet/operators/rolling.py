"""Rolling and lagged features per series, over rows rather than spans of time."""

from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.operators.rowframes import ROWS_PER_TASK, over_rows

AGGREGATES = {"sum": F.sum, "avg": F.avg, "max": F.max}


@dataclass(frozen=True)
class RollingSpec:
    """``fn`` of ``col`` over the current row and the ``rows - 1`` rows before it, as ``out``."""

    col: str
    fn: str
    rows: int
    out: str


def rain_sum(rows: int, out: str) -> RollingSpec:
    return RollingSpec("precipitation", "sum", rows, out)


RAIN_24 = rain_sum(24, "rainfall_24h")
RAIN_48 = rain_sum(48, "rainfall_48h")
RAIN_72 = rain_sum(72, "rainfall_72h")
RAIN_7D = rain_sum(168, "rainfall_7d")
RAIN_SHORT = (rain_sum(6, "rainfall_6h"), rain_sum(12, "rainfall_12h"))
SOIL_24 = RollingSpec("soil_moisture", "avg", 24, "soil_moisture_avg_24h")
MAX_RAIN_24 = RollingSpec("precipitation", "max", 24, "max_rainfall_24h")

MAIN_FEATURES = (RAIN_24, RAIN_72, RAIN_7D, SOIL_24, MAX_RAIN_24)
FEATURES_48H = (RAIN_24, RAIN_48, RAIN_72, RAIN_7D, SOIL_24, MAX_RAIN_24)


@dataclass(frozen=True)
class LagSpec:
    """``col`` now minus ``rows`` rows ago, as ``change``, and its negative, as ``drop``."""

    col: str
    rows: int

    @property
    def change(self):
        return f"{self.col}_{self.rows}h_change"

    @property
    def drop(self):
        return f"{self.col}_drop_{self.rows}h"


PRESSURE_LAGS = tuple(LagSpec("pressure", n) for n in (6, 12, 24))


def row_features(
    df: DataFrame,
    specs=MAIN_FEATURES,
    lags=(),
    keys=("location",),
    ts="datetime",
    rows_per_task=ROWS_PER_TASK,
) -> DataFrame:
    """Add the columns of all specs and lags, from one shuffle and sort.

    A frame at the start of a series is shorter, not null. Nulls inside a frame are skipped;
    a frame of nulls alone gives null. A change is null for the first rows of a series.
    ``keys=[]`` is the single-series form.
    """
    levels = _levels(specs)
    summed = {s.col: df.select(F.sum(s.col)).schema[0].dataType for s in specs if s.fn == "sum"}

    def columns(window):
        plain = {
            s.out: AGGREGATES[s.fn](s.col).over(window.rowsBetween(1 - s.rows, 0))
            for s in levels[0]
        }
        for lag in lags:
            plain[lag.change] = F.col(lag.col) - F.lag(lag.col, lag.rows).over(window)
        built = [
            {s.out: _from_blocks(s, block, window, summed[s.col]) for s, block in level.items()}
            for level in levels[1:]
        ]
        drops = {lag.drop: -F.col(lag.change) for lag in lags}
        return [plain, *built, drops]

    back = max([s.rows - 1 for s in specs] + [lag.rows for lag in lags])
    return over_rows(df, keys, ts, back, columns, rows_per_task)


def _levels(specs):
    """Specs by the order in which they can be computed, each with the sum it is built from.

    Spark recomputes a sliding frame at every row, so 168 rows cost 168 additions per row.
    Seven sums of 24 rows, already there and 24 rows apart, are the same 168 rows. A sum is
    built from the longest shorter one that it is a whole multiple of.
    """
    level, block = {}, {}
    for s in sorted(specs, key=lambda s: s.rows):
        shorter = [
            o
            for o in level
            if s.fn == o.fn == "sum" and s.col == o.col and o.rows < s.rows and s.rows % o.rows == 0
        ]
        block[s] = max(shorter, key=lambda o: o.rows, default=None)
        level[s] = level[block[s]] + 1 if block[s] else 0
    depth = max(level.values(), default=0)
    return [{s: block[s] for s in specs if level[s] == n} for n in range(depth + 1)]


def _from_blocks(spec, block, window, kind):
    """The sum from shorter ones, of the type that the plain sum has."""
    parts = [F.col(block.out)] + [
        F.lag(block.out, back).over(window) for back in range(block.rows, spec.rows, block.rows)
    ]
    total = reduce(add, [F.coalesce(p, F.lit(0).cast(kind)) for p in parts])
    return F.when(F.coalesce(*parts).isNotNull(), total.cast(kind))


def rolling(df: DataFrame, specs=MAIN_FEATURES, keys=("location",), ts="datetime", **options):
    """Rolling features alone; see ``row_features``."""
    return row_features(df, specs, (), keys, ts, **options)


def lag_change(
    df: DataFrame, col="pressure", lags=(6, 12, 24), keys=("location",), ts="datetime", **options
) -> DataFrame:
    """Add ``<col>_<n>h_change``, now minus n rows ago, and ``<col>_drop_<n>h``, its negative."""
    return row_features(df, (), tuple(LagSpec(col, n) for n in lags), keys, ts, **options)
