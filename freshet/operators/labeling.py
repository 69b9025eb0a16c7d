"""Labels from documented events: inclusive time intervals, per key or for all keys."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.operators.lookup import (
    BROADCAST_BYTES,
    BROADCAST_ROWS,
    ROWS_PER_TASK,
    fits_broadcast,
    free_names,
    lookup,
    row_bytes,
)

BITS = 64  # Units of time in a bin, one bit of a long each.
SECONDS = {"day": 86_400, "hour": 3_600, "minute": 60}


def label_intervals(
    obs: DataFrame,
    events: DataFrame,
    keys=("location",),
    ts="datetime",
    out="flood_event",
    start="start_date",
    end="end_date",
    unit="day",
    broadcast_rows=BROADCAST_ROWS,
    rows_per_task=ROWS_PER_TASK,
) -> DataFrame:
    """Add ``date`` and ``out``: 1 where some event covers the row's key and time, else 0.

    Time is counted in whole units (day, hour, minute), and both bounds count: an event covers
    all of its first and its last unit. Events that end before they start, or lack a bound, cover
    nothing, and a null key or time matches nothing. ``keys=[]`` lets an event cover every series.

    Each key's time is cut into bins of 64 units, and a bin's covered units are the bits of a
    number: an event is a row per bin, whatever its length, and overlapping events merge in a
    bitwise or, which Spark takes before and after its shuffle. One aggregate over the events
    bounds rows and bytes of that table; it is broadcast where both allow it. Otherwise bins
    outside the observed time are cut off first, and if still too large the table is joined by
    shuffle, hot bins spread over tasks.
    """
    keys = list(keys)
    first, last, at, bin_, mask = free_names([*obs.columns, *events.columns], "from", "to", "unit", "bin", "mask")
    spans = events.select(*keys, _unit(events, start, unit).alias(first), _unit(events, end, unit).alias(last))
    spans = spans.filter(F.col(first) <= F.col(last))
    for key in keys:
        spans = spans.filter(F.col(key).isNotNull())

    n = _bin(F.col(last)) - _bin(F.col(first)) + 1
    width = reduce(lambda a, b: a + b, [row_bytes(spans.schema[k]) for k in keys], F.lit(32))
    rows, size = spans.agg(F.sum(n), F.sum(n * width)).first()
    small = (rows or 0) <= broadcast_rows and (size or 0) <= BROADCAST_BYTES
    if not small:
        seen = obs.agg(F.min(ts).alias(ts), F.max(ts).alias(last))
        low, high = seen.select(_unit(seen, ts, unit), _unit(seen, last, unit)).first()
        spans = spans.select(
            *keys,
            F.greatest(first, F.lit(low).cast("long")).alias(first),
            F.least(last, F.lit(high).cast("long")).alias(last),
        ).filter(F.col(first) <= F.col(last))

    bins = spans.withColumn(bin_, F.explode(F.sequence(_bin(F.col(first)), _bin(F.col(last)))))
    low = F.greatest(F.col(first) - F.col(bin_) * BITS, F.lit(0)).cast("int")
    high = F.least(F.col(last) - F.col(bin_) * BITS, F.lit(BITS - 1)).cast("int")
    ones = F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), F.lit(BITS - 1) - (high - low))
    covered = bins.groupBy(*keys, bin_).agg(F.bit_or(F.call_function("shiftleft", ones, low)).alias(mask))
    if not small:
        small = fits_broadcast(covered, broadcast_rows)

    timed = obs.withColumns({"date": F.to_date(ts), at: _unit(obs, ts, unit)})
    timed = timed.withColumn(bin_, _bin(F.col(at)))
    marked = lookup(timed, covered, [*keys, bin_], small, rows_per_task)
    place = F.pmod(F.col(at), F.lit(BITS)).cast("int")
    hit = F.call_function("shiftright", F.col(mask), place).bitwiseAND(F.lit(1).cast("long"))
    names = [F.col(f"`{c}`") for c in obs.columns if c not in ("date", out)]
    return marked.select(*names, "date", F.coalesce(hit, F.lit(0)).cast("int").alias(out))


def _unit(df: DataFrame, column: str, unit: str) -> Column:
    """Number of the unit a date, time or text of one lies in, from 1970 on, in the session's zone."""
    value, kind = F.col(column), df.schema[column].dataType
    if unit == "day":
        return F.unix_date(F.to_date(value)).cast("long")
    if isinstance(kind, T.DateType):
        raise TypeError(f"dates have no {unit}: give times as bounds, or count in days")
    at = value.cast("timestamp_ntz")
    seconds = F.unix_date(at.cast("date")).cast("long") * 86_400 + F.hour(at) * 3_600 + F.minute(at) * 60
    return F.floor(seconds / F.lit(SECONDS[unit]))


def _bin(unit: Column) -> Column:
    return F.floor(unit / F.lit(BITS))
