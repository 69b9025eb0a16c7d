"""Trailing row windows over long series.

``Window.partitionBy(keys).orderBy(ts)`` sends each series to one task. With few keys, or one
key holding a third of the rows, that task does not finish. Here a series longer than a task's
share is cut along time into buckets, and each bucket also gets the rows just before it, so a
frame that looks at most ``back`` rows back finds the same rows as in the uncut series. The
copied rows are dropped again. The result is the same for any spacing of the rows in time.

How the cut is found: time is divided into cells; a cell that holds too many rows is divided again
by its own range, and one that holds a single time by the rows' content. Where rows lie is known
from a quantile sketch of each long series, so all divisions are found from one pass; a second
pass counts the cells. Cells are then packed into buckets in order. The tables of the cut are
small beside the rows, and broadcast where they were measured so; the rows themselves are
shuffled once, as in the plain window.
"""

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.operators.lookup import fits_broadcast, hashable
from freshet.storage import materialize

ROWS_PER_TASK = 250_000
CELLS_PER_BUCKET = 8
LEAST_PARTS = 16  # Parts of a cell that is divided; fewer would take more divisions.
SKETCHED = (64, 8192)  # Least and most quantiles taken of a series, 8 to a bucket between.
TURNS = 1 << 32


class _Names(str):
    """Names that a table's own columns cannot have: all begin with this."""

    def __getattr__(self, name):
        return f"{self}{name}"

    @classmethod
    def beside(cls, df):
        prefix = "_"
        while any(c.lower().startswith(prefix) for c in df.columns):
            prefix += "_"
        return cls(prefix)


def over_rows(df: DataFrame, keys, ts, back: int, columns, rows_per_task=ROWS_PER_TASK):
    """Add window columns that look at most ``back`` rows back within their series.

    ``columns`` takes a window specification, partitioned and ordered, and returns dicts of
    name to expression over it; a later dict may use the columns of an earlier one. They all
    share one shuffle and one sort, so ask for everything in one call. ``keys=[]`` treats the
    table as one series.

    Keys and times are counted first. Where a series is too long, those of long series are read
    twice more, whatever their spacing: once for the sketches and once for the cells. Rows of one
    key and time are ordered by their content. Pass a stored table rather than a long computation.
    """
    keys, p = list(keys), _Names.beside(df)
    cut = _find_cut(df, keys, ts, back, rows_per_task)
    if cut is None:
        window = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(ts, p.turn)
        return _with_all(df.withColumn(p.turn, _turn(df)), columns(window)).drop(p.turn)

    mine = _same(keys, p) & (F.col(p.cell) == F.col(p.start)) & (F.col(p.tie) == F.col(p.part))
    unplaced = F.raise_error(F.lit("the rows changed while their windows were planned"))
    buckets = F.when(F.col(p.cell).isNull(), F.array(F.lit(0))).otherwise(
        F.coalesce(F.col(p.buckets), unplaced)
    )
    copied = (
        cut.place(df, "left")
        .join(_hinted(cut.buckets), mine, "left")
        .select(*(F.col(f"`{c}`") for c in df.columns), F.posexplode(buckets).alias(p.copy, p.bucket))
    )
    copied = copied.withColumn(p.turn, _turn(df))
    window = Window.partitionBy(*keys, p.bucket).orderBy(ts, p.turn)
    computed = _with_all(copied, columns(window))
    return computed.filter(F.col(p.copy) == 0).drop(p.turn, p.copy, p.bucket)


def _turn(df):
    """Order of rows of one time: by their content, on every path; equal rows are alike anyway."""
    return F.pmod(F.xxhash64(*hashable(df)), F.lit(TURNS))


def _with_all(df, stages):
    for columns in stages:
        df = df.withColumns(columns)
    return df


def _hinted(table):
    """A table of the cut, broadcast if it was measured small enough; else joined by shuffle."""
    return F.broadcast(table) if fits_broadcast(table) else table


@dataclass
class Cut:
    """Tables that say which cell a row of a long series lies in, and the cells' buckets.

    ``roots`` has the first division of each long series; ``levels`` divide full cells again by
    time; ``ties`` divides cells of a single time.
    """

    keys: list
    ts: str
    names: _Names
    roots: DataFrame
    levels: list = field(default_factory=list)
    ties: DataFrame = None
    buckets: DataFrame = None

    def place(self, df: DataFrame, how: str) -> DataFrame:
        """Add the row's time as a number, ``at``, and its cell, ``cell`` and ``tie``.

        Rows of series that are not cut get a null cell, or are left out if ``how`` is inner.
        Rows without a time sort first: they get a cell before the first.
        """
        p = self.names
        placed = df.withColumn(p.at, _position(df, self.ts, F.col(f"`{self.ts}`")))
        if self.keys:
            placed = placed.join(_hinted(self.roots), _same(self.keys, p), how)
        else:
            lo, width = self.roots.select(p.lo, p.width).first()
            placed = placed.withColumn(p.lo, F.lit(lo)).withColumn(p.width, F.lit(width))
        placed = placed.withColumn(p.at, F.coalesce(F.col(p.at), F.col(p.lo) - 1))
        timeless = F.col(p.at) < F.col(p.lo)
        inside = F.expr(f"{p.lo} + (({p.at} - {p.lo}) div {p.width}) * {p.width}")
        placed = placed.withColumn(p.cell, F.when(timeless, F.col(p.at)).otherwise(inside))
        placed = placed.drop(p.lo, p.width, *self.small_keys)
        # A division spans what the sketch saw of its cell; rows before that go with the first part.
        within = F.expr(f"{p.lo} + floor(({p.at} - {p.lo}) / {p.width}) * {p.width}")
        for level in self.levels:
            divided = F.greatest(F.col(p.start), within)
            placed = self._inside(placed, level).withColumn(
                p.cell, F.when(F.col(p.start).isNull(), F.col(p.cell)).otherwise(divided)
            )
            placed = placed.drop(p.start, p.lo, p.width, *self.small_keys)
        if self.ties is None:
            return placed.withColumn(p.tie, F.lit(0).cast("long"))
        turn = F.expr(f"{p.turn} * {p.parts} div {TURNS}")
        placed = placed.withColumn(p.turn, _turn(df))
        placed = self._inside(placed, self.ties).withColumn(
            p.tie, F.coalesce(turn, F.lit(0).cast("long"))
        )
        return placed.drop(p.start, p.parts, p.turn, *self.small_keys)

    def _inside(self, placed, table):
        p = self.names
        inside = _same(self.keys, p) & (F.col(p.cell) == F.col(p.start))
        return placed.join(_hinted(table), inside, "left")

    def count(self, df: DataFrame, weight=None) -> DataFrame:
        """Rows and range of time per cell; ``weight`` is how many rows one of ``df`` stands for."""
        p = self.names
        n = F.count("*") if weight is None else F.ceil(F.sum(weight))
        return materialize(
            self.place(df, "inner")
            .groupBy(*_renamed(self.keys, p), p.cell, p.tie)
            .agg(n.alias(p.n), F.min(p.at).alias(p.lo), F.max(p.at).alias(p.hi))
        )

    def divide(self, df, per_cell, full, weight=None) -> DataFrame:
        """Divide cells of over ``full`` rows of ``df`` until none is left; gives the cells' counts."""
        p = self.names
        cells = self.count(df, weight)
        over = F.col(p.n) > full
        while not (again := cells.filter(over & (F.col(p.lo) < F.col(p.hi)))).isEmpty():
            self.levels.append(materialize(_division(again, per_cell, p)))
            cells = self.count(df, weight)
        tied = cells.filter(over & (F.col(p.tie) == 0) & (F.col(p.lo) == F.col(p.hi)))
        # Rows of one time are divided along the order that their windows use. Rows equal in every
        # column are told apart by nothing and stay together.
        parts = F.ceil(F.col(p.n) / F.lit(per_cell)).cast("long").alias(p.parts)
        tied = tied.select(*self.small_keys, F.col(p.cell).alias(p.start), parts)
        if self.ties is not None:
            known = reduce(lambda a, b: a & b, [F.col(f"t.{c}").eqNullSafe(F.col(f"k.{c}")) for c in [*self.small_keys, p.start]])
            tied = tied.alias("t").join(self.ties.alias("k"), known, "left_anti")
        tied = materialize(tied)
        if tied.isEmpty():
            return cells
        self.ties = tied if self.ties is None else materialize(self.ties.union(tied))
        return cells if weight is not None else self.count(df)

    @property
    def small_keys(self):
        return [f"{self.names}k{i}" for i in range(len(self.keys))]


def _find_cut(df, keys, ts, back, rows_per_task):
    """The cut, or None where no series is too long for a task."""
    p = _Names.beside(df)
    at = F.col(f"`{ts}`")
    ends = {p.lo: _position(df, ts, F.min(at)), p.hi: _position(df, ts, F.max(at))}
    series = (
        df.groupBy(*_renamed(keys, p))
        .agg(F.count("*").alias(p.n), F.count(at).alias(p.timed), *[e.alias(name) for name, e in ends.items()])
        .persist()
    )
    longest = series.agg(F.max(p.n)).first()[0]
    target = max(rows_per_task, 2 * back + 2)
    per_cell = max(1, target // CELLS_PER_BUCKET)
    long = None
    if longest and longest > target:
        # A series without any time is a single cell, before the first; its ties divide it.
        none = {c: F.coalesce(c, F.lit(0).cast("long")) for c in (p.lo, p.hi)}
        long = materialize(series.filter(F.col(p.n) > target).withColumns(none))
    series.unpersist()
    if long is None or long.isEmpty():
        return None

    cut = Cut(keys, ts, p, materialize(_division(long, per_cell, p).drop(p.start)))
    points = _points(df, long, cut, 8 * -(-longest // target))
    cut.divide(points, per_cell, target // 4, weight=p.weight)
    # Exact counts. Sketches are near enough that no cell is too full here, but for series of so
    # many buckets that more quantiles than SKETCHED would be needed: these are divided on.
    cells = cut.divide(df, per_cell, target // 2)
    cut.buckets = materialize(_pack(cells, cut.small_keys, target, back, p))
    return cut


def _points(df, long, cut, wanted):
    """Quantiles of each long series, and its rows without a time: a small table that lies in time as
    the rows do, with the number of rows that each point stands for."""
    p, keys = cut.names, cut.keys
    least, most = SKETCHED
    wanted = min(max(wanted, least), most)
    at = _position(df, cut.ts, F.col(f"`{cut.ts}`"))
    rows = df.select(*(F.col(f"`{k}`") for k in keys), at.alias(cut.ts))
    if keys:
        rows = rows.join(_hinted(long.select(*cut.small_keys)), _same(keys, p), "left_semi")
    # The sketch's error in rank is near 2 / k: a small part of the quantiles' distance.
    sketch = F.kll_sketch_agg_bigint(cut.ts, F.lit(min(65_535, 8 * wanted))).alias(p.sketch)
    sketches = rows.where(F.col(f"`{cut.ts}`").isNotNull()).groupBy(*_renamed(keys, p)).agg(sketch)
    ranks = F.array(*(F.lit((k + 0.5) / wanted) for k in range(wanted)))
    quantiles = F.explode(F.kll_sketch_get_quantile_bigint(p.sketch, ranks)).alias(cut.ts)
    named = [F.col(m).alias(k) for m, k in zip(cut.small_keys, keys)]
    same = reduce(lambda a, b: a & b, [F.col(f"s.{m}").eqNullSafe(F.col(f"l.{m}")) for m in cut.small_keys], F.lit(True))
    timed = (
        sketches.alias("s")
        .join(_hinted(long).alias("l"), same)
        .select(*(F.col(f"s.{m}") for m in cut.small_keys), p.sketch, p.timed)
        .select(*named, quantiles, (F.col(p.timed) / wanted).alias(p.weight))
    )
    timeless = long.where(F.col(p.n) > F.col(p.timed)).select(
        *named, F.lit(None).cast("long").alias(cut.ts), (F.col(p.n) - F.col(p.timed)).cast("double").alias(p.weight)
    )
    return materialize(timed.union(timeless))


def _division(cells, per_cell, p):
    """Equal parts of each cell's range, as many as its rows call for."""
    parts = F.greatest(F.lit(LEAST_PARTS), F.ceil(F.col(p.n) / F.lit(per_cell)))
    width = (((F.col(p.hi) - F.col(p.lo)) / parts).cast("long") + 1).alias(p.width)
    keys = [c for c in cells.columns if c.startswith(f"{p}k")]
    start = F.col(p.cell) if p.cell in cells.columns else F.lit(None)
    return cells.select(*keys, start.alias(p.start), p.lo, width)


def _pack(cells, small_keys, target, back, p):
    """Per cell: its own bucket, then the later buckets that need its rows in front.

    A bucket spans at most ``target`` rows plus one cell. The second bucket after a cell starts
    at or past the end of the first; the third lies more than ``target`` rows, hence more than
    ``back``, away. So two candidates are enough.
    """
    series = Window.partitionBy(*(small_keys or [F.lit(0)]))
    in_order = series.orderBy(p.cell, p.tie).rowsBetween(Window.unboundedPreceding, -1)
    by_bucket = series.orderBy(p.bucket)
    numbered = (
        cells.withColumn(p.before, F.coalesce(F.sum(p.n).over(in_order), F.lit(0)))
        .withColumn(p.slot, F.floor(F.col(p.before) / F.lit(target)))
        .withColumn(p.bucket, F.dense_rank().over(series.orderBy(p.slot)))
    )
    end = F.col(p.before) + F.col(p.n)
    wanted = []
    for step in (1, 2):
        begins = F.min(p.before).over(by_bucket.rangeBetween(step, step))
        wanted.append(F.when(begins - end < back, F.col(p.bucket) + step))
    return numbered.select(
        *small_keys,
        F.col(p.cell).alias(p.start),
        F.col(p.tie).alias(p.part),
        F.array_compact(F.array(p.bucket, *wanted)).alias(p.buckets),
    )


def _position(df, ts, at) -> Column:
    """A value of ``ts`` as a whole number that keeps its order. NTZ needs no time zone for it."""
    kind = df.schema[ts].dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(at)
    if isinstance(kind, T.TimestampNTZType):
        seconds = F.unix_date(at.cast("date")).cast("long") * 86400 + F.hour(at) * 3600
        micros = (F.extract(F.lit("SECOND"), at) * 1_000_000).cast("long")
        return (seconds + F.minute(at) * 60) * 1_000_000 + micros
    if isinstance(kind, T.DateType):
        return F.unix_date(at).cast("long")
    if isinstance(kind, T.IntegralType):
        return at.cast("long")
    raise TypeError(f"cannot order rows by {ts} of type {kind.simpleString()}")


def _renamed(keys, p):
    return [F.col(f"`{k}`").alias(f"{p}k{i}") for i, k in enumerate(keys)]


def _same(keys, p) -> Column:
    return reduce(
        lambda a, b: a & b,
        [F.col(f"`{k}`").eqNullSafe(F.col(f"{p}k{i}")) for i, k in enumerate(keys)],
        F.lit(True),
    )
