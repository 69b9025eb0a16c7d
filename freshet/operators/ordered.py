"""Running totals along one order of a whole table.

A window without partitions sends all rows to one task. Here rows are shuffled once, by ranges of
the order, and sorted there; each task adds up its own rows, and a row per task says what the
tasks before it hold.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.operators.lookup import free_names
from freshet.storage import stage

PLACE = "place"


def running(df: DataFrame, order, totals=(), name="ordered", place=PLACE, partitions=None) -> DataFrame:
    """``df`` with ``place``, from 1 along ``order``, and ``<c>_to`` for each column c of ``totals``:
    its sum over all rows up to this one. Stored, and read back in any order.

    ``order`` should be total: rows equal in it get places in any order. Sums of whole numbers are
    exact. A null counts as 0. ``df`` must have none of the new columns' names. ``partitions`` is
    the number of ranges, about even in rows; Spark's own setting without it.
    """
    totals = list(totals)
    whole = {c: isinstance(df.schema[c].dataType, T.IntegralType) for c in totals}
    sums = [f"{c}_to" for c in totals]
    part_ = free_names([*df.columns, place, *sums], "part")[0]
    new = [T.StructField(part_, T.IntegerType()), T.StructField(place, T.LongType())]
    new += [T.StructField(s, T.LongType() if whole[c] else T.DoubleType()) for c, s in zip(totals, sums)]

    def add_up(batches):
        part, done = TaskContext.get().partitionId(), 0
        held = dict.fromkeys(totals, 0)
        for batch in batches:
            n = batch.num_rows
            columns = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(done + 1, done + n + 1))]
            done += n
            for c in totals:
                values = batch.column(batch.schema.get_field_index(c)).fill_null(0).to_numpy(zero_copy_only=False)
                sums_here = np.cumsum(values.astype(np.int64 if whole[c] else np.float64)) + held[c]
                if n:
                    held[c] = sums_here[-1]
                columns.append(pa.array(sums_here))
            names = [*batch.schema.names, part_, place, *sums]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names)

    ranges = [*order] if partitions is None else [partitions, *order]
    in_order = df.repartitionByRange(*ranges).sortWithinPartitions(*order)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema] + new)
    placed = stage(in_order.mapInArrow(add_up, schema), name)
    start = {c: free_names([*placed.columns], f"{c}_start")[0] for c in [place, *sums]}
    ends = placed.groupBy(part_).agg(
        F.max(place).alias(start[place]), *(F.max_by(s, place).alias(start[s]) for s in sums)
    )
    # One row per task here, so a single window and a broadcast are right.
    before = Window.partitionBy(F.lit(0)).orderBy(part_).rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select(part_, *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in start.values()))
    return placed.join(F.broadcast(starts), part_).select(
        *(f"`{c}`" for c in df.columns), *((F.col(c) + F.col(start[c])).alias(c) for c in [place, *sums])
    )
