"""First rows of an order, overall or per group."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.operators.lookup import ROWS_PER_TASK, fits_broadcast, free_names
from freshet.operators.ordered import running
from freshet.storage import stage

# Spark prunes per-group ranks before the shuffle up to this rank (its default limit).
PRUNED_RANK = 1000


def top_rows(df: DataFrame, order, k: int, per=None, where: Column = None, rows_per_task=ROWS_PER_TASK):
    """The first ``k`` rows by ``order``, or the first ``k`` of each ``per`` group.

    ``order`` should be total, ties included, so that the rows chosen are always the same.
    Per group and up to the rank that Spark prunes at, only ranks up to ``k`` leave a task. Beyond
    it a group's first rows may be too many for a task: all rows are put in one order, groups
    one after another, by ranges of about ``rows_per_task`` rows, however large a group is; a
    row's place less that of its group's first row is its rank. ``df`` is then read three times:
    pass a stored table.
    """
    if where is not None:
        df = df.filter(where)
    if per is None:
        return df.orderBy(*order).limit(k)
    per = [per] if isinstance(per, str) else list(per)
    if k > PRUNED_RANK:
        return _first_places(df, per, order, k, rows_per_task)
    rank = F.row_number().over(Window.partitionBy(*per).orderBy(*order))
    name = free_names(df.columns, "rank")[0]
    return df.withColumn(name, rank).filter(F.col(name) <= k).drop(name)


def _first_places(df, per, order, k, rows_per_task):
    place, start, *marks = free_names(df.columns, "place", "start", *(f"key{i}" for i in range(len(per))))
    tasks = max(2, -(-df.count() // rows_per_task))
    placed = running(df, [*per, *order], name="ranked", place=place, partitions=tasks)
    renamed = [F.col(f"`{c}`").alias(m) for c, m in zip(per, marks)]
    starts = stage(placed.groupBy(*renamed).agg(F.min(place).alias(start)), "groups")
    if fits_broadcast(starts):
        starts = F.broadcast(starts)
    same = reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(m)) for c, m in zip(per, marks)])
    first = placed.join(starts, same).filter(F.col(place) - F.col(start) < k)
    return first.drop(place, start, *marks)
