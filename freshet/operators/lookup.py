"""Equality lookup into a dimension that has at most one row per key."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.storage import stage

BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 * 1024 * 1024
# Rows of one key that one task takes; a key with more is dealt over several.
ROWS_PER_TASK = 1_000_000


def free_names(taken, *names):
    """``names``, each made longer until it is none of ``taken``."""
    taken = {c.lower() for c in taken}
    out = []
    for name in names:
        name = f"_{name}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def _has_map(kind) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind)
    return isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and _has_map(kind.elementType)


def hashable(df: DataFrame):
    """The columns of ``df`` that Spark can hash: all without a map in them."""
    return [F.col(f"`{f.name}`") for f in df.schema if not _has_map(f.dataType)]


def spread(df: DataFrame, parts) -> Column:
    """A number below ``parts``, for rows of ``df`` that may be dealt freely.

    By the row's content, moved on by its partition so that equal rows do not stay together.
    A task that is run again deals its rows the same way. Columns with maps have no hash: rows
    are dealt by the others.
    """
    return F.pmod(F.pmod(F.xxhash64(*hashable(df), F.lit(0)), parts) + F.spark_partition_id(), parts)


def row_bytes(field) -> Column:
    """Bytes that a value of a column takes, about."""
    name = f"`{field.name}`"
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(name), F.lit(0)) + 16
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(name))), F.lit(0)) + 16
    return F.lit(16)


def fits_broadcast(df: DataFrame, rows=BROADCAST_ROWS, size=BROADCAST_BYTES) -> bool:
    """Measure ``df``: whether it may be sent whole to every executor."""
    width = reduce(lambda a, b: a + b, [row_bytes(f) for f in df.schema])
    n, total = df.agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return n <= rows and total <= size


def lookup(df: DataFrame, dim: DataFrame, on, small=None, rows_per_task=ROWS_PER_TASK, size=BROADCAST_BYTES):
    """Left-join ``dim`` to ``df`` on the columns ``on``; null keys match nothing.

    A dimension measured small is broadcast, so ``df`` is not shuffled. Any other is joined by
    shuffle, with the hot keys of ``df`` spread over several tasks. ``small`` skips the
    measurement where the caller has already bounded the dimension; ``size`` is what a table may
    take in bytes to be broadcast, the hot keys' own included.
    """
    on = list(on)
    if small is None:
        small = fits_broadcast(dim, size=size)
    if small:
        return df.join(F.broadcast(dim), on, "left")
    return _spread_lookup(df, dim, on, rows_per_task, size)


def _spread_lookup(df, dim, on, rows_per_task, size):
    parts, part, *marks = free_names([*df.columns, *dim.columns], "parts", "part", *(f"hot{i}" for i in range(len(on))))
    hot = _hot_keys(df, on, rows_per_task, parts, marks)
    if hot is None:
        return df.join(dim, on, "left")
    order = [f"`{c}`" for c in df.columns + [c for c in dim.columns if c not in on]]
    hinted = F.broadcast(hot) if fits_broadcast(hot, size=size) else hot
    # Where the hot keys are too many or too wide for every executor, they are joined by shuffle:
    # Spark splits the large partitions of that join, as the stored table has no state in it.
    same = reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(m)) for c, m in zip(on, marks)])
    mine = F.when(F.col(parts).isNotNull(), spread(df, F.col(parts))).otherwise(F.lit(0).cast("long"))
    dealt = df.join(hinted, same, "left").withColumn(part, mine).drop(parts, *marks)
    copies = F.sequence(F.lit(0).cast("long"), F.coalesce(F.col(parts), F.lit(1)) - 1)
    copied = dim.join(hinted, same, "left").withColumn(part, F.explode(copies)).drop(parts, *marks)
    return dealt.join(copied, [*on, part], "left").select(*order)


def _hot_keys(df, on, rows_per_task, parts, marks):
    """Keys with too many rows for one task, and the number of parts for each; None without any.

    A stored table. Null is a key here: a left join sends all null keys to one task too.
    """
    n = free_names(df.columns, "n")[0]
    counts = df.groupBy(*on).agg(F.count("*").alias(n)).filter(F.col(n) > rows_per_task)
    hot = stage(
        counts.select(
            *[F.col(f"`{c}`").alias(m) for c, m in zip(on, marks)],
            F.ceil(F.col(n) / F.lit(rows_per_task)).cast("long").alias(parts),
        ),
        "hot-keys",
    )
    return None if hot.isEmpty() else hot
