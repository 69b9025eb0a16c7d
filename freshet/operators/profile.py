"""Table profiles."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.operators.topk import top_rows


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"))


def preview(df: DataFrame, order, k: int = 10) -> DataFrame:
    """First ``k`` rows in a stated order."""
    return top_rows(df, order, k)


def schema_of(df: DataFrame) -> list[tuple[str, str]]:
    """Column names and types, in order."""
    return [(f.name, f.dataType.simpleString()) for f in df.schema]


QUARTILES = (0.25, 0.5, 0.75)


def profile_table(df: DataFrame, quantiles=QUARTILES) -> DataFrame:
    """One row per column: position, column_name, type, n_rows, n_nulls, n_distinct, least, most, quantiles.

    All from one pass, by sketches that merge: n_distinct is approximate (within a few percent, by
    a HyperLogLog sketch), and so are the quantiles of a numeric column, as doubles (by ranks
    within a thousandth). least and most are texts, null for columns without an order, as are
    quantiles of columns that are not numeric. NaN is a number, and the greatest.
    """
    columns = []
    for k, field in enumerate(df.schema):
        c, kind = F.col(f"`{field.name}`"), field.dataType
        nested = isinstance(kind, (T.MapType, T.ArrayType, T.StructType, T.VariantType))
        no_text, no_numbers = F.lit(None).cast("string"), F.lit(None).cast("array<double>")
        asked = F.array(*(F.lit(float(q)) for q in quantiles))
        numeric = isinstance(kind, T.NumericType) and len(quantiles) > 0
        columns.append(
            F.struct(
                F.lit(k).alias("position"),
                F.lit(field.name).alias("column_name"),
                F.lit(kind.simpleString()).alias("type"),
                F.count("*").alias("n_rows"),
                F.count_if(c.isNull()).alias("n_nulls"),
                (F.approx_count_distinct(F.to_json(F.struct(c)) if nested else c)).alias("n_distinct"),
                (no_text if nested else F.min(c).cast("string")).alias("least"),
                (no_text if nested else F.max(c).cast("string")).alias("most"),
                (F.percentile_approx(c.cast("double"), asked, 1000) if numeric else no_numbers).alias("quantiles"),
            )
        )
    return df.agg(F.array(*columns).alias("columns")).select(F.inline("columns"))


def null_counts(df: DataFrame) -> DataFrame:
    """Nulls per column, as rows, from one pass over the table."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counted.unpivot([], df.columns, "column_name", "null_count")


def describe_by(df: DataFrame, cols, by) -> DataFrame:
    """Count, mean, stddev, min and max per column and population, typed, in one pass."""
    by = [by] if isinstance(by, str) else list(by)
    measures = {
        "n": F.count,
        "mean": F.avg,
        "stddev": F.stddev,
        "min": F.min,
        "max": F.max,
    }
    wide = df.groupBy(*by).agg(
        *[
            F.struct(F.lit(c).alias("feature"), *[f(c).alias(m) for m, f in measures.items()])
            .alias(c)
            for c in cols
        ]
    )
    return wide.select(*by, F.inline(F.array(*cols)))


def distinct_sorted(df: DataFrame, cols) -> DataFrame:
    cols = [cols] if isinstance(cols, str) else list(cols)
    return df.select(*cols).distinct().orderBy(*cols)
