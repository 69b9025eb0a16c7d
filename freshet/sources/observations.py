"""Landed weather documents to observation rows."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.operators.lookup import lookup
from freshet.schemas import HOURLY_FIELDS, payload_schema


def _stamp(text):
    return text.try_cast("timestamp_ntz")


def unpack_hourly(raw: DataFrame, fields=None, payload="payload", ts="datetime"):
    """Split raw documents into observation rows and a quarantine table.

    ``raw`` holds one JSON document per row in ``payload``; its other columns are carried
    along. A document that does not parse or has arrays of unequal length goes whole to the
    quarantine, with the reason, and yields no rows. Of one with times that are none the other
    hours are rows; it is in the quarantine too, with these times in ``bad_times``.
    """
    fields = dict(fields or HOURLY_FIELDS)
    carried = [c for c in raw.columns if c != payload]
    # Parsed in a generator, so that a filter on the outcome stays above it: as a projection it
    # would be moved below and parse the document again for every field it looks at.
    parsed = raw.withColumn(
        "_doc", F.explode(F.array(F.from_json(payload, payload_schema(fields))))
    )
    length = F.size("_doc.hourly.time")
    unequal = reduce(
        lambda a, b: a | b,
        [~F.size(f"_doc.hourly.{name}").eqNullSafe(length) for name in fields],
    )
    reason = (
        F.when(F.col("_doc.hourly.time").isNull(), "unreadable")
        .when(unequal, "unequal_lengths")
        .when(F.exists("_doc.hourly.time", lambda t: _stamp(t).isNull()), "bad_time")
    )
    judged = parsed.withColumn("reason", reason)
    bad_times = F.when(
        F.col("reason") == "bad_time", F.filter("_doc.hourly.time", lambda t: _stamp(t).isNull())
    )

    arrays = F.arrays_zip(
        F.col("_doc.hourly.time").alias("time"),
        *[F.col(f"_doc.hourly.{source}").alias(source) for source in fields],
    )
    rows = (
        judged.filter(F.col("reason").isNull() | (F.col("reason") == "bad_time"))
        .select(*carried, F.inline(arrays))
        .withColumn(ts, _stamp(F.col("time")))
        .filter(F.col(ts).isNotNull())
        .select(*carried, ts, *[F.col(source).alias(out) for source, out in fields.items()])
    )
    quarantine = judged.filter(F.col("reason").isNotNull()).select(
        *carried, payload, "reason", bad_times.alias("bad_times")
    )
    return rows, quarantine


def tag_location(df: DataFrame, dim: DataFrame, on) -> DataFrame:
    """Attach the dimension's columns to each row by equality on ``on``; keeps every row."""
    return lookup(df, dim, [on] if isinstance(on, str) else list(on))
