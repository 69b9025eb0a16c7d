"""CSV and Parquet tables."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.schemas import EVENTS, OBSERVATIONS

# Hour stamps as the archive writes them, with seconds and micros where there are any.
READ_STAMP = "yyyy-MM-dd'T'HH:mm[:ss][.SSSSSS]"
WRITE_STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
CORRUPT = "_corrupt_record"


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Scan CSV files with a header; a row that does not fit keeps its text in ``_corrupt_record``."""
    with_corrupt = T.StructType(list(schema) + [T.StructField(CORRUPT, T.StringType())])
    return (
        spark.read.schema(with_corrupt)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("timestampNTZFormat", READ_STAMP)
        .csv(path)
    )


def quarantine(rows: DataFrame, required=()):
    """Split the rows of ``read_csv`` into good ones and a quarantine table with a ``reason``.

    ``unreadable``: the line does not fit the schema; ``missing``: a ``required`` column is null.
    """
    # The scan parses only columns that are asked for, and finds only their damage. The second
    # condition never holds, but asks for all of them.
    every = F.xxhash64(*(c for c in rows.columns if c != CORRUPT)) % 2 == 2
    reason = F.when(F.col(CORRUPT).isNotNull() | every, "unreadable")
    for column in required:
        reason = reason.when(F.col(column).isNull(), "missing")
    judged = rows.withColumn("reason", reason)
    good = judged.filter(F.col("reason").isNull()).drop("reason", CORRUPT)
    return good, judged.filter(F.col("reason").isNotNull())


def read_observations(spark: SparkSession, path: str, schema=OBSERVATIONS, ts="datetime"):
    """Scan observation CSV files, with a location column or, by ``schema``, without one.

    Returns the good rows and a quarantine table: a line that does not fit the schema, or has
    no time, has no place in a window.
    """
    return quarantine(read_csv(spark, path, schema), [ts])


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Scan event-interval CSV files. Surplus fields of a line are cut off, the row is kept."""
    return read_csv(spark, path, EVENTS)


def _files(spark: SparkSession, path: str):
    """The file system of ``path``, its path there, and the place its old table is kept at in a swap."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return files, place, _beside(spark, place, "old")


def _beside(spark, place, word):
    # Names that begin with a dot are no part of a table to Spark.
    return spark._jvm.org.apache.hadoop.fs.Path(place.getParent(), f".{place.getName()}.{word}")


def _rename(files, source, target):
    if not files.rename(source, target):
        raise OSError(f"cannot rename {source} to {target}")


def _swap(files, made, place, old):
    """Put ``made`` in the place of what is there, which stays at ``old`` until that is done."""
    files.delete(old, True)
    if files.exists(place):
        _rename(files, place, old)
    _rename(files, made, place)
    files.delete(old, True)


def _restore(files, place, old):
    """Put the old table back where a swap ended half way."""
    if files.exists(old) and not files.exists(place):
        _rename(files, old, place)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet table at ``path``; partitions that a filter rules out are not read."""
    files, place, old = _files(spark, path)
    _restore(files, place, old)
    return spark.read.parquet(path)


def _written_beside(df, path, columns):
    """Write ``df`` beside ``path``; gives the file system, the new folder and the places of the table."""
    spark = df.sparkSession
    files, place, old = _files(spark, path)
    _restore(files, place, old)
    made = _beside(spark, place, f"new-{uuid.uuid4().hex}")
    writer = df.hint("rebalance", *columns).write.partitionBy(*columns) if columns else df.write
    try:
        writer.parquet(made.toString())
    except BaseException:
        files.delete(made, True)
        raise
    return files, made, place, old


def _listed(columns):
    return [columns] if isinstance(columns, str) else list(columns or ())


def write_table(df: DataFrame, path: str, partition_by=None) -> None:
    """Replace the Parquet table at ``path``; ``df`` may read that table itself.

    The rows are written beside it and swapped in by renames once all are there: a job that fails
    leaves the old table, and one that ends between the renames has it put back by the next read
    or write here. For file systems that rename folders, as HDFS does.

    With ``partition_by`` the rows are rebalanced on those columns first: small partitions
    are joined and a hot one is split over several tasks and files, by size.
    """
    files, made, place, old = _written_beside(df, path, _listed(partition_by))
    _swap(files, made, place, old)


def replace_partitions(df: DataFrame, path: str, partition_by) -> None:
    """Replace those partitions of the table at ``path`` that ``df`` has rows of; the others stay.

    As ``write_table``, a partition at a time once all rows are written: a job that fails while
    it writes changes nothing. A table that is not there yet is made.
    """
    columns = _listed(partition_by)
    files, made, place, _ = _written_beside(df, path, columns)
    new = df.sparkSession._jvm.org.apache.hadoop.fs.Path
    level = [""]
    for _ in columns:
        level = [
            f"{at}/{f.getPath().getName()}"
            for at in level
            for f in files.listStatus(new(made.toString() + at))
            if f.isDirectory()
        ]
    for at in level:
        target = new(place.toString() + at)
        files.mkdirs(target.getParent())
        _swap(files, new(made.toString() + at), target, _beside(df.sparkSession, target, "old"))
    files.delete(made, True)


def write_csv(df: DataFrame, path: str) -> None:
    """Replace the CSV table at ``path``, with a header and stamps to the microsecond."""
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("timestampNTZFormat", WRITE_STAMP)
        .csv(path)
    )
