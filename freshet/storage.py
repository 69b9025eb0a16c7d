"""Where intermediate tables live: the shared folder named by ``spark.checkpoint.dir``."""

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_scope = ContextVar("stored tables of the scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can read.

    Taken from the session's setting, or from the folder its context was given. Only a local
    session that names none gets a temporary folder; on a cluster a missing setting is an error,
    since a machine-local folder would be lost with its machine. A ``file:`` path is taken as
    named: on a cluster it must be a file system mounted everywhere.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="freshet-"))
    return context.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    """A path not used before, under the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _scope.get() is not None:
        _scope.get().append(path)
    return path


@contextmanager
def scratch(spark: SparkSession):
    """Delete, at the end of the block, the tables and files that were stored inside it.

    Results that read them must be written elsewhere, or collected, before the block ends.
    """
    token = _scope.set([])
    try:
        yield
    finally:
        paths = _scope.get()
        _scope.reset(token)
        for path in paths:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    For large results read more than once: later scans prune columns and push filters down.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def materialize(df: DataFrame) -> DataFrame:
    """Compute the small table ``df`` once and keep it where lost executors do not matter."""
    spark = df.sparkSession
    directory = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(directory)
    return df.checkpoint(eager=True)
